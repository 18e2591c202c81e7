"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.shared import stored


def components(links: DataFrame, a: str, b: str, folder: str, name: str = "cc", rounds: int | None = None) -> DataFrame:
    """(node, component) of every node in the links `a`, `b`; component is the
    smallest node reachable. Links with a null end and loops are ignored. With `rounds`
    it stops early: nodes of one component are connected still, but not all that are
    connected need be of one component.

    Large-star and small-star steps in turn (Kiveris and others, 2014): each step
    ties a node's neighbours to the smallest node around it, until nothing
    changes. Minima are pre-aggregated before they move, so a node with any
    number of links is one row in the group step, and the joins are plain
    equi-joins that adaptive execution can split. No more links than given exist
    after any step. Nothing but two numbers reaches the driver."""
    low, high = F.least(a, b), F.greatest(a, b)
    edges = links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    edges = stored(edges, folder, f"{name}-0")
    state, step = _state(edges), 0
    while state[0] and step != rounds:
        step += 1
        edges = stored(_small_star(_large_star(edges)), folder, f"{name}-{step}")
        new = _state(edges)
        if new == state:
            break
        state = new
    # at the end every node has one link, to the smallest of its component
    labels = edges.select("u", "v").union(edges.select("v", "v"))
    return labels.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    # decimal, as a sum of hashes may leave the range of a long
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    rest = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(rest).distinct()
