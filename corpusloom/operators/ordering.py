"""Ranks, running sums and bounded windows that survive a hot group.

A plain window puts a whole group into one task. Here rows are cut into ranges
of (group, order) instead, so a group of any size is spread over many tasks.
The range limits come from a sample of fixed size (the rows with the smallest
key hashes), so they are the same however often a task is run again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MAX_RANGES = 8192
PER_RANGE = 8  # sampled keys per range


@dataclass
class Ranges:
    """Limits of the ranges, as a constant of the plan."""

    keys: list[str]
    schema: T.StructType
    limits: list[str]  # one JSON object per limit, ascending

    def column(self) -> Column:
        """Number of limits at or below the row's key, found in two steps."""
        if not self.limits:
            return F.lit(0)
        step = max(1, int(len(self.limits) ** 0.5))
        groups = [self.limits[i : i + step] for i in range(0, len(self.limits), step)]
        firsts = self._constant(f"[{','.join(g[0] for g in groups)}]", T.ArrayType(self.schema))
        nested = "[" + ",".join(f"[{','.join(g)}]" for g in groups) + "]"
        grouped = self._constant(nested, T.ArrayType(T.ArrayType(self.schema)))
        key = F.struct(*[F.col(k) for k in self.keys])
        coarse = F.size(F.filter(firsts, lambda x: x <= key))
        fine = F.size(F.filter(F.get(grouped, coarse - 1), lambda x: x <= key))
        return F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0)

    def _constant(self, text: str, kind: T.DataType) -> Column:
        return F.from_json(F.lit(text), kind)


def key_ranges(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> Ranges:
    """Cut points of `keys` into about equal ranges. Reads only the keys, twice:
    to count them and to pick about PER_RANGE per range, which are all that
    comes to the driver. Hash limits thin the rows out in the scan."""
    spark = df.sparkSession
    keys = list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(buckets, MAX_RANGES))
    size = PER_RANGE * buckets
    cols = df.select(*keys)
    schema = T.StructType([cols.schema[k] for k in keys])
    count = cols.count()
    if count < size or buckets == 1:
        return Ranges(keys, schema, [])
    hashed = cols.withColumn("_h", F.xxhash64(*keys))
    share = min(1.0, 4.0 * size / count)
    if share < 1.0:
        hashed = hashed.filter(F.col("_h") < int(-(2**63) + share * 2**64))
    sample = hashed.orderBy("_h", *keys).limit(size)
    packed = sample.select(
        F.struct(*keys).alias("k"), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("j")
    )
    rows = [r["j"] for r in packed.orderBy("k").collect()]
    cuts = [rows[i * len(rows) // buckets] for i in range(1, buckets)] if rows else []
    return Ranges(keys, schema, list(dict.fromkeys(cuts)))


def _offsets(df: DataFrame, group: list[str], bucket: str, total: Column) -> DataFrame:
    """What lies before each range within its group. Only a group that crosses a
    limit has such rows, so there are never more rows than limits."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per_range = df.groupBy(*group, bucket).agg(total.alias("_n"))
    return per_range.select(*group, bucket, F.sum("_n").over(w).alias("_before")).filter("_before is not null")


def _renamed(df: DataFrame, group: list[str], bucket: str, *rest: str) -> tuple[DataFrame, Column]:
    """Right side of a join on (group, range) with names of its own, and the condition."""
    right = df.select(
        F.col(bucket).alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *rest
    )
    cond = F.col(bucket) == F.col("_r")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return right, cond


def _with_offset(df: DataFrame, offsets: DataFrame, group: list[str], bucket: str) -> DataFrame:
    right, cond = _renamed(offsets, group, bucket, "_before")
    # safe to broadcast: at most one row per range limit (see _offsets)
    joined = df.join(F.broadcast(right), cond, "left")
    return joined.select(*df.columns, F.coalesce("_before", F.lit(0)).alias("_before"))


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", buckets: int | None = None
) -> DataFrame:
    """1, 2, 3, ... within each group, ordered by `order` (unique in the group).
    With no group it numbers the whole table."""
    return running_sum(df, group, order, F.lit(1), out, buckets, inclusive=True)


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    buckets: int | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Sum of `value` over the rows before (or up to) each row in its group."""
    group, order = list(group), list(order)
    cut = key_ranges(df, [*group, *order], buckets)
    tagged = df.withColumn("_range", cut.column()).withColumn("_value", value.cast("long"))
    w = Window.partitionBy("_range", *group).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = tagged.withColumn(out, F.coalesce(F.sum("_value").over(w), F.lit(0)))
    if not cut.limits:
        return local.drop("_range", "_value")
    offsets = _offsets(tagged, group, "_range", F.sum("_value"))
    joined = _with_offset(local, offsets, group, "_range")
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_value", "_before")


def bounded_window(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    reach: int,
    build: Callable[[Window], dict[str, Column]],
    buckets: int | None = None,
    direction: str = "back",
) -> DataFrame:
    """Add window columns that look "back", "ahead" or "both" ways, at most
    `reach` rows within the group. Each range gets a copy of the `reach` rows
    next to it, so results do not depend on where the limits fall. `build` gets
    the window in ascending order."""
    group, order = list(group), list(order)
    cut = key_ranges(df, [*group, *order], buckets)
    tagged = df.withColumn("_range", cut.column()).withColumn("_copy", F.lit(False))
    w = Window.partitionBy("_range", *group).orderBy(*order)
    if cut.limits:
        copies = [
            _edge_copies(tagged, group, order, reach, way == "ahead")
            for way in ("back", "ahead")
            if direction in (way, "both")
        ]
        for more in copies:
            tagged = tagged.unionByName(more)
    return tagged.withColumns(build(w)).filter(~F.col("_copy")).drop("_range", "_copy")


def _edge_copies(tagged: DataFrame, group: list[str], order: list[str], reach: int, forward: bool) -> DataFrame:
    """The `reach` rows of a group next to each range of that group. Edge rows
    number at most `reach` per (group, range); groups inside one range have no
    copies at all."""
    toward = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    near = Window.partitionBy("_range", *group).orderBy(*[toward(c) for c in order])
    ranges = tagged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    by_range = Window.partitionBy(*group).orderBy("_range")
    ranges = ranges.select(
        *group,
        "_range",
        F.collect_list("_range").over(
            by_range.rowsBetween(-reach, -1) if forward else by_range.rowsBetween(1, reach)
        ).alias("_targets"),
    ).filter(F.size("_targets") > 0)
    # At most one row per limit, as in _offsets, with at most `reach` numbers each.
    # Joined first, so that only rows of groups that cross a limit go on.
    right, cond = _renamed(ranges, group, "_range", "_targets")
    edge = tagged.join(F.broadcast(right), cond).select(*tagged.columns, "_targets")
    edge = edge.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= reach)
    copies = edge.select(
        *[c for c in tagged.columns if c not in ("_range", "_copy")], F.explode("_targets").alias("_range")
    )
    closest = Window.partitionBy("_range", *group).orderBy(*[toward(c) for c in order])
    kept = copies.withColumn("_near", F.row_number().over(closest)).filter(F.col("_near") <= reach)
    return kept.drop("_near").withColumn("_copy", F.lit(True))
