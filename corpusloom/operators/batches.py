"""Operators over numbered rows: batches, packing, splits and samples."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.ordering import rank_in_group, running_sum
from corpusloom.session import saved

PACK_BATCH = 1000  # rows that are packed together


def with_batch(df: DataFrame, order: list[str], size: int, buckets: int | None = None) -> DataFrame:
    """Consecutive rows in batches of `size`, numbered from 0."""
    ranked = rank_in_group(df, [], order, "_row", buckets)
    return ranked.withColumn("batch", F.expr(f"(_row - 1) div {size}")).drop("_row")


def mismatched(df: DataFrame, order: list[str], column: str, out: str, size: int, mode: str = "rotate", buckets: int | None = None) -> DataFrame:
    """Pair every row with another row's `column` of its batch: the one before
    it, with the first taking the last ("rotate"), or the mirrored one ("reverse").
    Rows meet their partners in a join on (batch, place), so no batch is gathered."""
    if mode not in ("rotate", "reverse"):
        raise ValueError(f"unknown mode: {mode}")
    placed = rank_in_group(df, [], order, "_row", buckets)
    placed = saved(placed.withColumns({"batch": F.expr(f"(_row - 1) div {size}"), "_place": F.expr(f"(_row - 1) % {size}")}).drop("_row"))
    # only the last batch can be short
    rows = F.least(F.lit(size), placed.agg(F.count(F.lit(1))).scalar() - F.col("batch") * size)
    partner = rows - 1 - F.col("_place") if mode == "reverse" else (F.col("_place") + rows - 1) % rows
    others = placed.select(F.col("batch").alias("_b"), F.col("_place").alias("_p"), F.col(column).alias(out))
    asked = placed.withColumn("_partner", partner).drop(*({out} & set(df.columns)))
    joined = asked.join(others, (F.col("batch") == F.col("_b")) & (F.col("_partner") == F.col("_p")))
    return joined.drop("_b", "_p", "_place", "_partner")


def zip_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables of the same rows side by side, by a stable key."""
    return left.join(right, key)


def packed_wrapped(df: DataFrame, order: list[str], tokens: str, length: int, buckets: int | None = None) -> DataFrame:
    """All tokens in a row, cut every `length`: (sequence, input_ids). Each row
    is cut where a sequence ends, so a sequence gathers at most `length` tokens."""
    sized = df.withColumn("_size", F.size(tokens)).filter(F.col("_size") > 0)
    placed = running_sum(sized, [], order, F.col("_size"), "_from", buckets)
    sequences = F.sequence(F.expr(f"_from div {length}"), F.expr(f"(_from + _size - 1) div {length}"))
    parts = placed.select(F.col(tokens).alias("_t"), "_from", F.explode(sequences).alias("sequence"))
    start = F.greatest(F.col("sequence") * length - F.col("_from"), F.lit(0))
    stop = (F.col("sequence") + 1) * length - F.col("_from")
    parts = parts.select(
        "sequence", F.col("_from"), F.slice("_t", (start + 1).cast("int"), (stop - start).cast("int")).alias("_p")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_from", "_p")))
    return parts.groupBy("sequence").agg(F.flatten(F.transform(ordered, lambda x: x["_p"])).alias("input_ids"))


def best_fit(lengths: list[int], room: int) -> list[int]:
    """Bin of each item: longest items first, each into the fullest bin that
    still takes it, else into a new one."""
    free: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins = [0] * len(lengths)
    count = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(free, (lengths[i], -1))
        left, b = free.pop(at) if at < len(free) else (room, count)
        count += b == count
        bins[i] = b
        if left - lengths[i]:
            bisect.insort(free, (left - lengths[i], b))
    return bins


def packed_best_fit(df: DataFrame, key: str, tokens: str, length: int, batch: int = PACK_BATCH, buckets: int | None = None) -> DataFrame:
    """Best-fit-decreasing packing within batches of `batch` pieces. Rows longer than
    `length` are cut into pieces of that many tokens, and every token lies in one piece.
    Only keys and lengths visit Python."""
    numbers = F.sequence(F.lit(0), F.expr(f"(_size - 1) div {length}").cast("int"))
    sized = df.select(key, F.col(tokens).alias("_t"), F.size(tokens).alias("_size")).filter(F.col("_size") > 0)
    cut = sized.select(key, "_t", F.explode(numbers).alias("_piece"))
    cut = cut.select(key, "_piece", F.slice("_t", F.col("_piece") * length + 1, F.lit(length)).alias("_t"))
    sizes = with_batch(cut.select(key, "_piece", F.size("_t").alias("_size")), [key, "_piece"], batch, buckets)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "_piece"])
        return pdf[[key, "_piece", "batch", "_size"]].assign(bin=best_fit(pdf["_size"].tolist(), length))

    kind = df.schema[key].dataType.simpleString()
    bins = sizes.groupBy("batch").applyInPandas(place, f"`{key}` {kind}, _piece int, batch long, _size int, bin long")
    # at most `length` tokens per bin; longest first, as they were placed
    placed = F.struct((-F.col("_size")).alias("n"), F.col(key).alias("k"), F.col("_piece").alias("p"), F.col("_t").alias("t"))
    ordered = F.sort_array(F.collect_list(placed))
    return (
        bins.join(cut, [key, "_piece"])
        .groupBy("batch", "bin")
        .agg(
            F.flatten(F.transform(ordered, lambda x: x["t"])).alias("input_ids"),
            F.transform(ordered, lambda x: -x["n"]).alias("lengths"),
        )
    )


def _hash(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def split(df: DataFrame, key: str, test_percent: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows on every run."""
    part = split_part(F.col(key), test_percent, seed)
    return df.filter(part == "train"), df.filter(part == "test")


def split_part(key: Column, test_percent: int = 10, seed: int = 0) -> Column:
    number = F.conv(F.substring(_hash(seed, key), 1, 7), 16, 10).cast("long")
    return F.when(number % 100 < test_percent, "test").otherwise("train")


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k different rows, chosen by a hash of the key (a top-k, no full sort)."""
    return df.orderBy(_hash(seed, F.col(key)), key).limit(k)


def sample_with_repeats(df: DataFrame, key: str, n: int = 512, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """n draws (the number of rows if that is smaller) with replacement. `draw`
    numbers them. Keys are unique.

    Rows are counted by hash bucket, which says how many draws fall into which bucket and on
    which place in it; only rows of buckets with a draw are ranked, each bucket on its own,
    and nothing is sorted as a whole."""
    spark = df.sparkSession
    number = lambda text, digits: F.conv(F.substring(text, 1, digits), 16, 10).cast("long")
    keys = df.select(key, _hash(seed, F.col(key)).alias("_h")).withColumn("_bucket", number(F.col("_h"), 15) % buckets)
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most `buckets` rows
    spans = counts.withColumn("_to", F.sum("_n").over(ahead))
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    draws = spark.range(1, n + 1).select(F.col("id").alias("draw"), rows.alias("_rows")).filter(F.col("draw") <= F.col("_rows"))
    draws = draws.select("draw", (number(_hash(seed, F.col("draw")), 15) % F.col("_rows")).alias("_at"))
    # at most n rows and `buckets` rows
    hit = (F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_n"))
    drawn = draws.join(F.broadcast(spans), hit).select("draw", F.col("_bucket").alias("_b"), (F.col("_at") - F.col("_to") + F.col("_n") + 1).alias("_place"))
    near = keys.join(F.broadcast(drawn.select(F.col("_b").alias("_bucket")).distinct()), "_bucket", "left_semi")
    places = near.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))).withColumnRenamed("_place", "_rank")
    chosen = places.join(F.broadcast(drawn), (F.col("_bucket") == F.col("_b")) & (F.col("_rank") == F.col("_place")))
    return df.join(F.broadcast(chosen.select(key, "draw")), key)


def repeated(df: DataFrame, key: str, times: int, seed: int | None = None) -> DataFrame:
    """Every row `times` times, numbered by `copy`; with a seed in shuffled
    order of `_order`, copies of a row side by side."""
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))
    return out if seed is None else out.withColumn("shuffle_key", _hash(seed, F.col(key)))
