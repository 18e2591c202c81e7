"""Scores of completions: combining, comparing within groups, reporting.

Group statistics come from an aggregation (combined in each task before the
shuffle) that is joined back, not from a window: a prompt that holds a third of
all rows is then no larger in the shuffle than any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.operators.ordering import bounded_window
from corpusloom.session import saved

# A scorer gets lists of prompts and completions, and the other columns as
# keyword lists; it gives one score per completion, None for no score.
Scorer = Callable[..., list[float | None]]


def scored_by(df: DataFrame, scorers: Sequence[Scorer], prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Add `scores`, one per scorer, in Arrow batches. No score is NULL."""
    schema = T.StructType([*df.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = {c: frame[c].tolist() for c in frame.columns}
            prompts, completions = lists.pop(prompt), lists.pop(completion)
            got = [scorer(prompts=prompts, completions=completions, **lists) for scorer in scorers]
            yield frame.assign(scores=[[None if x is None else float(x) for x in row] for row in zip(*got)])

    return df.mapInPandas(run, schema)


def weighted_score(scores: Column, weights: Sequence[float], clip: tuple[float, float] | None = None) -> Column:
    """Weighted sum of an array of scores; missing ones count 0."""
    factors = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(
        F.zip_with(scores, factors, lambda s, w: F.coalesce(s * w, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x
    )
    return total if clip is None else F.greatest(F.least(total, F.lit(float(clip[1]))), F.lit(float(clip[0])))


def unscored(scores: Column) -> Column:
    """True when no scorer gave a score."""
    return F.forall(scores, F.isnull)


def unterminated_penalty(score: Column, terminated: Column, penalty: float) -> Column:
    return F.when(~terminated, score - penalty).otherwise(score)


def terminated_only(df: DataFrame, terminated: str = "terminated") -> DataFrame:
    return df.filter(F.col(terminated))


def with_group_stats(df: DataFrame, group: str, aggregates: dict[str, Column]) -> DataFrame:
    """Join a group's statistics to its rows. The statistics have one row per
    group; Spark may split a hot group's rows when it joins (AQE skew join),
    because the other side is one row."""
    stats = df.groupBy(group).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(stats.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _whole(df: DataFrame, aggregates: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add statistics of the whole of `source` (default: the same rows) to every
    row, as a scalar subquery."""
    stats = (df if source is None else source).agg(F.struct(*[c.alias(n) for n, c in aggregates.items()])).scalar()
    return df.withColumn("_stats", stats).select(*df.columns, *[F.col("_stats")[n].alias(n) for n in aggregates])


def group_advantage(df: DataFrame, group: str, score: str, scale: str = "group", eps: float = 1e-4) -> DataFrame:
    """Score minus its group's mean, divided by the group's or the whole
    table's sample deviation, or not at all ("none")."""
    s = F.col(score)
    out = with_group_stats(df, group, {"_mean": F.avg(s), "_std": F.stddev_samp(s)})
    if scale == "group":
        out = out.withColumn("advantage", (s - F.col("_mean")) / (F.col("_std") + eps))
    elif scale == "batch":
        out = _whole(out, {"_all": F.stddev_samp(s)}, df)
        out = out.withColumn("advantage", (s - F.col("_mean")) / (F.col("_all") + eps)).drop("_all")
    elif scale == "none":
        out = out.withColumn("advantage", s - F.col("_mean"))
    else:
        raise ValueError(f"unknown scale: {scale}")
    return out.drop("_mean", "_std")


def leave_one_out(df: DataFrame, group: str, score: str, standardise: bool = False, eps: float = 1e-4) -> DataFrame:
    """Score minus the mean of the others in its group; NULL when alone."""
    s = F.col(score)
    out = with_group_stats(df, group, {"_sum": F.sum(s), "_n": F.count(s)})
    others = F.when(F.col("_n") > 1, (F.col("_sum") - s) / (F.col("_n") - 1))
    out = out.withColumn("advantage", s - others).drop("_sum", "_n")
    if standardise:
        out = _whole(out, {"_m": F.avg("advantage"), "_d": F.stddev_samp("advantage")})
        out = out.withColumn("advantage", (F.col("advantage") - F.col("_m")) / (F.col("_d") + eps)).drop("_m", "_d")
    return out


def global_z(df: DataFrame, score: str, eps: float = 1e-8) -> DataFrame:
    """Standard score over all rows, with the population deviation."""
    out = _whole(df, {"_m": F.avg(score), "_d": F.stddev_pop(score)})
    return out.withColumn("advantage", (F.col(score) - F.col("_m")) / (F.col("_d") + eps)).drop("_m", "_d")


def prompt_z(df: DataFrame, group: str, score: str, min_count: int = 16, eps: float = 1e-6) -> DataFrame:
    """Standard score within the prompt, or over all rows while the prompt has
    fewer than `min_count` scores."""
    s = F.col(score)
    out = with_group_stats(df, group, {"_n": F.count(s), "_m": F.avg(s), "_d": F.stddev_pop(s)})
    out = _whole(out, {"_am": F.avg(s), "_ad": F.stddev_pop(s)}, df)
    few = F.col("_n") < min_count
    mean = F.when(few, F.col("_am")).otherwise(F.col("_m"))
    deviation = F.when(few, F.col("_ad")).otherwise(F.col("_d")) + eps
    return out.withColumn("advantage", (s - mean) / deviation).drop("_n", "_m", "_d", "_am", "_ad")


def rolling_prompt_z(
    df: DataFrame, group: str, batch: str, order: Sequence[str], score: str, buffer: int = 16, min_count: int = 16,
    eps: float = 1e-6, buckets: int | None = None,
) -> DataFrame:
    """Standard score within the prompt's last `buffer` scores up to the end of the row's
    batch; over the batch while the buffer holds fewer than `min_count`. `batch` and `order`
    (unique in a prompt's batch) say what came when. A missing score has no standard score
    and takes no place in the buffer. A prompt of any size is cut into ranges that get copies
    of `buffer` - 1 rows from the one before."""
    known = df.filter(F.col(score).isNotNull()).select(group, batch, *order, score)
    known = saved(known)  # cut into ranges and read again

    def moments(w):
        w = w.rowsBetween(-(buffer - 1), 0)
        return {"_n": F.count(score).over(w), "_m": F.avg(score).over(w), "_d": F.stddev_pop(score).over(w)}

    rolled = bounded_window(known, [group], [batch, *order], buffer - 1, moments, buckets)
    # a row per prompt and batch: the buffer as the batch leaves it
    ends = rolled.groupBy(F.col(group).alias("_g"), F.col(batch).alias("_b")).agg(
        F.max_by(F.struct("_n", "_m", "_d"), F.struct(*order)).alias("_buffer")
    )
    whole = known.groupBy(F.col(batch).alias("_wb")).agg(F.avg(score).alias("_am"), F.stddev_pop(score).alias("_ad"))
    out = df.join(ends, F.col(group).eqNullSafe(F.col("_g")) & F.col(batch).eqNullSafe(F.col("_b")), "left")
    out = out.join(whole, F.col(batch).eqNullSafe(F.col("_wb")), "left")
    few = F.col("_buffer._n") < min_count
    mean = F.when(few, F.col("_am")).otherwise(F.col("_buffer._m"))
    deviation = F.when(few, F.col("_ad")).otherwise(F.col("_buffer._d")) + eps
    return out.withColumn("advantage", (F.col(score) - mean) / deviation).drop("_g", "_b", "_buffer", "_wb", "_am", "_ad")


def completion_report(df: DataFrame, length: str = "length", terminated: str = "terminated") -> DataFrame:
    n, size, done = F.count(F.lit(1)), F.col(length), F.col(terminated)
    ended = F.when(done, size)
    return df.agg(
        F.avg(size).alias("mean_length"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        (1 - F.count_if(done) / n).alias("clipped_ratio"),
        F.coalesce(F.avg(ended), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(ended), F.lit(0)).alias("min_terminated_length"),
        F.coalesce(F.max(ended), F.lit(0)).alias("max_terminated_length"),
    )


def scorer_report(df: DataFrame, names: Sequence[str], scores: str = "scores") -> DataFrame:
    """Mean and deviation per scorer over the scores there are."""
    labels = F.array(*[F.lit(n) for n in names])
    flat = df.select(F.posexplode(scores).alias("_i", "score")).withColumn("scorer", F.get(labels, F.col("_i")))
    return flat.groupBy("scorer").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def group_report(df: DataFrame, group: str, score: str) -> DataFrame:
    """Mean of group means, mean group deviation, share of groups without any
    spread. Rows count, as each carries its group's values."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("m"), F.stddev_samp(score).alias("d"))
    known = F.when(F.col("d").isNotNull(), F.col("n"))
    return g.agg(
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("score_mean"),
        (F.sum(F.col("d") * F.col("n")) / F.sum(known)).alias("score_std"),
        (F.sum(F.when(F.abs("d") <= 1e-8, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_zero_std"),
    )


def class_margin(df: DataFrame, label: Column, value: str) -> DataFrame:
    """Mean value of wanted and unwanted rows and the margin between them."""
    v = F.col(value)
    good, bad = F.avg(F.when(label, v)), F.avg(F.when(~label, v))
    return df.agg(good.alias("chosen"), bad.alias("rejected"), (good - bad).alias("margin"))


def unique_prompts(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key; rows without an order come first. An aggregation, so repeats
    of a hot key are dropped in each task before the shuffle."""
    place = F.struct(F.col(order).isNotNull(), order)  # a struct is never NULL, so no row is passed over
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), place).alias("_first"))
    return first.select("_first.*")


def scored_pairs(df: DataFrame, prompt: str = "prompt_id", completion: str = "completion_id", score: str = "score", judged: str | None = None) -> DataFrame:
    """Two scored completions per prompt -> chosen and rejected: the first wins
    when its score is at least the other's, or when the judge ranks it 0."""
    row = F.struct(completion, score, *([judged] if judged else []))
    two = df.groupBy(prompt).agg(
        F.min_by(row, F.col(completion)).alias("a"), F.max_by(row, F.col(completion)).alias("b"), F.count(F.lit(1)).alias("_n")
    ).filter("_n = 2")
    first = F.col(f"a.{judged}") == 0 if judged else F.col(f"a.{score}") >= F.col(f"b.{score}")
    chosen, rejected = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    return two.select(
        prompt,
        chosen[completion].alias("chosen_id"),
        rejected[completion].alias("rejected_id"),
        (chosen[score] - rejected[score]).alias("margin"),
    )


def label_balance(df: DataFrame, label: Column, wanted_weight: float = 1.0, unwanted_weight: float = 1.0) -> DataFrame:
    """Weight ranges that balance wanted and unwanted rows; NULL when there are
    as many of one as of the other."""
    pos = F.greatest(F.count_if(label), F.lit(1))
    neg = F.greatest(F.count(F.lit(1)) - pos, F.lit(1))
    counts = df.agg(pos.alias("wanted"), neg.alias("unwanted"))
    p, n = F.col("wanted"), F.col("unwanted")
    differ = p != n
    low_w = F.bround(n * unwanted_weight / p, 2)
    high_w = F.bround(n * unwanted_weight / p * 1.33, 2)
    low_u = F.bround(p * wanted_weight / n / 1.33, 2)
    high_u = F.bround(p * wanted_weight / n, 2)
    named = {"wanted_low": low_w, "wanted_high": high_w, "unwanted_low": low_u, "unwanted_high": high_u}
    return counts.select(
        "wanted",
        "unwanted",
        *[F.when(differ, c).alias(name) for name, c in named.items()],
        F.when(differ, F.lit(wanted_weight).between(low_w, high_w)).alias("wanted_in_range"),
        F.when(differ, F.lit(unwanted_weight).between(low_u, high_u)).alias("unwanted_in_range"),
    )


def labelled_union(wanted: DataFrame, unwanted: DataFrame) -> DataFrame:
    return wanted.withColumn("label", F.lit(1)).unionByName(unwanted.withColumn("label", F.lit(0)))


def clamped_ratio(p: Column, low: float = 0.5, high: float = 10.0) -> Column:
    """p / (1 - p), kept within limits."""
    return F.greatest(F.least(p / (1 - p + 1e-8), F.lit(high)), F.lit(low))


def density_weights(df: DataFrame, vector: str, label: str, low: float = 0.5, high: float = 10.0, train: DataFrame | None = None) -> DataFrame:
    """Weight of a row: how much more likely it is wanted than not, by a
    logistic regression with balanced classes. `train` (default: all rows)
    holds the rows to learn from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    learn = df if train is None else train
    wanted = F.col(label) == 1
    sizes = learn.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(wanted).alias("w"))).first()[0]
    balanced = learn.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.when(wanted, sizes["n"] / (2 * max(sizes["w"], 1)))
        .otherwise(sizes["n"] / (2 * max(sizes["n"] - sizes["w"], 1)))
        .alias("weight"),
    )
    # a unit L2 penalty against the summed loss, as classifiers are fitted by default
    fit = LogisticRegression(weightCol="weight", regParam=1.0 / max(sizes["n"], 1), standardization=False, maxIter=100)
    model = fit.fit(balanced)
    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    p = F.get(vector_to_array("probability"), F.lit(1))
    return scored.withColumn("weight", clamped_ratio(p, low, high)).drop("features", "rawPrediction", "probability", "prediction")
