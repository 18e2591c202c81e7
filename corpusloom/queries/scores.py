"""Scores of completions: events are completions (user = prompt), conversations
give lengths and completion pairs, labels give wanted and unwanted rows."""

from pyspark.sql import functions as F

from corpusloom.operators import preferences, scoring
from corpusloom.queries import query
from corpusloom.queries.conversations import messages, _QA, M, qa_pairs
from corpusloom.session import saved, table


def completions(spark, d):
    """Events as scored completions. The first score is missing for errors, the
    second for views, and neither is there for sign-ups."""
    e = table(spark, d, "events")
    first = F.when(~F.col("event_type").isin("error", "signup"), F.col("value"))
    second = F.when(~F.col("event_type").isin("view", "signup"), F.get_json_object("props", "$.k").cast("double"))
    return e.select(
        F.col("user_id").alias("prompt_id"),
        F.col("event_id").alias("completion_id"),
        F.array(first, second).alias("scores"),
        (F.col("event_type") != "error").alias("terminated"),
    )


_C = """c AS (SELECT user_id AS prompt_id, event_id AS completion_id,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS s1,
    CASE WHEN event_type NOT IN ('view', 'signup') THEN json_extract_string(props, '$.k')::DOUBLE END AS s2,
    event_type <> 'error' AS terminated FROM events)"""
_W = f"{_C}, w AS (SELECT *, coalesce(s1 * 1.0::DOUBLE, 0) + coalesce(s2 * 0.5::DOUBLE, 0) AS score FROM c)"


def weighted(spark, d):
    return completions(spark, d).withColumn("score", scoring.weighted_score(F.col("scores"), [1.0, 0.5]))


def _rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _brevity(prompts, completions, **rest):
    """Short answers are better; none at all for answers without a full stop."""
    return [1000.0 / (1 + len(c)) if "." in c else None for c in completions]


def _echo(prompts, completions, turn, **rest):
    return [float(len(p)) / 100 + t for p, t in zip(prompts, turn)]


@query(
    "scorer_functions",
    f"""WITH {M}, {_QA} SELECT session_id, turn, round(CASE WHEN contains(answer, '.') THEN 1000.0::DOUBLE / (1 + length(answer)) END, 6) AS brevity,
    round(length(question)::DOUBLE / 100 + turn, 6) AS echo FROM qa""",
)
def scorer_functions(spark, d):
    rows = qa_pairs(spark, d).withColumnsRenamed({"question": "prompt", "answer": "completion"})
    out = scoring.scored_by(rows, [_brevity, _echo])
    return out.select("session_id", "turn", F.round(F.get("scores", F.lit(0)), 6).alias("brevity"), F.round(F.get("scores", F.lit(1)), 6).alias("echo"))


@query(
    "weighted_scores",
    f"WITH {_W} SELECT completion_id, round(score, 6) AS score, round(greatest(least(score, 60.0::DOUBLE), 5.0::DOUBLE), 6) AS clipped FROM w",
)
def weighted_scores(spark, d):
    scores = F.col("scores")
    return completions(spark, d).select(
        "completion_id",
        F.round(scoring.weighted_score(scores, [1.0, 0.5]), 6).alias("score"),
        F.round(scoring.weighted_score(scores, [1.0, 0.5], (5, 60)), 6).alias("clipped"),
    )


@query("unscored_completions", f"WITH {_C} SELECT completion_id FROM c WHERE s1 IS NULL AND s2 IS NULL")
def unscored_completions(spark, d):
    return completions(spark, d).filter(scoring.unscored(F.col("scores"))).select("completion_id")


@query(
    "unterminated_penalty",
    f"WITH {_W} SELECT completion_id, round(CASE WHEN NOT terminated THEN score - 1.5::DOUBLE ELSE score END, 6) AS score FROM w",
)
def unterminated_penalty(spark, d):
    score = scoring.unterminated_penalty(F.col("score"), F.col("terminated"), 1.5)
    return weighted(spark, d).select("completion_id", F.round(score, 6).alias("score"))


@query("terminated_completions", f"WITH {_C} SELECT completion_id FROM c WHERE terminated")
def terminated_completions(spark, d):
    return scoring.terminated_only(completions(spark, d)).select("completion_id")


def _advantage(name: str, expression: str, run, digits: int = 6):
    sql = f"WITH {_W} SELECT completion_id, round({expression}, {digits}) AS advantage FROM w"

    def rows(spark, d):
        return _rounded(run(weighted(spark, d)).select("completion_id", "advantage"), "advantage", digits=digits)

    query(name, sql)(rows)


_MEAN = "avg(score) OVER (PARTITION BY prompt_id)"
_STD = "stddev_samp(score) OVER (PARTITION BY prompt_id)"
_advantage("group_advantage", f"(score - {_MEAN}) / ({_STD} + 1e-4)", lambda w: scoring.group_advantage(w, "prompt_id", "score"))
_advantage(
    "group_advantage_whole", f"(score - {_MEAN}) / (stddev_samp(score) OVER () + 1e-4)",
    lambda w: scoring.group_advantage(w, "prompt_id", "score", "batch"),
)
_advantage("group_advantage_unscaled", f"score - {_MEAN}", lambda w: scoring.group_advantage(w, "prompt_id", "score", "none"), 9)
_SUM, _N = "sum(score) OVER (PARTITION BY prompt_id)", "count(*) OVER (PARTITION BY prompt_id)"
_LOO = f"CASE WHEN {_N} > 1 THEN score - ({_SUM} - score) / ({_N} - 1) END"
_advantage("leave_one_out", _LOO, lambda w: scoring.leave_one_out(w, "prompt_id", "score"), 9)
_advantage("score_z", "(score - avg(score) OVER ()) / (stddev_pop(score) OVER () + 1e-8)", lambda w: scoring.global_z(w, "score"))
_advantage(
    "prompt_z",
    f"""CASE WHEN {_N} < 40 THEN (score - avg(score) OVER ()) / (stddev_pop(score) OVER () + 1e-6)
    ELSE (score - {_MEAN}) / (stddev_pop(score) OVER (PARTITION BY prompt_id) + 1e-6) END""",
    lambda w: scoring.prompt_z(w, "prompt_id", "score", 40),
)


_BUFFER = "(PARTITION BY prompt_id ORDER BY batch, completion_id ROWS 15 PRECEDING)"


@query(
    "rolling_prompt_z",
    f"""WITH {_W}, b AS (SELECT prompt_id, completion_id, completion_id // 2000 AS batch, CASE WHEN completion_id % 9 <> 0 THEN score END AS score FROM w),
    r AS (SELECT prompt_id, batch, completion_id, count(*) OVER o AS n, avg(score) OVER o AS m, stddev_pop(score) OVER o AS d
        FROM b WHERE score IS NOT NULL WINDOW o AS {_BUFFER}),
    e AS (SELECT prompt_id, batch, arg_max(n, completion_id) AS n, arg_max(m, completion_id) AS m, arg_max(d, completion_id) AS d FROM r GROUP BY ALL),
    a AS (SELECT batch, avg(score) AS am, stddev_pop(score) AS ad FROM b GROUP BY batch)
    SELECT completion_id, round(CASE WHEN n < 10 THEN (score - am) / (ad + 1e-6) ELSE (score - m) / (d + 1e-6) END, 4) AS advantage
    FROM b LEFT JOIN e USING (prompt_id, batch) LEFT JOIN a USING (batch)""",
)
def rolling_prompt_z(spark, d):
    """Batches of 2,000 completions; every ninth has no score."""
    rows = weighted(spark, d).select(
        "prompt_id", "completion_id", F.expr("completion_id div 2000").alias("batch"),
        F.when(F.col("completion_id") % 9 != 0, F.col("score")).alias("score"),
    )
    out = scoring.rolling_prompt_z(rows, "prompt_id", "batch", ["completion_id"], "score", 16, 10)
    return _rounded(out.select("completion_id", "advantage"), "advantage", digits=4)


@query(
    "leave_one_out_standardised",
    f"""WITH {_W}, l AS (SELECT completion_id, {_LOO} AS a FROM w)
    SELECT completion_id, round((a - avg(a) OVER ()) / (stddev_samp(a) OVER () + 1e-4), 6) AS advantage FROM l""",
)
def leave_one_out_standardised(spark, d):
    out = scoring.leave_one_out(weighted(spark, d), "prompt_id", "score", standardise=True)
    return _rounded(out.select("completion_id", "advantage"), "advantage")


@query(
    "scorer_report",
    f"""WITH {_C} SELECT 'value' AS scorer, round(avg(s1), 6) AS mean, round(stddev_samp(s1), 6) AS std FROM c
    UNION ALL SELECT 'property', round(avg(s2), 6), round(stddev_samp(s2), 6) FROM c""",
)
def scorer_report(spark, d):
    return _rounded(scoring.scorer_report(completions(spark, d), ["value", "property"]), "mean", "std")


@query(
    "group_report",
    f"""WITH {_W}, g AS (SELECT prompt_id, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM w GROUP BY prompt_id)
    SELECT round(sum(m * n) / sum(n), 6) AS score_mean, round(sum(sd * n) / sum(n) FILTER (sd IS NOT NULL), 6) AS score_std,
    round(sum(CASE WHEN abs(sd) <= 1e-8 THEN n ELSE 0 END) / sum(n), 6) AS share_zero_std FROM g""",
)
def group_report(spark, d):
    out = scoring.group_report(weighted(spark, d), "prompt_id", "score")
    return _rounded(out, "score_mean", "score_std", "share_zero_std")


_LEN = f"{M}, n AS (SELECT session_id, turn, role, length(content) AS length, right(content, 1) = '.' AS terminated FROM messages)"


def _lengths(spark, d):
    return messages(spark, d).select(
        "session_id", "turn", "role", F.length("content").alias("length"), (F.right("content", F.lit(1)) == ".").alias("terminated")
    )


@query(
    "completion_report",
    f"""WITH {_LEN}, a AS (SELECT * FROM n WHERE role = 'assistant') SELECT round(avg(length), 6) AS mean_length, min(length) AS min_length,
    max(length) AS max_length, round(1 - count(*) FILTER (terminated) / count(*)::DOUBLE, 6) AS clipped_ratio,
    round(coalesce(avg(length) FILTER (terminated), 0), 6) AS mean_terminated_length, coalesce(min(length) FILTER (terminated), 0) AS min_terminated_length,
    coalesce(max(length) FILTER (terminated), 0) AS max_terminated_length FROM a""",
)
def completion_report(spark, d):
    out = scoring.completion_report(_lengths(spark, d).filter(F.col("role") == "assistant"))
    return _rounded(out, "mean_length", "clipped_ratio", "mean_terminated_length")


@query(
    "class_margin",
    f"""WITH {_LEN} SELECT round(avg(length) FILTER (role = 'assistant'), 6) AS chosen, round(avg(length) FILTER (role <> 'assistant'), 6) AS rejected,
    round(avg(length) FILTER (role = 'assistant') - avg(length) FILTER (role <> 'assistant'), 6) AS margin FROM n""",
)
def class_margin(spark, d):
    out = scoring.class_margin(_lengths(spark, d), F.col("role") == "assistant", "length")
    return _rounded(out, "chosen", "rejected", "margin")


@query(
    "unique_prompts",
    f"""WITH {_W} SELECT prompt_id, min(completion_id) AS completion_id FROM w GROUP BY prompt_id""",
)
def unique_prompts(spark, d):
    return scoring.unique_prompts(weighted(spark, d), "prompt_id", "completion_id").select("prompt_id", "completion_id")


# two scored completions per prompt: the first and the last event of a user and type
_TWO = f"""{_W}, t AS (SELECT e.user_id || ':' || event_type AS prompt_id, completion_id, score FROM w JOIN events e ON e.event_id = completion_id),
    ends AS (SELECT prompt_id, min(completion_id) AS a, max(completion_id) AS b FROM t GROUP BY prompt_id HAVING count(*) > 1),
    p AS (SELECT prompt_id, a, b, ta.score AS sa, tb.score AS sb FROM ends
        JOIN (SELECT completion_id, score FROM t) ta ON ta.completion_id = a JOIN (SELECT completion_id, score FROM t) tb ON tb.completion_id = b)"""


def _two(spark, d):
    types = table(spark, d, "events").select(F.col("event_id").alias("completion_id"), "event_type")
    scored = weighted(spark, d).join(types, "completion_id")
    named = scored.select(F.concat_ws(":", "prompt_id", "event_type").alias("prompt_id"), "completion_id", "score")
    ends = named.groupBy("prompt_id").agg(F.min("completion_id").alias("a"), F.max("completion_id").alias("b")).filter("a < b")
    picked = ends.select("prompt_id", F.explode(F.array("a", "b")).alias("completion_id"))
    return named.join(picked, ["prompt_id", "completion_id"], "left_semi")


@query(
    "scored_pairs",
    f"""WITH {_TWO} SELECT prompt_id, CASE WHEN sa >= sb THEN a ELSE b END AS chosen_id, CASE WHEN sa >= sb THEN b ELSE a END AS rejected_id,
    round(abs(sa - sb), 6) AS margin FROM p""",
)
def scored_pairs(spark, d):
    return _rounded(scoring.scored_pairs(_two(spark, d)), "margin")


@query(
    "judged_pairs",
    f"""WITH {_TWO} SELECT prompt_id, CASE WHEN a % 2 = 0 THEN a ELSE b END AS chosen_id, CASE WHEN a % 2 = 0 THEN b ELSE a END AS rejected_id,
    round(CASE WHEN a % 2 = 0 THEN sa - sb ELSE sb - sa END, 6) AS margin FROM p""",
)
def judged_pairs(spark, d):
    """The judge's rank is carried with the rows: here the parity of the id."""
    judged = _two(spark, d).withColumn("rank", F.col("completion_id") % 2)
    return _rounded(scoring.scored_pairs(judged, judged="rank"), "margin")


@query(
    "label_balance",
    """WITH c AS (SELECT greatest(count(*) FILTER (quality = 1), 1) AS p, count(*) AS t FROM labels), b AS (SELECT p, greatest(t - p, 1) AS n FROM c)
    SELECT p AS wanted, n AS unwanted, CASE WHEN p <> n THEN round_even(n / p::DOUBLE, 2) END AS wanted_low,
    CASE WHEN p <> n THEN round_even(n / p::DOUBLE * 1.33::DOUBLE, 2) END AS wanted_high,
    CASE WHEN p <> n THEN round_even(p / n::DOUBLE / 1.33::DOUBLE, 2) END AS unwanted_low,
    CASE WHEN p <> n THEN round_even(p / n::DOUBLE, 2) END AS unwanted_high,
    CASE WHEN p <> n THEN 1 BETWEEN round_even(n / p::DOUBLE, 2) AND round_even(n / p::DOUBLE * 1.33::DOUBLE, 2) END AS wanted_in_range,
    CASE WHEN p <> n THEN 1 BETWEEN round_even(p / n::DOUBLE / 1.33::DOUBLE, 2) AND round_even(p / n::DOUBLE, 2) END AS unwanted_in_range FROM b""",
)
def label_balance(spark, d):
    return scoring.label_balance(table(spark, d, "labels"), F.col("quality") == 1)


@query("wanted_rows", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def wanted_rows(spark, d):
    return preferences.by_label(table(spark, d, "labels"), F.col("quality") == 1)[0].select("doc_id", "toxic")


@query("unwanted_rows", "SELECT doc_id, toxic FROM labels WHERE quality <> 1")
def unwanted_rows(spark, d):
    return preferences.by_label(table(spark, d, "labels"), F.col("quality") == 1)[1].select("doc_id", "toxic")


@query("labelled_union", "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM labels")
def labelled_union(spark, d):
    good, bad = preferences.by_label(table(spark, d, "labels").select("doc_id", "quality"), F.col("quality") == 1)
    return scoring.labelled_union(good, bad).select("doc_id", "label")


@query(
    "clamped_ratios",
    f"""WITH {_C} SELECT completion_id, round(greatest(least(p / (1 - p + 1e-8), 10.0::DOUBLE), 0.5::DOUBLE), 6) AS weight
    FROM (SELECT completion_id, coalesce(s2, 0) / 100.0::DOUBLE AS p FROM c)""",
)
def clamped_ratios(spark, d):
    p = F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)) / 100
    return completions(spark, d).select("completion_id", F.round(scoring.clamped_ratio(p), 6).alias("weight"))


@query("density_weights")
def density_weights(spark, d):
    """Weights of the unwanted documents, learnt on a sample with repeats of at
    most 512 rows of each class."""
    from corpusloom.operators.batches import sample_with_repeats
    from corpusloom.operators.chunking import encode

    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    rows = saved(encode(rows, "text").drop("text"))
    good, bad = preferences.by_label(rows, F.col("label") == 1)
    drawn = [sample_with_repeats(x.drop("label"), "doc_id", 512) for x in (good, bad)]
    out = scoring.density_weights(bad, "embedding", "label", train=scoring.labelled_union(*drawn))
    return out.select("doc_id", F.round("weight", 4).alias("weight"))
