"""Token arrays, preference rows, packing, samples and scores on small tables."""

import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import tokens as T
from corpusloom.operators import batches, preferences, scoring


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_cutting(spark):
    for n in (0, 1, 3, 4, 9):
        a = [1, 2, 3]
        df = spark.createDataFrame([(a,), ([],)], "a array<int>")
        got = df.select(T.keep_last(F.col("a"), n).alias("l"), T.keep_first(F.col("a"), n).alias("f")).collect()
        assert [got[0].l, got[0].f, got[1].l, got[1].f] == [a[-n:] if n else [], a[:n], [], []]
    with pytest.raises(ValueError):
        T.truncate(F.col("a"), 1, "middle")


def test_marks(spark):
    for a in ([], [7], [1, 2], [2, 7]):
        begin = one(spark, T.with_begin(F.col("a"), 1), (a,), "a array<int>")
        end = one(spark, T.with_end(F.col("a"), 7), (a,), "a array<int>")
        assert begin == (a if a[:1] == [1] else [1] + a) and end == (a if a[-1:] == [7] else a + [7])


def test_tokenize(spark):
    df = spark.createDataFrame([("a b  c",), (None,)], "text string")
    lengths = lambda texts: [[len(w) for w in t.split()] for t in texts]
    got = [r.input_ids for r in T.tokenize(df, "text", tokenizer=lengths, limit=2).collect()]
    assert got == [[1, 1], []]
    ready = df.withColumn("labels", F.lit(1))
    assert T.tokenize(ready, "text").columns == ready.columns


def test_step_rows(spark):
    """Shape of a worked example: the label sits on each step's last token."""
    args = dict(separator=F.array(F.lit(198).cast("long")))
    schema = "p array<bigint>, s array<array<bigint>>, l array<boolean>"
    row = ([9, 9], [[1, 2, 3], [4]], [True, False])

    def run(**kw):
        c = T.step_rows(F.col("p"), F.col("s"), F.col("l"), **args, **kw)
        r = one(spark, c, row, schema)
        return r.input_ids, r.labels

    assert run() == ([9, 9, 1, 2, 3, 198, 4, 198], [-100, -100, -100, -100, -100, 1, -100, 0])
    assert run(last_only=True)[1] == [-100] * 7 + [0]
    assert run(begin=5, max_prompt=1, max_completion=5, max_length=4) == ([9, 1, 2, 3], [-100] * 4)


def test_extract_prompt(spark):
    rows = [("the sky is blue", "the sky is green"), ("abc", "abd"), ("ab", "abc"), ("same", "same"), ("x", "y"), ("", "y"), ("a  b", "a  c")]
    got = preferences.extract_prompt(spark.createDataFrame(rows, "chosen string, rejected string")).collect()
    want = [("the sky is", " blue", " green"), ("ab", "c", "d"), ("a", "b", "bc"), ("sam", "e", "e"), ("", "x", "y"), ("", "", "y"), ("a ", " b", " c")]
    assert [(r.prompt, r.chosen, r.rejected) for r in got] == want
    kept = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert preferences.extract_prompt(kept).columns == kept.columns


def test_extract_prompt_messages(spark):
    m = lambda *t: [("user", x) for x in t]
    schema = "a array<struct<role:string,content:string>>, b array<struct<role:string,content:string>>"
    r = one(spark, preferences.extract_prompt_messages(F.col("a"), F.col("b")), (m("1", "2", "x"), m("1", "2", "y", "z")), schema)
    assert [len(r.prompt), len(r.chosen), len(r.rejected)] == [2, 1, 2]


def test_truncated_pair(spark):
    df = spark.createDataFrame([(list(range(8)), [1] * 5, [2] * 3), (list(range(4)), [1] * 3, [2] * 3), (list(range(3)), [1] * 9, [2])],
                               "prompt array<int>, chosen array<int>, rejected array<int>")
    got = [(r.prompt, len(r.chosen), len(r.rejected)) for r in preferences.truncated_pair(df, 8, 3).collect()]
    assert got == [([5, 6, 7], 5, 3), ([0, 1, 2, 3], 3, 3), ([0, 1, 2], 5, 1)]
    assert preferences.truncated_pair(df, 8, 3, "keep_start").first().prompt == [0, 1, 2]


def test_prompts_agree(spark):
    cases = [([1, 2], [1, 2], True), ([1, 2], [1, 3], True), ([1, 2], [3, 4], False), ([1], [1, 2], True), ([1], [1, 2, 3], False), ([], [], True)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a array<int>, b array<int>, w boolean")
    good, aside = preferences.checked_prompts(df, "a", "b")
    assert all(r.w for r in good.collect()) and not any(r.w for r in aside.collect())
    assert good.count() + aside.count() == len(cases)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(lengths):
    bins = batches.best_fit(lengths, 20)
    load = {}
    for n, b in zip(lengths, bins):
        load[b] = load.get(b, 0) + n
    assert all(v <= 20 for v in load.values()) and sorted(load) == list(range(len(load)))
    assert len(load) <= 2 * math.ceil(sum(lengths) / 20) + 1


def test_packing_keeps_every_token(spark):
    rows = [(i, list(range(i * 100, i * 100 + (i * 7) % 23))) for i in range(60)] + [(99, list(range(5000, 5100)))]
    df = spark.createDataFrame(rows, "id long, t array<int>").repartition(4)
    wrapped = batches.packed_wrapped(df, ["id"], "t", 16, buckets=8).orderBy("sequence").collect()
    assert [x for r in wrapped for x in r.input_ids] == [x for _, t in rows for x in t]
    assert all(len(r.input_ids) == 16 for r in wrapped[:-1])
    packed = batches.packed_best_fit(df, "id", "t", 24, batch=25, buckets=8).collect()
    assert sorted(x for r in packed for x in r.input_ids) == sorted(x for _, t in rows for x in t)
    assert all(len(r.input_ids) == sum(r.lengths) <= 24 for r in packed)
    assert {r.batch for r in packed} == {0, 1, 2}


def test_mismatched(spark):
    df = spark.createDataFrame([(i, f"c{i}") for i in range(7)], "id long, c string")
    rotate = [r.o for r in batches.mismatched(df, ["id"], "c", "o", 3).orderBy("id").collect()]
    assert rotate == ["c2", "c0", "c1", "c5", "c3", "c4", "c6"]
    mirror = [r.o for r in batches.mismatched(df, ["id"], "c", "o", 3, "reverse").orderBy("id").collect()]
    assert mirror == ["c2", "c1", "c0", "c5", "c4", "c3", "c6"]


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, test = batches.split(df, "k", 10, 1)
    assert train.count() + test.count() == 1000 and 60 < test.count() < 140 and train.join(test, "k").count() == 0
    few = batches.sample_rows(df.repartition(7), "k", 10, 5)
    assert {r.k for r in few.collect()} == {r.k for r in batches.sample_rows(df, "k", 10, 5).collect()} and few.count() == 10
    draws = batches.sample_with_repeats(df, "k", 300, 2)
    got = draws.collect()
    assert len(got) == 300 and len({r.draw for r in got}) == 300 and 200 < len({r.k for r in got}) < 300
    assert batches.sample_with_repeats(df.limit(5), "k", 300).count() == 5
    assert batches.sample_with_repeats(df.limit(0), "k", 300).count() == 0


SCORES = [(1, 1, [1.0, None]), (1, 2, [2.0, 4.0]), (1, 3, [None, None]), (2, 4, [3.0, 0.0]), (3, 5, [5.0, 1.0]), (3, 6, [5.0, 1.0])]


def scored(spark):
    df = spark.createDataFrame(SCORES, "prompt_id long, completion_id long, scores array<double>")
    return df.withColumn("score", scoring.weighted_score(F.col("scores"), [1.0, 0.5]))


def by_id(df):
    return {r.completion_id: r.advantage for r in df.collect()}


def test_advantages(spark):
    df = scored(spark)
    s = {1: 1.0, 2: 4.0, 3: 0.0, 4: 3.0, 5: 5.5, 6: 5.5}
    assert {r.completion_id: r.score for r in df.collect()} == s
    groups = {1: [1, 2, 3], 2: [4], 3: [5, 6]}
    of = {c: g for g, cs in groups.items() for c in cs}
    mean = {g: statistics.mean(s[c] for c in cs) for g, cs in groups.items()}
    got = by_id(scoring.group_advantage(df, "prompt_id", "score"))
    std = statistics.stdev([1.0, 4.0, 0.0])
    assert got[4] is None and got[5] == 0 and math.isclose(got[2], (4 - mean[1]) / (std + 1e-4))
    got = by_id(scoring.group_advantage(df, "prompt_id", "score", "batch"))
    whole = statistics.stdev(s.values())
    assert all(math.isclose(got[c], (s[c] - mean[of[c]]) / (whole + 1e-4), abs_tol=1e-12) for c in s)
    got = by_id(scoring.leave_one_out(df, "prompt_id", "score"))
    assert got[4] is None and math.isclose(got[1], 1 - 2.0) and math.isclose(sum(got[c] for c in groups[1]), 0, abs_tol=1e-12)
    got = by_id(scoring.prompt_z(df, "prompt_id", "score", 3))
    assert math.isclose(got[1], (1 - mean[1]) / (statistics.pstdev([1.0, 4.0, 0.0]) + 1e-6))
    assert math.isclose(got[5], (5.5 - statistics.mean(s.values())) / (statistics.pstdev(s.values()) + 1e-6))
    report = scoring.group_report(df, "prompt_id", "score").first()
    assert math.isclose(report.score_mean, statistics.mean(s.values())) and math.isclose(report.share_zero_std, 2 / 6)
    assert [r.completion_id for r in df.filter(scoring.unscored(F.col("scores"))).collect()] == [3]


def test_completion_report_without_ends(spark):
    df = spark.createDataFrame([(3, False), (5, False)], "length int, terminated boolean")
    r = scoring.completion_report(df).first()
    assert (r.mean_length, r.clipped_ratio, r.mean_terminated_length, r.max_terminated_length) == (4.0, 1.0, 0.0, 0)


def test_scored_pairs(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 2.0, 0), (2, 3, 1.0, 0), (2, 4, 5.0, 0), (3, 5, 1.0, 0)], "prompt_id long, completion_id long, score double, rank int")
    got = {r.prompt_id: (r.chosen_id, r.rejected_id, r.margin) for r in scoring.scored_pairs(df).collect()}
    assert got == {1: (1, 2, 0.0), 2: (4, 3, 4.0)}
    got = {r.prompt_id: (r.chosen_id, r.rejected_id) for r in scoring.scored_pairs(df, judged="rank").collect()}
    assert got == {1: (2, 1), 2: (3, 4)}


def test_label_balance(spark):
    def run(pos, neg):
        df = spark.createDataFrame([(True,)] * pos + [(False,)] * neg, "y boolean")
        return scoring.label_balance(df, F.col("y")).first()

    r = run(3, 1)
    assert tuple(r)[:6] == (3, 1, 0.33, 0.44, 2.26, 3.0) and not r.wanted_in_range
    assert tuple(run(2, 2)) == (2, 2, None, None, None, None, None, None)
    assert tuple(run(0, 3))[:2] == (1, 2) and tuple(run(3, 0))[:2] == (3, 1)


def test_density_weights(spark):
    rows = [([float(i % 10), 1.0], int(i % 10 >= 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "v array<float>, y int")
    got = {r.v[0]: r.weight for r in scoring.density_weights(df, "v", "y").collect()}
    assert got[0.0] == 0.5 and got[9.0] == 10.0 and all(0.5 <= w <= 10 for w in got.values())


def test_unpair_and_fit(spark):
    df = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert [tuple(r) for r in preferences.unpair(df).collect()] == [("p", "c", True), ("p", "r", False)]
    pairs = spark.createDataFrame([([1], [1, 2]), ([1], [1])], "chosen array<int>, rejected array<int>")
    assert preferences.fitting_pairs(pairs, 1).count() == 1


def _rolling(rows, buffer, least):
    """By brute force, batch after batch."""
    kept, out = {}, {}
    for batch in sorted({r[1] for r in rows}):
        own = [r for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[1] == batch]
        scored = [r for r in own if r[3] is not None]
        for p in {r[0] for r in scored}:
            kept[p] = (kept.get(p, []) + [r[3] for r in scored if r[0] == p])[-buffer:]
        for p, _, order, score in own:
            use = kept.get(p, []) if len(kept.get(p, [])) >= least else [r[3] for r in scored]
            out[order] = None if score is None else (score - np.mean(use)) / (np.std(use) + 1e-6)
    return out


def test_rolling_buffers(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i // 50, i, rng.choice([None, rng.random(), 5 * rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "p long, batch int, i int, score double").repartition(6)
    for buffer, least in ((16, 10), (3, 3), (1, 1), (200, 30)):
        got = {r.i: r.advantage for r in scoring.rolling_prompt_z(df, "p", "batch", ["i"], "score", buffer, least, buckets=5).collect()}
        want = _rolling(rows, buffer, least)
        assert set(got) == set(want)
        assert all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] - want[i]) < 1e-6 * (1 + abs(want[i]))) for i in want)
    assert scoring.rolling_prompt_z(df.limit(0), "p", "batch", ["i"], "score").count() == 0


def test_rolling_buffers_of_a_stream(spark, tmp_path):
    from corpusloom.streaming import scores, sessions

    rng = random.Random(9)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, 1e6 + rng.random()])) for i in range(120)]
    for batch in range(4):
        part = spark.createDataFrame(rows[batch * 30 : batch * 30 + 30], "prompt_id string, place long, score double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("prompt_id string, place long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    seen = {}

    def store(batch, number):
        seen.update({(number, r.prompt_id): (r.n, r.mean, r.deviation) for r in batch.collect()})

    assert sessions.start(scores.prompt_buffers(stream, 7), store, str(tmp_path / "c")).awaitTermination(180)
    for (number, prompt), (n, mean, deviation) in seen.items():
        last = [s for p, i, s in rows if p == prompt and s is not None and i < number * 30 + 30][-7:]
        assert n == len(last) and abs(mean - np.mean(last)) < 1e-6 and abs(deviation - np.std(last)) < 1e-6
    assert len(seen) >= 6


def test_first_rows_without_an_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", 1, 3), ("c", 5, 4), ("c", 4, 5)], "k string, o int, v int")
    assert sorted((r.k, r.v) for r in scoring.unique_prompts(df, "k", "o").collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_partners_of_a_large_batch_are_joined(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    for mode, partner in (("reverse", lambda i, n: n - 1 - i), ("rotate", lambda i, n: (i - 1) % n)):
        out = batches.mismatched(df, ["id"], "v", "other", 700, mode)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Window" not in plan
        for r in out.collect():
            first, n = (0, 700) if r.id < 700 else (700, 300)
            assert r.other == 2 * (first + partner(r.id - first, n)) and r.batch == r.id // 700


def test_draws_need_no_sort_of_the_table(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    draws = batches.sample_with_repeats(df, "k", 400, 5, 32)
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = draws.collect()
    assert sorted(r.draw for r in got) == list(range(1, 401)) and 340 < len({r.k for r in got}) <= 400
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, batches.sample_with_repeats(df.repartition(7), "k", 400, 5, 32).collect()))


def test_formatted_texts_and_begin_tokens(spark):
    df = spark.createDataFrame([(1, "x y", 2), (2, "z", 0), (3, None, 1)], "id long, a string, n int")
    rows = T.formatted(df, _formatting_of(), ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "<s> x y"), (1, 1, "<s> x y"), (3, 0, "<s> None")]
    assert T.formatted(df.limit(0), _formatting_of(), ["id"]).count() == 0
    with pytest.raises(Exception, match="list of texts"):
        T.formatted(df, lambda row: "text", ["id"]).collect()
    written = T.begin_is_written(rows, "text", "<s>", ["id", "place"])
    assert written and not T.begin_is_written(df, "a", "<s>", ["id"]) and T.begin_is_written(df.limit(0), "a", "<s>", ["id"], "{<s>}")
    tokens = lambda **kw: [r.input_ids for r in T.tokenize(df.select("id", F.coalesce("a", F.lit("<s> b")).alias("a")), "a", begin="<s>", **kw).orderBy("id").collect()]
    assert tokens() == [["<s>", "x", "y"], ["<s>", "z"], ["<s>", "b"]]
    assert tokens(written=False) == [["<s>", "x", "y"], ["<s>", "z"], ["<s>", "<s>", "b"]]
    assert tokens(written=True) == [["x", "y"], ["z"], ["<s>", "b"]]
    masked = T.tokenize(rows, "text", limit=2, mask="attention_mask").first()
    assert masked.attention_mask == [1, 1] and len(masked.input_ids) == 2


def _formatting_of():
    return lambda row: [f"<s> {row['a']}"] * row["n"]


def test_prompts_of_conversations(spark):
    kind = "array<struct<role:string,content:string>>"
    rows = [
        (1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]),
        (2, [("user", "q")], [("user", "r")]),
        (3, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a"), ("user", "more")]),
    ]
    df = spark.createDataFrame(rows, f"id int, chosen {kind}, rejected {kind}")
    got = {r.id: tuple([tuple(m) for m in c] for c in (r.prompt, r.chosen, r.rejected)) for r in preferences.extract_prompt(df).collect()}
    assert got[1] == ([("user", "q")], [("assistant", "a")], [("assistant", "b")])
    assert got[2] == ([], [("user", "q")], [("user", "r")])
    assert got[3] == ([("user", "q")], [("assistant", "a")], [("assistant", "a"), ("user", "more")])
