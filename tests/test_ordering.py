import random

from pyspark.sql import functions as F

from corpusloom.operators import ordering


def rows(spark):
    rnd = random.Random(1)
    out = []
    for g in range(40):
        n = 900 if g == 7 else rnd.randint(0, 12)  # one group holds most rows
        turns = sorted(rnd.sample(range(100_000), n))
        out += [(g, t, rnd.randint(1, 9)) for t in turns]
    rnd.shuffle(out)
    return out, spark.createDataFrame(out, "g long, t long, v int")


def test_rank_and_running_sum(spark):
    data, df = rows(spark)
    assert ordering.key_ranges(df, ["g", "t"], 16).limits
    got = ordering.rank_in_group(df, ["g"], ["t"], "r", 16)
    got = ordering.running_sum(got, ["g"], ["t"], F.col("v"), "s", 16).collect()
    want = {}
    for g in {d[0] for d in data}:
        total = 0
        for i, (_, t, v) in enumerate(sorted(d for d in data if d[0] == g), 1):
            want[g, t] = (i, total)
            total += v
    assert {(x.g, x.t): (x.r, x.s) for x in got} == want and len(got) == len(data)


def test_whole_table_rank(spark):
    data, df = rows(spark)
    got = ordering.rank_in_group(df, [], ["g", "t"], "r", 16).orderBy("r").collect()
    assert [(x.g, x.t) for x in got] == [d[:2] for d in sorted(data)]
    assert [x.r for x in got] == list(range(1, len(data) + 1))


def check_window(spark, forward):
    data, df = rows(spark)

    def build(w):
        frame = w.rowsBetween(1, 4) if forward else w.rowsBetween(-4, -1)
        return {"near": F.collect_list("t").over(frame)}

    got = ordering.bounded_window(df, ["g"], ["t"], 4, build, 64, "ahead" if forward else "back").collect()
    assert len(got) == len(data)
    for x in got:
        turns = sorted(d[1] for d in data if d[0] == x.g)
        i = turns.index(x.t)
        assert x.near == (turns[i + 1 : i + 5] if forward else turns[max(0, i - 4) : i])


def test_bounded_window_back(spark):
    check_window(spark, False)


def test_bounded_window_ahead(spark):
    check_window(spark, True)
