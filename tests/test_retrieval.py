import numpy as np
import pytest

from corpusloom.functions.vectors import WordHashEncoder, cells, sign_planes
from corpusloom.operators import chunking, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(12, 16))
    data = centers[rnd.integers(0, 12, 900)] + 0.3 * rnd.normal(size=(900, 16))
    data[5] = 0
    data[200:230] = data[100]  # ties
    asked = np.vstack([data[100:101], centers + 0.1 * rnd.normal(size=(12, 16))])
    frame = lambda m, name: spark.createDataFrame(
        [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(m)], f"{name} long, embedding array<float>"
    )
    return np.float32(data), np.float32(asked), frame(data, "id").repartition(5), frame(asked, "query_id")


def brute(data, asked, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    sims = np.round(unit(asked) @ unit(data).T, 6)
    return {(q, int(i), r + 1) for q, row in enumerate(sims) for r, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k])}


def found(df):
    return {(r.query_id, r.id, r.rank) for r in df.collect()}


def test_exact(tables):
    data, asked, corpus, queries = tables
    assert found(retrieval.nearest(corpus, queries, 10)) == brute(data, asked, 10)


def test_blockwise_is_the_same(tables):
    data, asked, corpus, queries = tables
    assert found(retrieval.nearest(corpus, queries, 10, max_sent=4, block=100)) == brute(data, asked, 10)
    assert found(retrieval.nearest(corpus, queries, 10, max_sent=4, block=7)) == brute(data, asked, 10)  # lists are merged by level
    cellwise = [found(retrieval.nearest(corpus, queries, 5, 6, 1, max_sent=m, block=b)) for m, b in ((4, 10), (4096, 50_000))]
    assert cellwise[0] == cellwise[1]


def test_fewer_rows_than_k(tables):
    _, _, corpus, queries = tables
    assert retrieval.nearest(corpus.filter("id < 3"), queries, 10).count() == 3 * queries.count()
    assert retrieval.nearest(corpus.filter("id < 0"), queries, 10).count() == 0


def test_recall_of_cells(tables):
    data, asked, corpus, queries = tables
    exact = {(q, i) for q, i, _ in brute(data, asked, 10)}
    near = {(q, i) for q, i, _ in found(retrieval.nearest(corpus, queries, 10, 6, 2))}
    assert len(exact & near) / len(exact) > 0.85
    assert all(0 <= c < 64 for c in cells(data, sign_planes(6, 16)))


def test_sign_cells_are_compared_by_brute_force(tables):
    data, asked, corpus, queries = tables
    own, near = (cells(m, sign_planes(6, 16)) for m in (data, asked))
    unit = lambda m: m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    sims = np.round(unit(asked) @ unit(data).T, 6)
    want = set()
    for q, row in enumerate(sims):
        ids = [i for i in range(len(data)) if bin(own[i] ^ near[q]).count("1") <= 2]
        want |= {(q, i, r) for r, i in enumerate(sorted(ids, key=lambda i: (-row[i], i))[:5], 1)}
    assert found(retrieval.nearest(corpus, queries, 5, 6, 2)) == want


def test_probes_go_by_the_nearest_planes():
    by, m = retrieval.SignCells(4, 2), np.random.default_rng(1).normal(size=(20, 16))
    got = by.near(m)
    margins = m @ sign_planes(4, 16).T
    for row, margin in zip(got, margins):
        cost = lambda c: sum(abs(x) for i, x in enumerate(margin) if (c >> i & 1) != (x > 0))
        assert [cost(c) for c in row] == sorted(cost(c) for c in row) and len(row) == 11
        assert cost(row[0]) == 0 and (by.near(m, 3) == got[:, :3]).all()


def test_recall_of_fitted_pivots(spark):
    """Every hundredth of the given vectors against all: recall 0.9 from less than half of the products."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    by = retrieval.fit_pivots(rows, 256, 8)
    exact, near = (
        {(r.query_id, r.id) for r in retrieval.nearest(rows, asked, 10, **kw).collect()} for kw in ({}, {"by": by, "probes": 100})
    )
    assert len(exact & near) >= 0.9 * len(exact)
    sizes = {r.cell: r["count"] for r in retrieval.with_cells(rows, by).groupBy("cell").count().collect()}
    products = sum(sizes.get(r.cell, 0) for r in retrieval.routed(asked, by, 100).collect())
    assert products < 0.45 * 2000 * 20


def test_groups_meet_only_their_own_queries(spark):
    rows = spark.createDataFrame([("ab"[i % 2], i, [1.0, float(i)]) for i in range(40)], "g string, id long, embedding array<float>")
    asked = spark.createDataFrame([("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 0.0]), ("c", 3, [1.0, 0.0])], "g string, query_id long, query array<float>")
    hits = retrieval.nearest_in_groups(rows, asked, "g", 2, block=6, query_block=1)
    assert found(retrieval.best_hits(hits, 2)) == {(1, 38, 1), (1, 36, 2), (2, 0, 1), (2, 2, 2)}


def test_vectors_that_are_null_or_ragged(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 0.0]), (4, [])], "id long, embedding array<float>")
    assert retrieval.with_cells(rows, 3).count() == 4
    assert retrieval.with_cells(rows.filter("id = 1"), 3).first().cell == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = retrieval.nearest(rows, asked, 4, by=retrieval.PivotCells(np.eye(2)), probes=2)
    assert [r.similarity for r in got.orderBy("rank").collect()] == [1.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        retrieval.with_cells(rows, 20)


def test_gates_and_contexts(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.9, 1), (1, "b", 0.5, 2), (1, "c", 0.45, 3), (2, "a", 0.39, 1), (3, "s", 0.4, 1), (5, "a", 0.3, 1)],
        "query_id long, id string, similarity double, rank int",
    )
    rows = spark.createDataFrame(
        [("a", "A", "x" * 1600), ("b", None, "long enough text"), ("c", "C", "never used here"), ("s", "S", "  short  ")],
        "id string, title string, content string",
    )
    queries = spark.createDataFrame([(q,) for q in range(1, 6)], "query_id long")
    got = {r.query_id: (r.top_similarity, r.intent, r.use_documents) for r in retrieval.gates(queries, hits).collect()}
    domain, chat = "medical_question", "chitchat"
    assert got == {1: (0.9, domain, True), 2: (0.39, domain, False), 3: (0.4, domain, True), 4: (0.0, chat, False), 5: (0.3, domain, False)}
    ctx = {r.query_id: r.context for r in retrieval.document_context(retrieval.hit_rows(hits, rows)).collect()}
    assert ctx == {1: "[A]: " + "x" * 1500 + "...\n\n[N/A]: long enough text", 3: ""}


def test_encoder(spark):
    m = WordHashEncoder(32)(["a b a", "", "A  B, a!"])
    assert np.allclose(np.linalg.norm(m, axis=1), [1, 0, 1]) and np.allclose(m[0], m[2])

    class Fixed:  # any callable of that shape can stand in
        def __call__(self, texts):
            return np.array([[float(len(t)), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    got = chunking.encode(df, "t", encoder=Fixed()).orderBy("id").collect()
    assert [r.embedding for r in got] == [[3.0, 1.0], [0.0, 1.0]]
    report = chunking.vector_report(chunking.encode(df, "t")).first()
    assert tuple(report) == (2, 256, 256)
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert [r[0] for r in chunking.normalised(zero).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_small_side_only_is_sent(tables):
    _, _, corpus, queries = tables
    plan = retrieval.nearest(corpus, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_stored_cells_limit_the_scan(spark, tables, tmp_path):
    _, _, corpus, queries = tables
    path = str(tmp_path / "cells")
    retrieval.with_cells(corpus.filter("id <> 5"), 6).write.partitionBy("cell").parquet(path)
    stored, one = spark.read.parquet(path), queries.filter("query_id = 3")
    search = retrieval.nearest(stored, one, 10, 6, 1)
    assert found(search) == found(retrieval.nearest(corpus.filter("id <> 5"), one, 10, 6, 1))
    plan = search._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_few_texts_are_encoded_at_a_time(spark):
    class Seen:  # number and length of the texts of a call, as their vectors
        def __call__(self, texts):
            return np.array([[float(len(texts)), float(sum(map(len, texts)))]] * len(texts))

    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "if(id = 7, repeat('y', 3000000), repeat('x', cast(id AS int))) AS t")
    got = {r.id: r.embedding for r in chunking.encode(rows, "t", encoder=Seen(), keep_text=False).collect()}
    assert len(got) == 5000
    assert max(n for n, _ in got.values()) <= 1024 and got[7] == [1.0, 3e6]
    assert max(size for i, (_, size) in got.items() if i != 7) <= 1 << 20


def test_slices_give_the_best_of_the_whole():
    import pyarrow as pa

    from corpusloom.functions.arrow import parts

    rnd = np.random.default_rng(5)
    data = np.round(rnd.normal(size=(5000, 4)), 1)  # with ties
    lists = [list(r) for r in data]
    batch = pa.RecordBatch.from_arrays([pa.array(rnd.permutation(5000)), pa.array(lists, pa.list_(pa.float32()))], ["id", "embedding"])
    sizes, best, whole = [], retrieval._Best(data[:300], 10), retrieval._Best(data[:300], 10)
    for part in parts(batch, rows=retrieval.PART_ROWS):
        sizes.append(part.num_rows)
        best.add(np.array(part.column(0).to_pylist(), dtype=object), retrieval._matrix(part.column(1)))
    whole.add(np.array(batch.column(0).to_pylist(), dtype=object), retrieval._matrix(batch.column(1)))
    assert sizes == [2048, 2048, 904]
    for q in range(300):
        assert list(best.ids[q]) == list(whole.ids[q]) and np.array_equal(best.sims[q], whole.sims[q])
    empty = batch.slice(0, 0)
    assert not [*parts(empty)] and not [*parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"]), 0)]
    mixed = pa.RecordBatch.from_arrays([pa.array([None, "é" * 9, None, "a", "b" * 3])], ["t"])
    assert [p.num_rows for p in parts(mixed, 0, 3, 4)] == [1, 1, 3]
