"""Tables of runs, the ingest over them, and the session store."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dialogue
from corpusloom.plans import corpus, requests
from corpusloom.sources.runs import Runs, filter_bits
from corpusloom.streaming import ingest, requests as streaming
from corpusloom.streaming.store import SessionStore


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_lookups_open_a_bounded_number_of_files(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "v"), "url", "url string", buckets=4, fan_in=3)
    seen, files = set(), []
    for batch in range(20):
        names = [f"u{batch * 5 + i}" for i in range(-3, 5)]
        fresh = runs.without_known(urls(spark, names), before=batch)
        got = [r.url for r in fresh.collect()]
        assert sorted(got) == sorted(set(names) - seen)
        runs.add(fresh, batch)
        seen |= set(names)
        files.append(len(runs.candidates(urls(spark, names)).inputFiles()))
        assert len(runs._listed(None)) <= 3
    assert sorted(r.url for r in runs.rows().collect()) == sorted(seen)
    assert max(files) <= 4 * 3
    # urls that no run holds are told from the filters: next to nothing is read
    assert len(runs.candidates(urls(spark, [f"x{i}" for i in range(5)])).inputFiles()) <= 4


def test_a_batch_can_be_repeated(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "v"), "url", "url string", buckets=2, fan_in=2)
    for batch in range(4):
        runs.add(urls(spark, [f"u{batch}"]), batch)
    for _ in range(2):  # the last one again, before and after a vacuum
        fresh = runs.without_known(urls(spark, ["u3", "u1", None]), before=3)
        assert sorted(r.url or "" for r in fresh.collect()) == ["", "u3"]
        runs.add(urls(spark, ["u3"]), 3)
        assert sorted(r.url for r in runs.rows().collect()) == ["u0", "u1", "u2", "u3"]
        runs.vacuum(before=3)


def test_runs_of_nothing(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "v"), "url", "url string")
    assert runs.rows().count() == 0 and runs.without_known(urls(spark, ["a"])).count() == 1
    runs.add(urls(spark, []), 0)
    assert runs.matching(urls(spark, ["a"])).count() == 0 and runs.rows().count() == 0


def test_filters_miss_no_key_and_let_few_others_pass():
    import numpy as np

    from corpusloom.sources.runs import _places

    rng = np.random.default_rng(2)
    keys, others = rng.integers(-(2**63), 2**63 - 1, (2, 5000, 2))
    bits, hashes = filter_bits(5000, 0.01)
    marks = np.zeros(bits, bool)
    marks[_places(keys[:, 0], keys[:, 1], bits, hashes).ravel()] = True
    assert marks[_places(keys[:, 0], keys[:, 1], bits, hashes)].all()
    assert marks[_places(others[:, 0], others[:, 1], bits, hashes)].all(axis=1).mean() < 0.02


def test_ingest_in_twenty_batches_equals_one(spark, tmp_path):
    rng = random.Random(4)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    pages, want = [], {}
    for batch in range(20):
        rows = []
        for i in range(6):
            url, good = f"u{rng.randint(0, 40)}", rng.random() < 0.7
            rows.append((batch * 10 + i, url, f"<h1>t{batch}.{i}</h1><main>text</main>" if good else "<p>nothing"))
        pages.append(rows)
        firsts = {}
        for page, url, html in rows:
            firsts.setdefault(url, (page, html))
        for url, (_, html) in firsts.items():
            if "<h1>" in html:
                want.setdefault(url, html.split("<h1>")[1].split("<")[0])
    schema = "page_id long, url string, html string"
    for rows in pages:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/d")
        query = ingest.ingest_articles(
            ingest.page_stream(spark, f"{source}/*"), target, str(tmp_path / "marks"), buckets=4, fan_in=3
        )
        assert query.awaitTermination(120)
    got = spark.read.parquet(target).collect()
    assert len(got) == len(want) and {r.url: r.title for r in got} == want
    visited = ingest.visited_urls(spark, f"{target}_visited", 4, 3)
    assert sorted(r.url for r in visited.rows().collect()) == sorted(want) and len(visited._listed(None)) <= 3


ANSWERED = "session_id string, order long, question string, answer string"


@pytest.fixture
def store(spark, tmp_path):
    made = SessionStore(spark, str(tmp_path / "store"), buckets=4, fan_in=2)
    said = [
        [("a", 1, "chào", "xin chào"), ("b", 1, "đau đầu", " "), ("a", 2, "tôi đau", "ở đâu")],
        [("a", 1, "đầu", "đau đầu à")],
        [("c", 9, "x", "y"), ("a", 5, "vâng", "thuốc"), ("b", 2, "sốt", "cao không")],
    ]
    for batch, rows in enumerate(said):
        made.append(spark.createDataFrame(rows, ANSWERED), batch)
    made.append(spark.createDataFrame(said[2], ANSWERED), 2)  # again, as after a failure
    return made


def test_turns_are_numbered_over_batches(spark, store):
    got = [(r.session_id, r.turn, r.content) for r in store.messages.rows().orderBy("session_id", "turn").collect()]
    apology = "Xin lỗi, tôi không thể trả lời câu hỏi này lúc này."
    assert got == [
        *[("a", i, c) for i, c in enumerate(["chào", "xin chào", "tôi đau", "ở đâu", "đầu", "đau đầu à", "vâng", "thuốc"])],
        *[("b", i, c) for i, c in enumerate(["đau đầu", apology, "sốt", "cao không"])],
        ("c", 0, "x"), ("c", 1, "y"),
    ]
    one = store.log(spark.createDataFrame([("c",), ("zz",)], "session_id string"))
    assert {r.session_id for r in one.collect()} == {"c"} and len(one.inputFiles()) <= 4


def only(allowed):
    """An encoder that refuses other texts, such as messages of the log."""

    def encode(texts):
        from corpusloom.functions.vectors import WordHashEncoder

        if not all(any(a in t for a in allowed) for t in texts if t):
            raise ValueError(texts)
        return WordHashEncoder()(texts)

    return encode


def test_requests_read_stored_vectors(spark, store):
    chunks = spark.createDataFrame([("c1", "T", "u", "thuốc giảm đau")], "id string, title string, url string, content string")
    found = corpus.embedded(chunks)
    rows = [(1, "a", "tôi đau đầu"), (2, "a", "chào"), (3, "b", "sốt cao"), (4, "new", "chào")]
    asked = spark.createDataFrame(rows, "query_id long, session_id string, question string")
    log = store.log(asked)
    questions = [r[2] for r in rows]
    got = {r.query_id: [(m.role, m.content) for m in r.history] for r in requests.session_prompts(asked, log, found, encoder=only(questions)).collect()}
    # the same from a log without vectors, a request at a time
    for query_id, session, question in rows:
        alone = spark.createDataFrame([(session, 100, question)], "session_id string, turn long, question string")
        mine = dialogue.earlier_messages(log.drop("embedding"), alone)
        vectors = corpus.chunking.encode(mine, "content").join(
            corpus.chunking.encode(alone, "question", "question_embedding").drop("turn", "question"), "session_id"
        )
        history = dialogue.hybrid_history(mine, dialogue.similar_messages(vectors)).collect()
        assert got[query_id] == ([(m.role, m.content) for m in history[0].history] if history else [])
    assert got[4] == []


def test_many_requests_of_a_session_meet_its_log_in_blocks(spark):
    log = spark.createDataFrame([("s", t, "user", f"w{t % 7} x") for t in range(60)], "session_id string, turn long, role string, content string")
    asked = spark.createDataFrame([(q, "s", f"w{q % 7}") for q in range(30)], "query_id long, session_id string, question string")
    coded = corpus.chunking.encode(log, "content")
    hits = requests.similar_by_request(asked, coded, 5, block=8, query_block=4).collect()
    assert len(hits) == 150
    for q in range(30):
        assert [r.turn for r in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)] == [t for t in range(60) if t % 7 == q % 7][:5]


def test_stream_into_the_store_and_answers_from_it(spark, tmp_path):
    source = str(tmp_path / "said")
    for batch in range(3):
        rows = [(s, batch, f"q{batch} {s}", f"a{batch}") for s in "ab"]
        spark.createDataFrame(rows, ANSWERED).coalesce(1).write.mode("append").parquet(source)
    store = SessionStore(spark, str(tmp_path / "store"), buckets=2, fan_in=2)
    stream = spark.readStream.schema(ANSWERED).option("maxFilesPerTrigger", 1).parquet(source)
    assert store.start(stream, str(tmp_path / "marks")).awaitTermination(180)
    got = sorted((r.session_id, r.turn, r.content) for r in store.messages.rows().collect())
    assert [t for s, t, _ in got if s == "a"] == list(range(6)) and len(got) == 12
    chunks = spark.createDataFrame([("c1", "T", "u", "q1 a")], "id string, title string, url string, content string")
    corpus.retrieval.with_cells(corpus.embedded(chunks), 3).write.partitionBy("cell").parquet(str(tmp_path / "corpus"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text('{"query_id": 1, "session_id": "a", "question": "q1"}')
    query = streaming.answer_requests(
        streaming.request_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "corpus"), str(tmp_path / "out"),
        str(tmp_path / "c"), by=corpus.retrieval.SignCells(3, 3),
    )
    assert query.awaitTermination(180)
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [m.content for m in row.history[:3]] == ["a1", "q2 a", "a2"] and row.history[3].content == "q1 a"


def test_counts_of_a_store_equal_its_messages(spark, store):
    ends = {r.session_id: r.next for r in store.ends.rows().groupBy("session_id").agg(F.max("next").alias("next")).collect()}
    assert ends == {"a": 8, "b": 4, "c": 2}
