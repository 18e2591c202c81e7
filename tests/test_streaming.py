from pyspark.sql import functions as F

from corpusloom.operators import dialogue
from corpusloom.streaming import ingest, sessions


def write_pages(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    df.write.mode("append").parquet(f"{folder}/{name}")


def test_ingest_is_resumable(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    ok = "<h1>{0}</h1><main>text {0}</main>".format
    write_pages(spark, source, "a.d", [(1, "u1", ok(1)), (2, "u2", "<p>no article"), (3, "u1", ok(3))])

    def run():
        q = ingest.ingest_articles(ingest.page_stream(spark, f"{source}/*"), target, marks)
        assert q.awaitTermination(120)
        return sorted((r.url, r.title) for r in spark.read.parquet(target).collect())

    assert [u for u, _ in run()] == ["u1"]
    write_pages(spark, source, "b.d", [(4, "u1", ok(4)), (5, "u2", ok(5)), (6, "u3", ok(6))])
    got = run()
    assert [u for u, _ in got] == ["u1", "u2", "u3"]
    assert run() == got  # nothing new


def write_messages(spark, tmp_path):
    rows = [(s, t, "user" if t % 2 == 0 else "assistant", f"{s}.{t}") for s in range(5) for t in range(s * 7)]
    df = spark.createDataFrame(rows, "session_id long, turn long, role string, content string")
    for i in range(4):  # several files, so several batches
        df.filter(F.col("turn") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    return df


def test_buffers_equal_batch(spark, tmp_path):
    df = write_messages(spark, tmp_path)
    seen = {}

    def store(batch, number):
        for r in batch.collect():
            seen[r.session_id] = list(zip(r.turns, r.roles, r.contents))

    stream = sessions.recent_buffers(sessions.message_stream(spark, str(tmp_path / "m"), 1), 6)
    assert sessions.start(stream, store, str(tmp_path / "c1")).awaitTermination(180)
    want = {}
    for r in dialogue.last_messages(df, 6).orderBy("session_id", "turn").collect():
        want.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    assert seen == want


def test_counts_equal_batch(spark, tmp_path):
    df = write_messages(spark, tmp_path)
    seen = {}

    def store(batch, number):
        seen.update({r.session_id: r.messages for r in batch.collect()})

    stream = sessions.session_counts(sessions.message_stream(spark, str(tmp_path / "m"), 1))
    assert sessions.start(stream, store, str(tmp_path / "c2")).awaitTermination(180)
    assert seen == {r.session_id: r.messages for r in dialogue.sessions(df).collect()}


def test_requests(spark, tmp_path):
    from corpusloom.plans import corpus
    from corpusloom.streaming import requests

    chunks = spark.createDataFrame(
        [("c1", "Đau đầu", "u", "thuốc giảm đau đầu dùng mỗi ngày sau bữa ăn sáng và tối"), ("c2", "Khác", "v", "một chuyện hoàn toàn khác hẳn")],
        "id string, title string, url string, content string",
    )
    log, store, source, out = (str(tmp_path / x) for x in ("log", "corpus", "in", "out"))
    corpus.embedded(chunks).write.parquet(store)
    answered = spark.createDataFrame([("s", 0, "chào", " ")], "session_id string, turn long, question string, answer string")
    requests.append_turns(answered, log)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"query_id": 1, "session_id": "s", "question": "thuốc giảm đau đầu dùng mỗi ngày sau bữa ăn sáng và tối, đau đầu, đau đầu"}\n{"query_id": 2, "question": "zzz"}\n{"query_id": 3, "question": " "}\n'
    )
    q = requests.answer_requests(requests.request_stream(spark, source), log, store, out, str(tmp_path / "c"))
    assert q.awaitTermination(180)
    got = {r.query_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2} and got[2].session_id == "default_api_session"
    assert got[1].user_text.startswith("Tài liệu y tế:\n[Đau đầu]: thuốc") and got[2].user_text == "zzz"
    assert [(m.role, m.content) for m in got[1].history] == [("user", "chào"), ("model", "Xin lỗi, tôi không thể trả lời câu hỏi này lúc này.")]
    assert got[2].history == [] and got[2].settings.max_tokens == 150
