import json

from pyspark.sql import functions as F

from corpusloom.operators import dialogue, web
from corpusloom.plans import corpus
from corpusloom.sources import files

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_one_sitemap(spark, tmp_path):
    leaf = "<url><loc> https://a.org/vi/professional/1 </loc><lastmod>1</lastmod></url><url><loc>https://a.org/vi/home/1</loc></url>"
    (tmp_path / "m.xml").write_text(f"<?xml version='1.0'?><urlset {NS}>{leaf}</urlset>")
    assert [r.url for r in files.read_sitemap(spark, str(tmp_path / "m.xml")).collect()] == ["https://a.org/vi/professional/1"]


def _index(*locs):
    return f"<?xml version='1.0'?><sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def _leaf(*numbers):
    urls = "".join(f"<url><loc>\n https://a.org/professional/{n}?a=1&amp;b=2 </loc></url><url><loc>https://a.org/home/{n}</loc></url>" for n in numbers)
    return f"<?xml version='1.0'?><urlset {NS}>{urls}</urlset>"


def test_nested_sitemap_indexes(spark, tmp_path):
    """Equal file names in several folders, a cycle, a repeat, unwanted, broken and missing ones."""
    kept = {
        "a.org/index.xml": _index("https://a.org/x/topic.xml", "https://a.org/y/topic.xml", "https://a.org/media.xml", " https://b.org/deep/topic.xml#z "),
        "a.org/x/topic.xml": _leaf(1, 2),
        "a.org/y/topic.xml": _index("http://a.org/x/topic.xml", "https://a.org/y/topic.xml", "https://a.org/index.xml", "https://a.org/m%C3%BC/topic.xml"),
        "a.org/mü/topic.xml": _leaf(3).replace("<url>", "<s:url>").replace("</url>", "</s:url>").replace("<urlset ", "<urlset xmlns:s='u' "),
        "a.org/media.xml": _leaf(9),
        "a.org/other/topic.xml": _leaf(8),
        "b.org/deep/topic.xml": _index("https://b.org/broken/topic.xml", "https://b.org/missing/topic.xml", "https://b.org/leaf/topic.xml"),
        "b.org/broken/topic.xml": "<urlset><url><loc>https://a.org/professional/7",
        "b.org/leaf/topic.xml": _leaf(4, 4),
    }
    for name, text in kept.items():
        path = tmp_path / "maps" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = files.read_sitemap_index(spark, "https://a.org/index.xml", str(tmp_path / "maps")).collect()
    assert sorted(r.url for r in got) == [f"https://a.org/professional/{n}?a=1&b=2" for n in (1, 2, 3, 4, 4)]
    assert files.read_sitemap_index(spark, "https://gone.org/index.xml", str(tmp_path / "maps")).count() == 0


DOC = {
    "id": "a", "title": "Đau", "url": "u", "content": "c", "authors": ["A"], "reviewers": [], "references": ["r"],
    "sections": {"Điều trị": "x"}, "metadata": {"title": "Đau", "url": "u", "source": "s", "language": "vi"},
}


def test_json(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([DOC, {**DOC, "id": "b"}], indent=2, ensure_ascii=False))
    docs = files.read_json_array(spark, str(tmp_path / "in.json"))
    assert [r.id for r in docs.orderBy("id").collect()] == ["a", "b"]
    assert docs.first().asDict(recursive=True) == DOC
    files.write_json_lines(docs, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert len(text.splitlines()) == 2 and "Điều trị" in text
    again = files.read_json_lines(spark, str(tmp_path / "out"))
    assert {json.dumps(r.asDict(recursive=True), sort_keys=True) for r in again.collect()} == {
        json.dumps(r.asDict(recursive=True), sort_keys=True) for r in docs.collect()
    }


def test_visited(spark, tmp_path):
    path = str(tmp_path / "visited")
    urls = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    files.add_visited(urls, path)
    known = files.read_visited(spark, path)
    files.add_visited(spark.createDataFrame([("b",), ("c",)], "url string"), path, known)
    assert sorted(r.url for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_article_round_trip(spark, tmp_path):
    arts = spark.createDataFrame(
        [(1, "u1", "Tên một", "thân bài", [("s", "t")]), (2, "u2", "Tên một", "khác", [])],
        "page_id long, url string, title string, content string, sections array<struct<title:string,content:string>>",
    )
    files.write_article_texts(web.file_names(arts, "page_id"), str(tmp_path / "texts"))
    made = sorted(p.parent.name for p in (tmp_path / "texts").glob("*/*.txt"))
    assert made == ["file_stem=Tên một", "file_stem=Tên một_1"]


def test_pages_to_documents(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>Bệnh A</h1><main>Lời một<p>hai</p></main>")], "page_id long, url string, html string")
    doc = corpus.pages_to_documents(pages, "site").first()
    assert (doc.id, doc.title, doc.url, doc.content, doc.metadata.source) == ("bệnh_a", "Bệnh A", "u", "Lời một hai", "site")


def test_history_files(spark, tmp_path):
    rows = spark.createDataFrame([(7, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(30)], "session_id long, turn long, role string, content string")
    dialogue.write_history(rows, str(tmp_path / "h"), 2)
    (made,) = (tmp_path / "h" / "session_id=7").glob("*.txt")
    head = "LỊCH SỬ CUỘC TRÒ CHUYỆN - Session: 7\n" + "=" * 60 + "\n\n"
    assert made.read_text() == head + "1. NGƯỜI DÙNG:\nm26\n\n2. TRỢ LÝ:\nm27\n\n3. NGƯỜI DÙNG:\nm28\n\n4. TRỢ LÝ:\nm29\n\n\n"


def test_first_urls_without_limit(spark):
    urls = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"))
    assert web.first_urls(urls, "page_id", None).count() == 3 and web.first_urls(urls, "page_id", 2).count() == 2
