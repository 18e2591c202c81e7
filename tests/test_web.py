from pyspark.sql import functions as F

from corpusloom.functions.html import read_page, with_pages_read
from corpusloom.functions import fixed
from corpusloom.operators import web

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><h1> Head <b>line</b></h1>
<main>no</main><div class="big topic__content"><p>One &amp; two<br>three<!-- c -->four</p><script>var a="<p>no</p>";</script>
<section><h2>First</h2><p>a <i>b</i></p>loose<ul><li>c</li><li>d</li></ul><h3>Second</h3><div> </div><h4>Third</h4><p>e</p></section>
<div><h2>Last</h2></div><p>after</p></div></body></html>"""


def test_read_page():
    title, content, sections = read_page(PAGE, fixed.BODY_SELECTORS)
    assert title == "Headline"
    assert content.split("\n\n") == ["One & two", "three", "four", "First", "a", "b", "loose", "c", "d", "Second", "Third", "e", "Last", "after"]
    assert sections == [{"title": "First", "content": "ab\n\ncd"}, {"title": "Third", "content": "e"}]


def test_selectors_in_order():
    def body(html):
        return read_page(html, fixed.BODY_SELECTORS)[1]

    assert body("<main>m</main><article>a</article>") == "a"
    assert body("<article>a</article><div class=content-body>b") == "b"
    assert body("<div class='topic__content'>t</div><div class=content-body>b</div>") == "t"
    assert body("<main>m") == "m" and body("<p>nothing") == ""
    assert read_page("<main>m</main>", fixed.BODY_SELECTORS)[0] == ""
    assert body("<main>a</p>b<template>x<b>y</b></template></main>c") == "a\n\nb"


def pages(spark):
    return spark.createDataFrame(
        [
            (1, "https://a.org/x/", '<a href="/vi/professional/1">1</a><a href="../vi/professional/2">2</a><a href="https://a.org/vi/professional/1">1</a>'
             '<a name="n">n</a><a href="/en/3">3</a>'),
            (2, "https://a.org/y", None),
        ],
        "page_id long, url string, html string",
    )


def test_links(spark):
    got = [(r.page_id, r.position, r.link) for r in web.links(pages(spark)).collect()]
    assert got == [(1, 0, "https://a.org/vi/professional/1"), (1, 1, "https://a.org/vi/professional/2")]
    fixed_base = web.links(pages(spark), base=F.lit("https://b.org")).collect()
    assert [r.link for r in fixed_base][0] == "https://b.org/vi/professional/1"


def test_file_names(spark):
    titles = ["a", "b!", "a", "a?", "a_1", "b", "c"]
    arts = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "page_id long, title string")
    names = lambda df: [r.file_stem for r in df.orderBy("page_id").collect()]
    got = names(web.file_names(arts, "page_id"))
    assert got == ["a", "b", "a_2", "a_3", "a_1", "b_1", "c"] and len(set(got)) == len(got)
    existing = spark.createDataFrame([("b",), ("c_1",), ("c",), ("b_2",)], "file_stem string")
    got = names(web.file_names(arts, "page_id", existing))
    assert got == ["a", "b_1", "a_2", "a_3", "a_1", "b_3", "c_2"]


def test_one_title_for_most_pages(spark):
    arts = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("title"))
    got = web.file_names(arts, "page_id", buckets=16)
    assert got.select("file_stem").distinct().count() == 3000
    assert got.filter("file_stem = 'same'").first().page_id == 1


def test_article_text(spark):
    df = spark.createDataFrame([("T", "u", "body", [("s", "one"), ("t", "two")])], "t string, u string, c string, s array<struct<title:string,content:string>>")
    rule = "=" * 80
    assert df.select(web.article_text(F.col("t"), F.col("u"), F.col("c"), F.col("s"))).first()[0] == (
        f"TIÊU ĐỀ: T\nURL: u\n{rule}\n\nNỘI DUNG:\n\nbody\n\n{rule}\nCÁC PHẦN CHI TIẾT:\n\n\n--- 1. s ---\n\none\n\n--- 2. t ---\n\ntwo\n"
    )


def test_few_pages_are_held_at_a_time(spark):
    def read(html, url):
        import tracemalloc

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        return html + url + "x" * 20_000, tracemalloc.get_traced_memory()[0]

    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "'h' AS html", "concat('u', id) AS url")
    got = with_pages_read(rows, "html", "text string, held long", read, "url")
    assert got.columns == ["id", "url", "text", "held"]
    least = got.agg(F.count_if(F.startswith("text", F.concat(F.lit("h"), "url", F.lit("xx")))).alias("n"), F.max("held").alias("held")).first()
    assert least.n == 5000 and least.held < 50_000_000  # all rows are 100 MB
