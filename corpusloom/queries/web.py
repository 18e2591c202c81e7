"""Pages: extraction, naming, links, url bookkeeping."""

from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import safe_stem
from corpusloom.operators import web
from corpusloom.queries import query, sqltext as S
from corpusloom.session import table
from corpusloom.sources import sitemaps


def _unescape(e: str) -> str:
    # these names also count without the semicolon; the ampersand comes last
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        e = f"regexp_replace({e}, '&{name};?', {S.lit(char)}, 'g')"
    return e


_TITLE = S.strip(_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))
_BODY = f"""array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>'),
    lambda x: {S.strip(_unescape('x'))}), lambda x: x <> ''), chr(10) || chr(10))"""
ARTICLES = f"arts AS (SELECT page_id, url, {_TITLE} AS title, {_BODY} AS content FROM pages)"
COMPLETE = "SELECT * FROM arts WHERE title <> '' AND content <> ''"


def articles(spark, d):
    return web.articles(table(spark, d, "pages", spread=True))


@query("page_articles", f"WITH {ARTICLES} SELECT page_id, title, content FROM arts")
def page_articles(spark, d):
    return articles(spark, d).select("page_id", "title", "content")


@query(
    "built_sections",
    f"""WITH l AS (SELECT doc_id, i, {S.strip('line')} AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
    s AS (SELECT doc_id, i // 4 AS g, max(line) FILTER (i % 4 = 0) AS title,
        string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (i % 4 <> 0 AND line <> '') AS content FROM l GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS position, title, content FROM s WHERE content IS NOT NULL""",
)
def built_sections(spark, d):
    """Documents as pages: every fourth line is a header, of one of three levels, and every
    third line behind a header stands deeper."""
    escaped = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))

    def element(line, i):
        level = (F.floor(i / 4) % 3 + 2).cast("string")
        deep = F.concat(F.lit("<div><ul><li>"), line, F.lit("</li></ul></div>"))
        head = F.concat(F.lit("<h"), level, F.lit(">"), line, F.lit("</h"), level, F.lit(">"))
        return F.when(i % 4 == 0, head).when(i % 4 == 3, deep).otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>")))

    body = F.array_join(F.transform(F.split(escaped, "\n"), element), "\n")
    html = F.concat(F.lit("<html><body><h1>t</h1><main>"), body, F.lit("</main></body></html>"))
    pages = table(spark, d, "documents", spread=True).filter("text IS NOT NULL").select("doc_id", html.alias("html"))
    rows = web.articles(pages).select("doc_id", F.posexplode("sections").alias("position", "s"))
    return rows.select("doc_id", "position", F.col("s.title").alias("title"), F.col("s.content").alias("content"))


@query("page_sections")
def page_sections(spark, d):
    arts = articles(spark, d).select("page_id", F.posexplode_outer("sections").alias("position", "s"))
    return arts.select("page_id", "position", F.col("s.title").alias("title"), F.col("s.content").alias("content"))


@query("complete_articles", f"WITH {ARTICLES} SELECT page_id, url, title FROM ({COMPLETE})")
def complete_articles(spark, d):
    return web.complete(articles(spark, d)).select("page_id", "url", "title")


@query("safe_file_stems", f"WITH {ARTICLES} SELECT page_id, {S.stem('title')} AS stem FROM arts")
def safe_file_stems(spark, d):
    return articles(spark, d).select("page_id", safe_stem("title").alias("stem"))


@query(
    "unique_file_stems",
    f"""WITH {ARTICLES}, s AS (SELECT page_id, {S.stem('title')} AS stem FROM ({COMPLETE})),
    n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) - 1 AS k FROM s)
    SELECT page_id, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS file_stem FROM n""",
)
def unique_file_stems(spark, d):
    return web.file_names(web.complete(articles(spark, d)), "page_id").select("page_id", "file_stem")


@query(
    "article_files",
    f"""WITH {ARTICLES} SELECT page_id, 'TIÊU ĐỀ: ' || title || chr(10) || 'URL: ' || url || chr(10) || repeat('=', 80)
    || chr(10) || chr(10) || 'NỘI DUNG:' || chr(10) || chr(10) || content || chr(10) || chr(10) AS value FROM ({COMPLETE})""",
)
def article_files(spark, d):
    text = web.article_text(F.col("title"), F.col("url"), F.col("content"), F.col("sections"))
    return web.complete(articles(spark, d)).select("page_id", text.alias("value"))


_LINKS = f"""links AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM
    (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages))"""


@query(
    "page_links",
    f"""WITH {_LINKS}, f AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_unescape('href')} AS link, min(i) AS i
    FROM links WHERE contains(href, '/') GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position, link FROM f""",
)
def page_links(spark, d):
    return web.links(table(spark, d, "pages", spread=True), "/")


@query("site_pages", "SELECT page_id, url FROM pages WHERE contains(url, '/en/')")
def site_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url").filter(F.contains("url", F.lit("/en/")))


@query(
    "unseen_pages",
    """WITH visited AS (SELECT url FROM pages WHERE contains(url, '?') OR contains(url, '#'))
    SELECT page_id, p.url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.url = p.url)""",
)
def unseen_pages(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    visited = urls.filter(F.contains("url", F.lit("?")) | F.contains("url", F.lit("#"))).select("url")
    return web.unseen(urls, visited)


@query("visited_urls", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def visited_urls(spark, d):
    urls = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return urls.dropDuplicates(["url"])


@query("first_urls", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 50")
def first_urls(spark, d):
    return web.first_urls(table(spark, d, "pages").select("page_id", "url"), "page_id", 50)


@query(
    "crawl_report",
    f"WITH {ARTICLES} SELECT (SELECT count(*) FROM ({COMPLETE})) AS stored, (SELECT count(*) FROM arts) AS total",
)
def crawl_report(spark, d):
    return web.crawl_report(articles(spark, d))


_FIVE = "list_slice(string_split(value, chr(10)), 1, 5)"


def header_sql(mark: str) -> str:
    hit = f"list_filter({_FIVE}, lambda l: starts_with(l, '{mark}'))"
    return f"coalesce({S.strip(f'replace(({hit})[-1], {S.lit(mark)}, {S.lit(str())})')}, '')"


@query(
    "page_metadata",
    f"""WITH {ARTICLES}, f AS (SELECT page_id, '{fixed.TITLE_MARK} ' || title || chr(10) || '{fixed.URL_MARK} ' || url || chr(10) AS value FROM arts)
    SELECT page_id, {header_sql(fixed.TITLE_MARK)} AS title, {header_sql(fixed.URL_MARK)} AS url, 'site' AS source, 'vi' AS language FROM f""",
)
def page_metadata(spark, d):
    from corpusloom.functions import article

    text = web.article_text(F.col("title"), F.col("url"), F.col("content"), F.col("sections"))
    files = articles(spark, d).select("page_id", text.alias("value"))
    return files.select("page_id", article.metadata(F.col("value"), "site").alias("m")).select("page_id", "m.*")


@query(
    "sitemap_pages",
    """SELECT url FROM pages WHERE contains(url, '/en/') AND (page_id // 20) % 4 <> 3
    UNION ALL SELECT url FROM pages WHERE contains(url, '/en/') AND page_id // 20 = 0""",
)
def sitemap_pages(spark, d):
    """Sitemaps of 20 pages each, built from the pages; every fourth is not named as wanted. Ten
    of them are listed by an index, these by one more, which names itself,
    a copy of the first one, whose pages so come twice, and one that was not fetched."""
    pages = table(spark, d, "pages").select("url", F.expr("page_id div 20").alias("n"))
    name = F.when(F.col("n") % 4 == 3, "media").otherwise("topic")
    own = F.concat(F.lit("https://maps.example/"), F.col("n").cast("string"), F.lit("/"), name, F.lit(".xml"))

    def document(rows, key, root, tag, loc):
        escaped = F.replace(F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        item = F.concat(F.lit(f"<{tag}><loc> "), escaped, F.lit(f" </loc></{tag}>"))
        # 20 pages or 10 sitemaps in a list
        body = F.array_join(F.sort_array(F.collect_list(item)), "")
        head = f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        return rows.groupBy(key.alias("address")).agg(F.concat(F.lit(head), body, F.lit(f"</{root}>")).alias("xml"))

    leaves = document(pages, own, "urlset", "url", F.col("url"))
    named = pages.select("n", own.alias("loc")).distinct()
    index = F.concat(F.lit("https://maps.example/index"), F.expr("n div 10").cast("string"), F.lit("/topic.xml"))
    lists = document(named, index, "sitemapindex", "sitemap", F.col("loc"))
    top = named.select(index.alias("loc")).distinct()
    again = spark.createDataFrame([("http://maps.example/topic.xml",), ("https://maps.example/copy/topic.xml",), ("https://gone.example/topic.xml",)], "loc string")
    top = document(top.unionByName(again), F.lit("https://maps.example/topic.xml"), "sitemapindex", "sitemap", F.col("loc"))
    copy = document(pages.filter("n = 0"), F.lit("https://maps.example/copy/topic.xml"), "urlset", "url", F.col("url"))
    fetched = leaves.unionByName(lists).unionByName(top).unionByName(copy).withColumnRenamed("address", "url")
    roots = spark.createDataFrame([("https://maps.example/topic.xml",)], "url string")
    return sitemaps.sitemap_pages(fetched, roots, "topic.xml", "/en/")
