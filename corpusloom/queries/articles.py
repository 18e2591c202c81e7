"""Article texts to structured documents. The article texts are built from the
documents table, one layout variant per language, so that every branch of the
parser runs over all rows."""

from pyspark.sql import functions as F

from corpusloom.functions import article, fixed
from corpusloom.functions.text import clean_text, document_id
from corpusloom.operators import documents
from corpusloom.queries import query, sqltext as S
from corpusloom.session import table

_NL = "\n\n"


def article_texts(spark, d):
    """documents -> (doc_id, file_name, value) in the article layout: German
    ones have no revision line, Spanish ones no body mark."""
    lines = F.split("text", "\n")
    docs = table(spark, d, "documents", spread=True).select(
        "doc_id", "lang", "source", "text",
        clean_text(lines[0]).alias("title"), lines[0].alias("who"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("l2"),
        F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("l3"),
    )
    number = F.col("doc_id").cast("string")
    revision = F.when(
        F.col("lang") != "de", F.concat(F.lit("Đã xem xét/Đã chỉnh sửa\n\nThg 7 2024\n\n|\n\nv"), number, F.lit("_vi" + _NL))
    ).otherwise("")
    body_mark = F.when(F.col("lang") != "es", F.lit(fixed.BODY_MARK + _NL)).otherwise("")
    text = F.concat(
        F.lit("TIÊU ĐỀ: "), "title", F.lit("\nURL: doc:"), number, F.lit("\n" + fixed.RULE + _NL), body_mark,
        "title", F.lit("\n\nTheo\n\n"), "who", F.lit("\n\n,\n\nMD\n\n,\n\n"), "source", F.lit(" University\n\nXem xét bởi\n\n"),
        "l2", F.lit(",\n\nMD\n\n"), revision, "who", F.lit("\n\n(Xem thêm\n\n"), "l2",
        F.lit(" và xem "), "l3", F.lit(".)\n\nCăn nguyên\n\n"), "l2", F.lit("\n\nChẩn đoán | Điều trị\n\n"), "l3",
        F.lit("\n\n| Tiên lượng |\n\nTriệu chứng Các biến chứng Phân loại "), "text", F.lit("\n\nCăn nguyên\n\n"), "l3",
        F.lit("\n\nTest your Knowledge\n\nTake a Quiz!\n\nBản quyền\n"),
    )
    return docs.select("doc_id", F.concat("source", F.lit(", "), "title", F.lit(".txt")).alias("file_name"), text.alias("value"))


_N = "chr(10) || chr(10)"
_SQL_ARTICLES = f"""src AS (SELECT doc_id, lang, source, text, {S.clean("string_split(text, chr(10))[1]")} AS title,
  string_split(text, chr(10))[1] AS who,
  coalesce(string_split(text, chr(10))[2], '') AS l2, coalesce(string_split(text, chr(10))[3], '') AS l3 FROM documents),
files AS (SELECT doc_id, source || ', ' || title || '.txt' AS file_name,
  'TIÊU ĐỀ: ' || title || chr(10) || 'URL: doc:' || doc_id || chr(10) || repeat('=', 80) || {_N}
  || CASE WHEN lang <> 'es' THEN 'NỘI DUNG:' || {_N} ELSE '' END || title || {_N} || 'Theo' || {_N} || who || {_N} || ',' || {_N} || 'MD' || {_N} || ',' || {_N}
  || source || ' University' || {_N} || 'Xem xét bởi' || {_N} || l2 || ',' || {_N} || 'MD' || {_N}
  || CASE WHEN lang <> 'de' THEN 'Đã xem xét/Đã chỉnh sửa' || {_N} || 'Thg 7 2024' || {_N} || '|' || {_N} || 'v' || doc_id || '_vi' || {_N} ELSE '' END
  || who || {_N} || '(Xem thêm' || {_N} || l2 || ' và xem ' || l3 || '.)' || {_N}
  || 'Căn nguyên' || {_N} || l2 || {_N} || 'Chẩn đoán | Điều trị' || {_N} || l3 || {_N} || '| Tiên lượng |' || {_N}
  || 'Triệu chứng Các biến chứng Phân loại ' || text || {_N} || 'Căn nguyên' || {_N} || l3 || {_N}
  || 'Test your Knowledge' || {_N} || 'Take a Quiz!' || {_N} || 'Bản quyền' || chr(10) AS value FROM src)"""


def _any(e: str, parts) -> str:
    return "(" + " OR ".join(f"contains({e}, {S.lit(p)})" for p in parts) + ")"


def _person_sql(block: str, organisations) -> str:
    names = f"""list_filter(list_transform(string_split({block}, chr(10)), lambda x: {S.strip('x')}),
        lambda x: NOT list_contains([{', '.join(S.lit(t) for t in fixed.DEGREES)}], x) AND NOT {_any('x', organisations)}
        AND length(x) > 5 AND length(x) < 50 AND regexp_matches(x, '\\p{{L}}'))"""
    return f"""coalesce({S.strip(f"regexp_replace(({names})[1], ',+$', '')")}, '')"""


# the earlier of two ends: RE2 has no look-ahead, a lazy group with either end is the same
_AUTHOR = f"regexp_extract(value, '(?s)Theo[{S.SPACE}]+(.*?)(?:Xem xét bởi|Đã xem xét)', 1)"
_REVIEWER = f"regexp_extract(value, '(?s)Xem xét bởi[{S.SPACE}]+(.*?)Đã xem xét', 1)"


@query(
    "article_people",
    f"""WITH {_SQL_ARTICLES} SELECT doc_id, {_person_sql(_AUTHOR, fixed.AUTHOR_ORGANISATIONS)} AS author,
    {_person_sql(_REVIEWER, fixed.REVIEWER_ORGANISATIONS)} AS reviewer FROM files""",
)
def article_people(spark, d):
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    return article_texts(spark, d).select(
        "doc_id",
        first(article.authors(F.col("value"))).alias("author"),
        first(article.reviewers(F.col("value"))).alias("reviewer"),
    )


_LINES = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"


def _main_sql() -> str:
    footer = "CASE " + " ".join(
        f"WHEN contains(main, {S.lit(f)}) THEN substring(main, 1, instr(main, {S.lit(f)}) - 1)" for f in fixed.FOOTERS
    ) + " ELSE main END"
    return f"""b AS (SELECT *, CASE WHEN contains(value, 'NỘI DUNG:') THEN substring(value, instr(value, 'NỘI DUNG:') + 9) END AS body FROM files),
    r AS (SELECT *, regexp_replace(body, '(?s)^.*?Đã xem xét/Đã chỉnh sửa.*?v[0-9]+_vi', '') AS rest, {_LINES} AS ls FROM b),
    h AS (SELECT *, list_position(list_transform(ls, lambda x: {_any('x', fixed.HEADER_WORDS)}), false) AS p FROM r),
    m AS (SELECT *, CASE WHEN body IS NULL THEN NULL WHEN length(rest) < length(body) THEN rest
        WHEN coalesce(p, 0) > 0 THEN array_to_string(ls[p:], ' ') ELSE '' END AS main FROM h),
    docs AS (SELECT doc_id, file_name, value, CASE WHEN body IS NULL THEN value ELSE {S.clean(footer)} END AS content FROM m)"""


@query("article_content", f"WITH {_SQL_ARTICLES}, {_main_sql()} SELECT doc_id, content FROM docs")
def article_content(spark, d):
    parsed = documents.parse_articles(_with_id(article_texts(spark, d)), "site")
    return parsed.select(_doc_number(), "content")


def _with_id(files):
    """Carry the row number in the file name, so that it comes back as the id."""
    return files.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "value")


def _doc_number():
    return F.col("id").cast("long").alias("doc_id")


_GROUPS = f"regexp_extract_all(value, '\\(Xem thêm[{S.SPACE}]+([^)]+)\\)', 1)"
_PIECES = f"""list_transform(flatten(list_transform({_GROUPS},
    lambda g: string_split_regex(g, '[{S.SPACE}]+và[{S.SPACE}]+(?:xem[{S.SPACE}]+)?'))), lambda x: trim(x, '. '))"""
_KEPT = f"""list_transform(list_filter({_PIECES}, lambda x: length(x) > 20 AND length(x) < 150 AND NOT {_any('x', fixed.REFERENCE_STOPS)}),
    lambda x: {S.clean('x')})"""


@query(
    "article_references",
    f"""WITH {_SQL_ARTICLES}, k AS (SELECT doc_id, {_KEPT} AS refs FROM files),
    u AS (SELECT doc_id, unnest(refs) AS reference, generate_subscripts(refs, 1) AS i FROM k),
    f AS (SELECT doc_id, reference, min(i) AS i FROM u GROUP BY ALL),
    n AS (SELECT doc_id, reference, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM f)
    SELECT * FROM n WHERE position < 10""",
)
def article_references(spark, d):
    refs = article_texts(spark, d).select("doc_id", article.references(F.col("value")).alias("r"))
    return refs.select("doc_id", F.posexplode_outer("r").alias("position", "reference")).filter("reference is not null")


def _sections_sql() -> str:
    heads = ", ".join(S.lit(h) for h in fixed.SECTION_HEADERS)
    sp = f"[{S.SPACE}]"
    return f"""hh AS (SELECT unnest([{heads}]) AS h),
    sp AS (SELECT doc_id, content, h, string_split(content, h) AS ps FROM docs JOIN hh ON contains(content, h)),
    occ AS (SELECT doc_id, content, h, unnest(range(1, len(ps))) AS i, ps FROM sp),
    pos AS (SELECT doc_id, content, h, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + i * length(h) AS e FROM occ),
    gap AS (SELECT *, substring(content, e + 1) AS tail, length(regexp_extract(substring(content, e + 1), '^{sp}+')) AS ws,
        regexp_matches(substring(content, 1, e - length(h)), '\\|{sp}*$') AND regexp_matches(substring(content, e + 1), '^{sp}*\\|') AS piped FROM pos),
    cand AS (SELECT doc_id, content, h, CASE WHEN piped THEN e + length(regexp_extract(tail, '^{sp}*\\|')) ELSE e + ws END AS s FROM gap
        WHERE piped OR (ws > 0 AND regexp_matches(substring(tail, ws + 1, 1), '[{fixed.SECTION_CAPITALS}]')
        AND len(list_filter([{heads}], lambda o: o <> h AND contains(substring(tail, ws + 1, 50), o))) = 0)),
    ends AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM cand),
    txt AS (SELECT doc_id, h AS header, s, regexp_replace({S.strip("substring(content, s + 1, coalesce(nxt, length(content)) - s)")}, '^[| \\n\\t]+', '') AS t FROM ends),
    ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, header ORDER BY s DESC) AS last FROM txt WHERE length(t) > 50 AND length(t) < 20000),
    secs AS (SELECT doc_id, header, {S.clean('t')} AS section_text FROM ok WHERE last = 1)"""


@query(
    "article_sections",
    f"WITH {_SQL_ARTICLES}, {_main_sql()}, {_sections_sql()} SELECT doc_id, header, section_text FROM secs",
)
def article_sections(spark, d):
    parsed = documents.parse_articles(_with_id(article_texts(spark, d)), "site")
    rows = parsed.select(_doc_number(), F.explode_outer("sections").alias("header", "section_text"))
    return rows.filter("header is not null")


@query(
    "article_ids",
    f"""WITH {_SQL_ARTICLES} SELECT doc_id, replace(replace(lower(regexp_replace(file_name, '\\.[^.]*$', '')), ' ', '_'), ',', '') AS id FROM files""",
)
def article_ids(spark, d):
    return article_texts(spark, d).select("doc_id", document_id(F.replace(F.url_encode("file_name"), F.lit("+"), F.lit("%20"))).alias("id"))


@query(
    "corpus_statistics",
    f"""WITH {_SQL_ARTICLES}, {_main_sql()}, {_sections_sql()},
    k AS (SELECT doc_id, len(list_distinct({_KEPT})) AS n FROM files),
    p AS (SELECT {_person_sql(_AUTHOR, fixed.AUTHOR_ORGANISATIONS)} AS a, {_person_sql(_REVIEWER, fixed.REVIEWER_ORGANISATIONS)} AS r FROM files)
    SELECT count(*) AS documents, sum(length(content))::BIGINT AS characters, (sum(length(content)) // count(*))::BIGINT AS characters_per_document,
    (SELECT count(*) FROM secs) AS sections, (SELECT sum(least(n, 10))::BIGINT FROM k) AS "references",
    (SELECT count(*) FROM p WHERE a <> '') AS with_author, (SELECT count(*) FROM p WHERE r <> '') AS with_reviewer FROM docs""",
)
def corpus_statistics(spark, d):
    return documents.statistics(documents.parse_articles(_with_id(article_texts(spark, d)), "site"))


@query(
    "instruction_rows",
    f"""WITH {_SQL_ARTICLES}, {_main_sql()}, {_sections_sql()},
    t AS (SELECT doc_id, title, 'doc:' || doc_id AS url FROM src)
    SELECT title || ' là gì?' AS instruction, '' AS input, {S.ellipsis('content', 500)} AS output, url AS source, {S.strip('title')} AS title, NULL AS section
    FROM (SELECT doc_id, content, {S.strip('title')} AS title, url FROM docs JOIN t USING (doc_id))
    UNION ALL SELECT 'Giải thích về ' || lower(header) || ' của ' || {S.strip('title')}, '', section_text, url, {S.strip('title')}, header
    FROM secs JOIN t USING (doc_id) WHERE length(section_text) > 50""",
)
def instruction_rows(spark, d):
    rows = documents.instruction_rows(documents.parse_articles(_with_id(article_texts(spark, d)), "site"))
    return rows.select("instruction", "input", "output", "metadata.source", "metadata.title", "metadata.section")
