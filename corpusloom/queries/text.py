"""Text cleaning, cutting, chunking, splitting."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import batches, chunking, documents
from corpusloom.plans import corpus
from corpusloom.queries import query, sqltext as S
from corpusloom.session import table


@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents", spread=True).select("doc_id", T.clean_text("text").alias("cleaned"))


@query(
    "normalized_text",
    f"""SELECT conv_id, turn, nfc_normalize({S.strip("text")}) AS normalized FROM conversations""",
)
def normalized_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.nfc("text").alias("normalized"))


@query(
    "truncated_text",
    f"""SELECT doc_id, {S.ellipsis('text', 500)} AS intro, {S.ellipsis('text', 1500)} AS context,
        {S.ellipsis('text', 150)} AS history, {S.ellipsis('text', 200)} AS listing,
        substring(text, 1, 100) || '...' AS query_part, substring(text, 1, 250) AS plain FROM documents""",
)
def truncated_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        T.ellipsis("text", 500).alias("intro"),
        T.ellipsis("text", 1500).alias("context"),
        T.ellipsis("text", 150).alias("history"),
        T.ellipsis("text", 200).alias("listing"),
        T.always_ellipsis("text", 100).alias("query_part"),
        T.cut("text", 250).alias("plain"),
    )


@query(
    "document_preview",
    "SELECT doc_id, lang, source, substring(text, 1, 200) || '...' AS content FROM documents ORDER BY doc_id LIMIT 1",
)
def document_preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("text").alias("content"))
    return documents.first_preview(docs, "doc_id")


@query("nonempty_documents", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 0")
def nonempty_documents(spark, d):
    return table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", "n_chars")


_PARTS = f"""SELECT doc_id, trim(p, '. ') AS part FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents)"""


@query(
    "plausible_lines",
    f"""SELECT DISTINCT doc_id, part FROM ({_PARTS}) WHERE length(part) > 20 AND length(part) < 150
        AND NOT contains(part, 'Thg') AND NOT contains(part, '_vi')""",
)
def plausible_lines(spark, d):
    parts = F.transform(F.split("text", "\n"), lambda p: F.trim(p, F.lit(". ")))
    kept = F.filter(
        parts,
        lambda p: (F.length(p) > 20) & (F.length(p) < 150) & ~F.contains(p, F.lit("Thg")) & ~F.contains(p, F.lit("_vi")),
    )
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(kept).alias("parts"))
    return docs.select("doc_id", F.explode("parts").alias("part"))


@query(
    "window_chunks",
    f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS t, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
    s AS (SELECT *, unnest(range(0, greatest(1, ceil((length(t) - 200) / 800.0))::BIGINT)) AS i FROM c WHERE length(t) > 0)
    SELECT doc_id || '_' || pos || '_chunk_' || i AS id, substring(t, i * 800 + 1, 1000) AS content FROM s""",
)
def window_chunks(spark, d):
    docs = corpus.document_rows(table(spark, d, "documents", spread=True))
    placed = chunking.with_position(docs, ["id"])
    return chunking.explode_chunks(placed, chunking.window_chunks(F.col("content"))).select("id", "content")


def _level(n: int) -> str:
    """SQL of one splitting level: pieces that are too long go one separator
    down, each maximal row of short ones becomes a run."""
    return f"""
p{n}a AS (SELECT doc_id, path, left_seps, t, list_filter(left_seps, lambda s: contains(t, s)) AS found FROM p{n}),
p{n}b AS (SELECT *, CASE WHEN len(found) > 0 THEN found[1] END AS sep FROM p{n}a),
p{n}c AS (SELECT doc_id, path, CASE WHEN sep IS NULL THEN [] ELSE left_seps[list_position(left_seps, sep) + 1:] END AS finer,
    CASE WHEN sep IS NULL THEN [t] ELSE list_filter(list_transform(string_split(t, sep),
    lambda x, i: CASE WHEN i = 1 THEN x ELSE sep || x END), lambda x: x <> '') END AS pieces FROM p{n}b),
p{n}d AS (SELECT doc_id, path, finer, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p{n}c),
p{n}e AS (SELECT *, length(piece) >= 1000 AS big, count(*) FILTER (length(piece) >= 1000) OVER (PARTITION BY doc_id, path ORDER BY i) AS r FROM p{n}d),
p{n + 1} AS (SELECT doc_id, list_append(path, i) AS path, finer AS left_seps, piece AS t FROM p{n}e WHERE big AND len(finer) > 0),
w{n} AS (SELECT doc_id, list_append(path, i) AS path, piece AS content FROM p{n}e WHERE big AND len(finer) = 0),
r{n} AS (SELECT doc_id, list_append(path, min(i)) AS path, list(piece ORDER BY i) AS ps FROM p{n}e WHERE NOT big GROUP BY doc_id, path, r)"""


def _recursive_chunks_sql() -> str:
    levels = ",".join(_level(n) for n in range(6))
    runs = " UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(6))
    whole = " UNION ALL ".join(f"SELECT doc_id, path, 0 AS k, content FROM w{n}" for n in range(6))
    return f"""WITH RECURSIVE c AS (SELECT doc_id, {S.clean('text')} AS t, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
p0 AS (SELECT doc_id, []::BIGINT[] AS path, [chr(10) || chr(10), chr(10), '. ', ', ', ' '] AS left_seps, t FROM c WHERE length(t) > 0),
{levels},
runs AS (SELECT doc_id, path, ps, list_transform(ps, lambda x, i: list_sum(list_transform(ps[1:i], lambda y: length(y)))) AS ends FROM ({runs})),
g AS (
  SELECT doc_id, path, 0 AS k, ps, ends, 1 AS a, greatest(1, len(list_filter(ends, lambda x: x <= 1000))) AS b FROM runs
  UNION ALL
  SELECT doc_id, path, k + 1, ps, ends, a2,
    greatest(b + 1, len(list_filter(ends, lambda x: x - (CASE WHEN a2 = 1 THEN 0 ELSE ends[a2 - 1] END) <= 1000))) AS b
  FROM (SELECT *, coalesce(list_min(list_filter(range(a, b + 1), lambda s: ends[b] - (CASE WHEN s = 1 THEN 0 ELSE ends[s - 1] END) <= 200
      AND ends[b + 1] - (CASE WHEN s = 1 THEN 0 ELSE ends[s - 1] END) <= 1000)), b + 1) AS a2 FROM g WHERE b < len(ps))
),
cut AS (SELECT doc_id, path, k, {S.strip("list_reduce(ps[a:b], lambda x, y: x || y)")} AS content FROM g),
al AS (SELECT * FROM cut WHERE content <> '' UNION ALL {whole}),
num AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path, k) - 1 AS j, content FROM al)
SELECT doc_id || '_' || pos || '_chunk_' || j AS id, content FROM num JOIN c USING (doc_id)"""


@query("recursive_chunks", _recursive_chunks_sql())
def recursive_chunks(spark, d):
    return corpus.chunked(corpus.document_rows(table(spark, d, "documents", spread=True))).select("id", "content")


@query("embed_text", f"""SELECT doc_id AS id, 'Tiêu đề: ' || {S.clean("string_split(text, chr(10))[1]")} || chr(10) || 'Nội dung: ' || {S.clean('text')} AS embed_text FROM documents""")
def embed_text(spark, d):
    docs = corpus.document_rows(table(spark, d, "documents", spread=True))
    return docs.select("id", chunking.embed_text("title", "content").alias("embed_text"))


@query(
    "train_test_split",
    f"""SELECT doc_id, CASE WHEN {S.md5_number("'0:' || doc_id")} % 100 < 10 THEN 'test' ELSE 'train' END AS part FROM documents""",
)
def train_test_split(spark, d):
    return table(spark, d, "documents").select("doc_id", batches.split_part(F.col("doc_id")).alias("part"))
