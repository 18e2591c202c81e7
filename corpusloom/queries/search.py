"""Vectors, nearest neighbours and prompts. Questions are the benchmark texts;
the corpus is every document, cut into windows."""

from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import sign_planes
from corpusloom.operators import chunking, dialogue, retrieval
from corpusloom.plans import corpus, requests
from corpusloom.queries import conversations, query, sqltext as S
from corpusloom.queries.conversations import messages
from corpusloom.session import table


@query(
    "vector_report",
    "SELECT count(*) AS vectors, min(len(embedding)) AS min_dimensions, max(len(embedding)) AS max_dimensions FROM embeddings",
)
def vector_report(spark, d):
    return chunking.vector_report(table(spark, d, "embeddings"))


@query(
    "unit_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (label + 1))::FLOAT) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v)
    SELECT vec_id, unnest(range(0, len(v))) AS place, unnest(list_transform(v, lambda x: round(x::DOUBLE / n, 6))) AS x FROM n""",
)
def unit_vectors(spark, d):
    scaled = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")).alias("v")
    )
    rows = chunking.normalised(scaled, "v").select("vec_id", F.posexplode("v").alias("place", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    "encoded_documents",
    f"""WITH docs AS (SELECT doc_id AS id, {S.clean('text')} AS text FROM documents), {S.word_hash('docs').strip()}
    SELECT id AS doc_id, d AS place, round(w, 5) AS weight FROM enc_w""",
)
def encoded_documents(spark, d):
    docs = corpus.document_rows(table(spark, d, "documents", spread=True)).select("id", "content")
    rows = chunking.encode(docs, "content").select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("place", "w"))
    return rows.filter("w <> 0").select("doc_id", "place", F.round(F.col("w").cast("double"), 5).alias("weight"))


def _centroids(spark, d):
    """Mean vector per label: one query per class."""
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one number per dimension and label is collected
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(F.col("label").alias("query_id"), F.transform("v", lambda e: e["x"]).alias("embedding"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_CENTROID = """flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    cent AS (SELECT label AS query_id, i, avg(x) AS x FROM flat GROUP BY ALL),
    cn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM cent GROUP BY query_id),
    vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY vec_id),
    sims AS (SELECT query_id, f.vec_id AS id, round(sum(c.x * f.x) / (any_value(cn.n) * any_value(vn.n)), 6) AS similarity
        FROM cent c JOIN flat f USING (i) JOIN cn USING (query_id) JOIN vn ON vn.vec_id = f.vec_id GROUP BY query_id, f.vec_id)"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims {where}) WHERE rank <= 10"


@query("nearest_to_centroids", f"WITH {_CENTROID} SELECT query_id, id, similarity, rank FROM {_TOP.format(where='')}")
def nearest_to_centroids(spark, d):
    return retrieval.nearest(_vectors(spark, d), _centroids(spark, d), 10)


_BITS, _REACH = 6, 2


def _cells_sql() -> str:
    signs = ", ".join("[" + ", ".join(str(int(x)) for x in row) + "]" for row in sign_planes(_BITS, 64))

    def code(vector: str) -> str:
        dots = f"list_transform(ps, lambda p: list_sum(list_transform(list_zip(p, {vector}), lambda z: z[1] * z[2])))"
        return f"list_sum(list_transform({dots}, lambda x, i: CASE WHEN x > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT"

    return f"""pl AS (SELECT [{signs}] AS ps),
    vc AS (SELECT vec_id, {code('embedding')} AS cell FROM embeddings, pl),
    qv AS (SELECT query_id, list(x ORDER BY i) AS v FROM cent GROUP BY query_id),
    qc AS (SELECT query_id, {code('v')} AS cell FROM qv, pl)"""


@query(
    "nearest_in_cells",
    f"""WITH {_CENTROID}, {_cells_sql()} SELECT query_id, id, similarity, rank FROM {_TOP.format(
    where=f'JOIN qc USING (query_id) JOIN vc ON vc.vec_id = id WHERE bit_count(xor(qc.cell, vc.cell)) <= {_REACH}')}""",
)
def nearest_in_cells(spark, d):
    return retrieval.nearest(_vectors(spark, d), _centroids(spark, d), 10, _BITS, _REACH)


_PIVOTS, _PROBES = 128, 48


@query(
    "nearest_in_probes",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    pivots AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, v AS p FROM v ORDER BY vec_id LIMIT {_PIVOTS}),
    near AS (SELECT vec_id, v, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, p), 6) DESC, cell) AS n FROM v, pivots),
    sims AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity
        FROM near q JOIN near c ON q.cell = c.cell WHERE q.vec_id % 100 = 0 AND q.n <= {_PROBES} AND c.n = 1)
    SELECT query_id, id, similarity, rank FROM {_TOP.format(where='')}""",
)
def nearest_in_probes(spark, d):
    """Every hundredth vector against all, over the cells nearest to it. The pivots are the
    vectors with the smallest ids, so that SQL can repeat them."""
    vectors = _vectors(spark, d)
    first = vectors.orderBy("id").limit(_PIVOTS).toArrow()  # so many rows
    by = retrieval.PivotCells(retrieval._matrix(first.column("embedding")))
    asked = vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return retrieval.nearest(vectors, asked, 10, by=by, probes=_PROBES)


# --- questions against the chunked documents -------------------------------------


def chunks(spark, d):
    docs = corpus.document_rows(table(spark, d, "documents", spread=True))
    placed = chunking.with_position(docs, ["id"])
    return chunking.explode_chunks(placed, chunking.window_chunks(F.col("content"))).select("id", "title", "url", "content")


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def with_history(spark, d):
    """Questions with the last four messages of the session of their number."""
    last = dialogue.last_messages(messages(spark, d), 4).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("before")
    )
    asked = questions(spark, d).join(last, F.col("query_id") == F.col("session_id"), "left")
    before = F.coalesce("before", F.array().cast("array<struct<turn:bigint,role:string,content:string>>"))
    return asked.select("query_id", "question", dialogue.contextual_query(F.col("question"), before).alias("search_text"))


def hits(spark, d, asked=None, text="question"):
    found = corpus.vectors(chunks(spark, d))
    asked = chunking.encode(asked if asked is not None else questions(spark, d), text)
    return retrieval.nearest(found, asked, 10)


_CHUNKS = f"""dc AS (SELECT doc_id, {S.clean('text')} AS t, {S.clean("string_split(text, chr(10))[1]")} AS title,
    row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
    ds AS (SELECT *, unnest(range(0, greatest(1, ceil((length(t) - 200) / 800.0))::BIGINT)) AS i FROM dc WHERE length(t) > 0),
    chunks AS (SELECT doc_id || '_' || pos || '_chunk_' || i AS id, title, 'doc:' || doc_id AS url, substring(t, i * 800 + 1, 1000) AS content FROM ds),
    ctext AS (SELECT id, 'Tiêu đề: ' || title || chr(10) || 'Nội dung: ' || content AS text FROM chunks)"""


def _search(asked: str) -> str:
    return f"""{_CHUNKS}, {S.word_hash('ctext', 'ce').strip()}, {asked}, {S.word_hash('qtext', 'qe').strip()},
    dots AS (SELECT q.id AS query_id, c.id, sum(q.w * c.w) AS s FROM qe_w q JOIN ce_w c USING (d) GROUP BY q.id, c.id),
    sims AS (SELECT query_id, d.id, round(s / (a.l * b.l), 6) AS similarity FROM dots d JOIN qe_l a ON a.id = query_id JOIN ce_l b ON b.id = d.id),
    hits AS (SELECT * FROM {_TOP.format(where='')})"""


_PLAIN = "qtext AS (SELECT item_id AS id, text FROM benchmark)"


@query("nearest_chunks", f"WITH {_search(_PLAIN)} SELECT query_id, id, similarity, rank FROM hits")
def nearest_chunks(spark, d):
    return hits(spark, d)


@query("hit_rows", f"WITH {_search(_PLAIN)} SELECT query_id, rank, h.id, title, url, content FROM hits h JOIN chunks c ON c.id = h.id")
def hit_rows(spark, d):
    rows = retrieval.hit_rows(hits(spark, d), chunks(spark, d))
    return rows.select("query_id", "rank", "id", "title", "url", "content")


@query("relevant_hits", f"WITH {_search(_PLAIN)} SELECT query_id, id, similarity FROM hits WHERE similarity >= 0.75")
def relevant_hits(spark, d):
    return hits(spark, d).filter("similarity >= 0.75").select("query_id", "id", "similarity")


_GATED = """gated AS (SELECT item_id AS query_id, text AS question, coalesce(max(similarity), 0) AS top_similarity,
    CASE WHEN coalesce(max(similarity), 0) >= {t} THEN 'medical_question' ELSE 'chitchat' END AS intent,
    coalesce(max(similarity), 0) >= {t} AND coalesce(max(similarity), 0) >= {f} AS use_documents
    FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY ALL)"""


@query(
    "question_gates",
    f"""WITH {_search(_PLAIN)}, {_GATED.format(t=0.85, f=0.9)} SELECT query_id, top_similarity, intent, use_documents FROM gated""",
)
def question_gates(spark, d):
    out = retrieval.gates(questions(spark, d), hits(spark, d), 0.85, 0.9)
    return out.select("query_id", "top_similarity", "intent", "use_documents")


_CTX = f"""best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, title, content
        FROM hits h JOIN chunks c ON c.id = h.id WHERE similarity >= {{f}}),
    ctx AS (SELECT query_id, coalesce(string_agg('[' || title || ']: ' || {S.ellipsis('content', 1500)}, chr(10) || chr(10) ORDER BY place)
        FILTER (length({S.strip('content')}) >= 10 AND length({S.strip(S.ellipsis('content', 1500))}) > 10), '') AS context FROM best WHERE place <= 2 GROUP BY query_id)"""


@query("document_contexts", f"WITH {_search(_PLAIN)}, {_CTX.replace("{f}", "0.75")} SELECT query_id, context FROM ctx")
def document_contexts(spark, d):
    rows = retrieval.hit_rows(hits(spark, d), chunks(spark, d))
    return retrieval.document_context(rows, 0.75)


@query(
    "usable_chunks",
    f"""WITH {_CHUNKS} SELECT id FROM chunks WHERE length({S.strip('content')}) >= 10 AND length({S.strip(S.ellipsis('content', 1500))}) > 10""",
)
def usable_chunks(spark, d):
    rows = chunks(spark, d)
    return rows.filter((F.length(strip("content")) >= 10) & (F.length(strip("content")) > 10)).select("id")


_HISTORY = """lastm AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
    hist AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Bot: ' END || substring(text, 1, 100) || '...', chr(10) ORDER BY turn) AS h
        FROM lastm WHERE rn <= 4 GROUP BY conv_id),
    qtext AS (SELECT item_id AS id, CASE WHEN h IS NULL THEN text ELSE 'Lịch sử:' || chr(10) || h || chr(10) || chr(10) || 'Câu hỏi mới: ' || text END AS text
        FROM benchmark LEFT JOIN hist ON conv_id = item_id)"""
_USER = f"""CASE WHEN intent = 'medical_question' AND length({S.strip("c")}) > 50 THEN 'Tài liệu y tế:' || chr(10) || c || chr(10) || chr(10)
        || 'Dựa vào tài liệu trên, trả lời câu hỏi: ' || question
    WHEN intent = 'medical_question' THEN 'Câu hỏi: ' || question || chr(10) || '(Không tìm thấy tài liệu liên quan, trả lời theo kiến thức chung)'
    ELSE question END"""


@query(
    "question_prompts",
    f"""WITH {_search(_HISTORY)}, {_GATED.format(t=0.3, f=0.4)}, {_CTX.replace("{f}", "0.4")},
    j AS (SELECT g.*, CASE WHEN use_documents THEN coalesce(context, '') ELSE '' END AS c FROM gated g LEFT JOIN ctx USING (query_id))
    SELECT query_id, CASE WHEN intent = 'medical_question' THEN {S.lit(fixed.SYSTEM_DOMAIN)} ELSE {S.lit(fixed.SYSTEM_CHAT)} END AS system_text,
    {_USER} AS user_text, CASE WHEN intent = 'medical_question' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS temperature,
    CASE WHEN intent = 'medical_question' THEN 2048 ELSE 150 END AS max_tokens FROM j""",
)
def question_prompts(spark, d):
    texts = chunks(spark, d)
    out = corpus.answers(with_history(spark, d), corpus.vectors(texts), texts)
    return out.select("query_id", "system_text", "user_text", "settings.temperature", "settings.max_tokens")


_REQUESTS = f"""{S.MESSAGES}, q AS (SELECT item_id AS session_id, text AS question FROM benchmark),
    log AS (SELECT m.*, question FROM messages m JOIN q USING (session_id))"""


@query(
    "session_prompts",
    f"""WITH {_search(_HISTORY)}, {_GATED.format(t=0.3, f=0.4)}, {_CTX.replace("{f}", "0.4")},
    j AS (SELECT g.*, CASE WHEN use_documents THEN coalesce(context, '') ELSE '' END AS c FROM gated g LEFT JOIN ctx USING (query_id)),
    hist_log AS (WITH {_REQUESTS}, {conversations._RECENT}, {conversations._SIMILAR}, {conversations._EXTRA},
        both_ AS (SELECT session_id, role, content, place AS o FROM recent UNION ALL SELECT session_id, role, content, 3 + rank FROM extra)
        {conversations._HISTORY_OUT} FROM both_ GROUP BY session_id)
    SELECT query_id, {_USER} AS user_text, coalesce(history, '') AS history FROM j LEFT JOIN hist_log ON session_id = query_id""",
)
def session_prompts(spark, d):
    """Benchmark questions as requests in the conversations of their number."""
    texts = chunks(spark, d)
    asked = questions(spark, d).withColumn("session_id", F.col("query_id"))
    out = requests.session_prompts(asked, messages(spark, d), corpus.vectors(texts), texts)
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.select("query_id", "user_text", F.array_join(lines, "\n").alias("history"))


@query(
    "prompt_branches",
    f"""WITH q AS (SELECT doc_id, text AS question, CASE WHEN n_chars % 3 = 0 THEN 'chitchat' ELSE 'medical_question' END AS intent,
    CASE WHEN n_chars % 5 = 0 THEN '' ELSE text END AS c FROM documents) SELECT doc_id, {_USER} AS user_text FROM q""",
)
def prompt_branches(spark, d):
    """Prompt assembly over all documents, so that every branch is taken."""
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.col("text").alias("question"),
        F.when(F.col("n_chars") % 3 == 0, fixed.INTENT_CHAT).otherwise(fixed.INTENT_DOMAIN).alias("intent"),
        F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("text")).alias("context"),
    )
    return dialogue.prompts(rows).select("doc_id", "user_text")
