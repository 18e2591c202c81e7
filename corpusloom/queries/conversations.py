"""History, sessions, chat rows and chat templates over the conversations table."""

from pyspark.sql import functions as F

from corpusloom.functions import chat, fixed
from corpusloom.operators import dialogue
from corpusloom.operators.chunking import encode
from corpusloom.operators.ordering import bounded_window
from corpusloom.plans.requests import similar_by_request
from corpusloom.queries import query, sqltext as S
from corpusloom.session import new_folder, saved, table
from corpusloom.streaming.store import SessionStore

M = S.MESSAGES


def messages(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


def _last(n: int, rows: str = "messages") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM {rows}) WHERE rn <= {n}"""


_QA = """qa AS (SELECT session_id, turn, content AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(content) OVER w AS answer
    FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""


@query("qa_pairs", f"WITH {M}, {_QA} SELECT * FROM qa")
def qa_pairs(spark, d):
    return dialogue.qa_pairs(messages(spark, d))


@query(
    "turn_messages",
    f"""WITH {M}, {_QA} SELECT session_id, turn, 'user' AS role, question AS content FROM qa
    UNION ALL SELECT session_id, turn + 1, 'assistant', answer FROM qa""",
)
def turn_messages(spark, d):
    return dialogue.turn_rows(qa_pairs(spark, d))


@query("last_messages", f"WITH {M} SELECT session_id, turn, role, content FROM ({_last(3)})")
def last_messages(spark, d):
    return dialogue.last_messages(messages(spark, d), 3)


@query("one_session", f"WITH {M} SELECT turn, role, content FROM messages WHERE session_id = 3")
def one_session(spark, d):
    return dialogue.session_messages(messages(spark, d), 3).select("turn", "role", "content")


_BEFORE = """b AS (SELECT session_id, turn, role, content,
    list({'role': role, 'content': content}) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before FROM messages)"""


@query(
    "preceding_messages",
    f"""WITH {M}, {_BEFORE} SELECT session_id, turn, coalesce(len(before), 0) AS n,
    coalesce(array_to_string(list_transform(before, lambda m: m.role || ':' || m.content), chr(10)), '') AS before FROM b""",
)
def preceding_messages(spark, d):
    near = dialogue.preceding_messages(messages(spark, d))
    lines = F.transform("before", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return near.select("session_id", "turn", F.size("before").alias("n"), F.array_join(lines, "\n").alias("before"))


_CONTEXT = """'Lịch sử:' || chr(10) || array_to_string(list_transform(before, lambda m:
    CASE WHEN m.role = 'user' THEN 'User: ' ELSE 'Bot: ' END || substring(m.content, 1, 100) || '...'), chr(10))
    || chr(10) || chr(10) || 'Câu hỏi mới: ' || content"""


@query(
    "contextual_queries",
    f"""WITH {M}, {_BEFORE} SELECT session_id, turn, CASE WHEN coalesce(len(before), 0) = 0 THEN content ELSE {_CONTEXT} END AS query
    FROM b WHERE role = 'user'""",
)
def contextual_queries(spark, d):
    return dialogue.contextual_queries(messages(spark, d))


@query(
    "history_text",
    f"""WITH {M} SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' ||
    {S.ellipsis('content', 150)}, chr(10) ORDER BY turn) AS history FROM ({_last(6)}) GROUP BY session_id""",
)
def history_text(spark, d):
    return dialogue.history_texts(messages(spark, d))


@query(
    "session_list",
    f"WITH {M} SELECT session_id, count(*) AS messages, row_number() OVER (ORDER BY session_id) AS position FROM messages GROUP BY session_id",
)
def session_list(spark, d):
    return dialogue.sessions(messages(spark, d))


_TAIL = f"tail AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS number FROM ({_last(6)}))"


@query("session_history", f"WITH {M}, {_TAIL} SELECT session_id, number, turn, role, content FROM tail")
def session_history(spark, d):
    return dialogue.session_history(messages(spark, d), 3)


@query(
    "history_listing",
    f"""WITH {M}, {_TAIL} SELECT session_id, number, number || '. ' || CASE WHEN role = 'user' THEN '[NGƯỜI DÙNG]' ELSE '[TRỢ LÝ]' END || ':' || chr(10)
    || '   ' || {S.ellipsis('content', 200)} || chr(10) AS line FROM tail""",
)
def history_listing(spark, d):
    return dialogue.history_listing(messages(spark, d), 3)


@query(
    "history_export",
    f"""WITH {M}, {_TAIL} SELECT session_id, number AS piece, number || '. ' || CASE WHEN role = 'user' THEN 'NGƯỜI DÙNG' ELSE 'TRỢ LÝ' END || ':' || chr(10)
    || content || chr(10) || chr(10) AS text FROM tail
    UNION ALL SELECT DISTINCT session_id, 0, 'LỊCH SỬ CUỘC TRÒ CHUYỆN - Session: ' || session_id || chr(10) || repeat('=', 60) || chr(10) || chr(10) FROM tail""",
)
def history_export(spark, d):
    return dialogue.history_export(messages(spark, d), 3)


# --- history for a session's open question ------------------------------------

_OPEN = """q AS (SELECT session_id, max(turn) AS asked, arg_max(content, turn) AS question FROM messages WHERE role = 'user' GROUP BY session_id),
log AS (SELECT m.*, question FROM messages m JOIN q ON m.session_id = q.session_id AND m.turn < q.asked)"""
_RECENT = f"""recent AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS place FROM
    (SELECT session_id, turn, role, content FROM ({_last(3, 'log')})))"""
_HISTORY_OUT = """SELECT session_id, string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'model' END || ': ' || substring(content, 1, 250), chr(10) ORDER BY o) AS history"""


def _open(spark, d, keep=True):
    """Open questions and the messages before them; the latter are read several
    times, so they are joined once and kept."""
    rows = messages(spark, d)
    asked = dialogue.pending_questions(rows)
    log = dialogue.earlier_messages(rows, asked)
    return asked, saved(log) if keep else log


def _shown(history):
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return history.select("session_id", F.array_join(lines, "\n").alias("history"))


@query("pending_questions", f"WITH {M}, {_OPEN} SELECT session_id, asked AS turn, question FROM q")
def pending_questions(spark, d):
    return dialogue.pending_questions(messages(spark, d))


_SIMILAR = f"""lt AS (SELECT session_id || ':' || turn AS id, content AS text FROM log),
qt AS (SELECT session_id AS id, question AS text FROM q),
{S.word_hash('lt', 'le').strip()}, {S.word_hash('qt', 'qe').strip()},
dots AS (SELECT l.session_id, l.turn, sum(a.w * b.w) AS s FROM log l JOIN le_w a ON a.id = l.session_id || ':' || l.turn
    JOIN qe_w b ON b.id = l.session_id AND b.d = a.d GROUP BY ALL),
sims AS (SELECT l.*, round(coalesce(s, 0), 6) AS similarity FROM log l LEFT JOIN dots USING (session_id, turn)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY similarity DESC, turn) AS rank FROM sims) WHERE rank <= 5)"""


def _similar(asked, log):
    asked = encode(asked.withColumnRenamed("turn", "asked_at"), "question", "question_embedding")
    vectors = encode(log.drop("question"), "content")
    key = ["session_id", "asked_at"]
    return dialogue.similar_messages(vectors.join(asked.drop("question"), key))


@query("similar_messages", f"WITH {M}, {_OPEN}, {_SIMILAR} SELECT session_id, turn, role, content, similarity, rank FROM hits")
def similar_messages(spark, d):
    return _similar(*_open(spark, d, keep=False))


_EXTRA = """firsts AS (SELECT session_id, role, content, min(turn) AS turn FROM log GROUP BY ALL),
free AS (SELECT *, row_number() OVER (PARTITION BY session_id, content ORDER BY turn) AS i FROM firsts f
    WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.session_id = f.session_id AND r.role = f.role AND r.content = f.content)),
wanted AS (SELECT session_id, content, rank, row_number() OVER (PARTITION BY session_id, content ORDER BY rank) AS i FROM hits),
extra AS (SELECT w.session_id, w.rank, f.turn, f.role, w.content FROM wanted w JOIN free f USING (session_id, content, i))"""


@query("first_equal_messages", f"WITH {M}, {_OPEN}, {_RECENT}, {_SIMILAR}, {_EXTRA} SELECT * FROM extra")
def first_equal_messages(spark, d):
    asked, log = _open(spark, d)
    return dialogue.first_equal_messages(_similar(asked, log), log, dialogue.last_messages(log, 3))


@query(
    "hybrid_history",
    f"""WITH {M}, {_OPEN}, {_RECENT}, {_SIMILAR}, {_EXTRA},
    both_ AS (SELECT session_id, role, content, place AS o FROM recent UNION ALL SELECT session_id, role, content, 3 + rank FROM extra)
    {_HISTORY_OUT} FROM both_ GROUP BY session_id""",
)
def hybrid_history(spark, d):
    asked, log = _open(spark, d)
    return _shown(dialogue.hybrid_history(log, _similar(asked, log)))


def _keywords_sql() -> str:
    parts = []
    for looked_for, words in fixed.KEYWORD_RULES:
        chosen = "[" + ", ".join(S.lit(w) for w in words) + "]"
        if looked_for:
            test = " OR ".join(f"contains(lower(question), {S.lit(w)})" for w in looked_for)
            parts.append(f"WHEN {test} THEN {chosen}")
        else:
            parts.append(f"ELSE {chosen}")
    return f"CASE {' '.join(parts)} END"


@query(
    "keyword_history",
    f"""WITH {M}, {_OPEN}, {_RECENT},
    fits AS (SELECT session_id, role, content, min(turn) AS ft FROM log l WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.session_id = l.session_id AND r.turn = l.turn)
        AND len(list_filter({_keywords_sql()}, lambda k: contains(lower(question), k) AND contains(lower(content), k))) > 0 GROUP BY ALL),
    al AS (SELECT session_id, role, content, place, (SELECT min(turn) FROM log l WHERE l.session_id = r.session_id AND l.role = r.role AND l.content = r.content) AS ft FROM recent r
        UNION ALL SELECT session_id, role, content, 4 + ft, ft FROM fits f
        WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.session_id = f.session_id AND r.role = f.role AND r.content = f.content)),
    cnt AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY ft DESC, place DESC) AS late FROM al),
    sel AS (SELECT *, CASE WHEN n > 8 THEN ft * 1000 + place ELSE place END AS o FROM cnt WHERE n <= 8 OR late <= 8)
    {_HISTORY_OUT} FROM sel GROUP BY session_id""",
)
def keyword_history(spark, d):
    _, log = _open(spark, d)
    return _shown(dialogue.keyword_history(log))


@query(
    "question_keywords",
    f"""WITH {M}, {_OPEN} SELECT session_id, array_to_string({_keywords_sql()}, ',') AS keywords FROM q""",
)
def question_keywords(spark, d):
    asked = dialogue.pending_questions(messages(spark, d))
    return asked.select("session_id", F.array_join(dialogue.question_keywords(F.col("question")), ",").alias("keywords"))


@query(
    "checked_answers",
    f"""WITH {M} SELECT session_id, turn, CASE WHEN {S.strip('a')} = '' THEN {S.lit(fixed.EMPTY_ANSWER)} ELSE a END AS answer
    FROM (SELECT *, regexp_replace(content, '^[^.]*[.]?', '') AS a FROM messages)""",
)
def checked_answers(spark, d):
    rest = F.regexp_replace("content", r"\A[^.]*[.]?", "")
    return messages(spark, d).select("session_id", "turn", dialogue.checked_answer(rest).alias("answer"))


# --- conversations that grow ------------------------------------------------------


@query(
    "stored_turns",
    f"""WITH {M}, {_QA}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn % 3, turn) - 1 AS i FROM qa)
    SELECT session_id::VARCHAR AS session_id, 2 * i AS turn, 'user' AS role, question AS content FROM n
    UNION ALL SELECT session_id::VARCHAR, 2 * i + 1, 'assistant', CASE WHEN {S.strip('answer')} = '' THEN {S.lit(fixed.EMPTY_ANSWER)} ELSE answer END FROM n""",
)
def stored_turns(spark, d):
    """All questions and answers, appended in three batches to a store that numbers them."""
    answered = saved(qa_pairs(spark, d).select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").alias("order"), "question", "answer"))
    store = SessionStore(spark, new_folder(spark), buckets=8, fan_in=2)
    for batch in range(3):
        store.append(answered.filter(F.col("order") % 3 == batch), batch)
    return store.messages.rows().select("session_id", "turn", "role", "content")


@query(
    "request_matches",
    f"""WITH {M}, r AS (SELECT item_id AS query_id, item_id % 9 AS session_id, text FROM benchmark),
    lt AS (SELECT session_id || ':' || turn AS id, content AS text FROM messages), qt AS (SELECT query_id AS id, text FROM r),
    {S.word_hash('lt', 'le').strip()}, {S.word_hash('qt', 'qe').strip()},
    dots AS (SELECT r.query_id, m.turn, sum(a.w * b.w) AS s FROM r JOIN messages m USING (session_id)
        JOIN le_w a ON a.id = m.session_id || ':' || m.turn JOIN qe_w b ON b.id = r.query_id AND b.d = a.d GROUP BY ALL),
    sims AS (SELECT r.query_id, m.*, round(coalesce(s / (a.l * b.l), 0), 6) AS similarity FROM r JOIN messages m USING (session_id) LEFT JOIN dots USING (query_id, turn)
        LEFT JOIN le_l a ON a.id = m.session_id || ':' || m.turn LEFT JOIN qe_l b ON b.id = r.query_id)
    SELECT query_id, session_id, turn, role, content, similarity, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, turn) AS rank FROM sims) WHERE rank <= 5""",
)
def request_matches(spark, d):
    """Benchmark questions, many to a conversation, and the messages closest to each."""
    asked = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 9).alias("session_id"), F.col("text").alias("question")
    )
    return similar_by_request(asked, saved(encode(messages(spark, d), "content")), block=3, query_block=2)


# --- chat rows and templates ----------------------------------------------------


@query(
    "chat_rows",
    f"WITH {M}, {_QA} SELECT session_id, turn, 'user|' || question || '|assistant|' || answer AS messages FROM qa",
)
def chat_rows(spark, d):
    rows = qa_pairs(spark, d).withColumn("messages", chat.qa_messages("question", "answer"))
    flat = F.flatten(F.transform("messages", lambda m: F.array(m["role"], m["content"])))
    return rows.select("session_id", "turn", F.array_join(flat, "|").alias("messages"))


@query(
    "tagged_chat",
    f"""WITH {M}, {_QA} SELECT session_id, turn, '[INST] <<SYS>>\\nBạn là trợ lý y tế chuyên nghiệp.\\n<</SYS>>\\n\\n' || question || ' [/INST] ' || answer || '</s>' AS text FROM qa""",
)
def tagged_chat(spark, d):
    return qa_pairs(spark, d).select(
        "session_id", "turn", chat.tagged_text(F.col("question"), F.col("answer"), "</s>").alias("text")
    )


def _block(role: str, content: str) -> str:
    return f"('<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10))"


_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1 AS first FROM messages)"
_SIMPLE_TURN = f"""CASE WHEN role = 'user' THEN {_block("'user'", 'content')} || '<|im_start|>assistant' || chr(10)
    WHEN role = 'assistant' THEN content || '<|im_end|>' || chr(10) ELSE '' END"""
_SIMPLE = f"""CASE WHEN first AND role = 'system' THEN {_block("'system'", 'content')}
    WHEN first THEN {_block("'system'", S.lit(fixed.CHATML_DEFAULT_SIMPLE))} || {_SIMPLE_TURN} ELSE {_SIMPLE_TURN} END"""
_FULL = f"""CASE WHEN first AND role = 'system' THEN {_block("'system'", 'content')}
    WHEN first THEN {_block("'system'", S.lit(fixed.CHATML_DEFAULT_FULL))} || {_block('role', 'content')} ELSE {_block('role', 'content')} END"""


def _neighbours(rows):
    def build(w):
        return {"before": F.lag("role").over(w), "behind": F.lead("role").over(w)}

    return bounded_window(rows, ["session_id"], ["turn"], 1, build, direction="both")


@query("simple_chat_pieces", f"WITH {M}, {_FIRST} SELECT session_id, turn, {_SIMPLE} AS text FROM f")
def simple_chat_pieces(spark, d):
    """Rendered conversation as one piece per message: the text of a
    conversation is its pieces in turn order, however long it is."""
    rows = bounded_window(messages(spark, d), ["session_id"], ["turn"], 1, lambda w: {"before": F.lag("role").over(w)})
    return rows.select("session_id", "turn", chat.simple_piece(F.col("role"), F.col("content"), F.col("before").isNull()).alias("text"))


@query("full_chat_pieces", f"WITH {M}, {_FIRST} SELECT session_id, turn, {_FULL} AS text FROM f")
def full_chat_pieces(spark, d):
    rows = _neighbours(messages(spark, d))
    piece = chat.full_piece(
        F.col("role"), F.col("content"), F.col("before").isNull(), F.col("before"), F.col("behind")
    )
    return rows.select("session_id", "turn", piece.alias("text"))


@query(
    "rendered_chat_rows",
    f"""WITH {M}, {_QA} SELECT session_id, turn,
    {_block("'system'", S.lit(fixed.CHATML_DEFAULT_FULL))} || {_block("'user'", 'question')} || {_block("'assistant'", 'answer')} AS full_text,
    {_block("'system'", S.lit(fixed.CHATML_DEFAULT_SIMPLE))} || {_block("'user'", 'question')} || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) AS simple_text,
    question AS plain FROM qa""",
)
def rendered_chat_rows(spark, d):
    rows = qa_pairs(spark, d).withColumn("full_text", chat.qa_messages("question", "answer"))
    rows = rows.withColumn("simple_text", F.col("full_text")).withColumn("plain", F.col("question"))
    rows = chat.render_if_chat(rows, ["full_text", "plain"])
    rows = chat.render_if_chat(rows, ["simple_text"], chat.simple_chat)
    return rows.select("session_id", "turn", "full_text", "simple_text", "plain")


_CALL = """'{"name": "tìm", "arguments": {"turn": ' || turn || ', "q": "a, b: \\"c\\"", "deep": {"z": [1, 2.5, null], "a": {"e": true}}}}'"""


@query(
    "tool_chat",
    f"""WITH {M}, t AS (SELECT session_id, turn, CASE WHEN turn % 3 = 2 AND role = 'user' THEN 'tool' ELSE role END AS role,
        CASE WHEN turn % 4 = 1 THEN '' ELSE content END AS content, role = 'assistant' AND turn % 4 = 1 AS calls FROM messages WHERE turn < 5),
    n AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS behind, row_number() OVER w = 1 AS first FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    p AS (SELECT session_id, turn, CASE WHEN first THEN {_block("'system'", f"CASE WHEN role = 'system' THEN content ELSE {S.lit(fixed.CHATML_DEFAULT_FULL)} END")} ELSE '' END
        || CASE WHEN role = 'tool' THEN CASE WHEN before IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || content
            || chr(10) || '</tool_response>' || CASE WHEN behind IS DISTINCT FROM 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
        WHEN calls THEN '<|im_start|>assistant' || chr(10) || '<tool_call>' || chr(10) || {_CALL} || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10)
            || '{{"name": "g", "arguments": "x: 1"}}' || chr(10) || '</tool_call><|im_end|>' || chr(10)
        WHEN role = 'system' AND first THEN '' ELSE {_block('role', 'content')} END AS text FROM n)
    SELECT session_id, string_agg(text, '' ORDER BY turn) AS text FROM p GROUP BY session_id""",
)
def tool_chat(spark, d):
    """The first five messages of each conversation, some answered by nested tool calls."""
    rows = messages(spark, d).filter("turn < 5")
    call = F.concat(
        F.lit('[{"type":"function","function":{"name":"tìm","arguments":{"turn":'), F.col("turn").cast("string"),
        F.lit(', "q" : "a, b: \\"c\\"","deep":{"z":[1,2.50,null],"a":{"e":true}}}}}, {"name":"g","arguments":"x: 1"}]'),
    )
    called = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    message = F.struct(
        "turn",
        F.when((F.col("turn") % 3 == 2) & (F.col("role") == "user"), "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("turn") % 4 == 1, "").otherwise(F.col("content")).alias("content"),
        F.when(called, call).alias("tool_calls"),
    )
    chats = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(message)).alias("m"))  # five at most
    return chats.select("session_id", chat.full_chat(F.col("m"), calls="json").alias("text"))
