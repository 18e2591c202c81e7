"""Conversation history and prompts, per session.

Messages are rows (session_id, turn, role, content); `turn` counts the messages
of a session. A session may hold any share of all rows: windows either keep a
fixed number of rows per session (pruned before the shuffle) or go through
`bounded_window`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import always_ellipsis, cut, ellipsis, strip
from corpusloom.operators.ordering import bounded_window, rank_in_group
from corpusloom.session import saved



def _role_name(role: Column, user: str, other: str) -> Column:
    return F.when(role == "user", user).otherwise(other)


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id)


def turn_rows(answered: DataFrame) -> DataFrame:
    """(session_id, turn, question, answer) -> the question's and the answer's
    message; `turn` is the place of the question."""
    pair = F.array(
        F.struct(F.col("turn"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    return answered.select("session_id", F.explode(pair).alias("m")).select("session_id", "m.*")


def checked_answer(answer: Column) -> Column:
    """A blank answer becomes a fixed apology."""
    return F.when(strip(F.coalesce(answer, F.lit(""))) == "", fixed.EMPTY_ANSWER).otherwise(answer)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session. The rank filter is applied in each
    task before the shuffle, so at most n rows per session and task move."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def preceding_messages(
    messages: DataFrame, n: int = 4, width: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Add `before`: the up to n messages ahead of each one, in turn order, cut
    to `width` before they are gathered."""
    shown = F.col("content") if width is None else cut("content", width)

    def build(w):
        return {"before": F.collect_list(F.struct("role", F.col("_shown").alias("content"))).over(w.rowsBetween(-n, -1))}

    rows = messages.withColumn("_shown", shown)
    return bounded_window(rows, ["session_id"], ["turn"], n, build, buckets).drop("_shown")


def qa_pairs(messages: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each user message and the assistant message right behind it."""

    def build(w):
        return {"_role": F.lead("role").over(w), "answer": F.lead("content").over(w)}

    near = bounded_window(messages, ["session_id"], ["turn"], 1, build, buckets, direction="ahead")
    pairs = near.filter((F.col("role") == "user") & (F.col("_role") == "assistant"))
    return pairs.select("session_id", "turn", F.col("content").alias("question"), "answer")


def contextual_queries(messages: DataFrame, n: int = 4, width: int = 100, buckets: int | None = None) -> DataFrame:
    """Search text of every user message: the n messages before it, each cut
    and marked, and the question; the bare question when there are none."""
    asked = preceding_messages(messages, n, width, buckets).filter(F.col("role") == "user")
    return asked.select("session_id", "turn", contextual_query(F.col("content"), F.col("before"), width).alias("query"))


def contextual_query(question: Column, before: Column, width: int = 100) -> Column:
    lines = F.transform(
        before, lambda m: F.concat(_role_name(m["role"], "User: ", "Bot: "), always_ellipsis(m["content"], width))
    )
    text = F.concat(
        F.lit(fixed.CONTEXT_HEAD + "\n"), F.array_join(lines, "\n"), F.lit("\n\n" + fixed.CONTEXT_QUESTION), question
    )
    return F.when(F.size(before) > 0, text).otherwise(question)


def _by_turn(part: Column) -> Column:
    """Texts of few rows (callers limit them first) in turn order."""
    return F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"])


def history_texts(messages: DataFrame, n: int = 6, width: int = 150) -> DataFrame:
    """Per session the last n messages as labelled lines."""
    line = F.concat(_role_name(F.col("role"), fixed.HISTORY_USER, fixed.HISTORY_BOT), F.lit(": "), ellipsis("content", width))
    lines = messages.select("session_id", "turn", line.alias("line"))  # cut before anything moves
    return last_messages(lines, n).groupBy("session_id").agg(F.array_join(_by_turn(F.col("line")), "\n").alias("history"))


def sessions(messages: DataFrame, buckets: int | None = None) -> DataFrame:
    """All sessions with their number of messages, numbered in id order."""
    counts = messages.filter(F.length(F.col("session_id").cast("string")) > 0)
    counts = saved(counts.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")))  # ranked in several jobs
    return rank_in_group(counts, [], ["session_id"], "position", buckets)


def _numbered_tail(messages: DataFrame, limit: int) -> DataFrame:
    """Last 2 x limit messages per session with their place, 1 = oldest shown."""
    w = Window.partitionBy("session_id").orderBy("turn")
    return last_messages(messages, limit * 2).withColumn("number", F.row_number().over(w))


def session_history(messages: DataFrame, limit: int = 10) -> DataFrame:
    return _numbered_tail(messages, limit).select("session_id", "number", "turn", "role", "content")


def history_listing(messages: DataFrame, limit: int = 10, width: int = 200) -> DataFrame:
    """Two lines per message: number and role, and a preview."""
    text = F.concat(
        F.col("number").cast("string"), F.lit(". "), _role_name(F.col("role"), fixed.LISTING_USER, fixed.LISTING_BOT),
        F.lit(":\n   "), F.col("content"), F.lit("\n"),
    )
    shown = messages.withColumn("content", ellipsis("content", width))  # cut before anything moves
    return _numbered_tail(shown, limit).select("session_id", "number", text.alias("line"))


def history_export(messages: DataFrame, limit: int = 10) -> DataFrame:
    """Text of the exported history, as numbered pieces: piece 0 is the head,
    then one per message. The file of a session is its pieces in order."""
    tail = _numbered_tail(messages, limit)
    body = F.concat(
        F.col("number").cast("string"), F.lit(". "), _role_name(F.col("role"), fixed.EXPORT_USER, fixed.EXPORT_BOT),
        F.lit(":\n"), F.col("content"), F.lit("\n\n"),
    )
    head = F.concat(
        F.lit(fixed.EXPORT_TITLE), F.col("session_id").cast("string"), F.lit("\n" + "=" * 60 + "\n\n")
    )
    first = F.when(F.col("number") == 1, F.struct(F.lit(0).alias("piece"), head.alias("text")))
    pieces = F.array_compact(F.array(first, F.struct(F.col("number").alias("piece"), body.alias("text"))))
    return tail.select("session_id", F.explode(pieces).alias("p")).select("session_id", "p.piece", "p.text")


def write_history(messages: DataFrame, path: str, limit: int = 10, mode: str = "errorifexists") -> None:
    """One text file per session: at most 2 x limit messages are joined."""
    pieces = history_export(messages, limit).withColumnRenamed("piece", "turn")
    whole = pieces.groupBy("session_id").agg(F.array_join(_by_turn(F.col("text")), "").alias("value"))
    whole.write.mode(mode).partitionBy("session_id").text(path)


# --- history that goes into a prompt ----------------------------------------

_BLOCK = 100_000  # messages of a session that share a join key


def pending_questions(messages: DataFrame) -> DataFrame:
    """The newest user message of each session, as its open question."""
    asked = messages.filter(F.col("role") == "user")
    last = asked.groupBy("session_id").agg(F.max_by(F.struct("turn", "content"), "turn").alias("m"))
    return last.select("session_id", F.col("m.turn").alias("turn"), F.col("m.content").alias("question"))


def earlier_messages(messages: DataFrame, questions: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Messages before the session's question, with the question's fields. The
    join key holds a block number besides the session, so a long session is
    spread over as many tasks as it has blocks."""
    cols = [c for c in questions.columns if c not in ("session_id", "turn")]
    asked = questions.select(
        F.col("session_id").alias("_s"),
        F.col("turn").alias("asked_at"),
        *cols,
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"turn div {block}"))).alias("_b"),
    )
    placed = messages.withColumn("_block", F.expr(f"turn div {block}"))
    cond = (F.col("session_id") == F.col("_s")) & (F.col("_block") == F.col("_b")) & (F.col("turn") < F.col("asked_at"))
    return placed.join(asked, cond).drop("_s", "_b", "_block")


def similar_messages(log: DataFrame, k: int = 5) -> DataFrame:
    """The k messages of a session closest to its question. Needs unit vectors
    `embedding` and `question_embedding`."""
    dot = F.aggregate(
        F.zip_with("embedding", "question_embedding", lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    best = Window.partitionBy("session_id").orderBy(F.desc("similarity"), "turn")
    scored = log.withColumn("similarity", F.round(dot, 6)).select("session_id", "turn", "role", "content", "similarity")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _identity(content: Column | str) -> Column:
    """Stands for a content where only equality matters, so that shuffles carry
    32 bytes instead of the text."""
    return F.unhex(F.sha2(content, 256))


def _first_turns(log: DataFrame, *more: Column) -> DataFrame:
    """First turn of every (session, role, content): one row each, reduced in
    every task before the shuffle, however often a content is repeated."""
    rows = log.withColumn("_c", _identity("content"))
    return rows.groupBy("session_id", "role", "_c").agg(F.min("turn").alias("first_turn"), *more)


def first_equal_messages(hits: DataFrame, log: DataFrame, selected: DataFrame, by: str = "session_id") -> DataFrame:
    """Each hit -> the first message of its session with the same content whose
    (role, content) is not selected yet. `by` names what hits belong to: a session, or one
    of the requests in it, all of which share the session's log."""
    key, same = ["session_id", "role", "_c"], ["session_id", "_c"]
    chosen = selected.select("session_id", "role", _identity("content").alias("_c"))
    wanted = hits.select(*{by, "session_id"}, "content", "rank", _identity("content").alias("_c"))
    wanted = wanted.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_c").orderBy("rank")))
    free = _first_turns(log).join(chosen, key, "left_anti").join(wanted.select(*same).distinct(), same, "left_semi")
    # one row per role and content is left to number
    free = free.withColumn("_i", F.row_number().over(Window.partitionBy(*same).orderBy("first_turn")))
    return wanted.join(free, [*same, "_i"]).select(by, "rank", F.col("first_turn").alias("turn"), "role", "content")


def _selected_history(rows: DataFrame, keep: int, width: int, by: str = "session_id") -> DataFrame:
    """(session_id, place, first_turn, role, content), few rows per session ->
    history. In place order; when there are more than `keep`, by first
    occurrence and only the last `keep`."""
    message = F.struct(
        _role_name(F.col("role"), "user", "model").alias("role"), cut("content", width).alias("content")
    )
    got = rows.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("place", "first_turn", message.alias("m")))).alias("_all")
    )
    moved = F.sort_array(
        F.transform("_all", lambda x: F.struct(x["first_turn"].alias("t"), x["place"].alias("p"), x["m"].alias("m")))
    )
    in_place = F.transform("_all", lambda x: x["m"])
    newest = F.transform(F.slice(moved, -keep, keep), lambda x: x["m"])
    return got.select(by, F.when(F.size("_all") > keep, newest).otherwise(in_place).alias("history"))


def _recent(log: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn")
    return last_messages(log, n).select("session_id", "turn", "role", "content").withColumn("place", F.row_number().over(w))


def _with_first_turn(recent: DataFrame, log: DataFrame) -> DataFrame:
    rows = recent.withColumn("_c", _identity("content"))
    return rows.join(_first_turns(log), ["session_id", "role", "_c"]).select(
        "session_id", "role", "content", "place", "first_turn"
    )


def hybrid_history(
    log: DataFrame, hits: DataFrame, recent: int = 3, k: int = 5, keep: int = 8, width: int = 250, requests: DataFrame | None = None
) -> DataFrame:
    """Per session: the last messages before its question, then those most
    similar to the question that are not among them. `log` comes from
    `earlier_messages`, `hits` from `similar_messages` with the same k.

    With `requests` (query_id, session_id) a history for each of these, of which a session
    may have many: they share its log, and `hits` has query_id as well."""
    by = "session_id" if requests is None else "query_id"
    newest = _recent(log, recent)
    extra = first_equal_messages(hits, log, newest, by)
    extra = extra.select(by, "role", "content", (F.col("rank") + recent).alias("place"), F.col("turn").alias("first_turn"))
    if recent + k > keep:
        newest = _with_first_turn(newest, log)
    else:
        newest = newest.select("session_id", "role", "content", "place", F.col("turn").alias("first_turn"))
    if requests is not None:
        newest = newest.join(requests.select("query_id", "session_id"), "session_id").drop("session_id")
    return _selected_history(newest.unionByName(extra), keep, width, by)


def question_keywords(question: Column) -> Column:
    """Keyword list that a question selects."""
    q = F.lower(question)
    out = None
    for looked_for, words in fixed.KEYWORD_RULES:
        chosen = F.array(*[F.lit(w) for w in words])
        if looked_for:
            hit = F.lit(False)
            for w in looked_for:
                hit = hit | F.contains(q, F.lit(w))
            out = F.when(hit, chosen) if out is None else out.when(hit, chosen)
    return out.otherwise(chosen)


def shares_keyword(question: Column, content: Column) -> Column:
    q, c = F.lower(question), F.lower(content)
    return F.exists(question_keywords(question), lambda k: F.contains(q, k) & F.contains(c, k))


def keyword_history(log: DataFrame, recent: int = 3, keep: int = 8, width: int = 250) -> DataFrame:
    """As `hybrid_history` without vectors: older messages are taken when a
    keyword is both in them and in the question. `log` has `question`."""
    key = ["session_id", "role", "content"]
    newest = _recent(log, recent)
    older = log.join(newest.select("session_id", "turn"), ["session_id", "turn"], "left_anti")
    fits = older.filter(shares_keyword(F.col("question"), F.col("content")))
    chosen = newest.select("session_id", "role", _identity("content").alias("_c"))
    firsts = _first_turns(fits, F.any_value("content").alias("content")).join(chosen, ["session_id", "role", "_c"], "left_anti")
    # the newest keep+1 decide both the choice and whether there are too many
    late = Window.partitionBy("session_id").orderBy(F.desc("first_turn"))
    few = firsts.withColumn("_n", F.row_number().over(late)).filter(F.col("_n") <= keep + 1)
    few = few.select(*key, (F.col("first_turn") + recent + 1).alias("place"), "first_turn")
    newest = _with_first_turn(newest, log).select(*key, F.col("place").cast("long").alias("place"), "first_turn")
    return _selected_history(newest.unionByName(few), keep, width)


def prompts(asked: DataFrame) -> DataFrame:
    """(question, intent, context) -> what goes to the model: system text, user
    text and generation settings. Other columns are kept."""
    domain = F.col("intent") == fixed.INTENT_DOMAIN
    context = F.coalesce("context", F.lit(""))
    with_documents = F.concat(
        F.lit(fixed.PROMPT_DOCUMENTS + "\n"), context, F.lit("\n\n" + fixed.PROMPT_ASK), F.col("question")
    )
    without = F.concat(F.lit(fixed.PROMPT_QUESTION), F.col("question"), F.lit("\n" + fixed.PROMPT_NO_DOCUMENT))

    def settings(values: dict) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    return asked.withColumns(
        {
            "system_text": F.when(domain, fixed.SYSTEM_DOMAIN).otherwise(fixed.SYSTEM_CHAT),
            "user_text": F.when(domain & (F.length(strip(context)) > 50), with_documents)
            .when(domain, without)
            .otherwise(F.col("question")),
            "settings": F.when(domain, settings(fixed.DOMAIN_SETTINGS)).otherwise(settings(fixed.CHAT_SETTINGS)),
        }
    )
