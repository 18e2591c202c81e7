"""Chat requests: a question in a session becomes a prompt with its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.vectors import Encoder
from corpusloom.operators import dialogue
from corpusloom.operators.chunking import encode
from corpusloom.operators.retrieval import best_hits, nearest_in_groups
from corpusloom.plans.corpus import answers
from corpusloom.session import saved

_BEFORE = "array<struct<turn:bigint,role:string,content:string>>"


def session_prompts(
    requests: DataFrame,
    log: DataFrame,
    corpus: DataFrame,
    texts: DataFrame | None = None,
    encoder: Encoder | None = None,
    cell_bits: int | None = None,
    **search,
) -> DataFrame:
    """(query_id, session_id, question), the message log and embedded chunks ->
    prompt, settings and history of every request. Requests of one session are
    answered side by side, each from the log as it is.

    Messages of sessions without a request are left out first; the others are read once,
    however many requests a session has, and are not encoded if the log has their vectors
    (`embedding`). `search` goes to the search over the corpus."""
    asked_for = requests.select("session_id").distinct()
    mine = log.join(asked_for, "session_id", "left_semi")
    if "embedding" not in log.columns:
        mine = encode(mine, "content", "embedding", encoder)
    mine = saved(mine.select("session_id", "turn", "role", "content", "embedding"))

    newest = dialogue.last_messages(mine.drop("embedding"), 4).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("before")  # four at most
    )
    asked = requests.join(newest, "session_id", "left")
    before = F.coalesce("before", F.array().cast(_BEFORE))
    asked = asked.withColumn("search_text", dialogue.contextual_query(F.col("question"), before)).drop("before")
    prompted = answers(asked, corpus, texts, encoder, cell_bits=cell_bits, **search)

    history = dialogue.hybrid_history(mine, similar_by_request(requests, mine, encoder=encoder), requests=requests)
    return prompted.join(history, "query_id", "left").select(
        "query_id", "session_id", "question", "system_text", "user_text", "settings",
        F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")).alias("history"),
    )


def similar_by_request(
    requests: DataFrame, log: DataFrame, k: int = 5, encoder: Encoder | None = None, block: int = 50_000, query_block: int = 4096
) -> DataFrame:
    """The k messages of its session closest to each request: query_id, session_id, turn,
    role, content, similarity, rank. Messages meet the requests of their session in blocks,
    so rows read are messages and requests, not their pairs."""
    questions = encode(requests.select("query_id", "session_id", "question"), "question", "query", encoder)
    vectors = log.select("session_id", F.col("turn").alias("id"), "embedding")
    found = nearest_in_groups(vectors, questions.select("session_id", "query_id", "query"), "session_id", k, block, query_block)
    hits = best_hits(found, k).withColumnRenamed("id", "turn").join(requests.select("query_id", "session_id"), "query_id")
    return hits.join(log.select("session_id", "turn", "role", "content"), ["session_id", "turn"])
