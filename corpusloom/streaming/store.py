"""Conversations that grow turn by turn: every message gets its number when it is appended
and is stored with its vector, so that no request numbers or encodes the log again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.vectors import Encoder
from corpusloom.operators import dialogue
from corpusloom.operators.chunking import encode
from corpusloom.operators.ordering import rank_in_group
from corpusloom.session import saved
from corpusloom.sources.runs import Runs

MESSAGES = "session_id string, turn long, role string, content string, embedding array<float>"
ENDS = "session_id string, next long"


def _latest(ends: DataFrame) -> DataFrame:
    return ends.groupBy("session_id").agg(F.max("next").alias("next"))


class SessionStore:
    """Messages and the next turn of each session, both found by session. Reading a few
    sessions opens only the folders that may hold them."""

    def __init__(self, spark: SparkSession, path: str, encoder: Encoder | None = None, buckets: int = 64, fan_in: int = 8) -> None:
        self.encoder = encoder
        self.messages = Runs(spark, f"{path}/messages", "session_id", MESSAGES, buckets, fan_in)
        self.ends = Runs(spark, f"{path}/ends", "session_id", ENDS, buckets, fan_in, combine=_latest)

    def append(self, answered: DataFrame, batch: int) -> None:
        """(session_id, order, question, answer) -> two messages each, behind those of earlier
        batches, in `order` (unique in a session); blank answers are replaced. Batches count
        up from 0; a batch that is repeated with the same rows leaves the same messages.

        A session may hold any share of a batch: rows are ranked range by range, and a
        session's end comes from counts. Work is in proportion to the batch."""
        rows = answered.select("session_id", "order", "question", dialogue.checked_answer(F.col("answer")).alias("answer"))
        rows = saved(rows)  # ranked in several jobs
        counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        known = _latest(self.ends.matching(rows, before=batch))
        ends = saved(counts.join(known, "session_id", "left").fillna(0, ["next"]))
        placed = rank_in_group(rows, ["session_id"], ["order"], "place").join(ends.drop("n"), "session_id")
        turns = dialogue.turn_rows(placed.withColumn("turn", F.col("next") + 2 * (F.col("place") - 1)))
        self.messages.add(encode(turns, "content", "embedding", self.encoder), batch)
        self.ends.add(ends.select("session_id", (F.col("next") + 2 * F.col("n")).alias("next")), batch)

    def log(self, sessions: DataFrame) -> DataFrame:
        """Messages of the sessions named, with their vectors."""
        return self.messages.matching(sessions)

    def start(self, answered: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Append a stream of answered questions, batch by batch."""
        writer = answered.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
