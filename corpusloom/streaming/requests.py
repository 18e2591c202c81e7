"""Questions that arrive over time, answered from the log and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import fixed
from corpusloom.functions.vectors import Encoder
from corpusloom.operators import dialogue
from corpusloom.plans.requests import session_prompts
from corpusloom.streaming.store import SessionStore

REQUEST_SCHEMA = "query_id long, session_id string, question string"
LOG_SCHEMA = "session_id string, turn long, role string, content string"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON lines; without a session they share the default one, and
    blank questions are left out."""
    rows = spark.readStream.schema(REQUEST_SCHEMA).json(folder).na.fill(fixed.DEFAULT_SESSION, ["session_id"])
    return rows.filter("length(trim(question)) > 0")


def answer_requests(
    requests: DataFrame, log: str | SessionStore, corpus_path: str, prompts_path: str, checkpoint: str,
    encoder: Encoder | None = None, trigger: dict | None = None, **search,
) -> StreamingQuery:
    """Write the prompts of every batch to its own sub-folder, which a repeated
    batch overwrites. The corpus is a stored table, read anew per batch, and so is the log
    if it is a path; of a store only the sessions asked for are read, with their vectors.
    `search` (cell_bits, by, probes) chooses cells of the corpus."""

    def answer(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        said = spark.read.schema(LOG_SCHEMA).parquet(log) if isinstance(log, str) else log.log(batch)
        out = session_prompts(batch, said, spark.read.parquet(corpus_path), encoder=encoder, **search)
        out.write.mode("overwrite").parquet(f"{prompts_path}/batch={number}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_turns(answered: DataFrame, log_path: str) -> None:
    """(session_id, turn, question, answer) -> two rows each at the end of the
    log, a plain table whose turns the caller numbers (`SessionStore.append` numbers them).
    Blank answers are replaced first."""
    checked = answered.withColumn("answer", dialogue.checked_answer(answered["answer"]))
    dialogue.turn_rows(checked).write.mode("append").parquet(log_path)
