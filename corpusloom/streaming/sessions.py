"""Running state per conversation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

MESSAGE_SCHEMA = "session_id long, turn long, role string, content string"


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def session_counts(messages: DataFrame) -> DataFrame:
    """Messages per session so far; counted in each task before the shuffle."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def recent_buffers(messages: DataFrame, keep: int = 6, idle_ms: int | None = None) -> DataFrame:
    """After every batch, the last `keep` messages of each session that got new
    ones. State holds `keep` messages per session, whatever its length. With
    `idle_ms` a session that stays silent that long is forgotten."""
    key = messages.schema["session_id"].dataType.simpleString()
    row = f"session_id {key}, turns array<bigint>, roles array<string>, contents array<string>"
    state = "turns array<bigint>, roles array<string>, contents array<string>"

    def update(session: tuple, frames: Iterable[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        rows = list(zip(*kept.get)) if kept.exists else []
        for frame in frames:  # never more than keep rows plus one frame at a time
            rows += list(zip(frame["turn"], frame["role"], frame["content"]))
            rows = sorted(rows)[-keep:]
        turns, roles, contents = ([r[i] for r in rows] for i in range(3))
        turns = [int(t) for t in turns]
        kept.update((turns, roles, contents))
        if idle_ms:
            kept.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [session[0]], "turns": [turns], "roles": [roles], "contents": [contents]})

    timeout = "ProcessingTimeTimeout" if idle_ms else "NoTimeout"
    return messages.groupBy("session_id").applyInPandasWithState(update, row, state, "update", timeout)


def start(df: DataFrame, store, checkpoint: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Hand each batch of updates to `store(batch, number)`."""
    writer = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
