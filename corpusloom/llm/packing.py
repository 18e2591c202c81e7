"""Packing of tokenised documents into sequences of fixed length.

Texts are tokenised once and cut into pieces of at most `length` tokens. The
histogram of piece lengths, at most `length` numbers however many documents there
are, is packed on the driver: lengths are placed longest first, each into the
shortest pack that has room, and whole groups of equal packs (patterns with a
count) are updated at once. Pieces are numbered within their length by the task that
writes them, and counts of the tasks before give their rank; rank and length alone say
which pattern, sequence and offset a piece has. Ids are written once and never moved for
their rank."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches, shared_folder, stored

LENGTH = 2048
SENT = 1 << 20  # counts of (task, length) that may be sent to every task

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers. A byte-level model is
    merged by the quicker of two libraries, which gives the same ids from the same vocabulary;
    texts that hold a special token go through the file's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = _quick_encoding(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(self._ids(t), "<u4").tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        if self.quick and not any(x in text for x in self.special):
            return self.quick.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


#: The pattern that byte-level models split text by before merges (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _quick_encoding(model: dict):
    """The same byte-level model for the other library; None for other models, and where ids
    are not in the order of the merges."""
    import tiktoken

    own, split = model["model"], model["pre_tokenizer"] or {}
    if own["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["normalizer"]:
        return None
    merged = [own["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in own["merges"]]
    added = {t["content"] for t in model["added_tokens"]}
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in token): i for token, i in own["vocab"].items() if token not in added}
    if merged != sorted(merged) or len(ranks) != len(merged) + 256 or max(ranks.values()) != len(ranks) - 1:
        return None
    return tiktoken.Encoding("quick", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Pattern:
    """Packs that hold the same lengths: (length, copies) in order."""

    count: int
    parts: list[tuple[int, int]] = field(default_factory=list)

    def with_one(self, length: int, count: int) -> Pattern:
        last = self.parts[-1]
        more = [*self.parts[:-1], (length, last[1] + 1)] if last[0] == length else [*self.parts, (length, 1)]
        return Pattern(count, more)


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Patterns that hold every length as often as `counts` says."""
    by_room: list[list[Pattern]] = [[] for _ in range(length + 1)]
    most = 0  # no pack has more room
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            while most and not by_room[most]:
                most -= 1
            if most >= size:
                shortest = by_room[most].pop()
                used = min(left, shortest.count)
                if shortest.count > used:
                    by_room[most].append(Pattern(shortest.count - used, shortest.parts))
                by_room[most - size].append(shortest.with_one(size, used))
                left -= used
                continue
            # in a new pack, the next ones of this length are placed too while they fit
            copies = min(left, length // size)
            packs = left // copies
            room = length - size * copies
            by_room[room].append(Pattern(packs, [(size, copies)]))
            most = max(most, room)
            left -= packs * copies
    return [p for room in by_room for p in room]


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 1, payload: str = "ids", folder: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and
    either ids (array of int) or, with payload="ids_crc32", their checksum.

    A document is its ids by the file `tokenizer`, without special tokens, then `end`;
    null and empty texts are that one id. It is cut every `length` ids. Each id lies in
    one piece, and pieces fill a sequence from offset 0 without gaps. Rows are packed
    one by one, so rows with equal or null doc_id are documents of their own. Other
    columns are ignored. An empty table gives no rows."""
    folder = folder or shared_folder(docs.sparkSession)
    pieces = stored(token_pieces(docs, tokenizer, length, end, payload), folder, "pieces")
    per_task = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), folder, "counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(docs.sparkSession, pack_histogram(counts, length), counts)
    ranked = _ranked(pieces, per_task)
    # at most `length` rows
    placed = ranked.join(F.broadcast(slots), ranked["length"] == slots["size"])
    slot = F.get(F.filter("slots", lambda s: (s["from"] <= F.col("rank")) & (F.col("rank") < s["to"])), F.lit(0))
    placed = placed.withColumn("s", slot).withColumn("j", F.col("rank") - F.col("s.from"))
    sequence = F.col("s.sequence") + F.floor(F.col("j") / F.col("s.copies"))
    offset = F.col("s.offset") + F.col("j") % F.col("s.copies") * F.col("length")
    return placed.select(
        "doc_id", "start", "length", payload, "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset")
    )


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 1, payload: str = "ids") -> DataFrame:
    """doc_id, start, length, doc_tokens and the payload (see pack) of each piece, with the
    task that made it and its number (`within`, from 0) among that task's pieces of the length."""
    kinds = {"ids": T.ArrayType(T.IntegerType()), "ids_crc32": T.LongType()}
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name in ("start", "length", "doc_tokens", "task", "within"):
        schema.add(name, T.LongType())
    schema.add(payload, kinds[payload])
    last = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        task, made = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in text_batches(batches):
            rows, starts, parts, totals = [], [], [], []
            texts = [t.decode() for t in batch.column("text").to_pylist()]
            for i, ids in enumerate(encoder.encode(texts)):
                ids += last
                for start in range(0, len(ids), 4 * length):
                    rows.append(i)
                    starts.append(start // 4)
                    parts.append(ids[start : start + 4 * length])
                    totals.append(len(ids) // 4)
            sizes = np.asarray([len(p) // 4 for p in parts], np.int64)
            order = np.argsort(sizes, kind="stable")
            firsts = np.searchsorted(sizes[order], sizes[order])
            within = np.empty(len(sizes), np.int64)
            within[order] = np.arange(len(sizes)) - firsts + made[sizes[order]]
            made += np.bincount(sizes, minlength=length + 1)
            if payload == "ids_crc32":
                value = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            else:
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                value = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(sizes),
                    "doc_tokens": pa.array(totals, pa.int64()),
                    "task": pa.array([task] * len(rows), pa.int64()),
                    "within": pa.array(within),
                    payload: value,
                }
            )

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), cut, schema)


def _slots(spark, patterns: list[Pattern], counts: dict[int, int]) -> DataFrame:
    """For each length the ranges of ranks that a pattern takes: of the pieces with
    rank from..to - 1, every `copies` follow each other in one sequence."""
    taken = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple]] = {size: [] for size in counts}
    sequence = 0
    for p in patterns:
        offset = 0
        for size, copies in p.parts:
            first = taken[size]
            taken[size] += p.count * copies
            rows[size].append((first, taken[size], sequence, copies, offset))
            offset += size * copies
        sequence += p.count
    slot = "struct<from: bigint, to: bigint, sequence: bigint, copies: bigint, offset: bigint>"
    return spark.createDataFrame(list(rows.items()), f"size bigint, slots array<{slot}>")


def _ranked(pieces: DataFrame, per_task: DataFrame) -> DataFrame:
    """`rank` from 0 among the pieces of a length: a piece's number in its task behind those
    of the tasks before. The tasks' counts go to all tasks while there are at most SENT of them;
    beyond that both sides are dealt out by (task, length), which no length makes hot."""
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select(
        F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before")
    )
    side = F.broadcast(before) if per_task.count() <= SENT else before.hint("shuffle_hash")
    joined = pieces.join(side, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")))
    return joined.withColumn("rank", F.col("_before") + F.col("within")).drop("_task", "_length", "_before", "task", "within")
