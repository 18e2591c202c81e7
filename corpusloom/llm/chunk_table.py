"""Work on each distinct chunk of text once, and its results back in every place.

Texts are cut into chunks. A block, some megabytes of texts read by one task,
numbers its distinct chunks and keeps a document as the numbers of its chunks by
position. The distinct chunks of all blocks are dealt out by hash, so that all
occurrences of one meet in one task, which works on it once. The results go back to
the blocks that asked, where they are put in place by number.

What moves is one number per position and each distinct chunk once per block, both
compressed; texts never do. A common chunk costs a row's share per block, not per
occurrence, and a long text or a group of copies stays in the blocks it was read in, so
no key is hot. Numbers and chunks go through one exchange, which both steps read."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches

BLOCK = 16 << 20  # bytes of text that share one numbering
_EXCHANGED = "key long, seen long, rows binary, sizes binary, numbers binary, counts binary, chunks binary"
_REPLY = "key long, seen long, bucket long, sizes binary, values binary"


def pack_ints(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte of their places."""
    raw = np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack_ints(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.empty(0, np.int64)
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_texts(texts: list[bytes]) -> bytes:
    sizes, body = pack_ints(np.fromiter(map(len, texts), np.int64, len(texts))), b"".join(texts)
    parts = [sizes, len(body).to_bytes(8, "little"), pa.compress(body, codec="zstd", asbytes=True) if body else b""]
    return len(sizes).to_bytes(8, "little") + b"".join(parts)


def unpack_texts(data: bytes) -> list[bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    size = int.from_bytes(data[cut : cut + 8], "little")
    body = pa.decompress(data[cut + 8 :], size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(unpack_ints(data[8:cut]))
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _rows_out(columns: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(columns)
    return sink.getvalue().to_pybytes()


class _Block:
    """Numbers the distinct chunks of a block. The i-th chunk of bucket b has the
    number i * buckets + b, so chunks need no numbers when they are sent."""

    def __init__(self, key: int, buckets: int):
        self.key, self.buckets, self.size = key, buckets, 0
        self.known: dict[bytes, int] = {}
        self.lists: list[list[bytes]] = [[] for _ in range(buckets)]

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of chunks (large or plain binary), in order."""
        known, lists, buckets = self.known, self.lists, self.buckets
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        for w in distinct:
            if w not in known:
                b = zlib.crc32(w) % buckets
                known[w] = len(lists[b]) * buckets + b
                lists[b].append(w)
        own = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return own[np.asarray(coded.indices)]

    def ended(self) -> list[dict]:
        """A row that ends the block, and its distinct chunks for each bucket."""
        seen = _check(len(self.known), self.key)
        packets = [
            {"key": -1 - b, "seen": seen, "rows": self.key.to_bytes(8, "little"), "chunks": pack_texts(chunks)}
            for b, chunks in enumerate(self.lists)
            if chunks
        ]
        return [{"key": self.key, "seen": seen}, *packets]


def _check(chunks: int, key: int) -> int:
    return zlib.crc32(f"{key}:{chunks}".encode())


@dataclass
class Placed:
    """Documents of a block with the results of their chunks. rows: their kept columns;
    bounds: document i has positions bounds[i] to bounds[i + 1] of `numbers` and of
    `counts`, how often each chunk stands in the document (None if every position has
    a number of its own); chunk number j has values starts[j] to starts[j] + sizes[j]
    of `values`."""

    rows: pa.RecordBatch
    bounds: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray | None
    starts: np.ndarray
    sizes: np.ndarray
    values: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into `values` in the order of positions, and how many each position has."""
        n = self.sizes[self.numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.starts[self.numbers] - (ends - n), n) + np.arange(total), n


def by_chunk(
    docs: DataFrame,
    keep: list[str],
    cut: Callable[[pa.Array], pa.ListArray],
    work: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray | list[bytes]]]],
    place: Callable[[Iterable[Placed]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    texts: bool = False,
    counted: bool = False,
    block: int = BLOCK,
    buckets: int | None = None,
) -> DataFrame:
    """`place` over all documents. `cut` gives the chunks of each of the texts given, all as
    UTF-8, and with `counted` each is kept once per document with its count. `work()` is made once per task; called
    with distinct chunks it gives how many values each has and all values, numbers below
    2^32 or, with `texts`, texts. A null text is empty; other columns than `keep` are ignored.

    `buckets`, by default four for each of the session's shuffle partitions, deals the
    distinct chunks out. A task holds the distinct chunks of its buckets, or one block."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    asked = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    exchanged = T._parse_datatype_string(_EXCHANGED)
    names = exchanged.fieldNames()
    arrow = pa.schema([(n, pa.int64() if n in ("key", "seen") else pa.binary()) for n in names])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 24
        now = None
        for batch in text_batches(batches):
            now = now or _Block(key, buckets)
            documents = cut(batch.column("text"))
            sizes, numbers = np.asarray(documents.value_lengths()), now.numbers(documents.flatten())
            row = {"key": now.key, "rows": _rows_out(batch.select(keep))}
            if counted:
                width = int(numbers.max(initial=0)) + 1
                pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + numbers, return_counts=True)
                sizes, numbers = np.bincount(pairs // width, minlength=len(sizes)), pairs % width
                row["counts"] = pack_ints(counts)
            row |= {"sizes": pack_ints(sizes), "numbers": pack_ints(numbers)}
            yield pa.RecordBatch.from_pylist([row], arrow)
            now.size += batch.column("text").nbytes
            if now.size >= block:
                yield pa.RecordBatch.from_pylist(now.ended(), arrow)
                key, now = key + 1, None
        if now:
            yield pa.RecordBatch.from_pylist(now.ended(), arrow)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, table = None, {}
        reply = pa.schema([(f, pa.binary() if f in ("sizes", "values") else pa.int64()) for f in ("key", "seen", "bucket", "sizes", "values")])
        for batch in batches:
            packets = batch.filter(pa.compute.is_valid(batch.column("chunks")))
            for p in packets.select(["key", "seen", "rows", "chunks"]).to_pylist():
                worker = worker or work()
                chunks = unpack_texts(p["chunks"])
                new = [c for c in chunks if c not in table]
                if new:
                    sizes, values = worker(new)
                    ends = np.cumsum(sizes).tolist()
                    table.update((c, values[e - s : e]) for c, s, e in zip(new, np.asarray(sizes).tolist(), ends))
                found = [table[c] for c in chunks]
                flat = pack_texts([x for f in found for x in f]) if texts else pack_ints(np.concatenate(found))
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "key": int.from_bytes(p["rows"], "little"),
                            "seen": p["seen"],
                            "bucket": -1 - p["key"],
                            "sizes": pack_ints(np.fromiter(map(len, found), np.int64, len(found))),
                            "values": flat,
                        }
                    ],
                    reply,
                )

    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def joined(rows: pa.Table, replies: pa.Table) -> pa.Table:
        documents = rows.filter(pa.compute.is_valid(rows.column("numbers"))).select(names).to_pylist()
        results = list(place(_placed(documents, rows, replies, buckets, texts))) if documents else []
        return pa.Table.from_batches(results) if results else to_arrow_schema(out).empty_table()

    dealt = map_batches(asked, coded, exchanged).repartition(parts, "key")
    replies = dealt.mapInArrow(answered, _REPLY)
    return dealt.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(joined, out)


def _placed(documents: list[dict], rows: pa.Table, replies: pa.Table, buckets: int, texts: bool) -> Iterator[Placed]:
    seen = {x for x in rows.column("seen").to_pylist() if x is not None}
    packets = replies.to_pylist()
    sizes = [unpack_ints(p["sizes"]) for p in packets]
    key, got = documents[0]["key"], sum(map(len, sizes))
    if seen != {_check(got, key)} or any(p["seen"] not in seen for p in packets):
        raise RuntimeError("the documents changed while they were read; write them to a table first")
    most = max((len(s) for s in sizes), default=0) * buckets
    all_sizes, starts, flat, at = np.zeros(most, np.int64), np.zeros(most, np.int64), [], 0
    for p, s in zip(packets, sizes):
        places = np.arange(len(s)) * buckets + p["bucket"]
        all_sizes[places] = s
        starts[places] = at + np.cumsum(s) - s
        flat.append(np.array(unpack_texts(p["values"]), object) if texts else unpack_ints(p["values"]))
        at += int(s.sum())
    values = np.concatenate(flat) if flat else np.empty(0, object if texts else np.int64)
    for d in documents:
        kept = pa.ipc.open_stream(d["rows"]).read_all().combine_chunks().to_batches()
        bounds = np.concatenate(([0], np.cumsum(unpack_ints(d["sizes"]))))
        counts = None if d["counts"] is None else unpack_ints(d["counts"])
        yield Placed(kept[0], bounds, unpack_ints(d["numbers"]), counts, starts, all_sizes, values)
