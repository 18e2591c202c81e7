"""Removal of passages that an earlier document has, by joins of blocks and windows.

This is no greedy Lempel-Ziv parse (README says why). Every text is cut into reference blocks: a window of `window` words belongs to the
word run inside it with the smallest hash (its anchor; the leftmost of equal ones),
and consecutive windows with one anchor make up a block. Which anchor a window has
depends on its own words only, so equal windows lie in blocks with equal anchors, at
the same distance from them. All blocks of all documents are indexed.

A document is then factored against the index: blocks that a document with a smaller
doc_id has as a whole are the inner parts of a factor. A factor starts and ends within
a block, so blocks whose anchor is known with other words around it are checked window
by window, at these factor boundaries only. Together the factors hold exactly the
windows that also start in an earlier document; their words are the duplicate spans.

Windows are compared by two 64-bit hashes (anchor and window)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches, shared_folder, stored
from corpusloom.llm.words import Words, mix, powers, run_hashes

WINDOW, RUN = 50, 6
PLACE = np.uint64((1 << 28) - 1)  # low bits of a key hold the place: no text has more words


def without_repeats(docs: DataFrame, window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the words that stay,
    joined by one space) and spans (array of word ranges [from, to) that go).

    A word goes if a run of `window` words around it also starts in a text with a
    smaller doc_id. Null and empty texts have no words. Texts of one doc_id don't affect
    each other; rows with a null doc_id neither lose words nor cost others any. Texts
    under `window` words stay as they are. Other columns are ignored."""
    folder = folder or shared_folder(docs.sparkSession)
    blocks = _blocks(docs, window)
    anchors = blocks.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = stored(blocks.join(anchors.filter("low < high").select("anchor"), "anchor"), folder, "shared")
    owners = shared.groupBy("anchor", "words").agg(
        F.min(F.struct("doc_id", "version", "start", "size", "lead")).alias("own")
    )
    owners = stored(owners, folder, "owners")
    several = owners.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    edges = owners.join(several, "anchor", "left_semi")
    windows = stored(_windows(docs, edges, window), folder, "windows")
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"))
    late = windows.join(first, ["anchor", "window"]).filter("first < doc_id")
    late = late.groupBy("anchor", "words").agg(F.collect_list("place").alias("places"))  # a block's windows at most
    owned = shared.join(owners.select("anchor", "words", F.col("own.doc_id").alias("owner")), ["anchor", "words"])
    owned = stored(owned, folder, "owned")
    inner = owned.filter("owner < doc_id").select("doc_id", "version", "start", F.col("size").alias("n"))
    outer = owned.filter("owner = doc_id").join(late, ["anchor", "words"])
    outer = outer.select("doc_id", "version", "start", F.explode("places").alias("place"))
    outer = outer.select("doc_id", "version", (F.col("start") + F.col("place")).alias("start"), F.lit(1).alias("n"))
    found = inner.unionByName(outer).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    return _rewritten(docs, found, window)


def _versions(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes) and a hash of the text that tells rows of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))


def _sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] for each i."""
    reach = 1
    while 2 * reach <= n:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (n - reach)], x[n - reach :]) if n > reach else x


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on, as one array."""
    if not len(sizes):
        return np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums, down


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version, start (first window), size (windows), lead (place of the anchor
    after start), anchor and words (hash of the block's words) of each block."""
    run = min(RUN, window)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("version", T.LongType()), ("start", T.IntegerType()), ("size", T.IntegerType()), ("lead", T.IntegerType()), ("anchor", T.LongType()), ("words", T.LongType())):
        schema.add(name, kind)

    def parse(batches):
        for batch in text_batches(batches):
            w = Words(batch.column("text").to_pylist())
            counts = np.maximum(np.diff(w.first) - window + 1, 0)
            at = _ranges(w.first[:-1][counts > 0], counts[counts > 0])
            if not len(at):
                continue
            runs = run_hashes(w.hashes, run)
            keys = (runs & ~PLACE) | np.arange(len(runs), dtype=np.uint64)
            place = (_sliding_minimum(keys, window - run + 1)[at] & PLACE).astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
            size = np.diff(np.concatenate((new, [len(at)])))
            start, doc, place = at[new], doc[new], place[new]
            sums, down = _prefix_sums(w.hashes)
            lead = place - start
            words = (sums[start + size + window - 1] - sums[start]) * down[start]
            words = mix(words + (lead * 4096 + size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rows = pa.array(doc)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(rows),
                    "version": batch.column("version").take(rows),
                    "start": pa.array((start - w.first[doc]).astype(np.int32)),
                    "size": pa.array(size.astype(np.int32)),
                    "lead": pa.array(lead.astype(np.int32)),
                    "anchor": pa.array(mix(runs[place]).view(np.int64)),
                    "words": pa.array(words.view(np.int64)),
                }
            )

    return map_batches(_versions(docs.filter("doc_id IS NOT NULL")), parse, schema)


def _windows(docs: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """anchor, words, doc_id, place and hash of each window of the given blocks."""
    block = F.struct("anchor", "words", "own.start", "own.size", "own.lead")
    wanted = edges.groupBy("own.doc_id", "own.version").agg(F.collect_list(block).alias("blocks"))  # of one text
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("anchor", T.LongType()), ("words", T.LongType()), ("place", T.IntegerType()), ("window", T.LongType())):
        schema.add(name, kind)

    def unfold(batches):
        for batch in text_batches(batches):
            w = Words(batch.column("text").to_pylist())
            blocks = batch.column("blocks")
            doc = np.repeat(np.arange(len(batch)), np.asarray(pa.compute.list_value_length(blocks)))
            flat = blocks.flatten()
            anchor, words, start, size, lead = (np.asarray(flat.field(n)) for n in ("anchor", "words", "start", "size", "lead"))
            place = _ranges(np.zeros(len(size), np.int64), size.astype(np.int64))
            at = np.repeat(w.first[doc] + start, size) + place
            sums, down = _prefix_sums(w.hashes)
            # the distance to the anchor is part of the hash
            away = (np.repeat(lead, size) - place + 4096).astype(np.uint64)
            hashes = mix((sums[at + window] - sums[at]) * down[at] + away * np.uint64(0x9E3779B97F4A7C15))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(np.repeat(doc, size))),
                    "anchor": pa.array(np.repeat(anchor, size)),
                    "words": pa.array(np.repeat(words, size)),
                    "place": pa.array(place.astype(np.int32)),
                    "window": pa.array(hashes.view(np.int64)),
                }
            )

    texts = _versions(docs).join(wanted, ["doc_id", "version"])
    return map_batches(texts.dropDuplicates(["doc_id", "version"]), unfold, schema)


def _rewritten(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("spans", T.ArrayType(T.ArrayType(T.IntegerType())))):
        schema.add(name, kind)

    def rewrite(batches):
        for batch in text_batches(batches):
            out = {name: [] for name in schema.names[1:]}
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("found")):
                words = text.split()
                n, spans = len(words), []
                if ranges.is_valid:
                    flat = ranges.values
                    start, size = (np.asarray(flat.field(name)).astype(np.int64) for name in ("start", "n"))
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + size + window - 1, -1)
                    gone = np.cumsum(step) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist()
                    spans = [edges[i : i + 2] for i in range(0, len(edges), 2)]
                    limits = [0, *edges, n]
                    words = [x for i in range(0, len(limits), 2) for x in words[limits[i] : limits[i + 1]]]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode())
                out["spans"].append(spans)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    found = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "found")
    texts = _versions(docs)
    texts = texts.join(found, (texts["doc_id"] == F.col("_id")) & (texts["version"] == F.col("_version")), "left")
    return map_batches(texts.select("doc_id", "text", "found"), rewrite, schema)
