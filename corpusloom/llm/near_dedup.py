"""Near-duplicate documents by a join of MinHash signature coordinates.

1.  One pass hashes each text's word shingles and keeps the size of its set
    and its MinHash signature. Equal texts share one node, named by the text's digest.
2.  Every node is posted under each (coordinate, value) of its signature. Values
    that a single node has can join nothing; they are the rarest, so they fill a
    node's prefix first. A pair with at least `MATCHES` equal coordinates must meet
    in the rarest COORDINATES - MATCHES + 1 of either, hence a node with s shared
    values has to be looked up under its rarest s - MATCHES + 1 ones only (prefix),
    and one with fewer than MATCHES shared values not at all (skip).
3.  The full sets of the nodes that are left tell how many shingles each has to
    itself. These can be in no intersection, which bounds the similarity of a node, or
    of a pair, from above; nodes and pairs whose bound is too low are out.
4.  Each node is first compared with one leader: the node with the least to itself of a
    posting list, of those that most of its lists have. A list of n copies gives n
    links, not n^2.
5.  Lists that still span several components give the missing pairs: nodes outside
    the list's largest component against the whole list. A parity sketch (the parities
    of the hashes' counts in PARITIES cells, which differ in no more cells than the
    sets in shingles) drops pairs that differ too much for certain. Collisions are
    counted over all coordinates, and only pairs above the match threshold go on.
6.  All links are confirmed on the full shingle sets.

Two sets with similarity 0.8 have each coordinate equal with probability 0.8; of 32
fewer than 16 are equal with probability 3.3e-5, which is the chance to miss such a
link (and components rarely hang on one link)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.llm.components import components
from corpusloom.llm.shared import map_batches, shared_folder, stored
from corpusloom.llm.words import Words, run_hashes

COORDINATES, MATCHES = 32, 16
_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PARITIES = 2048
BLOCK = 1 << 15  # hashes per step of the signature


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id
    of the linked texts), kept (true for one document of each component), digest.

    A text's set holds its distinct runs of `words` lower-cased (A-Z) words; a text
    with fewer words has its whole sequence as one. Texts are linked if
    100 * |intersection| >= percent * |union|, percent being 80 or more.

    Null and empty texts have no shingles, are linked with nothing, and are kept.
    Of a component the document with the smallest doc_id stays; a null doc_id sorts
    last, and a component of such rows only has a null component_id. Rows that repeat
    both doc_id and text are the same document and get the same answer. Other
    columns are ignored."""
    if percent < 80:
        raise ValueError("the signature is made for a similarity of 0.8 or more")
    folder = folder or shared_folder(docs.sparkSession)
    signed = stored(_signed(docs, words), folder, "signed")
    nodes = signed.filter("n_shingles > 0").select(F.col("digest").alias("node"), "n_shingles", "signature")
    nodes = stored(nodes.dropDuplicates(["node"]), folder, "nodes")
    shared = stored(_shared_postings(nodes), folder, "shared")
    sets = stored(_sets(docs, words, shared), folder, "sets")
    lists = stored(_posting_lists(shared, _common(sets, percent)), folder, "lists")
    led = stored(_confirmed(_leaders(lists, percent), sets, percent), folder, "led")
    found = stored(components(led, "a", "b", folder, "first", rounds=1), folder, "found")
    rest = _enough_matches(_missing_pairs(lists, found, sets, percent), shared)
    rest = stored(_confirmed(rest, sets, percent), folder, "rest")
    found = components(led.union(found.select("component", "node")).union(rest), "a", "b", folder, "second")
    return _result(signed, found, folder)


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest and text (null: empty). The digest depends on the text alone,
    so every scan of the documents gives the same."""
    text = F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    return docs.select("doc_id", digest.alias("digest"), text.cast("binary").alias("text"))


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, of one row at least."""
    for batch in batches:
        column = batch.column("text")
        ends = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0)))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size)))
            yield batch.slice(start, stop - start)
            start = stop


def _signed(docs: DataFrame, words: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("digest", T.BinaryType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("signature", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches):
        for batch in text_batches(batches):
            sets = _shingles(batch, words)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "digest": batch.column("digest"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "signature": _signatures(sets),
                }
            )

    return map_batches(_digested(docs), sign, schema)


def _shingles(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    w = Words([t.lower() for t in batch.column("text").to_pylist()])
    return [np.unique(run_hashes(w.hashes[a:b], words)) for a, b in zip(w.first, w.first[1:])]


def _signatures(sets: list[np.ndarray]) -> pa.ListArray:
    full = [s for s in sets if len(s)]
    values = np.empty((len(full), COORDINATES), np.uint64)
    i = 0
    while i < len(full):
        j, size = i, 0
        while j < len(full) and (j == i or size + len(full[j]) <= BLOCK):
            size += len(full[j])
            j += 1
        joined = np.concatenate(full[i:j])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in full[i : j - 1]], dtype=np.int64)))
        for k, m in enumerate(_MULTIPLIERS):
            values[i:j, k] = np.minimum.reduceat(joined * m, starts)
        i = j
    ends = np.cumsum([COORDINATES * (len(s) > 0) for s in sets], dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel().view(np.int64)))


def _shared_postings(nodes: DataFrame) -> DataFrame:
    """node, n_shingles, signature and the postings that other nodes have too,
    rarest first, of the nodes that have enough of them."""
    # the coordinate is mixed into the value, so that one number names a list
    postings = nodes.select("node", F.posexplode("signature").alias("k", "v")).select(
        "node", F.xxhash64("k", "v").alias("key")
    )
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    enough = (
        postings.join(counts, "key")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("postings"))  # COORDINATES of them at most
        .filter(F.size("postings") >= MATCHES)
    )
    return enough.join(nodes, "node")


def _common(sets: DataFrame, percent: int) -> DataFrame:
    """node, n_shingles and common, the number of its shingles that other nodes have
    too, of the nodes that can be similar enough to another by it."""
    every = sets.select("node", F.explode("shingles").alias("shingle"))
    alone = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = F.size("shingles").cast("long")
    sized = sets.select("node", size.alias("n_shingles")).join(alone, "node", "left")
    sized = sized.select("node", "n_shingles", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common"))
    return sized.filter(F.col("common") * 100 >= F.col("n_shingles") * percent)


def _posting_lists(shared: DataFrame, common: DataFrame) -> DataFrame:
    prefix = F.slice("postings", 1, F.size("postings") - MATCHES + 1)
    rows = shared.select("node", "postings", F.transform(prefix, lambda p: p["key"]).alias("prefix")).join(common, "node")
    rows = rows.select("node", "n_shingles", "common", F.explode(F.col("postings.key")).alias("key"), "prefix")
    return rows.select("node", "n_shingles", "common", "key", F.array_contains("prefix", F.col("key")).alias("in_prefix"))


def _sets(docs: DataFrame, words: int, shared: DataFrame) -> DataFrame:
    """node and sorted shingle hashes of the nodes that have a chance of a link."""
    texts = _digested(docs).select(F.col("digest").alias("node"), "text").join(shared.select("node"), "node", "left_semi")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))  # copies are reduced before they move

    def hashed(batches):
        for batch in text_batches(batches):
            sets = _shingles(batch, words)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))), pa.int32())
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.record_batch({"node": batch.column("node"), "shingles": pa.ListArray.from_arrays(ends, pa.array(flat)), "parities": _parities(sets)})

    return map_batches(texts, hashed, "node binary, shingles array<bigint>, parities array<bigint>")


def _parities(sets: list[np.ndarray]) -> pa.ListArray:
    odd = [np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1 for s in sets]
    bits = np.packbits(np.asarray(odd, np.uint8).reshape(len(sets), PARITIES), axis=1).view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), PARITIES // 64).cast(pa.list_(pa.int64()))


def _leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each node b with the leader a of most of its lists."""
    alone = (F.col("n_shingles") - F.col("common")) / F.col("n_shingles")
    leaders = lists.groupBy("key").agg(F.min(F.struct(alone.alias("alone"), "node", "n_shingles", "common")).alias("leader"))
    fit = _can_be_similar(F.col("leader.n_shingles"), F.col("leader.common"), F.col("n_shingles"), F.col("common"), percent)
    pairs = (
        lists.join(leaders, "key")
        .filter((F.col("leader.node") != F.col("node")) & fit)
        .groupBy("node", F.col("leader.node").alias("a"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    best = pairs.groupBy("node").agg(F.max_by("a", F.struct("hits", "a")).alias("a"))
    return best.select("a", F.col("node").alias("b"))


def _can_be_similar(n, common, m, shared, percent: int):
    """Whether the sizes, and what either set has in common with any other, allow it:
    |intersection| >= percent / (100 + percent) * (n + m)."""
    most = F.least(common, shared)
    return most * (100 + percent) >= (n + m) * percent


def _missing_pairs(lists: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes of different components that share a list which is in
    the prefix of both."""
    tagged = lists.filter("in_prefix").join(found.withColumnRenamed("component", "c"), "node", "left")
    tagged = tagged.select("node", "n_shingles", "common", "key", F.coalesce("c", "node").alias("c"))
    sizes = tagged.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("parts"))
    spanning = tagged.join(top.filter("parts > 1").select("key", "top"), "key").join(sets.select("node", "parities"), "node")
    x = spanning.filter("c != top").select(F.col("key").alias("k"), *[F.col(c).alias(f"x_{c}") for c in ("node", "c", "n_shingles", "common", "parities")])
    y = spanning.select("key", "top", *[F.col(c).alias(f"y_{c}") for c in ("node", "c", "n_shingles", "common", "parities")])
    once = (F.col("y_c") == F.col("top")) | (F.col("x_node") < F.col("y_node"))
    fit = _can_be_similar(F.col("x_n_shingles"), F.col("x_common"), F.col("y_n_shingles"), F.col("y_common"), percent)
    differ = F.zip_with("x_parities", "y_parities", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(differ, F.lit(0), lambda total, n: total + n)
    close = differ * (100 + percent) <= (F.col("x_n_shingles") + F.col("y_n_shingles")) * (100 - percent)
    met = x.join(y, (F.col("k") == F.col("key")) & (F.col("x_c") != F.col("y_c")) & once & fit & close)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _enough_matches(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs that collide in at least MATCHES coordinates."""
    one = shared.select(F.col("node").alias("a"), F.col("signature").alias("s"))
    other = shared.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    equal = F.filter(F.zip_with("s", "t", lambda s, t: s == t), lambda e: e)
    return pairs.join(one, "a").join(other, "b").filter(F.size(equal) >= MATCHES).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def compare(batches):
        for batch in batches:
            sides = [(np.asarray(c.values), np.asarray(c.offsets)) for c in (batch.column("x"), batch.column("y"))]
            keep = []
            for i in range(len(batch)):
                x, y = (flat[at[i] : at[i + 1]] for flat, at in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y"), compare, "a binary, b binary")


def _result(signed: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """A text without shingles is a component of its own row, named by its doc_id."""
    rows = signed.select("doc_id", "digest", "n_shingles").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    full = F.col("n_shingles") > 0
    rows = stored(rows.withColumn("c", F.when(full, F.coalesce("component", "digest"))).drop("component"), folder, "rows")
    first = rows.filter(full).groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return rows.join(first, "c", "left").select(
        "doc_id",
        "n_shingles",
        F.when(full, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(full, same).otherwise(True).alias("kept"),
        "digest",
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with all their columns.
    Of rows that repeat both doc_id and text one stays, unless the text is empty."""
    found = near_duplicates(docs, words, percent).filter("kept and n_shingles > 0")
    keep = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    # a row's columns stay inside a struct, so their names clash with none here
    own = docs.select(F.struct(*docs.columns).alias("row"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("own"))
    joined = own.join(keep, (F.col("own") == F.col("_digest")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    once = Window.partitionBy("own", "row.doc_id").orderBy(F.lit(1))
    kept = joined.withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")
    blank = docs.filter(F.coalesce("text", F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z"))
    return kept.unionByName(blank)
