"""How far the sources of a language diverge in their terms.

Texts are factored into white-space chunks, counted once per document. Each globally
distinct chunk is broken into terms once, and its terms come back to the documents that
hold it, block by block; blocks give occurrences and distinct documents of each term, which
Spark adds up. Shares of terms are whole numbers, so results are exact."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.chunk_table import BLOCK, Placed, by_chunk
from corpusloom.llm.shared import shared_folder, stored

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCUMENTS = 10  # a term is kept for a language if so many of its documents have it
TOP = 10  # terms listed for a source
SCALE = 1_000_000_000  # shares are counted in parts of it
TERMS = 4096  # terms that a task compares at a time, about
TILE = 256  # sources that a task compares with as many others, about
_COUNTS = "lang string, source string, term string, n long, documents long"


def term_counts(docs: DataFrame, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """lang, source, term, n (occurrences) and documents (that hold the term), in parts
    to be added up. Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z in
    lower case. Null text, lang and source are empty; other columns are ignored."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]

    def work():
        def terms(chunks: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
            found = [_TERM.findall(c.decode("utf-8", "replace").encode().lower()) for c in chunks]  # bytes: only A-Z change
            return np.fromiter(map(len, found), np.int64, len(found)), [t for f in found for t in f]

        return terms

    return by_chunk(docs.select(*named), ["lang", "source"], _chunks, work, _added, _COUNTS, True, True, block, buckets)


def _chunks(texts: pa.Array) -> pa.ListArray:
    found = pa.compute.ascii_split_whitespace(texts.view(pa.string()))  # spaces and x09 to x0D only
    return pa.ListArray.from_arrays(found.offsets, found.values.view(pa.binary()))


def _added(blocks: Iterable[Placed]) -> Iterator[pa.RecordBatch]:
    """One row for each term of each source in a block."""
    groups: dict[tuple[str, str], int] = {}
    names, codes = None, np.empty(0, np.int64)
    keys, occurrences, documents = [], [], []
    for b in blocks:
        if names is None:
            coded = pa.array(b.values, pa.binary()).cast(pa.string()).dictionary_encode()
            names, codes = coded.dictionary, np.asarray(coded.indices, np.int64)
        width = max(1, len(names))
        pairs = zip(b.rows.column("lang").to_pylist(), b.rows.column("source").to_pylist())
        group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
        places, n = b.places()
        document = np.repeat(np.repeat(np.arange(len(group)), np.diff(b.bounds)), n)
        of, inverse = np.unique(document * width + codes[places], return_inverse=True)
        keys.append(group[of // width] * width + of % width)
        occurrences.append(np.bincount(inverse, np.repeat(b.counts, n), len(of)).astype(np.int64))
        documents.append(np.ones(len(of), np.int64))
    if names is None or not len(names):
        return
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    listed = list(groups)
    of = (key // len(names)).tolist()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([listed[g][0] for g in of], pa.string()),
            pa.array([listed[g][1] for g in of], pa.string()),
            names.take(pa.array(key % len(names))),
            *(pa.array(np.bincount(inverse, np.concatenate(x), len(key)).astype(np.int64)) for x in (occurrences, documents)),
        ],
        ["lang", "source", "term", "n", "documents"],
    )


def _share(n: Column | str, total: Column) -> Column:
    """1 + floor(SCALE * n / total), exact; 1 where there is nothing to share."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * F.expr(n).cast("decimal(20,0)")
    whole = F.call_function("div", scaled, F.greatest(total, F.lit(1)).cast("decimal(20,0)"))
    return F.when(total > 0, 1 + whole).otherwise(1).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(
    docs: DataFrame, least: int = DOCUMENTS, top: int = TOP, terms: int = TERMS, tile: int = TILE, folder: str | None = None,
    block: int = BLOCK, buckets: int | None = None,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    part `pair`: item is each other source of the language, value the distance between
    both over all kept terms. part `term`: item is a kept term that the source has a
    greater share of than its language, value its share of the distance; the `top` first.
    Ranks go by value, greatest first, then by item. A term is kept if `least` documents of
    the language have it.

    A row of `docs` is a document, so null and repeated doc_id count. Null text, lang and
    source are empty strings; extra columns are ignored. A source without terms has
    pairs; a language with one source has none. An empty table gives no rows.

    A language's terms are compared in parts of about `terms`, its sources in tiles of
    about `tile`, so no task holds a whole language."""
    folder = folder or shared_folder(docs.sparkSession)
    # dealt out by (lang, term), which serves both the sums and the choice of terms
    dealt = term_counts(docs, block, buckets).repartition("lang", "term").groupBy("lang", "source", "term")
    per_lang = Window.partitionBy("lang", "term")
    summed = dealt.agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    chosen = summed.withColumns({"in_lang": F.sum("documents").over(per_lang), "n_lang": F.sum("n").over(per_lang)})
    held = stored(chosen.filter(F.col("in_lang") >= least).drop("documents", "in_lang"), folder, "terms")
    totals = stored(_totals(docs, held), folder, "sources")
    shared = held.join(totals, ["lang", "source"]).withColumn("p", _share("n + 2", F.col("total") + 2 * F.col("v")))
    found = _leading(shared, top).unionByName(_pairs(shared, totals, terms, tile))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _totals(docs: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each source: total (occurrences of kept terms), v (kept terms of the
    language), lang_total, sources (of the language), p0 (share of a term it lacks)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = held.groupBy("lang", "term").agg(F.any_value("n_lang").alias("n_lang"))
    lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("lang_total"))
    all_sources = docs.select(*named).distinct()
    count = all_sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    rows = all_sources.join(own, ["lang", "source"], "left").join(count, "lang").join(lang, "lang", "left")
    rows = rows.fillna(0, ["total", "v", "lang_total"])
    return rows.withColumn("p0", _share("2", F.col("total") + 2 * F.col("v")))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _leading(shared: DataFrame, top: int) -> DataFrame:
    q = _share("n_lang + 2", F.col("lang_total") + 2 * F.col("v"))
    rows = shared.withColumn("q", q).filter(F.col("p") > F.col("q"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))


def _pairs(shared: DataFrame, totals: DataFrame, terms: int, tile: int) -> DataFrame:
    """Distances between sources: every part of the terms meets every two tiles of
    sources, and sums over the parts are added up."""

    def up_to(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    parts = F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("long")
    tiles = F.ceil(F.col("sources") / tile).cast("long")
    own = F.pmod(F.xxhash64("source"), tiles)
    key = ["lang", "part", "first", "second"]

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("own", own).withColumn("other", up_to(tiles))
        return rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})

    left = met(shared.withColumn("part", F.pmod(F.xxhash64("term"), parts))).select(*key, "source", "term", "p")
    right = met(totals.withColumn("part", up_to(parts))).select(*key, "source", "own", "p0", "v")
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_distances, "lang string, a string, b string, value long")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("x"), "value")
    return _ranked(rows.select("lang", "x.*", "value")).withColumn("part", F.lit("pair"))


def _distances(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms given, less what as many terms that both lack would give;
    the first part of a language adds that for all its terms."""
    rows = sorted(sources.select(["source", "own", "p0", "v", "lang", "part", "first", "second"]).to_pylist(), key=lambda r: r["source"])
    names = [r["source"] for r in rows]
    at = pa.compute.index_in(terms.column("source").combine_chunks(), pa.array(names, pa.string()))
    coded = terms.column("term").combine_chunks().dictionary_encode()
    lacking = np.array([r["p0"] for r in rows], np.int64)
    shares = np.repeat(lacking[:, None], len(coded.dictionary), axis=1)
    shares[np.asarray(at), np.asarray(coded.indices)] = np.asarray(terms.column("p"))
    one, cross = rows[0], rows[0]["first"] != rows[0]["second"]
    own = np.array([r["own"] for r in rows])
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in range(len(rows)):
        others = np.arange(i + 1, len(rows))
        if cross:
            others = others[own[others] != own[i]]
        p, q = shares[i], shares[others]
        same = (lacking[i] - lacking[others]) ** 2 // (lacking[i] + lacking[others])
        value = ((p - q) ** 2 // (p + q) - same[:, None]).sum(axis=1)
        out.append((i, others, value + same * one["v"] if one["part"] == 0 else value))
    a = [names[i] for i, others, _ in out for _ in others]
    b = [names[j] for _, others, _ in out for j in others]
    values = np.concatenate([v for _, _, v in out]).astype(np.int64)
    return pa.table({"lang": pa.array([one["lang"]] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(values)})
