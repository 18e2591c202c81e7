"""Nearest vectors by cosine: exact, within groups, and over sign-hash cells.

Every task keeps only its best k per query, so what is shuffled does not grow
with the number of vectors per task. Exact search sends a small query side to all
tasks, after its size has been checked; a larger one is split and meets the vectors
block by block. Approximate search is one plan for any number of queries: vectors are
dealt out by cell, every query goes to the cells near to it, and products are made only
where they meet. A group or cell of any size is worked on in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusloom.functions import fixed
from corpusloom.functions.arrow import parts
from corpusloom.functions.text import ellipsis, strip
from corpusloom.functions.vectors import cells, sign_planes

# What may be sent to every task: 4,096 queries of 1,024 doubles are 32 MiB.
MAX_SENT_QUERIES = 4096
MAX_SENT_BYTES = 256 << 20
MAX_CELL_BITS = 16  # a stored table has a directory for each cell, and a filter lists those to read
FAN_IN = 64  # lists of best rows of one query that a task merges, where there are many
PART_ROWS = 2048  # vectors that are compared with up to 256 queries at a time
DIGITS = 6  # similarities are single precision; ties beyond that go by id


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as one matrix; NULL and empty vectors count as zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    dim = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends, lengths)):
        out[i, :n] = flat[end - n : end]
    return out


def _widened(m: np.ndarray, dim: int) -> np.ndarray:
    """Zeros for the numbers that shorter vectors lack."""
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


class _Best:
    """Running best k per query over the batches of a task. Never holds more
    than k rows per query plus one batch."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = _unit(queries), k
        self.ids = [np.empty(0, dtype=object)] * len(queries)
        self.sims = [np.empty(0)] * len(queries)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not vectors.shape[1]:
            return
        by_id = np.argsort(ids, kind="stable")  # so that ties go by id
        ids, vectors = ids[by_id], _unit(_widened(vectors[by_id], self.queries.shape[1]))
        for first in range(0, len(self.queries), 256):
            sims = np.round(self.queries[first : first + 256] @ vectors.T, DIGITS) + 0.0
            for q, (row, most) in enumerate(zip(sims, sims.max(axis=1)), first):
                if len(self.sims[q]) < self.k or most >= self.sims[q][-1]:
                    self._merge(q, ids, row)

    def _merge(self, q: int, ids: np.ndarray, row: np.ndarray) -> None:
        k = self.k
        floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else row.min()
        if len(self.sims[q]) >= k:
            floor = max(floor, self.sims[q][-1])
        near = np.concatenate([np.nonzero(row > floor)[0], np.nonzero(row == floor)[0][:k]])
        all_ids = np.concatenate([self.ids[q], ids[near]])
        all_sims = np.concatenate([self.sims[q], row[near]])
        order = sorted(range(len(all_ids)), key=lambda i: (-all_sims[i], all_ids[i]))[:k]
        self.ids[q], self.sims[q] = all_ids[order], all_sims[order]

    def batch(self, query_ids: list, names: list[str], id_type: pa.DataType, query_type: pa.DataType) -> pa.RecordBatch:
        qs, ids, sims = [], [], []
        for q, (i, s) in enumerate(zip(self.ids, self.sims)):
            qs += [query_ids[q]] * len(i)
            ids += list(i)
            sims += list(s)
        return pa.RecordBatch.from_arrays(
            [pa.array(qs, query_type), pa.array(ids, id_type), pa.array(sims, pa.float64())], names=names
        )


class SignCells:
    """Cells by the signs of products with fixed planes, one bit for each. `reach`: a query
    looks into cells at most so many bits away."""

    def __init__(self, bits: int, reach: int = 1) -> None:
        if not 0 < bits <= MAX_CELL_BITS:
            raise ValueError(f"cells have 1 to {MAX_CELL_BITS} bits")
        self.bits, self.reach = bits, reach

    def of(self, matrix: np.ndarray) -> np.ndarray:
        return cells(matrix, _planes(self.bits, matrix.shape[1]))

    def near(self, matrix: np.ndarray, most: int | None = None) -> np.ndarray:
        """For each vector, a row of cells within reach, by how little the planes that part
        them lie from the vector; the first `most` of them."""
        masks = np.array(sorted(sum(1 << b for b in c) for n in range(self.reach + 1) for c in combinations(range(self.bits), n)))
        margins = matrix @ _planes(self.bits, matrix.shape[1]).T
        crossed = (masks[:, None] >> np.arange(self.bits)) & 1
        order = np.argsort(np.abs(margins) @ crossed.T, axis=1, kind="stable")[:, :most]
        return self.of(matrix)[:, None] ^ masks[order]


class PivotCells:
    """Cells by the most similar of some unit vectors, the lowest number of equal ones."""

    def __init__(self, pivots: np.ndarray) -> None:
        if not 0 < len(pivots) <= 1 << MAX_CELL_BITS:
            raise ValueError(f"there are 1 to {1 << MAX_CELL_BITS} pivots")
        self.pivots = _unit(np.asarray(pivots, np.float64))

    def near(self, matrix: np.ndarray, most: int | None = None) -> np.ndarray:
        return np.argsort(-self._similar(matrix), axis=1, kind="stable")[:, :most]

    def of(self, matrix: np.ndarray) -> np.ndarray:
        return self._similar(matrix).argmax(axis=1).astype(np.int64)

    def _similar(self, matrix: np.ndarray) -> np.ndarray:
        return np.round(_unit(_widened(matrix, self.pivots.shape[1])) @ self.pivots.T, DIGITS)


@lru_cache(8)
def _planes(bits: int, dim: int) -> np.ndarray:
    return sign_planes(bits, dim)


def fit_pivots(corpus: DataFrame, count: int = 256, per_pivot: int = 64, rounds: int = 10) -> PivotCells:
    """Pivots fitted to a sample of count x per_pivot vectors, those with the smallest hashes
    of their ids, however many there are: means of the sampled vectors most similar to each,
    moved `rounds` times. The same rows give the same pivots."""
    order = [F.xxhash64("id"), F.col("id")]
    # the bound of the sample is count x per_pivot rows
    sample = _unit(_matrix(corpus.select("id", "embedding").orderBy(*order).limit(count * per_pivot).toArrow().column("embedding")))
    if not len(sample):
        raise ValueError("no vectors to fit pivots to")
    pivots = sample[:count].copy()
    for _ in range(rounds):
        nearest_one = np.round(sample @ pivots.T, DIGITS).argmax(axis=1)
        for j in np.unique(nearest_one):
            pivots[j] = sample[nearest_one == j].mean(axis=0)
        pivots = _unit(pivots)
    return PivotCells(pivots)


def with_cells(df: DataFrame, by: int | SignCells | PivotCells, vector: str = "embedding") -> DataFrame:
    """Add `cell`, to write a table by: `write.partitionBy("cell")`. A search over such a
    table with the same cells (a number stands for the bits of sign cells) then reads only
    those near its queries. NULL and empty vectors count as zero."""
    by = SignCells(by) if isinstance(by, int) else by

    def run(vectors: pd.Series) -> pd.Series:
        matrix = _matrix(pa.array(vectors, pa.list_(pa.float64()), from_pandas=True))
        return pd.Series(by.of(matrix) if matrix.shape[1] else np.zeros(len(matrix)), dtype="int64")

    run.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return df.withColumn("cell", F.pandas_udf(run, "long")(vector))


def routed(queries: DataFrame, by: SignCells | PivotCells, most: int | None = None) -> DataFrame:
    """(query_id, embedding) -> a row (query_id, query, cell) for each cell to look into,
    the nearest `most` of them."""
    asked = queries.select("query_id", F.col("embedding").alias("query"))
    schema = T.StructType([asked.schema["query_id"], asked.schema["query"], T.StructField("cell", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = _matrix(b.column("query"))
            cell = by.near(matrix, most) if matrix.shape[1] else np.zeros((len(matrix), 1), np.int64)
            taken = b.take(pa.array(np.repeat(np.arange(len(matrix)), cell.shape[1])))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell.ravel().astype(np.int64))], schema.names)

    return asked.mapInArrow(run, schema)


def _hit_type(vectors: DataFrame, asked: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType),
         T.StructField("similarity", T.DoubleType())]
    )


def best_hits(hits: DataFrame, k: int, lists: int | None = None) -> DataFrame:
    """The k best of each query's hits, with `rank`. Where a query has up to `lists` lists
    of hits, groups of FAN_IN lists are merged first, level by level, so that no task gets
    more than FAN_IN x k rows of a query; that needs their number in `list`."""
    order = [F.desc("similarity"), F.col("id")]
    while lists is not None and lists > FAN_IN:
        lists = -(-lists // FAN_IN)
        # hits of equal lists / FAN_IN meet; others follow in the next round
        hits = hits.withColumn("list", F.expr(f"list div {FAN_IN}"))
        within = Window.partitionBy("query_id", "list").orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    within = Window.partitionBy("query_id").orderBy(*order)
    return hits.drop("list").withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)


def _block_best(k: int):
    """Best k of the vectors of a block for each query of a block."""
    names = ["query_id", "id", "similarity"]

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        id_type, query_type = v.schema.field("id").type, q.schema.field("query_id").type
        best = _Best(_matrix(q.column("query")), k)
        for b in v.to_batches(max_chunksize=PART_ROWS) if q.num_rows else []:
            best.add(np.array(b.column("id").to_pylist(), dtype=object), _matrix(b.column("embedding")))
        return pa.Table.from_batches([best.batch(q.column("query_id").to_pylist(), names, id_type, query_type)])

    return run


def nearest_in_groups(
    vectors: DataFrame, queries: DataFrame, group: str, k: int, block: int = 50_000, query_block: int = MAX_SENT_QUERIES
) -> DataFrame:
    """(group, id, embedding) x (group, query_id, query) -> query_id, id, similarity: up to
    k rows for each query and block of vectors of its groups. Vectors meet only queries of
    their own group. A group is cut into blocks of vectors and of queries by hash; blocks
    meet in tasks of bounded size, however large a group is."""
    sizes = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_vs"))
    asks = queries.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / query_block).alias("_qs"))
    shape = sizes.join(asks, group)  # a row for each group with both

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = vectors.join(shape, group).select(group, "id", "embedding", F.pmod(F.xxhash64("id"), F.col("_vs")).alias("_v"), numbers("_qs").alias("_q"))
    right = queries.join(shape, group).select(group, "query_id", "query", F.pmod(F.xxhash64("query_id"), F.col("_qs")).alias("_q"), numbers("_vs").alias("_v"))
    key = [group, "_v", "_q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_best(k), _hit_type(vectors, queries))


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    cell_bits: int | None = None,
    cell_reach: int = 1,
    max_sent: int = MAX_SENT_QUERIES,
    block: int = 50_000,
    by: SignCells | PivotCells | None = None,
    probes: int | None = None,
) -> DataFrame:
    """(id, embedding) x (query_id, embedding) -> query_id, id, similarity, rank.

    With cells (`by`, or sign cells of `cell_bits` and `cell_reach`) a query is compared only
    with vectors in its `probes` nearest cells (approximate); without them with all vectors
    (exact). A column `cell` that `with_cells` made by the same cells limits what is read."""
    by = SignCells(cell_bits, cell_reach) if cell_bits else by
    if by:
        return _nearest_in_cells(corpus, queries, k, by, probes, block, max_sent)
    vectors = corpus.select("id", "embedding")
    asked = queries.select("query_id", F.col("embedding").alias("query"))
    head = asked.limit(max_sent + 1).toArrow()
    if head.num_rows > max_sent or head.nbytes > MAX_SENT_BYTES:
        return _blockwise(vectors, asked, k, max_sent, block)
    query_ids, query_type = head.column("query_id").to_pylist(), head.schema.field("query_id").type
    sent = corpus.sparkSession.sparkContext.broadcast(_matrix(head.column("query")))
    out = _hit_type(vectors, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in (p for batch in batches for p in parts(batch, rows=PART_ROWS)):
            best = best or _Best(sent.value, k)
            best.add(np.array(b.column(0).to_pylist(), dtype=object), _matrix(b.column(1)))
            id_type = b.schema.field(0).type
        if best is not None:
            yield best.batch(query_ids, out.names, id_type, query_type)

    return best_hits(vectors.mapInArrow(run, out), k)


def _nearest_in_cells(corpus, queries, k, by, probes, block, query_block) -> DataFrame:
    asked = routed(queries, by, probes)
    if "cell" in corpus.columns:
        # cells are at most 2 ** MAX_CELL_BITS numbers; the scan reads only those asked for
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]
        vectors = corpus.filter(F.col("cell").isin(wanted)).select("cell", "id", "embedding")
    else:
        vectors = with_cells(corpus.select("id", "embedding"), by)
    # partial lists of a query come from few cells; Spark prunes them in every task before the shuffle
    return best_hits(nearest_in_groups(vectors, asked, "cell", k, block, query_block), k)


def _blockwise(vectors, asked, k, query_block, block) -> DataFrame:
    """Many queries: every block of vectors meets every block of queries in a
    task of its own; blocks have bounded size and each task emits only its best."""
    n, m = (int(d.count()) for d in (vectors, asked))
    v_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int").alias("_v"))
    left = left.select("id", "embedding", "_v", numbers(q_blocks).alias("_q"))
    right = asked.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("_q"))
    right = right.select("query_id", "query", "_q", numbers(v_blocks).alias("_v"))
    best = _block_best(k)

    def run(key: tuple, v: pa.Table, q: pa.Table) -> pa.Table:
        found = best(v, q)
        return found.append_column("list", pa.array([key[0].as_py()] * found.num_rows, pa.int32()))

    schema = T.StructType([*_hit_type(vectors, asked), T.StructField("list", T.IntegerType())])
    hits = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(run, schema)
    return best_hits(hits, k, v_blocks)


def hit_rows(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with the fields of the chunk they point to."""
    return hits.join(corpus.drop("embedding"), "id")


def intent(similarity: Column, threshold: float = fixed.INTENT_THRESHOLD) -> Column:
    return F.when(similarity >= threshold, fixed.INTENT_DOMAIN).otherwise(fixed.INTENT_CHAT)


def gates(queries: DataFrame, hits: DataFrame, threshold: float = fixed.INTENT_THRESHOLD, floor: float = fixed.DOCUMENT_FLOOR) -> DataFrame:
    """Per query: best similarity (0 without hits), intent, and whether
    documents are used."""
    top = hits.groupBy("query_id").agg(F.max("similarity").alias("top_similarity"))
    joined = queries.join(top, "query_id", "left").withColumn("top_similarity", F.coalesce("top_similarity", F.lit(0.0)))
    joined = joined.withColumn("intent", intent(F.col("top_similarity"), threshold))
    use = (F.col("intent") == fixed.INTENT_DOMAIN) & (F.col("top_similarity") >= floor)
    return joined.withColumn("use_documents", use)


def document_context(hits: DataFrame, floor: float = fixed.DOCUMENT_FLOOR, top: int = 2, width: int = 1500) -> DataFrame:
    """Text of the first `top` hits above the floor. A query without such a hit
    has no row; one whose hits are all too short has an empty text. Needs
    query_id, rank, similarity, title, content."""
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    best = hits.filter(F.col("similarity") >= floor).withColumn("_place", F.row_number().over(by_rank)).filter(F.col("_place") <= top)
    text = F.col("content")
    stripped = strip(text)
    shown = ellipsis(text, width)
    shown_stripped = strip(shown)
    usable = (F.length(stripped) >= 10) & (F.length(shown_stripped) > 10)
    part = F.when(usable, F.concat(F.lit("["), F.coalesce("title", F.lit("N/A")), F.lit("]: "), shown))
    # at most `top` parts per query are collected
    parts = F.sort_array(F.collect_list(F.when(usable, F.struct(F.col("_place"), part.alias("t")))))
    return best.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))
