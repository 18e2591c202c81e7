"""Compression of vectors to codes by part, with a memory of grid cells.

A vector's parts are whole numbers. Each falls into a coarse cell of a grid; for a cell,
bounds on the distance from any point of its box to an entry (least and greatest) show
which entries can be nearest to some point in it. Those candidates are kept per cell,
and only they are compared exactly. All results are whole numbers and exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.llm.shared import shared_folder, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CELL = 32  # side of a grid cell
CELLS = 1 << 16  # cells of a part that a task remembers
ROWS = 4096  # vectors compared at a time
_NARROW = 1 << 29  # squared distances below this fit 64 bits; beyond it Python's numbers are used
_LONG = 1 << 63
_HALF = 10**19  # sums are added up in two halves, as single precision exceeds 38 digits


class Cells:
    """Nearest entries of one part's codebook, an array (entries, size) of whole numbers."""

    def __init__(self, entries: np.ndarray, side: int = CELL, most: int = CELLS):
        self.entries, self.side, self.most = entries, side, most
        self.known: dict[bytes, int] = {}
        self.candidates = np.empty((0, 1), np.int64)
        self.compared = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, the lowest of equally near ones, and
        its squared distance."""
        cells, inverse = np.unique(points // self.side, axis=0, return_inverse=True)
        near = self._of(cells)[inverse.ravel()]
        apart = ((points[:, None, :] - self.entries[near]) ** 2).sum(axis=2)
        best = apart.argmin(axis=1)  # candidates are in order, so the first is the lowest
        rows = np.arange(len(points))
        self.compared += near.size
        return near[rows, best], apart[rows, best]

    def _of(self, cells: np.ndarray) -> np.ndarray:
        """Candidates of each cell; short lists repeat their last one."""
        keys = [c.tobytes() for c in cells]
        if len(self.known) + len(keys) > self.most:
            self.known, self.candidates = {}, self.candidates[:0]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            found = self._not_dominated(cells[new])
            width = max(found.shape[1], self.candidates.shape[1])
            wide = [np.pad(x, ((0, 0), (0, width - x.shape[1])), "edge") for x in (self.candidates, found)]
            self.known.update((keys[i], len(self.candidates) + j) for j, i in enumerate(new))
            self.candidates = np.concatenate(wide)
        return self.candidates[[self.known[k] for k in keys]]

    def _not_dominated(self, cells: np.ndarray) -> np.ndarray:
        """Entries whose least distance to the box is not above the smallest greatest
        distance of any entry: others are farther than that one all over the box."""
        low = (cells * self.side)[:, None, :]
        high = low + self.side - 1
        under, over = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(high - self.entries, self.entries - low) ** 2).sum(axis=2)
        stay = least <= greatest.min(axis=1)[:, None]
        count = stay.sum(axis=1)
        place = np.argsort(~stay, axis=1, kind="stable")[:, : count.max()]
        last = np.minimum(np.arange(place.shape[1]), count[:, None] - 1)
        return np.take_along_axis(place, last, axis=1)


class WideCells(Cells):
    """For numbers beyond 64 bits: every entry is a candidate."""

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = ((points[:, None, :] - self.entries) ** 2).sum(axis=2)
        best = apart.argmin(axis=1)
        return best, apart[np.arange(len(points)), best]


def whole(column: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * x) of vectors that all have `size` numbers."""
    flat = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    if len(flat) and np.abs(flat).max() >= _NARROW:
        return np.array([int(x) for x in flat], object).reshape(-1, size)
    return flat.astype(np.int64).reshape(-1, size)


def _cells(book: np.ndarray, points: np.ndarray, known: dict) -> list[Cells]:
    """One for each part of `book` (parts, entries, size of a part), kept in `known`."""
    wide = book.dtype == object or points.dtype == object
    if wide not in known:
        kind = WideCells if wide else Cells
        known[wide] = [kind(part.astype(object) if wide else part) for part in book]
    return known[wide]


def usable(vector: str) -> Column:
    """Whether a vector is there and all its numbers are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(F.col(vector), bad), F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """Length of most vectors, the longest of equally common ones; 0 without vectors."""
    sizes = vectors.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.filter("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def first_codebook(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts of the vectors of length `size` with the smallest ids (nulls last, then by vector)."""
    if size % parts:
        raise ValueError(f"vectors of {size} numbers cannot be cut into {parts} equal parts")
    rows = vectors.filter(F.size("embedding") == size).orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    column = rows.select("embedding").limit(entries).toArrow().column("embedding").combine_chunks()
    return whole(column, size).reshape(-1, parts, size // parts).transpose(1, 0, 2)


def moved_codebook(vectors: DataFrame, book: np.ndarray) -> np.ndarray:
    """Every entry becomes the floor of the mean of the parts nearest to it."""
    size = book.shape[0] * book.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        total, count = np.zeros(book.shape, object), np.zeros(book.shape[:2], np.int64)
        for points in _points(batches, size):
            for part, cells in enumerate(_cells(book, points, known)):
                own = points[:, part * book.shape[2] : (part + 1) * book.shape[2]]
                code, _ = cells.nearest(own)
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                total[part, used] += np.add.reduceat(own[order], starts, axis=0).astype(object)
                count[part] += np.bincount(code, minlength=book.shape[1])
        part, entry = np.nonzero(count)
        halves = [[divmod(int(x), _HALF) for x in total[p, e]] for p, e in zip(part, entry)]
        columns = [[[Decimal(h[i]) for h in x] for x in halves] for i in (0, 1)]
        kind = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *(pa.array(c, kind) for c in columns)],
            ["part", "entry", "n", "high", "low"],
        )

    schema = "part long, entry long, n long, high array<decimal(38,0)>, low array<decimal(38,0)>"
    rows = vectors.select("embedding").mapInArrow(sums, schema)
    places = [F.sum(F.get(h, F.lit(i))).alias(f"{h}{i}") for h in ("high", "low") for i in range(book.shape[2])]
    moved = book.copy()
    # one row for each entry of each part, whatever the number of vectors
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        mean = [(int(r[f"high{i}"]) * _HALF + int(r[f"low{i}"])) // r["n"] for i in range(book.shape[2])]
        if moved.dtype != object and max(map(abs, mean)) >= _NARROW:
            moved = moved.astype(object)
        moved[r["part"], r["entry"]] = mean
    return moved


def _points(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column("embedding")
        column = column.filter(pa.compute.equal(column.value_lengths(), size))
        for start in range(0, len(column), ROWS):
            yield whole(column.slice(start, ROWS), size)


def encoded(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """All columns with `code`, array of the index of each part's nearest entry, and
    `error`, their squared distances added up (null where it doesn't fit 64 bits)."""
    kept = [c for c in vectors.columns if c not in ("code", "error")]
    schema = T.StructType([vectors.schema[c] for c in kept])
    schema.add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    size = book.shape[0] * book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole_batch in batches:
            for start in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(start, ROWS)
                column = batch.column("embedding")
                fits = np.asarray(pa.compute.equal(column.value_lengths(), size))
                points = whole(column.filter(pa.array(fits)), size)
                found = [c.nearest(points[:, i * book.shape[2] : (i + 1) * book.shape[2]]) for i, c in enumerate(_cells(book, points, known))]
                codes = iter(np.stack([f[0] for f in found], axis=1).tolist())
                errors = iter(sum(f[1] for f in found).tolist())
                rows = [(next(codes), next(errors)) if f else (None, None) for f in fits]
                errors = [e if e is not None and e < _LONG else None for _, e in rows]
                codes = pa.array([c for c, _ in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), codes, pa.array(errors, pa.int64())], schema.names)

    return vectors.select(*kept).mapInArrow(run, schema)


def codebook_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, folder: str | None = None
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, label) -> (vec_id, label, code, error), and the codebook (parts,
    entries, numbers of a part).

    Rows whose vector is null or holds a null or a number that isn't finite are left out.
    The codebook starts as the vectors with the smallest ids (null ids come last, equal ids
    go by vector) and is moved to the means `rounds` times; entries near to nothing stay.
    With fewer rows than `entries` there are as many entries as rows. Equally near entries: the
    lowest index. A vector of another length than most have has null code and error and
    moves nothing. Repeated rows each count. Other columns are ignored. An
    empty table gives no rows and an empty codebook."""
    folder = folder or shared_folder(vectors.sparkSession)
    kept = stored(vectors.filter(usable("embedding")).select("vec_id", "embedding", "label"), folder, "vectors")
    size = common_length(kept)
    if not size:
        nothing = {"code": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("long")}
        return kept.select("vec_id", "label").withColumns(nothing), np.empty((parts, 0, 0), np.int64)
    book = first_codebook(kept, size, parts, entries)
    for _ in range(rounds):
        book = moved_codebook(kept, book)
    return stored(encoded(kept, book).select("vec_id", "label", "code", "error"), folder, "codes"), book


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add `label_error`, the error summed over rows of the same label; nulls are one. Sums
    come from partial aggregation, so a common label is never gathered."""
    sums = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
