"""Toxicity scores from positive and unlabelled text.

A linear model over hashed words and word beginnings is fitted by non-negative
positive-unlabelled learning (Kiryo and others, 2017). The risk of the unlabelled texts
as negatives is corrected by the share of positives they hide (the class prior); where
the corrected part falls below zero the step climbs out again, which keeps the model
from treating hidden positives as negatives. Only confirmed toxic texts and texts
without regard to any label enter the risk; the prior is the toxic share among the
labelled rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches, shared_folder, stored

BUCKETS = 1 << 18
POSITIVES, UNLABELLED = 4_000, 12_000  # texts fitted on, at most
BEGINNINGS = (3, 4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
LEAST_TEXTS = 3  # positive texts that a feature must occur in
DEVIATIONS = 3.0  # by which it must be more frequent there than among the unlabelled
_hashes: dict[str, np.ndarray] = {}


def features(text: str) -> np.ndarray:
    """Buckets of the distinct lower-cased words and their beginnings."""
    found = [_word(w) for w in set(LETTERS.findall(text.lower()))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _word(word: str) -> np.ndarray:
    known = _hashes.get(word)
    if known is None:
        if len(_hashes) >= 200_000:
            _hashes.clear()
        parts = [word, *(word[:k] + "~" for k in BEGINNINGS if len(word) >= k)]
        known = _hashes[word] = np.asarray([_bucket(p.encode()) for p in parts], np.int64)
    return known


def _bucket(data: bytes) -> int:
    """FNV-1a, the same in every process."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features(text)].sum() + self.bias, -30, 30))))


class Rows:
    """Sparse binary rows over a compact numbering of the features in use."""

    def __init__(self, rows: list[np.ndarray], number: np.ndarray):
        kept = [number[r][number[r] >= 0] for r in rows]
        self.n = len(kept)
        self.columns = np.concatenate([*kept, np.empty(0, np.int32)])
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(k) for k in kept])

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], self.n) + bias

    def gradient(self, slopes: np.ndarray, size: int) -> np.ndarray:
        return np.append(np.bincount(self.columns, slopes[self.row], size), slopes.sum())


def _telling(seen: np.ndarray, among: np.ndarray, positive: int, unlabelled: int) -> np.ndarray:
    """Features that `positive` texts have (`seen` of them) more often than chance would
    give them by the `unlabelled` ones (`among`)."""
    expected = among * (positive / unlabelled)
    return np.flatnonzero((seen >= min(LEAST_TEXTS, positive)) & (seen - expected >= DEVIATIONS * np.sqrt(expected + 1)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, decay: float = 3e-4) -> Model:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)), with logistic loss, by
    Adam over all rows. Without positive texts every score is next to 0."""
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), -10.0)
    seen, among = (np.bincount(np.concatenate(rows), minlength=BUCKETS) for rows in (positive, unlabelled))
    used = _telling(seen, among, len(positive), len(unlabelled))
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    p, u = Rows(positive, number), Rows(unlabelled, number)
    x = np.append(np.zeros(len(used)), np.log(prior / (1 - prior)))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    for t in range(1, steps + 1):
        mp, mu = p.margins(x[:-1], x[-1]), u.margins(x[:-1], x[-1])
        negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        corrected = u.gradient(sigmoid(mu) / u.n, len(used)) - p.gradient(prior * sigmoid(mp) / p.n, len(used))
        if negative >= 0:
            g = p.gradient(prior * (sigmoid(mp) - 1) / p.n, len(used)) + corrected
        else:
            g = -corrected
        g[:-1] += decay * x[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        x = x - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = x[:-1]
    return Model(weights, float(x[-1]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of `docs` and the rows of `labels` (doc_id, toxic).
    Rows of the held-out fold, and rows with a null doc_id, are not read.

    The fit is on a sample whose size is fixed: at most POSITIVES toxic and UNLABELLED
    other texts, those with the smallest hashes of their
    doc_id. A doc_id that is labelled toxic in one row and clean in another counts as
    not labelled."""
    marks = labels.filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    marks = marks.filter("low = high").select("doc_id", F.col("high").alias("toxic"))
    n, toxic = marks.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return fit([], [], 0.5)
    prior = min(0.5, max(1e-3, toxic / n))
    # a share of the ids first, so that the sort sees few more rows than it keeps
    total = docs.count()
    order = F.xxhash64("doc_id")

    def few(df: DataFrame, size: int, count: int) -> DataFrame:
        below = min(2**63 - 1, int(-(2**63) + min(1.0, 3 * size / max(count, 1)) * 2**64))
        return df.filter(order <= below).orderBy(order, "doc_id").limit(size)

    known = few(marks.filter("toxic = 1").select("doc_id"), POSITIVES, toxic)
    folder = shared_folder(docs.sparkSession)
    positive = _texts(docs.join(F.broadcast(known), "doc_id"), POSITIVES, folder, "positive")  # at most POSITIVES ids
    pool = docs.filter(~held_out()).filter("text != ''").select("doc_id", "text")
    # ids first, so that texts are read where they are and not gathered in one task
    others = few(pool.select("doc_id"), UNLABELLED, total).distinct()  # at most UNLABELLED ids
    unlabelled = _texts(pool.join(F.broadcast(others), "doc_id"), UNLABELLED, folder, "unlabelled")
    sizes = positive.count(), unlabelled.count()
    if not all(sizes):
        return fit([], [], prior)
    used = _telling(_frequencies(positive), _frequencies(unlabelled), *sizes)
    return fit(_few_features(positive, used), _few_features(unlabelled, used), prior)


def _texts(df: DataFrame, count: int, folder: str, name: str) -> DataFrame:
    """Features of the texts, made where the texts are, with a place that the rows alone
    decide; of more than `count` texts those with the first places."""

    def extract(batches):
        for batch in text_batches(batches):
            rows = [features((t or b"").decode()) for t in batch.column("text").to_pylist()]
            found = pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.record_batch({"place": batch.column("place"), "f": found})

    text = F.coalesce("text", F.lit(""))
    placed = df.select(F.xxhash64("doc_id", text).alias("place"), text.cast("binary").alias("text"))
    found = stored(map_batches(placed, extract, "place long, f array<int>"), folder, name)
    return found.orderBy("place").limit(count) if found.count() > count else found


def _frequencies(rows: DataFrame) -> np.ndarray:
    """Texts that have each feature: BUCKETS numbers, whatever the input."""
    out = np.zeros(BUCKETS, np.int64)
    found = rows.select(F.explode("f").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def _few_features(rows: DataFrame, used: np.ndarray) -> list[np.ndarray]:
    """The features in use of each text, in order of place; only they come to the driver."""
    wanted = pa.array(used, pa.int32())

    def keep(batches):
        for batch in batches:
            column = batch.column("f")
            flat, sizes = column.flatten(), np.asarray(column.value_lengths())
            known = np.asarray(pa.compute.is_in(flat, wanted))
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes)))
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), flat.filter(pa.array(known)))
            yield pa.record_batch({"place": batch.column("place"), "f": kept})

    found = map_batches(rows, keep, rows.schema).toArrow()
    out = []
    for part in found.column("f").chunks:
        flat, offsets = np.asarray(part.values), np.asarray(part.offsets)
        out += [flat[a:b] for a, b in zip(offsets, offsets[1:])]
    return [out[i] for i in np.argsort(found.column("place").to_numpy(), kind="stable")]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Null and empty
    texts get the score of a text without known words; a null doc_id is in no fold and
    counts as not held out. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS numbers, whatever the input
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        for batch in text_batches(batches):
            model = Model(*sent.value)
            found = [model.score(t.decode()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(found, pa.float64())})

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_batches(rows, score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def clean(batches):
        for batch in text_batches(batches):
            model = Model(*sent.value)
            keep = [model.score(t or "") < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, clean, docs.schema)
