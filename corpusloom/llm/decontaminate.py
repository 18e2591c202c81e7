"""Benchmark passages in documents, by edit distance over words.

Texts become sequences of lower-cased words. A passage of an item with n words may
differ by SHARE * n edits, so some run of words survives unbroken in it; runs of that
length that an item and a document share propose windows of the item's size, at every
shift that the edits allow, where there are as many as the edits leave at least.
Nothing within the distance is lost by that.

Windows and items are embedded by a random walk (Chakraborty, Goldenberg and Koucky,
2016): a pointer moves through the sequence, and whether it moves on after a step is a
random bit that depends on the step and the word under it. Edits become a few unequal
places, since two walks that part soon meet again. A place behind either sequence's end
equals nothing. Each sample of PLACES places of a walk is a hash; a window that agrees
with its item in one of them, at some shift, is a candidate. Long sequences drift
further apart, so they get more walks. Of windows with all the edits that an item
allows, about 99 % become candidates; of unrelated ones a few in a hundred.
Candidates are verified by exact edit distance against the text around them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches, shared_folder, stored
from corpusloom.llm.words import Words, mix, run_hashes

WORD = re.compile(r"\w+")
SHARE = 0.2  # edits for each word of an item
RUN = 3  # words of a seed, at most
WALKS, LONG = 8, 10  # walks of an item, and words for which it gets one more
REPEATS, PLACES = 16, 3  # samples of each walk, and places of a sample
STEPS = 2  # of a walk, for each word: a walk moves on in every other step
CELLS = 1 << 20  # steps of walks kept at a time
ITEMS, BYTES = 20_000, 4 << 20  # searched for in one pass over the documents, about


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def distances(item: list[int], text: list[int]) -> Iterator[int]:
    """Edit distance of `item` to the best passage that ends after each word of `text`
    (Myers, 1999: a column of differences as the bits of two numbers)."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score = full, 0, n
    for w in text:
        eq = at.get(w, 0)
        x = eq | down
        d = ((eq & up) + up ^ up) | eq
        more = down | ~(d | up) & full
        less = up & d
        score += bool(more & top) - bool(less & top)
        more <<= 1
        up = (less << 1 | ~(x | more)) & full
        down = more & x & full
        yield score


class Finder:
    """Searches for a block of items: (item_id, text) each."""

    def __init__(self, items: list[tuple[int, str]]):
        w = Words([normal(t or "").encode() for _, t in items])
        self.ids, self.hashes, seeds, least = [], [], {}, []
        for i, (item_id, _) in enumerate(items):
            hashes = w.hashes[w.first[i] : w.first[i + 1]]
            n = len(hashes)
            if not n:
                continue
            e = int(SHARE * n)
            run = min(RUN, -(-(n - e) // (e + 1)))
            for o, h in enumerate(run_hashes(hashes, run).tolist()):
                seeds.setdefault(run, []).append((h, len(self.ids), o))
            least.append(max(1, n - run + 1 - run * e))
            self.ids.append(item_id)
            self.hashes.append(hashes)
        self.sizes = np.asarray([len(h) for h in self.hashes], np.int64)
        self.edits = (SHARE * self.sizes).astype(np.int64)
        self.least = np.asarray(least, np.int64)
        self.seeds = {}
        for run, rows in seeds.items():
            rows.sort()
            known = np.zeros(1 << 20, bool)
            keys = np.asarray([r[0] for r in rows], np.uint64)
            known[keys >> np.uint64(44)] = True
            self.seeds[run] = (known, keys, np.asarray([r[1:] for r in rows], np.int64))
        self.walks = WALKS + self.sizes // LONG
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*self.hashes, np.empty(0, np.uint64)])
        self.most = STEPS * int(self.sizes.max(initial=1))

    def _bits(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The marks of the steps of walk k and its samples, the same everywhere."""
        rng = np.random.Generator(np.random.PCG64([11, k]))
        return rng.random((REPEATS * PLACES)), rng.integers(0, 2**63, self.most, dtype=np.uint64)

    def _walk(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, size: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The embedding of words[start:stop] for each row; 0 stands for its end."""
        steps = STEPS * int(size.max(initial=0))
        out = np.zeros((len(start), steps), np.uint64)
        at = start.copy()
        for t in range(steps):
            here = np.where(at < stop, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            out[:, t] = here
            at += (mix(here ^ marks[t]) >> np.uint64(17) & np.uint64(1)).astype(np.int64)
        return out

    def windows(self, w: Words) -> np.ndarray:
        """Distinct (text, start, item) that a common run proposes; start is a place
        among all words of the batch and may lie before its text."""
        found = [np.empty((0, 3), np.int64)]
        for run, (known, keys, places) in self.seeds.items():
            if len(w.hashes) < run:
                continue
            runs = run_hashes(w.hashes, run)
            hit = np.flatnonzero(known[runs >> np.uint64(44)])
            low, high = np.searchsorted(keys, runs[hit]), np.searchsorted(keys, runs[hit], side="right")
            count = high - low
            hit, low = np.repeat(hit, count), np.repeat(low, count)
            seed = places[low + np.arange(len(low)) - np.repeat(np.cumsum(count) - count, count)]
            doc = np.searchsorted(w.first, hit, side="right") - 1
            inside = hit + run <= w.first[doc + 1]
            found.append(np.stack((doc, hit - seed[:, 1], seed[:, 0]), axis=1)[inside])
        rows, count = np.unique(np.concatenate(found), axis=0, return_counts=True)
        if not len(rows):
            return rows
        # an edit breaks at most `run` runs, so enough of them start near one place
        doc, start, item = rows.T
        wide = 4 * (len(w.hashes) + int(self.sizes.max()))
        key = (doc * len(self.ids) + item) * wide + start + wide // 2
        order = np.argsort(key)
        key, count = key[order], np.concatenate(([0], np.cumsum(count[order])))
        edits = self.edits[item[order]]
        near = count[np.searchsorted(key, key + edits, side="right")] - count[np.searchsorted(key, key - edits)]
        return rows[order][near >= self.least[item[order]]]

    def agrees(self, w: Words, windows: np.ndarray) -> np.ndarray:
        """Whether a window, at some shift, agrees with its item in all places of a sample."""
        ok = np.zeros(len(windows), bool)
        cells = np.cumsum((2 * self.edits + 1)[windows[:, 2]] * STEPS * self.sizes[windows[:, 2]])
        lo = 0
        while lo < len(windows):
            hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, side="right")))
            part = windows[lo:hi]
            left = np.arange(len(part))
            for k in range(int(self.walks[part[:, 2]].max())):
                left = left[k < self.walks[part[left, 2]]]
                left = left[~self._agree(w, part[left], k, ok[lo:hi], left)]
                if not len(left):
                    break
            lo = hi
        return ok

    def _agree(self, w: Words, windows: np.ndarray, k: int, ok: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which windows agree with their items in a sample of walk k; ok[to] is marked."""
        sample, marks = self._bits(k)
        edits = self.edits[windows[:, 2]]
        shifts = 2 * edits + 1
        row = np.repeat(np.arange(len(windows)), shifts)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(shifts) - shifts, shifts) - edits[row]
        doc, start, item = windows[row].T
        begin = np.maximum(start + shift, w.first[doc])
        stop = np.minimum(start + shift + self.sizes[item], w.first[doc + 1])
        walk = self._walk(w.hashes, begin, stop, self.sizes[item], marks)
        known, which = np.unique(windows[:, 2], return_inverse=True)
        size = self.sizes[known]
        own = self._walk(self.words, self.begin[known], self.begin[known] + size, size, marks)
        at = (sample[None, :] * STEPS * size[:, None]).astype(np.int64)[which[row]]
        here = np.take_along_axis(walk, at, axis=1)
        equal = (here == np.take_along_axis(own[which[row]], at, axis=1)) & (here != 0)
        hit = np.zeros(len(windows), bool)
        np.logical_or.at(hit, row, equal.reshape(len(row), REPEATS, PLACES).all(axis=2).any(axis=1))
        ok[to] |= hit
        return hit

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, first word, word after the last, distance) of each passage;
        of overlapping passages of one item the nearest, then the first."""
        if not self.ids:
            return []
        w = Words([normal(t).encode() for t in texts])
        windows = self.windows(w)
        windows = windows[self.agrees(w, windows)] if len(windows) else windows
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for doc, start, item in windows.tolist():
            e, n = int(self.edits[item]), int(self.sizes[item])
            a, b = max(start - e, int(w.first[doc])), min(start + n + e, int(w.first[doc + 1]))
            parts = regions.setdefault((doc, item), [])
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(b, parts[-1][1])
            else:
                parts.append([a, b])
        found = []
        for (doc, item), parts in regions.items():
            for a, b in parts:
                for start, stop, d in self._passages(item, w.hashes[a:b].tolist()):
                    first = int(w.first[doc])
                    found.append((doc, self.ids[item], a + start - first, a + stop - first, d))
        return sorted(found)

    def _passages(self, item: int, text: list[int]) -> list[tuple[int, int, int]]:
        pattern, limit = self.hashes[item].tolist(), int(self.edits[item])
        ends = [(d, i + 1) for i, d in enumerate(distances(pattern, text)) if d <= limit]
        taken: list[tuple[int, int, int]] = []
        for d, stop in sorted(ends):
            back = list(distances(pattern[::-1], text[:stop][::-1][: len(pattern) + limit]))
            start = stop - 1 - back.index(d)
            if all(stop <= a or start >= b for a, b, _ in taken):
                taken.append((start, stop, d))
        return taken


def passes(benchmark: DataFrame, one: Callable[[Broadcast, int], DataFrame]) -> Iterator[DataFrame]:
    """What `one` gives for each block of items: about ITEMS items and BYTES bytes, sent to
    the executors under a number. Only one block at a time is held: where there are
    several, a block's rows are written before the next is collected."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    folder = shared_folder(spark) if blocks > 1 else ""
    for b in range(blocks):
        block = [tuple(r) for r in items.filter(part == b).orderBy("item_id", "text").collect()]
        data = spark.sparkContext.broadcast(block)
        rows = one(data, hash(tuple(block)))
        if blocks > 1:
            rows = stored(rows, folder, f"block-{b}")
            data.destroy()
        yield rows


_finders: dict[int, Finder] = {}


def finder(data, number: int) -> Finder:
    """The tables of the broadcast items, built once in a Python worker."""
    if number not in _finders:
        _finders.clear()
        _finders[number] = Finder(data.value)
    return _finders[number]


def benchmark_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage: doc_id, item_id, start_word, end_word (exclusive), distance.

    A passage is a run of words whose edit distance to an item is at most SHARE of the
    item's words. Null and empty texts have no passages, and null and empty items none
    either. Rows with equal or null doc_id are texts of their own. Items with equal
    texts are all reported; repeated rows of the benchmark count once. Other columns are
    ignored."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)])
    for name in ("start_word", "end_word", "distance"):
        schema.add(name, T.LongType())

    def search(data: Broadcast, number: int) -> DataFrame:
        def find(batches):
            for batch in text_batches(batches):
                hits = finder(data, number).search([t.decode() for t in batch.column("text").to_pylist()])
                columns = list(zip(*hits)) or [()] * 5
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in columns[1:]],
                    names=schema.names,
                )

        return map_batches(rows, find, schema)

    return reduce(DataFrame.unionByName, passes(benchmark, search))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a passage of an item, with all their columns."""
    schema = docs.schema

    def search(data: Broadcast, number: int) -> DataFrame:
        def clean(batches):
            for batch in text_batches(batches):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                hit = {h[0] for h in finder(data, number).search(texts)}
                yield batch.filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_()))

        return map_batches(docs, clean, schema)

    for docs in passes(benchmark, search):  # each block searches what the one before left
        pass
    return docs
