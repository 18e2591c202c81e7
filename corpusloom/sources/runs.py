"""Tables that grow by batches and are read by key: visited urls, ends of sessions, messages.

Each batch adds a run, its rows in folders by hash bucket of the key and a Bloom filter for
each bucket. A lookup tests its keys against the filters and reads only the (run, bucket)
folders that may hold one of them. Every `fan_in` runs are merged into one, so the number of
runs, and of files a lookup may open, does not grow with the number of batches."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import _parse_datatype_string

_RUN = re.compile(r"run=(\d+)-(\d+)$")


def filter_bits(keys: int, false_rate: float) -> tuple[int, int]:
    """Size in bits, a multiple of 8, and number of hashes of a Bloom filter."""
    bits = max(64, math.ceil(-max(keys, 1) * math.log(false_rate) / math.log(2) ** 2))
    bits += -bits % 8
    return bits, max(1, round(bits / max(keys, 1) * math.log(2)))


def _places(first: np.ndarray, second: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Places of keys in a filter, a row for each key, from two hashes of the key."""
    steps = np.arange(hashes, dtype=np.uint64)
    mixed = first.astype(np.int64).view(np.uint64)[:, None] + steps * (second.astype(np.int64).view(np.uint64)[:, None] | np.uint64(1))
    return (mixed % np.uint64(bits)).astype(np.int64)


@dataclass
class Runs:
    """Rows of `schema` below `path`, found by the column `key`. `buckets` and the layout
    belong to the table and stay. A run is written once and then only read; it counts from
    the moment its filters are written, and a batch that is repeated writes it anew.
    `combine` may reduce the rows of runs that are merged, to one per key for instance."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int = 64
    fan_in: int = 8
    false_rate: float = 0.01
    combine: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def _hashed(self, rows: DataFrame) -> DataFrame:
        key = F.col(self.key)
        return rows.withColumns({"_one": F.xxhash64(key), "_two": F.xxhash64(F.lit("two"), key)}).withColumn(
            "bucket", F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")
        )

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _spans(self, before: int | None) -> list[tuple[int, int]]:
        """(first, last) batch of all runs of batches below `before`, long ones first."""
        path, system = self._folder("filters/run=*/_SUCCESS")
        found = system.globStatus(path) or []
        spans = [tuple(map(int, _RUN.search(f.getPath().getParent().toString()).groups())) for f in found]
        return sorted((s for s in spans if before is None or s[1] < before), key=lambda s: (s[0], -s[1]))

    def _listed(self, before: int | None) -> list[tuple[int, int]]:
        """The runs that count: of those that overlap the longest, which holds the others."""
        chosen: list[tuple[int, int]] = []
        for first, last in self._spans(before):
            if not chosen or first > chosen[-1][1]:
                chosen.append((first, last))
        return chosen

    def vacuum(self, before: int) -> None:
        """Delete runs that a longer one holds, where both are of batches below `before`.
        Batches from `before` on can be repeated afterwards, and no reader may be at work."""
        kept = self._listed(before)
        for first, last in set(self._spans(before)) - set(kept):
            for kind in ("filters", "rows"):
                path, system = self._folder(f"{kind}/run={first}-{last}")
                system.delete(path, True)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        """Rows first, filters last. Rows are dealt out by bucket, so a run has one file for
        each bucket it touches; Spark splits a bucket that a common key makes large."""
        name = f"run={first}-{last}"
        hashed = self._hashed(rows.selectExpr(*_names(self.schema)))
        dealt = hashed.drop("_one", "_two").hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{name}")
        rate = self.false_rate

        def built(key: tuple, keys: pa.Table) -> pa.Table:
            bits, hashes = filter_bits(keys.num_rows, rate)
            marks = np.zeros(bits, bool)
            places = _places(*(np.asarray(keys.column(c)) for c in ("_one", "_two")), bits, hashes)
            marks[places.ravel()] = True
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(marks).tobytes()], "hashes": pa.array([hashes], pa.int32())})

        # two numbers for each distinct key of a bucket meet in a task
        keys = hashed.select("bucket", "_one", "_two").distinct()
        filters = keys.groupBy("bucket").applyInArrow(built, "bucket int, bits binary, hashes int")
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/{name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the rows as run `batch`, counted up from 0; then merge runs if there are many."""
        self._write(rows, batch, batch)
        runs = self._listed(batch + 1)
        while len(runs) > self.fan_in:
            # the shortest neighbours are merged, so a row is rewritten a few times in all
            spans = [sum(b - a + 1 for a, b in runs[i : i + self.fan_in]) for i in range(len(runs) - self.fan_in + 1)]
            i = spans.index(min(spans))
            merged = runs[i : i + self.fan_in]
            self._write(self.combine(self._read([(r, None) for r in merged])), merged[0][0], merged[-1][1])
            runs = self._listed(batch + 1)

    def _read(self, places: list[tuple[tuple[int, int], list[int] | None]]) -> DataFrame:
        """Rows of runs, each in the buckets named (None: in all)."""
        parts = []
        for (first, last), buckets in places:
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/rows/run={first}-{last}")
            parts.append(rows if buckets is None else rows.filter(F.col("bucket").isin(buckets)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0]
        for p in parts[1:]:  # at most fan_in + 1 runs
            out = out.unionByName(p)
        return out.drop("bucket")

    def rows(self, before: int | None = None) -> DataFrame:
        return self._read([(r, None) for r in self._listed(before)])

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of the folders that may hold one of `keys`, of batches below `before`."""
        runs = self._listed(before)
        if not runs:
            return self._read([])
        names = [f"{self.path}/filters/run={a}-{b}" for a, b in runs]
        filters = self.spark.read.schema("bucket int, bits binary, hashes int").parquet(*names)
        filters = filters.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"run=(\d+-\d+)", 1))
        asked = self._hashed(keys.select(self.key).distinct()).select("bucket", "_one", "_two")

        def tested(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
            hits = []
            one, two = (np.asarray(asked.column(c)) for c in ("_one", "_two"))
            for f in filters.to_pylist():
                marks = np.unpackbits(np.frombuffer(f["bits"], np.uint8)).astype(bool)
                if len(one) and marks[_places(one, two, len(marks), f["hashes"])].all(axis=1).any():
                    hits.append(f["run"])
            return pa.table({"run": pa.array(hits, pa.string()), "bucket": pa.array([key[0].as_py()] * len(hits), pa.int32())})

        found = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(tested, "run string, bucket int")
        # at most (runs x buckets) short rows
        wanted: dict[str, list[int]] = {}
        for r in found.collect():
            wanted.setdefault(r.run, []).append(r.bucket)
        return self._read([((a, b), sorted(wanted[f"{a}-{b}"])) for a, b in runs if f"{a}-{b}" in wanted])

    def matching(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose key is among `keys`, of batches below `before`."""
        return self.candidates(keys, before).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def without_known(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose key is in no batch below `before`; a NULL key is never known."""
        return rows.join(self.candidates(rows, before).select(self.key).distinct(), self.key, "left_anti")


def _names(schema: str) -> list[str]:
    return [f"`{n}`" for n in _parse_datatype_string(schema).fieldNames()]
