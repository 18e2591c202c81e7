"""Secrets in texts: known shapes, and strings that look random.

Known shapes are found by pattern. Other candidates are runs of key characters: a
window slides over them, and the Shannon entropy of the window is kept up by adding the
character that enters and taking out the one that leaves. The entropy that makes a
window suspicious depends on the class of the run's characters. Runs that an allow list
explains (identifiers of known shape, paths, words) are let go. Dates and sequences
split a run, and each part is judged for itself, so a window never spans characters
that are no neighbours in the text. A run inside a base span is reported by that only."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.llm.near_dedup import text_batches
from corpusloom.llm.shared import map_batches

ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run of fewer fails as a whole, so this finds what [0-9a-f]+ leaves
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
# Class of a run's characters and the bits in a window from which it is suspicious: what
# all but 1 in 200 random windows of 20 characters of the class's alphabet reach (20,000
# drawn). Numbers are no keys. Upper case goes by base 32.
CLASSES = (
    ("numbers", re.compile("[0-9+/_=-]+"), math.inf),
    ("hex", re.compile("[0-9a-f]+|[0-9A-F]+"), 2.84),
    ("lower", re.compile("[a-z0-9+/_=-]+"), 3.34),
    ("upper", re.compile("[A-Z0-9+/_=-]+"), 3.28),
    ("letters", re.compile("[A-Za-z]+"), 3.52),
    ("mixed", re.compile("[A-Za-z0-9+/_=-]+"), 3.58),
)
# words that each begin with a capital, with at most one abbreviation
CAMEL = "[a-z]*(?:[A-Z][a-z]{2,})*[A-Z]{0,5}(?:[A-Z][a-z]{2,})+"
# such words or one word, with some digits behind; or a number
NAME = f"(?:[A-Z]{{1,15}}|{CAMEL}|[A-Z]?[a-z]{{1,20}})[0-9]{{0,4}}|[0-9]{{1,8}}"
# abbreviations with numbers: i18n, x86, 3DES, AES128GCM, v1beta2
TERM = "[0-9]?(?:[a-z]{1,6}|[A-Z]{1,6})[0-9]{1,3}(?:[a-z]{1,4}|[A-Z]{1,4})?[0-9]?|[0-9](?:[a-z]{2,4}|[A-Z]{2,4})"
ALLOWED = (
    re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(f"[-_/=+]*(?:{NAME})(?:[-_/=+]+(?:{NAME}))+[-_/=+]*"),  # names joined
    re.compile(f"_*(?:{NAME}|{TERM})(?:_+(?:{NAME}|{TERM}))+_*"),  # the same with abbreviations; groups of keys have hyphens
    re.compile("(.)\\1*"),  # one character
    re.compile(f"[-_/=+]*([A-Z]?[a-z]+|[A-Z]+|{CAMEL})[0-9]{{0,4}}[-_/=+]*"),  # one name
    re.compile("[-+]?[0-9_]+[eE][-+]?[0-9]+"),  # a number
)
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
PLAIN = re.compile("|".join(SEQUENCES) + "|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])")  # sequences and dates


def entropy(run: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy of a window of `run`, in bits per character, from counts
    that change by two characters a step."""
    size = min(window, len(run))
    if not size:
        return 0.0
    term = [0.0, *(n * math.log2(n) for n in range(1, size + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log n over the counts
    least = math.inf
    for i, c in enumerate(run):
        if i >= size:
            gone = run[i - size]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= size - 1:
            least = min(least, total)
    return max(0.0, math.log2(size) - least / size)


def suspicious(run: str) -> bool:
    """Whether a part of the run, between dates and sequences, is long and random enough."""
    return any(_random(part) for part in PLAIN.split(run))


def _random(run: str) -> bool:
    if len(run) < WINDOW or any(a.fullmatch(run) for a in ALLOWED):
        return False
    limit = next(bits for _, shape, bits in CLASSES if shape.fullmatch(run))
    return limit < math.inf and entropy(run) >= limit


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in a text, sorted; end is exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    more, i, reach = [], 0, 0  # reach: of the base spans that start at or before a run
    for m in CANDIDATE.finditer(text):
        while i < len(found) and found[i][0] <= m.start():
            reach = max(reach, found[i][2])
            i += 1
        if m.end() > reach and suspicious(m.group()):
            more.append((m.start(), 3, m.end()))
    return sorted(found + more)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id and spans, an array of (kind, start, end) sorted
    by start, then kind in the order of KINDS.

    start and end are code points, end exclusive. Spans of one kind don't overlap. Null
    and empty texts have none. A null doc_id stays null; repeated rows are rows of their
    own. Other columns are ignored."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in secrets(t.decode())] for t in batch.column("text").to_pylist()
            ]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind)})

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), find, schema)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
