"""Splitter against a direct reading of its rules, and its properties."""

import itertools
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.chunks import split_text
from corpusloom.operators import chunking

SEPS = ["\n\n", "\n", ". ", ", ", " "]


def windows(pieces, size, overlap):
    """Chunks of a row of short pieces, by the ranges they cover: a chunk ends
    before the first piece that does not fit; the next one starts as early as the
    overlap and that piece allow."""
    ends = [0]
    for p in pieces:
        ends.append(ends[-1] + len(p))
    first, last = 0, 0
    while last < len(pieces):
        last = max((i for i in range(first, len(pieces) + 1) if ends[i] - ends[first] <= size), default=last + 1)
        last = max(last, first + 1)
        yield "".join(pieces[first:last]).strip()
        if last < len(pieces):
            first = next(
                i for i in range(first, last + 1)
                if i == last or (ends[last] - ends[i] <= overlap and ends[last + 1] - ends[i] <= size)
            )


def direct(text, size, overlap, seps):
    at = min((i for i, s in enumerate(seps) if s in text), default=None)
    if at is None:
        pieces, finer = [text], []
    else:
        pieces, finer = re.findall(rf"(?s)(?:{re.escape(seps[at])}|^).*?(?={re.escape(seps[at])}|$(?!\n))", text), seps[at + 1 :]
        assert "".join(pieces) == text
    out = []
    for short, row in itertools.groupby(filter(None, pieces), key=lambda p: len(p) < size):
        for p in [list(row)] if short else row:
            out += windows(p, size, overlap) if short else direct(p, size, overlap, finer) if finer else [p]
    return [c for c in out if c]


TEXT = st.lists(st.sampled_from(["a", "bb", "ccc", "dddddd", " ", ". ", ", ", "\n", "\n\n", "\n\n\n", ".", "  "]), max_size=80).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(4, 30), st.integers(0, 3))
def test_same_as_direct(text, size, overlap):
    assert split_text(text, size, overlap, SEPS) == direct(text, size, overlap, SEPS)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(8, 40))
def test_nothing_lost_and_sizes(text, size):
    chunks = split_text(text, size, 2, SEPS)
    squeeze = lambda t: re.sub(r"\s", "", t)
    assert set(squeeze(text)) == set(squeeze("".join(chunks)))
    assert all(len(c) <= size or not re.search("|".join(map(re.escape, SEPS)), c.strip()) for c in chunks)


def test_ids_count_empty_documents(spark):
    docs = spark.createDataFrame(
        [("a", "T", "u", "x" * 1200), ("b", "T", "u", ""), ("c", "T", "u", None), ("d", "T", "u", "short")],
        "id string, title string, url string, content string",
    )
    placed = chunking.with_position(docs, ["id"])
    rows = chunking.explode_chunks(placed, chunking.recursive_chunks(F.col("content"))).orderBy("id").collect()
    assert [r.id for r in rows] == ["a_0_chunk_0", "d_3_chunk_0"]
    assert len(rows[0].content) == 1200  # a run without separators is kept whole
    text = docs.select(chunking.embed_text("title", "content")).collect()[2][0]
    assert text == "Tiêu đề: T\nNội dung: "
