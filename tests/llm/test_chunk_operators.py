"""Operators over distinct chunks, and vector codes, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import TABLES, rows
from hypothesis import given, strategies as st
from sentencepiece import SentencePieceProcessor

from corpusloom.llm import chunk_table, piece_coding, source_audit, vector_codes
from corpusloom.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


@given(st.lists(st.binary(max_size=20), max_size=40), st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_packed_and_back(texts, numbers):
    assert chunk_table.unpack_texts(chunk_table.pack_texts(texts)) == texts
    assert chunk_table.unpack_ints(chunk_table.pack_ints(np.array(numbers, np.int64))).tolist() == numbers


ODD = [
    "", " ", "   ", "a", " a", "a ", "  two  spaces  ", "\n\n x\t y", "▁marker▁ in ▁▁text", "\x00a b\x00", "<s> </s> <0x0A>",
    "ＡＢＣ é é", "😀😀  x\xa0y", "x" * 5000, "word " * 3000, "the the the", " ", "a\r\nb",
]


def _library(text):
    model = SentencePieceProcessor(model_file=MODEL)
    ids = model.encode(text or "", add_eos=True)
    return ids, model.decode(ids)


@pytest.mark.parametrize("cut", [True, False])
def test_pieces_equal_the_library(spark, monkeypatch, cut):
    texts = [*ODD, None, "the the the", None]
    if not cut:
        monkeypatch.setattr(piece_coding, "can_cut", lambda path: False)
    given_rows = [(i if i % 5 else None, t, "x", "y", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(given_rows, "doc_id long, text string, key string, rows string, ids array<int>").repartition(3)
    coded = piece_coding.encoded(docs, MODEL, block=2000, buckets=5)
    assert coded.columns == ["doc_id", "ids"]
    got = [(r.doc_id, r.ids, r.decoded) for r in piece_coding.decoded(coded, MODEL).collect()]
    want = [(r[0], *_library(r[1])) for r in given_rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@given(st.lists(st.text("ab ▁\n\x00é", max_size=12), max_size=8))
def test_chunks_of_texts(texts):
    import pyarrow as pa

    got = piece_coding.chunks(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
    want = [re.findall(" +[^ ]*", " " + t.replace("▁", " ")) if t else [] for t in texts]
    assert got == [[c[1:].encode() for c in w] for w in want]


def test_model_can_be_cut_and_each_chunk_is_segmented_once(spark):
    assert piece_coding.can_cut(MODEL)
    calls = spark.sparkContext.accumulator(0)

    def work():
        def sizes(new):
            calls.add(len(new))
            return np.ones(len(new), np.int64), np.arange(len(new))

        return sizes

    docs = spark.createDataFrame([(i, "a b c " + "d " * i) for i in range(40)], "doc_id long, text string").repartition(4)
    place = lambda blocks: (b.rows for b in blocks)
    out = chunk_table.by_chunk(docs, ["doc_id"], source_audit._chunks, work, place, "doc_id long", block=50, buckets=3)
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    assert calls.value == 5  # and the empty one at a text's end


def test_pieces_of_an_empty_table_and_decoding_of_odd_ids(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    assert piece_coding.decoded(piece_coding.encoded(none, MODEL), MODEL).collect() == []
    ids = [(1, [2]), (2, None), (3, []), (4, [None, -1, 32000, 264]), (5, [3, 300, 264])]
    got = piece_coding.decoded(spark.createDataFrame(ids, "doc_id long, ids array<int>"), MODEL).collect()
    model = SentencePieceProcessor(model_file=MODEL)
    assert [r.decoded for r in got] == ["", None, "", "a", model.decode([3, 300, 264])]


def test_pieces_of_the_given_table(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_pieces"].run(spark, FOLDER).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for key, text in texts:
        ids, back = _library(text)
        want[key] = (len(ids), sha(" ".join(map(str, ids))), sha(back))
    assert got == want


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_source_audit"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(QUERIES[name].run(spark, FOLDER).toPandas()) == rows(con.execute(QUERIES[name].sql).fetchdf())


def _audit(docs, least, top):
    """By brute force."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    found = [(lang or "", source or "", term.findall((text or "").translate(lower))) for _, text, lang, source in docs]
    out = []
    for lang in {x[0] for x in found}:
        own = [x for x in found if x[0] == lang]
        holders = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in holders.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for source, c in counts.items():
            parts = {"pair": [], "term": []}
            for other, d in counts.items():
                if other != source:
                    parts["pair"].append((-sum(apart(share(c, t), share(d, t)) for t in kept), other.encode(), other))
            for t in kept:
                p, q = share(c, t), share(whole, t)
                if c[t] and p > q:
                    parts["term"].append((-apart(p, q), t.encode(), t))
            for part, listed in parts.items():
                for rank, (value, _, item) in enumerate(sorted(listed), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, source, part, item, -value, rank))
    return sorted(out)


@pytest.mark.parametrize("parts", [{}, {"terms": 3, "tile": 2, "block": 300, "buckets": 4}])
def test_source_audit_by_brute_force(spark, parts):
    rng = random.Random(5)
    words = ["the", "The,", "ÄB", "äb", "x-y", "x", "y z", "42", "__", "日本", "o'clock", "zebra", "Ab", "\U0001f600"]
    docs = []
    for i in range(160):
        text = rng.choice([" ", "\n", "\t"]).join(rng.choices(words, k=rng.randint(0, 12)))
        docs.append((rng.choice([None, i, 7]), rng.choice([None, text, text, text]), rng.choice([None, "", "en", "de"]), rng.choice([None, "s0", "s0", "s1", "s2", "ü"])))
    docs += [(1, "rare words only here", "fr", "s0"), (2, "others", "fr", "s1"), (3, "alone", "it", "s0")]
    given_docs = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, lang string, source string, term string, n long")
    got = sorted(map(tuple, source_audit.divergence(given_docs.repartition(5), least=4, top=3, **parts).collect()))
    assert got == _audit(docs, 4, 3)


def test_source_audit_of_an_empty_table_and_without_terms(spark):
    assert source_audit.divergence(spark.createDataFrame([], DOCUMENTS)).collect() == []
    bare = spark.createDataFrame([(1, None, "a", "x", 0), (2, "", "a", "y", 0), (3, "12", "b", None, 0)], DOCUMENTS)
    got = sorted(map(tuple, source_audit.divergence(bare).collect()))
    assert got == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    pairs = [(1, 3), (10**13 + 7, 3 * 10**13 + 11), (2, 10**15 + 1), (99, 99), (0, 0)]
    got = spark.createDataFrame(pairs, "n long, total long").select(source_audit._share("n", F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * n // t if t else 1 for n, t in pairs]


# --- vector codes -------------------------------------------------------------------------


def _nearest(point, entries):
    return min((sum((a - b) ** 2 for a, b in zip(point, e)), i) for i, e in enumerate(entries))


def _codes(table, parts, entries, rounds):
    """By brute force: codes and errors by row, and the codebook."""
    kept = [r for r in table if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    size = Counter(len(r[1]) for r in kept if r[1])
    size = max(size, key=lambda s: (size[s], s)) if size else 0
    cut = lambda v: [[math.floor(256 * x) for x in v[i * size // parts : (i + 1) * size // parts]] for i in range(parts)]
    sized = sorted((r for r in kept if size and len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = [cut(r[1]) for r in sized]
    book = [[c[i] for c in cuts[:entries]] for i in range(parts)]
    for _ in range(rounds):
        for i in range(parts):
            of = defaultdict(list)
            for c in cuts:
                of[_nearest(c[i], book[i])[1]].append(c[i])
            book[i] = [[sum(x) // len(of[e]) for x in zip(*of[e])] if e in of else own for e, own in enumerate(book[i])]
    out = []
    for r in kept:
        found = [_nearest(p, b) for p, b in zip(cut(r[1]), book)] if size and len(r[1]) == size else None
        error = sum(f[0] for f in found) if found else None
        out.append((r[0], r[2], [f[1] for f in found] if found else None, error if error is not None and error < 2**63 else None))
    return sorted(out, key=repr), book


def _vectors(kind):
    rng = np.random.default_rng(3)
    spread = rng.normal(0, 0.4, (70, 8)).astype(np.float32)
    table = [(int(i), v.tolist(), int(i) % 3) for i, v in enumerate(spread)]
    if kind == "odd":
        table += [(None, table[0][1], None), (3, table[3][1], 0), (3, table[4][1], None), (90, None, 1), (91, [0.5] * 7 + [None], 1)]
        table += [(92, [float("nan")] + [0.0] * 7, 1), (93, [float("inf")] * 8, 1), (94, [1.0, 2.0], 1), (-1, [], 2), (95, [-0.001] * 8, None)]
    if kind == "wide":
        table += [(80, [3e38] * 8, 0), (81, [-1e30] * 4 + [1.0] * 4, 1), (-5, [2e9] * 8, 1)]
        table = [(i, np.float32(v).tolist(), x) for i, v, x in table]
    if kind == "few":
        table = [*table[:3], (7, table[1][1], 2)]
    return [] if kind == "none" else table


@pytest.mark.parametrize("kind", ["plain", "odd", "wide", "few", "none"])
def test_vector_codes_by_brute_force(spark, kind):
    table = _vectors(kind)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in table], "vec_id long, embedding array<float>, label int, code string, error int")
    coded, book = vector_codes.compressed(frame.repartition(3), parts=4, entries=8)
    want, entries = _codes(table, 4, 8, 2)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=repr) == want
    assert book.tolist() == (entries if table else book.tolist())
    errors = defaultdict(int)
    for _, label, _, e in want:
        errors[label] += e or 0
    if kind != "wide":
        got = vector_codes.with_label_error(coded).select("label", "label_error").collect()
        assert len(got) == len(want) and all((r.label_error or 0) == errors[r.label] for r in got)


def test_cells_keep_every_entry_that_can_be_nearest():
    rng = np.random.default_rng(9)
    entries = rng.integers(-90, 90, (64, 4))
    entries[10] = entries[3]  # equal entries
    cells = vector_codes.Cells(entries, side=16, most=500)
    for _ in range(6):
        points = rng.integers(-120, 120, (3000, 4))
        apart = ((points[:, None, :] - entries) ** 2).sum(axis=2)
        code, error = cells.nearest(points)
        assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
        assert len(cells.known) <= 3000
    assert cells.compared < 0.7 * 6 * 3000 * 64
