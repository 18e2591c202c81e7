"""Near, exact and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, near_dedup
from corpusloom.llm.components import components
from corpusloom.llm.exact_dedup import exact_duplicates, without_duplicates
from corpusloom.llm.near_dedup import near_duplicates, without_near_duplicates
from corpusloom.llm.shared import shared_folder
from corpusloom.llm.substring_dedup import without_repeats
from corpusloom.llm.words import Words, run_hashes

SCHEMA = "doc_id long, text string, lang string, digest string, place long, component_id long"


def table(spark, rows):
    """Documents with null in every other column and columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "d", 0, 7) for i, t in rows], SCHEMA)


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        texts.append(base)
        for _ in range(rng.randrange(0, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    return [" ".join(t) for t in texts] + ["", None, " \t\n", "one two", "One  TWO", "ä Ä", "x" * 30_000, texts[0] and " ".join(texts[0])]


def expected_components(rows, words):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {rows[i][0]: (len(sets[i]), least[root(i)], rows[i][0] == least[root(i)]) for i in range(len(rows))}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = list(enumerate(near_texts()))
    random.Random(1).shuffle(rows)
    got = near_duplicates(table(spark, rows).repartition(5), words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected_components(rows, words)


def test_near_group_with_many_members(spark):
    """A dense group of wide spread, with all members of it in the same lists."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(table(spark, rows), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected_components(rows, 4)


def test_near_edge_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other words than the rest have"), (None, "A b c d e f"), (None, None), (1, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table(spark, rows), 4).collect()}
    assert got == {(3, 3, 3, True), (None, 3, 3, False), (None, 0, None, True), (1, 0, 1, True)}
    kept = without_near_duplicates(table(spark, rows), 4)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (False, 1, ""), (False, 3, "a b c d e f"), (False, 3, "other words than the rest have"), (True, 0, "")]
    assert kept.columns == table(spark, rows).columns
    assert near_duplicates(table(spark, []), 4).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(table(spark, rows), 4, percent=50)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    equal = []
    for k in range(60):
        a = np.unique(np.concatenate((x[:889], rng.integers(0, 2**63, 111, dtype=np.uint64))))
        b = np.unique(np.concatenate((x[:889], rng.integers(0, 2**63, 111, dtype=np.uint64))))
        x = rng.permutation(rng.integers(0, 2**63, 1000, dtype=np.uint64))
        s = np.asarray(near_dedup._signatures([a, b]).to_pylist())
        equal.append((s[0] == s[1]).mean())
    assert abs(np.mean(equal) - 0.8) < 0.03


def test_word_hashes():
    texts = [b"a b  c", b"", b"\t x\x0by\r\n", ("é" * 300_000 + " z").encode(), b"a b c"]
    w = Words(texts)
    assert [w.words(i) for i in range(5)] == [t.split() for t in texts]
    flat = [x for t in texts for x in t.split()]
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert run_hashes(w.hashes[:3], 3).tolist() == run_hashes(w.hashes[-3:], 3).tolist()
    assert len(run_hashes(w.hashes[:2], 3)) == 1 and len(run_hashes(w.hashes[:0], 3)) == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    rest = [(rng.randrange(0, 60), rng.randrange(0, 60)) for _ in range(40)] + [(7, 7), (None, 3)]
    links = chain + star + rest
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", shared_folder(spark)).collect()}
    want = {}
    for a, b in links:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(len(links)):
        for a, b in links:
            if a is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


@pytest.mark.parametrize("digest", ["strong", "weak"])
def test_exact_duplicates(spark, digest):
    """With a weak digest nearly all texts collide, so that only the bytes tell them apart."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(" \tab\nçX") for _ in range(rng.randrange(0, 6)))) for i in range(200)] + [(300, None), (301, "y" * 50_000)]
    rng.shuffle(rows)
    weak = {"digest": lambda t: F.encode((F.length(t) % 2).cast("string"), "UTF-8")} if digest == "weak" else {}
    got = {r.doc_id: r for r in exact_duplicates(table(spark, rows).repartition(4), **weak).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for key, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
            if digest == "strong":
                assert got[i].digest.hex() == hashlib.sha256(key.encode()).hexdigest()


@pytest.mark.parametrize("digest", ["strong", "weak"])
def test_exact_duplicates_over_arrivals(spark, digest, monkeypatch):
    """Three arrivals, one of them repeated and one that fails at first, against all rows at once."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(" ab") for _ in range(rng.randrange(0, 5)))) for i in range(60)] + [(60, "a b"), (61, "ab")]
    parts = [rows[40:60], rows[61:] + rows[:20], rows[60:61] + rows[20:40]]
    weak = {"digest": lambda t: F.encode((F.length(t) % 2).cast("string"), "UTF-8")} if digest == "weak" else {}
    folder, seen = shared_folder(spark), []
    for number, part in enumerate(parts):
        seen += part
        arriving = table(spark, part).repartition(2)
        if number == 2:
            with monkeypatch.context() as broken:
                broken.setattr(exact_dedup, "_differing", lambda hits: 1 / 0)
                with pytest.raises(Exception, match="division"):
                    exact_duplicates(arriving, folder=folder, arrival=number, **weak)
        for _ in range(1 + (number == 1)):
            found = exact_duplicates(arriving, folder=folder, arrival=number, **weak)
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect())
        groups = {}
        for i, t in seen:
            groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
        assert got == sorted((i, min(m)[1], len(m), i == min(m)[1]) for m in groups.values() for _, i in m)


def test_exact_edge_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (None, "a    b"), (2, None), (3, " ")]
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_duplicates(table(spark, rows)).collect())
    assert got == [(0, 0, 4, True), (1, 0, 4, False), (1, 0, 4, False), (1, 0, 4, False), (2, 3, 2, False), (3, 3, 2, True)]
    kept = without_duplicates(table(spark, rows + [(4, "z"), (4, "z")]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a    b"), (3, " "), (4, "z")]
    assert exact_duplicates(table(spark, [])).count() == 0


def brute_repeats(rows, window):
    first = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 8, 3])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    words = ["a", "b"] if window == 8 else [f"w{i}" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randrange(0, window))]
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            text += p[a:] if rng.random() < 0.5 else p
        rows.append((i, " ".join(text)))
    rows += [(90, "a " * 400), (91, "a " * 300), (92, None), (93, ""), (5, rows[5][1]), (95, rows[5][1])]
    rng.shuffle(rows)
    rows = [(i, t.replace(" ", "\n\t") if t and i % 3 == 0 else t) for i, t in rows]
    got = without_repeats(table(spark, rows).repartition(4), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(rows, window)
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in got)


def test_substring_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (2, text), (2, text + " more"), (None, None)]
    got = without_repeats(table(spark, rows)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (60, 0), (60, 0), (61, 0)]
    assert without_repeats(table(spark, [])).count() == 0


def test_filters_keep_clashing_columns_and_single_rows(spark):
    """Columns named like those of the operators, and texts that end in a line separator only."""
    from corpusloom.llm.decontaminate import without_benchmark
    from corpusloom.llm.exact_dedup import without_duplicates
    from corpusloom.llm.near_dedup import without_near_duplicates
    from corpusloom.llm.toxicity import BUCKETS, Model, without_toxic

    names = ["own", "_own", "n", "_n", "_id", "_digest", "digest", "row", "place", "kept", "one"]
    texts = ["\u2028", "\u0085", " ", "", None, "a b c d e f g", "a b c d e f g", "other words here", "long " * 5000]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(i, t, *[f"{i}{c}" for c in names]) for i, t in enumerate(texts)], schema)
    items = spark.createDataFrame([(1, "other words here")], "item_id long, text string")
    got = {
        "exact": without_duplicates(docs),
        "near": without_near_duplicates(docs),
        "toxic": without_toxic(docs, Model(np.zeros(BUCKETS), -1.0)),
        "leak": without_benchmark(docs, items),
    }
    want = {"exact": [0, 1, 2, 5, 7, 8], "near": [0, 1, 2, 3, 4, 5, 7, 8], "toxic": list(range(9)), "leak": [0, 1, 2, 3, 4, 5, 6, 8]}
    for name, rows in got.items():
        assert rows.columns == docs.columns
        found = sorted(rows.collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in found] == want[name], name
        assert all(r.own == f"{r.doc_id}own" and r.row == f"{r.doc_id}row" and r.text == texts[r.doc_id] for r in found)
