"""Each stage of the pipeline against a version by brute force on its own input."""

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import decontaminate
from corpusloom.llm.shared import shared_folder, stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def exact(rows):
    best = {}
    for i, t in rows.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, i)), (-len(t), i))
    return {i for _, i in best.values()}


def near(rows):
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                high, low = max(root(a), root(b)), min(root(a), root(b))
                parent[high] = low
    return {i for i in ids if root(i) == i}


def clean(rows, items):
    def best(item, text):
        row = list(range(len(item) + 1))
        low = len(item)
        for w in text:
            new = [0]
            for j, x in enumerate(item, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row, low = new, min(low, new[-1])
        return low

    split = [decontaminate.normal(t).split() for t in items]
    kept = set()
    for i, t in rows.items():
        text = decontaminate.normal(t).split()
        known = set(text)
        # a passage within the distance shares most of the item's words
        near_items = [q for q in split if q and sum(w not in known for w in q) <= len(q) // 5]
        if all(best(q, text) > int(0.2 * len(q)) for q in near_items):
            kept.add(i)
    return kept


def test_stages(spark):
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, FOLDER), folder, name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and all(before[i] == t for i, t in after.items())
        if name == "toxicity":
            learned = [i for i in before if i in toxic and zlib.crc32(str(i).encode()) % 5]
            assert np.mean([(i in after) == (toxic[i] == 0) for i in learned]) > 0.9
        if name == "exact_dedup":
            assert set(after) == exact(before)
        if name == "near_dedup":
            assert set(after) == near(before)
        if name == "decontamination":
            assert set(after) == clean(before, items)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        texts.setdefault(r.doc_id, []).extend(r.ids)
    assert texts == {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t in before.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()]
