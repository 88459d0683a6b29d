"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from regioscope.llm import range_maximum


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(own), sum(len(t) for _, t in own)
    out = []
    for item, text in items:
        asked = sorted(set(terms(text)))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in own) + 1))) for t in asked}
        found = []
        for i, d in own:
            m = 10 + (90 * len(d) * n) // total
            score = sum(weight[t] * (10 ** 9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in asked)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(texts):
    words = dict(texts)[92].split(" ")
    return [(1, " ".join(words[:30])), (2, "the"), (2, "the"), (3, None), (4, ""), (5, "zzz ... nothing"),
            (None, dict(texts)[70]), (6, dict(texts)[40]), (7, "The, THE the onr"), (8, "a" * 5000)]


@pytest.mark.parametrize("postings, step, item_bytes", [(1_000_000, 64, 8 << 20), (50, 1, 8 << 20), (400, 3, 3000)])
def test_ranks(spark, documents, texts, items, monkeypatch, postings, step, item_bytes):
    monkeypatch.setattr(range_maximum, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(range_maximum, "POSTINGS", postings)
    monkeypatch.setattr(range_maximum, "STEP", step)
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, rank int")
    rows = [*texts, (None, dict(texts)[3]), (3, dict(texts)[3])]
    got = range_maximum.search(spark.createDataFrame([(*r, "s", 1) for r in rows],
                                                     "doc_id long, text string, score string, item int").repartition(3), asked)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


def test_search_of_one_block_in_small_steps(monkeypatch):
    """Every number of documents and interval, split one at a time."""
    rng = np.random.default_rng(3)
    for step in (1, 5, 64):
        monkeypatch.setattr(range_maximum, "STEP", step)
        for size in (1, 2, 3, 17, 200):
            lists = rng.integers(1, 6, size).astype(np.int32)
            term = np.concatenate([rng.choice(8, n, replace=False) for n in lists]).astype(np.int32)
            tf = rng.integers(1, 4, len(term))
            weights = np.array([0, 5, 900, 40, 3, 3, 7000, 1])
            m = rng.integers(10, 13, size)
            order = rng.permutation(size)
            block = range_maximum.Block(lists, term, tf, order, m, weights)
            owner = np.repeat(np.arange(size), lists)
            item = np.array([0, 2, 3, 4, 6, 7], np.int32)
            scores = np.zeros(size, np.int64)
            for o, t, f in zip(owner, term, tf):
                if t in item:
                    scores[o] += weights[t] * (10 ** 9 * f // (1000 * f + 8 * m[o]))
            placed = scores[order]
            want = [p for p in np.lexsort((np.arange(size), -placed)) if placed[p] > 0][:10]
            docs, got = block.search(item, 10)
            assert docs.tolist() == want and got.tolist() == placed[want].tolist()


def test_long_texts_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(range_maximum, "SLICE", 7)
    rng = random.Random(1)
    vocabulary = {b"ab": 0, b"c": 1, "é".encode(): 2, b"x" * 30: 3}
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", "é", " ", ",", "x" * 30, "AB "]) for _ in range(rng.randint(0, 30)))
        want = terms(text)
        n, found = range_maximum.count_terms(text.encode(), vocabulary)
        assert n == len(want) and dict(found) == {i: want.count(w.decode()) for w, i in vocabulary.items() if w.decode() in want}


def test_nothing_to_rank(spark, documents):
    asked = spark.createDataFrame([(1, "the one")], "item_id long, text string")
    assert range_maximum.search(documents.limit(0), asked).collect() == []
    assert range_maximum.search(documents, asked.limit(0)).collect() == []
