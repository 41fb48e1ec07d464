"""Near-duplicates against all pairs on a small corpus."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kmerloom.llm import near_dup


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(docs, percent):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Straße", "ABC", "x y"]
    docs, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not bases:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 120, 300]))]
            bases.append(words)
        else:
            words = list(rng.choice(bases[-12:] if kind < 0.9 else bases))
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                bases.append(words)
        sep = rng.choice([" ", "\n", "\t "])
        text = sep.join(words)
        docs.append((i * 3, rng.choice([text, text.upper() if text.isascii() else text])))
    return docs


@pytest.mark.parametrize("percent", [85, 80])
def test_components(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)  # small blocks, so that buckets fall into several cells
    monkeypatch.setattr(near_dup, "SPARSE", 0 if percent == 80 else 0.5)  # so that cells leave rows, and some of them pairs
    docs = corpus(percent)
    rows = [(d, t, "clash", 1) for d, t in docs] + [(None, "no id at all here", "c", 2), (10**12, None, "c", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept int").repartition(4)
    got = near_dup.near_duplicates(frame, percent).collect()
    want = brute(docs, percent) | {10**12: (0, 10**12)}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    kept = near_dup.drop_duplicates(frame, percent)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)


def test_rows_that_share_an_id(spark):
    """Each text is judged in its id's name, one row each; no text goes that no other kept document has."""
    docs = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "x y z u v w"), (7, "x y z u v w"), (7, "x y z u v w"), (9, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(frame).collect())
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1), (5, 1), (5, 5), (7, 5), (7, 5), (9, 9)]
    assert sorted(r.doc_id for r in near_dup.drop_duplicates(frame).collect()) == [1, 5, 5, 9]


def test_large_groups_go_by_few_rows(spark):
    """One group of near copies, one of exact ones and a band's task that gets a row a chunk only."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(words if i % 2 else base)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = near_dup.near_duplicates(frame).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    table = near_dup.signatures(frame).selectExpr("doc_id as doc", "bands")
    pairs = near_dup.stars(table, 4)
    assert pairs.count() < 400 * 9  # a document has few partners, not one a band


def test_texts_that_fool_plain_hashes(spark):
    from test_spans import thue_morse

    one, two = thue_morse(2048)
    docs = [(1, f"a b {one} c d"), (2, f"a b {two} c d"), (3, f"a b {one} c d"), (4, one), (5, two)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(frame).count() == 0


def test_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**48, 600, dtype=np.uint64)
    b = np.concatenate((a[:540], rng.integers(0, 2**48, 60, dtype=np.uint64)))
    m = near_dup.minima(np.concatenate((np.sort(a), np.sort(b))), np.array([0, 600]))
    s = near_dup.packed(m)
    assert abs(float(near_dup._similarities(s[:1], s[1])[0]) - 540 / 660) < 0.13
