"""Substring dedup by words and by bytes against brute force, with small batches and blocks so that all paths are taken."""

import hashlib
import random
import re

import numpy as np
import pytest

from kmerloom.llm import spans, substring_dedup, suffix_dedup


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Straße", "the", "a"]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(30, 140))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pool).split()
            kind = rng.random()
            if kind < 0.4:
                parts.append(" ".join(p))
            elif kind < 0.7:
                p[rng.randrange(len(p))] = "zz"
                a = rng.randrange(len(p) // 2)
                parts.append(" ".join(p[a:]))
            else:
                parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 80))))
        docs.append((i * 2 + 1, rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(1001, None), (1002, ""), (1003, "ab" * 400), (1004, "ab" * 300 + "c"), (1005, "x " * 300), (1006, "x " * 120), (1007, docs[3][1]), (1008, docs[3][1]), (1009, "a\0b" * 60), (1010, "a\0b" * 60)]
    return docs


def thue_morse(length):
    """A text of two letters and its opposite: hashes modulo a power of two can't tell them apart from 1,024 letters on."""
    one = "a"
    while len(one) < length:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def brute_words(docs, length=50):
    first = {}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def brute_bytes(docs, length=100):
    first, out = {}, {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            first.setdefault(raw[d][i : i + length], (d, i))
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] != (d, i):
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_dedup(spark, monkeypatch, small):
    docs = corpus(7 + small)
    if small:
        monkeypatch.setattr(spans, "HOT", 2)  # so that crowded anchors are parted
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs] + [(None, docs[0][1], "c", 1)], "doc_id long, text string, spans string, low int").repartition(5)
        words = {r.doc_id: r for r in substring_dedup.dedup(frame).collect()}
        raw = {r.doc_id: r for r in suffix_dedup.dedup(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(words) == len(raw) == len(docs) + 1
    assert words.pop(None).n_removed == 0 and raw.pop(None).n_removed == 0
    want = brute_words(docs)
    assert {d: tuple(r)[1:4] for d, r in words.items()} == want
    want = brute_bytes(docs)
    assert {d: tuple(r)[1:5] for d, r in raw.items()} == want
    assert sum(r.n_removed for r in raw.values()) > 1000


def longest(words, docs, i, p):
    """Longest match of strip i at place p in a strip of a smaller document, by brute force."""
    best = 0
    for j, other in enumerate(words):
        if docs[j] < docs[i]:
            for q in range(len(other)):
                n = 0
                while p + n < len(words[i]) and q + n < len(other) and words[i][p + n] == other[q + n]:
                    n += 1
                best = max(best, n)
    return best


def test_factors_are_greedy_and_have_sources():
    rng = random.Random(9)
    for _ in range(40):
        pool = [[rng.randrange(3) for _ in range(12)] for _ in range(3)]
        strips = [[rng.randrange(3) for _ in range(rng.randrange(0, 4))] + rng.choice(pool)[: rng.randrange(4, 13)] + [rng.randrange(3) for _ in range(rng.randrange(0, 6))] for _ in range(8)]
        doc = np.array([rng.randrange(5) for _ in strips])
        first = np.concatenate(([0], np.cumsum([len(x) for x in strips])))
        words = np.array([w for x in strips for w in x], np.uint64)
        got = list(zip(*substring_dedup.parse(words, first, doc, np.arange(len(strips)) * 100, 5)))
        want = []
        for i in range(len(strips)):
            end = 0
            for p in range(len(strips[i])):
                n = longest(strips, doc, i, p)
                if n >= 5 and p + n > end:
                    end = p + n
                    want.append((i, p, n))
        assert [tuple(map(int, x[:3])) for x in got] == want
        for i, p, n, j, q in got:
            assert doc[j] < doc[i] and strips[i][p : p + n] == strips[j][q : q + n]


def test_long_text_blocks(monkeypatch):
    rng = random.Random(3)
    text = ("".join(rng.choice("abc ") for _ in range(700)) * 3).encode()
    monkeypatch.setattr(spans, "BLOCK", 128)
    rule = suffix_dedup.RULE
    u = spans.units(np.frombuffer(text, np.uint8), np.array([0, len(text)]), rule)
    row, start, windows, _, _ = spans.strips(u.sums, u.first, rule)
    assert windows.sum() == len(text) - rule.length + 1 and (np.sort(start) == start).all()
    assert (start[1:] == start[:-1] + windows[:-1]).all()


def test_parts_hold_each_window_once_and_equal_windows_meet(spark):
    rng = random.Random(4)
    middle = [f"m{i}" for i in range(20)]
    side = lambda: [rng.choice("ab") for _ in range(40)]
    texts = [" ".join(side() + middle + side()) for _ in range(30)]
    rule = substring_dedup.RULE
    found = [r for r in spans.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule, 8).where("kind = 0").collect()]
    rows = [(r.anchor, r.doc, r.start, " ".join(texts[r.doc].split()[r.start : r.start + r.windows + rule.length - 1]).encode()) for r in found]
    windows = {(r.doc, r.start + i) for r in found for i in range(r.windows)}
    frame, core = spark.createDataFrame([(*r, -1) for r in rows], "anchor long, doc long, start long, text binary, core long"), rule.gram
    while core < rule.length:
        side_units = (rule.length - core + 1) // 2
        parts = spans.part(frame, rule, core, side_units).collect()
        core += side_units
        own = [(r.doc, r.start + i) for r in parts for i in range(r.windows)]
        assert len(own) == len(windows) and set(own) == windows
        keys = {}
        for r in parts:
            words = texts[r.doc].split()
            for i in range(r.windows):
                assert r.start + i <= r.start + r.core and r.start + r.core + core <= r.start + i + rule.length
                keys.setdefault(tuple(words[r.start + i : r.start + i + rule.length]), set()).add(r.anchor)
        assert all(len(k) == 1 for k in keys.values())
        frame = spark.createDataFrame([(r.anchor, r.doc, r.start, bytes(r.text), r.core) for r in parts], frame.schema)
    assert all(r.windows == 1 for r in parts)


def test_crowded_anchors(spark, monkeypatch):
    """One passage with many different neighbours: no more than HOT different strips are judged together."""
    rng = random.Random(6)
    middle = [f"m{i}" for i in range(25)]
    tails = [[rng.choice("abc") for _ in range(40)] for _ in range(6)]
    docs = []
    for i in range(150):
        tail = rng.choice(tails)[: rng.randrange(10, 40)] + [f"t{i}"]
        head = [f"h{i}"] + rng.choice(tails)[rng.randrange(30) :]
        docs.append((i, " ".join(head + middle + tail)))
    monkeypatch.setattr(spans, "HOT", 6)
    sizes = []
    decide = spans.decide
    monkeypatch.setattr(spans, "decide", lambda sent, *rest: sizes.append(sent.groupBy("anchor").count().agg({"count": "max"}).first()[0]) or decide(sent, *rest))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.dedup(frame).collect()} == brute_words(docs)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(frame).collect()} == brute_bytes(docs)
    assert len(sizes) == 2 and all(x <= 6 for x in sizes)


def test_merge_orders_like_sorting():
    rng = np.random.default_rng(2)
    shards = [np.append(rng.integers(1, 3, n), 0) for n in (50, 70, 31)]
    order, common = suffix_dedup.merge(shards, 8)
    base = np.concatenate(([0], np.cumsum([len(s) for s in shards])))
    def head(p):
        k = int(np.searchsorted(base, p, "right")) - 1
        s = shards[k]
        return tuple(s[(p - base[k] + j) % len(s)] for j in range(8))
    heads = [head(p) for p in order]
    assert heads == sorted(heads)
    assert common[0] == 0
    for i in range(1, len(heads)):
        assert common[i] == next((j for j in range(8) if heads[i - 1][j] != heads[i][j]), 8)


def test_texts_that_fool_plain_hashes(spark):
    one, two = thue_morse(2048)
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join([*words, one])), (2, " ".join([*words[:30], two, *words[30:], one])), (3, one + two), (4, two + one), (5, f"{one}\n{two}\n{one}")]
    docs += [(6, " ".join([*words[:30], one, *words[30:]])), (7, " ".join([*words[:30], two, *words[30:]]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.dedup(frame).collect()} == brute_words(docs)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(frame).collect()} == brute_bytes(docs)


def test_repetitions(spark):
    """Repeated words, letters and lines, alone and beside other words, in few and in many copies."""
    rng = random.Random(5)
    other = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(other[: rng.randrange(40)] + [rng.choice("xy")] * rng.randrange(40, 130) + other[rng.randrange(40) :])) for i in range(60)]
    docs += [(100 + i, "\n".join(["the same line again"] * rng.randrange(5, 40) + other[: i % 7])) for i in range(12)] + [(200, docs[0][1])] * 1
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.dedup(frame).collect()} == brute_words(docs)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(frame).collect()} == brute_bytes(docs)
    rows = spans.scan(frame, substring_dedup.RULE, 8).where("kind = 0").count()
    assert rows < 60 * 40  # not one for each place of a repeated word


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(frame).count() == 0 and suffix_dedup.dedup(frame).count() == 0
