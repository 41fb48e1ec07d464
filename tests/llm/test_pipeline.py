"""The pipeline against plain versions of its stages on a small corpus."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_near_dup import brute  # noqa: E402
from test_rows import plain_counts, plain_targets  # noqa: E402

from kmerloom.llm import linear, quality  # noqa: E402

VOCAB = [a + b + c for a in ("ka", "lo", "mi", "ren", "sto") for b in ("ta", "vi", "ro", "ne") for c in ("l", "n", "s", "")]


def corpus(seed=4):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n)) + "."
    items = [(i, prose(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        kind = i % 8
        text = prose(rng.randrange(40, 90))
        if kind == 1:
            text = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in text.split())
        elif kind == 2 and len(docs) > 8:
            text = docs[i - 8 + 1 - 3][1] + " extra"
        elif kind == 3:
            text += " " + rng.choice(items)[1] + " " + prose(20)
        elif kind == 4:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" ' + prose(5)
        elif kind == 5 and i % 16 == 5:
            text = prose(5)
        docs.append((i, text, "xx", f"s{i % 3}", len(text)))
        if i % 2 or kind == 0:
            labels.append((i, int(kind != 1), 0))
    docs += [(500, None, None, None, None), (501, "", "xx", "s1", 0)]
    return docs, labels, items


def test_run(spark, tmp_path):
    docs, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    read = lambda t: spark.read.parquet(str(tmp_path / f"{t}.parquet"))
    model = quality.train(read("documents"), read("labels"))
    p = model.probability(*linear.texts_of([d[1] for d in docs]))
    kept = []
    for d, good in zip(docs, p >= quality.THRESHOLD):
        n, _, _, _, repeats = plain_counts(d[1])
        if n >= 10 and 100 * repeats <= 20 * n and good:
            kept.append(d)
    assert 100 < len(kept) < 150
    groups = brute([(d[0], d[1]) for d in kept], 80)
    kept = [d for d in kept if groups[d[0]][1] == d[0]]
    kept = [d for d in kept if not any(t in d[1] for _, t in items)]
    clean = {}
    for d in kept:
        text = re.sub(r'token = "[0-9a-f]{40}', "[SECRET]", d[1])
        clean[d[0]] = (d[0], text, d[2], d[3], len(text) if text != d[1] else d[4])
    assert any("[SECRET]" in c[1] for c in clean.values())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} <= set(clean.values())
    copies = Counter(r.doc_id for r in got)
    assert max(copies.values()) <= 3
    size = lambda t: len(t.split())
    totals, largest, taken = Counter(), Counter(), Counter()
    for c in clean.values():
        totals[c[3]] += size(c[1])
        largest[c[3]] = max(largest[c[3]], size(c[1]))
        taken[c[3]] += size(c[1]) * copies[c[0]]
    for source, goal in plain_targets(list(totals.items())).items():
        assert abs(taken[source] - goal) <= largest[source]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "secrets", "mixing"]
