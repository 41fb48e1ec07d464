"""Benchmark decontamination on planted copies and re-parameterised questions."""

import random

from kmerloom.llm import decontam, linear

ITEMS = [
    (1, "Anna buys 3 apples and 12 pears for 4 dollars at the market near the old station. How much does Anna pay for each pear?"),
    (2, "a train leaves the harbour at noon and travels north with constant speed until it meets another slow train"),
    (3, None),
    (4, ""),
    (5, "Solve for x now"),
]
FILL = "the river runs along many fields and quiet villages where nobody counts hours while birds sing over roofs "


def run(spark, docs, items=ITEMS):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return frame, bench, {(r.doc_id, r.item_id): r for r in decontam.contamination(frame, bench).collect()}


def test_copies_and_templates(spark):
    other = ITEMS[0][1].replace("Anna", "Peter").replace("3", "8").replace("12", "70").replace("dollars", "euros")
    broken = ITEMS[0][1].replace("Anna buys", "Peter buys").replace("Anna pay", "Anna pay")
    docs = [
        (10, FILL + ITEMS[0][1] + FILL), (11, FILL + other), (12, FILL * 40), (13, None), (14, ""), (15, FILL + ITEMS[1][1].upper() + " " + FILL),
        (16, " ".join(ITEMS[1][1].split()[:6]) + " " + FILL), (17, broken), (18, FILL * 3000 + ITEMS[1][1]), (10, ITEMS[0][1]), (None, ITEMS[1][1]), (19, "please Solve for x now or never"),
    ]
    frame, bench, got = run(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (15, 2), (17, 1), (18, 2), (None, 2), (19, 5)}
    assert got[10, 1].exact and not got[11, 1].exact and got[11, 1].consistency == 1.0
    assert got[17, 1].consistency < 1.0
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 16]


def test_join_finds_what_comparing_all_finds(spark, monkeypatch):
    """Random documents and items that share windows, against the comparison of every document with every item; also with a filter that lets all windows pass."""
    rng = random.Random(6)
    vocab = "the of river Anna Boris Clara 3 14 159 dollars km fields run slowly over many old roofs question answer".split()
    shared = " ".join(rng.choice(vocab) for _ in range(14))
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{prose(rng.randrange(0, 20))} {shared if i % 3 else ''} {prose(rng.randrange(1, 12))}") for i in range(25)] + [(30, "old roofs"), (31, None), (3, "zzz")]
    docs = [(i, f"{prose(10)} {rng.choice(items[:25])[1]} {prose(8)} {rng.choice(items[:25])[1] if i % 2 else ''}") for i in range(60)]
    docs += [docs[0], (None, docs[1][1]), (None, None), (70, "")]
    least = {}
    for i, t in items:
        if t is not None:
            least[i] = min(t, least.get(i, t))
    want = set()
    for d, t in docs:
        for i, text in least.items():
            x = decontam.index([(i, text)])
            want |= {(d, i, w, round(c, 9), round(s, 9), e) for _, _, w, c, s, e in decontam.matches(x, *linear.texts_of([t])) if c >= decontam.COVERAGE and s >= decontam.CONSISTENCY}
    for bits, together in ((decontam.MOST_BITS, 512), (1 << 6, 3)):
        monkeypatch.setattr(decontam, "MOST_BITS", bits)
        monkeypatch.setattr(decontam, "TOGETHER", together)
        frame, bench, _ = run(spark, docs, items)
        got = [(r.doc_id, r.item_id, r.windows, round(r.coverage, 9), round(r.consistency, 9), r.exact) for r in decontam.contamination(frame, bench).collect()]
        assert set(got) == want and len(want) > 60
        assert len(got) == len(want) + sum(x[0] == 0 for x in want)  # the repeated row is reported twice
        kept = sorted((r.doc_id or -1, r.text or "") for r in decontam.drop_contaminated(frame, bench).collect())
        assert kept == sorted((d or -1, t or "") for d, t in docs if not any(w[0] == d and (d is not None or t) for w in want))


def test_inconsistent_slots(spark):
    item = [(1, "Anna met Boris so Anna told Boris that Anna likes Boris but Boris left Anna when Anna saw Boris again")]
    swapped = "Clara met David so Erik told Frida that Gina likes Hugo but Ines left Jan when Karl saw Lena again"
    _, _, got = run(spark, [(1, swapped), (2, item[0][1].replace("Anna", "Zoe"))], item)
    assert set(got) == {(2, 1)}


def test_empty(spark):
    _, _, got = run(spark, [(1, FILL)], [(1, None)])
    assert not got
    frame = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(frame, bench).count() == 0 and decontam.drop_contaminated(frame, bench).count() == 0


def test_few_literals(spark):
    """Whole copies of items of mostly numbers and names are reported, and so are halves with their own values."""
    listed = "Which of these numbers is the largest prime that divides the product below? " + " ".join(f"{chr(65 + i)} {12 + 3 * i}" for i in range(11))
    rulers = "Name the ruler who came first in this list: " + ", ".join(f"{n} {r}" for n in ("Henry", "Edward", "James", "George") for r in ("VI", "VII", "VIII"))
    total = "Add up all of the following numbers for me: " + " ".join(str(17 * i % 101) for i in range(16))
    items = [(1, listed), (2, rulers), (3, total), (4, "1 2 1 2 1 3 1 2 1 4 1 2 1 3 1 2 1 5")]
    docs = [(i, FILL + t + " " + FILL) for i, t in items] + [(5, FILL + " ".join(total.split()[9:]) + " " + FILL), (6, FILL + " ".join(str(i) for i in range(200, 216)) + " " + FILL)]
    frame, bench, got = run(spark, docs, items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)} <= set(got) and not {(6, 1), (6, 2), (6, 3)} & set(got)
    assert all(got[i, i].coverage == 1 and got[i, i].consistency == 1 and got[i, i].exact for i in range(1, 5))
    assert not {1, 2, 3, 4, 5} & {r.doc_id for r in decontam.drop_contaminated(frame, bench).collect()}
