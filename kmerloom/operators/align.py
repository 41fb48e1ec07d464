"""Edit distance, alignments, seed extension and pattern search.

Global distance is the built-in ``levenshtein``; prefix and infix modes, paths and seed extension run as Arrow UDFs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import saved

MODES = ("global", "prefix", "infix")


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Global edit distance; -1 if over ``most``."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def equal_letters(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Makes the second letter of each pair equal to the first, before a comparison."""
    return F.translate(text, "".join(b for _, b in pairs), "".join(a for a, _ in pairs))


def _last_row(query: str, target: str, mode: str) -> np.ndarray:
    """Distances of the whole query to target[:j] (any start in infix mode) for each j; rows are vectorised by a prefix minimum."""
    t = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64) if mode == "infix" else at.copy()
    for i, c in enumerate(query, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
        row = np.minimum.accumulate(best - at) + at
    return row


def semiglobal(query: str, target: str, mode: str, most: int = -1) -> tuple[int, int | None, int | None]:
    """(distance, start, end) of the first best place of the query in the target (end inclusive); -1 over ``most``."""
    row = _last_row(query, target, mode)
    end = len(target) if mode == "global" else int(row.argmin())
    distance = int(row[end])
    if 0 <= most < distance:
        return -1, None, None
    start = 0
    if mode == "infix" and end:
        back = _last_row(query[::-1], target[:end][::-1], "prefix")
        start = end - int(np.flatnonzero(back == back.min())[-1])
    return distance, start, end - 1


#: Cells of a table of distances that are kept at once; larger ones are split at the query's middle.
CELLS = 1 << 20


def _steps(query: str, target: str) -> list[str]:
    """Steps of a best global alignment. Space is CELLS distances and a few rows, whatever the lengths: the query is halved, and the target cut where the halves' distances add up to the least."""
    n, m = len(query), len(target)
    if n > 1 and (n + 1) * (m + 1) > CELLS:
        half = n // 2
        cut = int((_last_row(query[:half], target, "prefix") + _last_row(query[half:][::-1], target[::-1], "prefix")[::-1]).argmin())
        return _steps(query[:half], target[:cut]) + _steps(query[half:], target[cut:])
    t = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    at = np.arange(m + 1)
    rows = np.empty((n + 1, m + 1), np.int32)
    rows[0] = at
    for i, c in enumerate(query, 1):
        best = np.empty(m + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(rows[i - 1, 1:] + 1, rows[i - 1, :-1] + (t != ord(c)))
        rows[i] = np.minimum.accumulate(best - at) + at
    i, j, steps = n, m, []
    while i or j:
        here = rows[i, j]
        if i and j and here == rows[i - 1, j - 1] + (query[i - 1] != target[j - 1]):
            steps.append("=" if query[i - 1] == target[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and here == rows[i - 1, j] + 1:
            steps.append("I")
            i -= 1
        else:
            steps.append("D")
            j -= 1
    return steps[::-1]


def path(query: str, target: str, extended: bool = False, mode: str = "global") -> tuple[int, str]:
    """Distance and CIGAR of a best alignment; in prefix and infix modes, to the target's part that ``semiglobal`` finds."""
    if mode != "global":
        _, start, end = semiglobal(query, target, mode)
        target = target[start : end + 1]
    steps = _steps(query, target)
    distance = sum(x != "=" for x in steps)
    if not extended:
        steps = ["M" if x in "=X" else x for x in steps]
    return distance, "".join(f"{sum(1 for _ in group)}{x}" for x, group in itertools.groupby(steps))


def banded_distance(query: str, target: str, width: int) -> int:
    """Global edit distance of alignments that stay within ``width`` of the diagonal: -1 if none does. Space and time are a band's, not a table's."""
    n, m = len(query), len(target)
    if abs(n - m) > width:
        return -1
    t = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    lanes, far = np.arange(-width, width + 1), 1 << 30
    row = np.where((lanes >= 0) & (lanes <= m), lanes, far)
    for i, c in enumerate(query, 1):
        j = i + lanes
        inside = (j >= 0) & (j <= m)
        new = row + np.where((j > 0) & inside, t[np.clip(j - 1, 0, max(0, m - 1))] != ord(c) if m else True, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(inside, np.minimum(new, far), far)
        row = np.where(inside, np.minimum.accumulate(new - lanes) + lanes, far)
    return int(row[m - n + width])


def _local_end(a: np.ndarray, b: np.ndarray, match: int, mismatch: int, gap: int) -> tuple[int, int, int]:
    """Best score of any two parts, and where they end (the first such place)."""
    at = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, c in enumerate(a, 1):
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[1:] + gap, row[:-1] + np.where(b == c, match, mismatch)), 0)
        row = np.maximum.accumulate(new - at * gap) + at * gap
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), i, j
    return best


def local_align(query: str, target: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int, int]:
    """(score, begin and end in the query, begin and end in the target) of the best local alignment; zeros without any match. Space is one row."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (query, target))
    score, i, j = _local_end(a, b, match, mismatch, gap)
    back, p, q = _local_end(a[:i][::-1], b[:j][::-1], match, mismatch, gap)
    return score, i - p, i, j - q, j


def local_udf(**scores):
    """Arrow UDF (query, target) to struct(score, begin1, end1, begin2, end2)."""

    @F.pandas_udf("score int, begin1 int, end1 int, begin2 int, end2 int")
    def apply(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if q is None or t is None else local_align(q, t, **scores) for q, t in zip(query, target)]
        return pd.DataFrame(rows, columns=["score", "begin1", "end1", "begin2", "end2"]).astype("Int32")

    return apply


def semiglobal_udf(mode: str, most: int = -1):
    """Arrow UDF (query, target) to struct(distance, start, end)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    @F.pandas_udf("distance int, start int, end int")
    def apply(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if q is None or t is None else semiglobal(q, t, mode, most) for q, t in zip(query, target)]
        return pd.DataFrame(rows, columns=["distance", "start", "end"]).astype("Int32")

    return apply


def cigar(extended: bool = False, mode: str = "global"):
    """Arrow UDF (query, target) to struct(distance, cigar)."""

    @F.pandas_udf("distance int, cigar string")
    def apply(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if q is None or t is None else path(q, t, extended, mode) for q, t in zip(query, target)], columns=["distance", "cigar"])

    return apply


def extend(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 1, mismatch: int = -1, gap: int = -1, drop: int = 7) -> list[tuple[int, int, int]]:
    """X-drop extensions from the start of each pair: (score, letters of a, letters of b).

    All pairs advance row by row together. A pair's lanes are the diagonals around its live cells: they move with them,
    and become more where live cells spread; a pair ends when all its cells are more than drop below its best.
    """
    out = [(0, 0, 0)] * len(pairs)
    low = -(1 << 20)
    keep = np.array([k for k, (a, b) in enumerate(pairs) if len(a) and len(b)], int)
    if not len(keep):
        return out
    reach = drop // -gap + 1  # lanes that a row's live cells can spread to the right; one to the left
    size = 2 * reach + 4
    n, m = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    flat_a, flat_b = (np.concatenate([p[s] for p in pairs]) for s in (0, 1))
    begin_a, begin_b = np.cumsum(n) - n, np.cumsum(m) - m
    best, place = np.zeros(len(pairs), int), np.zeros((len(pairs), 2), int)
    base = np.full(len(keep), -2)  # diagonal of the first lane
    lanes = np.arange(size)
    row = np.where((lanes >= 2) & ((lanes - 2) * gap >= -drop), (lanes - 2) * gap, low) * np.ones((len(keep), 1), int)
    row[lanes - 2 > m[keep][:, None]] = low
    i = 0
    while len(keep):
        i += 1
        here = n[keep] >= i
        if not here.all():
            keep, base, row = keep[here], base[here], row[here]
            if not len(keep):
                break
        j = i + base[:, None] + lanes
        wide = m[keep][:, None]
        outside = (j < 0) | (j > wide)
        letters = flat_b[begin_b[keep][:, None] + np.clip(j - 1, 0, wide - 1)]
        new = row + np.where(letters == flat_a[begin_a[keep] + i - 1][:, None], match, mismatch)
        new[j < 1] = low
        new[:, :-1] = np.maximum(new[:, :-1], row[:, 1:] + gap)
        new[outside] = low
        new = np.maximum.accumulate(new - lanes * gap, axis=1) + lanes * gap
        new[outside] = low
        top, at = new.max(axis=1), new.argmax(axis=1)
        better = top > best[keep]
        best[keep[better]] = top[better]
        place[keep[better], 0], place[keep[better], 1] = i, j[better, at[better]]
        new[new < best[keep][:, None] - drop] = low
        alive = new > low // 2
        new[~alive] = low
        ok = alive.any(axis=1)
        if not ok.all():
            keep, base, new, alive = keep[ok], base[ok], new[ok], alive[ok]
            if not len(keep):
                break
        left, right = alive.argmax(axis=1), len(lanes) - 1 - alive[:, ::-1].argmax(axis=1)
        if (left < 1).any() or (right + reach >= len(lanes)).any():
            size = max(len(lanes), int((right - left).max()) + 2 * reach + 4)
            source = left[:, None] - 2 + np.arange(size)
            inside = (source >= 0) & (source < len(lanes))
            new = np.where(inside, np.take_along_axis(new, np.clip(source, 0, len(lanes) - 1), 1), low)
            base, lanes = base + left - 2, np.arange(size)
        row = new
    return [(int(best[k]), int(place[k, 0]), int(place[k, 1])) for k in range(len(pairs))]


def seed_alignment(k: int, **scores):
    """Arrow UDF (seq1, seq2, seeds) to struct(pos1, pos2, score, begin1, end1, begin2, end2) of the best of the pair's seeds (pos1, pos2), each extended both ways; the second read is turned if the k-mers agree as reverse complements.

    Of seeds that follow one another letter by letter, the first is extended: the others lie on its equal letters and
    reach the same ends. Of equal scores, the first seed's counts.
    """
    flip = str.maketrans("ACGT", "TGCA")

    def block(rows) -> list[tuple[int, ...]]:
        right, left, seeds = [], [], []
        for number, x, y, turned, p, q in rows:
            right.append((x[p + k :], y[q + k :]))
            left.append((x[:p][::-1], y[:q][::-1]))
            seeds.append((number, turned, p, q, len(y)))
        both = zip(seeds, extend(left, **scores), extend(right, **scores))
        return [(number, p, size - q - k if turned else q, k * scores.get("match", 1) + f[0] + g[0], p - f[1], p + k + g[1], q - f[2], q + k + g[2]) for (number, turned, p, q, size), f, g in both]

    def tasks(s1, s2, places):
        for number, (x, y, own) in enumerate(zip(s1, s2, places)):
            back = y.translate(flip)[::-1]
            a, b, c = (np.frombuffer(z.encode(), np.uint8) for z in (x, y, back))
            kept = {(turned := x[s["pos1"] : s["pos1"] + k] != y[s["pos2"] : s["pos2"] + k], s["pos1"], len(y) - s["pos2"] - k if turned else s["pos2"]) for s in own}
            for turned, p, q in sorted(kept):
                if (turned, p - 1, q - 1) not in kept:
                    yield number, a, c if turned else b, turned, p, q

    @F.pandas_udf("pos1 int, pos2 int, score int, begin1 int, end1 int, begin2 int, end2 int")
    def apply(s1: pd.Series, s2: pd.Series, places: pd.Series) -> pd.DataFrame:
        best: dict[int, tuple[int, ...]] = {}
        rows, letters = [], 0

        def settle():
            for number, *found in block(rows):
                if number not in best or (-found[2], found[0], found[1]) < (-best[number][2], best[number][0], best[number][1]):
                    best[number] = tuple(found)

        for task in tasks(s1, s2, places):
            rows.append(task)
            letters += len(task[1]) + len(task[2])
            if len(rows) >= 1024 or letters >= 1 << 24:
                settle()
                rows, letters = [], 0
        settle()
        return pd.DataFrame([best[i] for i in range(len(s1))], columns=["pos1", "pos2", "score", "begin1", "end1", "begin2", "end2"])

    return apply


def align_overlaps(places: DataFrame, reads: DataFrame, k: int, seeds: int | None = None, minimum: int = 50, adaptive: bool = False, error: float = 0.15, delta: float = 0.2, **scores) -> DataFrame:
    """The best alignment of each read pair over its seeds (r1, r2, pos1, pos2), extended with x-drop and filtered by score; ``seeds`` first ones of a pair only, if given.

    Adaptive: the least score is (1 - delta) times the expected score at this error rate over the overlap's length.
    """
    own = F.sort_array(F.collect_list(F.struct("pos1", "pos2")))
    pairs = places.groupBy("r1", "r2").agg((F.slice(own, 1, seeds) if seeds else own).alias("s"))
    for i in (1, 2):
        pairs = pairs.join(reads.select(F.col("read_id").alias(f"r{i}"), F.col("seq").alias(f"seq{i}")), f"r{i}")
    scored = pairs.select("r1", "r2", seed_alignment(k, **scores)("seq1", "seq2", "s").alias("a")).select("r1", "r2", "a.*")
    return well_scored(scored, minimum, adaptive, error, delta)


def well_scored(scored: DataFrame, minimum: int = 50, adaptive: bool = False, error: float = 0.15, delta: float = 0.2) -> DataFrame:
    """The alignments that pass ``align_overlaps``' filter."""
    if adaptive:
        length = F.least(F.col("end1") - F.col("begin1"), F.col("end2") - F.col("begin2"))
        return scored.where(F.col("score") >= (1 - delta) * (1 - 2 * error) * length)
    return scored.where(F.col("score") >= minimum)


def hamming(a: Column, b: Column) -> Column:
    """Number of places that differ; null for different lengths."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(differ))


def d2(counts_a: DataFrame, counts_b: DataFrame) -> DataFrame:
    """D2 score: sum of products of k-mer counts."""
    a, b = counts_a.select("packed", F.col("cnt").alias("x")), counts_b.select("packed", F.col("cnt").alias("y"))
    return a.join(b, "packed").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("d2"))


def find_patterns(reads: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """read_id, pattern_id, pos of each occurrence of patterns of at least k letters: equi-join on the first k letters, then comparison. No pair is formed without a shared k-mer."""
    keyed = patterns.where(F.length("pattern") >= k).select("pattern_id", "pattern", F.left("pattern", F.lit(k)).alias("kmer"))
    seq = F.encode("seq", "utf-8")
    at = reads.where(F.length("seq") >= k).select("read_id", seq.alias("b"), F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("p")).select("read_id", (F.col("p") - 1).alias("pos"), F.substr("b", "p", F.lit(k)).cast("string").alias("kmer"))
    hits = at.join(keyed, "kmer").join(reads.select("read_id", "seq"), "read_id")
    return hits.where(F.substr("seq", F.col("pos") + 1, F.length("pattern")) == F.col("pattern")).select("read_id", "pattern_id", F.col("pos").cast("long").alias("pos"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of an undirected edge list (a, b): labels spread along edges and jump to their label's label until none changes; each round's labels are a written table."""
    both = saved(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("n"))
        new = label.join(near, label["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "n").alias("component"))
        up = label.select(F.col("node").alias("m"), F.col("component").alias("over"))
        jumped = saved(new.join(up, new["component"] == up["m"], "left").select("node", "old", F.least("component", F.coalesce("over", "component")).alias("component")), "labels")
        changed = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        if not changed:
            return label
