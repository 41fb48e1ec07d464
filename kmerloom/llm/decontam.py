"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names become typed placeholders, all else its lower-case letters.
Windows of template tokens are hash-joined with the benchmark's (windows of mostly placeholders by their words), spread
to the equal tokens around them, and must fill their slots consistently: the same value of a benchmark slot by the same
value in the document. So copies are caught, and questions with other numbers and names, too.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import kernels as K
from . import linear as L
from .common import clean_texts, joined, map_arrow, saved, stream_arrow

WINDOW = 8
#: A window must have so many tokens that are no placeholders to be indexed by its template, or else the most of its item;
#: the item's other windows are indexed by their own words.
LITERALS = 5
#: Least share of an item's tokens in matched windows, and least share of consistent slots.
COVERAGE, CONSISTENCY = 0.5, 0.8

# Number words and units.
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice dozen""".split()
UNITS = """mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces
ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers watt watts volt volts byte bytes""".split()

WORD, NUMBER, UNIT, NAME = range(4)
_MARKS = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)

KEEP = np.zeros(256, bool)
KEEP[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SMALL = np.zeros(256, bool)
SMALL[97:123] = True


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = L.texts_of(words)
    return np.sort(K.span_hash(K.byte_prefix(data), offsets[:-1], offsets[1:]))


_NUMBERS, _UNITS = _hashes(NUMBERS), _hashes(UNITS)


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token's letters and digits (lower case), its kind, its template value, and each row's first token.

    Punctuation is left out, and words of nothing else. A name starts with a capital and has small letters or nothing after it.
    """
    starts, ends, _ = K.words(data, offsets)
    kept = KEEP[data]
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    low, high = place[starts], place[ends]
    used = high > low
    starts, low, high = starts[used], low[used], high[used]
    raw = data[kept]
    h = K.span_hash(K.byte_prefix(K.LOWER[raw]), low, high)

    def has(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        return total[high] > total[low]

    second = raw[np.minimum(low + 1, len(raw) - 1)] if len(raw) else raw
    wide = (raw[low] == 0xC3) if len(raw) else np.zeros(0, bool)
    capital = (UPPER[raw[low]] | (wide & (second >= 0x80) & (second <= 0x9E))) if len(raw) else wide
    kind = np.full(len(h), WORD)
    kind[capital & (has(SMALL) | (high - low - wide == 1))] = NAME
    if len(h):
        kind[_among(h, _UNITS)] = UNIT
        kind[_among(h, _NUMBERS)] = NUMBER
    kind[has(DIGIT)] = NUMBER
    return h, kind, np.where(kind == WORD, h, _MARKS[kind]), np.searchsorted(starts, offsets)


@dataclass
class Index:
    """Some benchmark items: their tokens, and the hashes of their windows, sorted, with their places."""

    ids: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    by_width: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]  # width, by words: distinct hashes, start in places, places


def index(items: list[tuple[int, str | None]]) -> Index:
    data, offsets = L.texts_of([t for _, t in items])
    letters, kind, value, first = tokens(data, offsets)
    sums = {False: K.prefix(value), True: K.prefix(letters)}
    literal = np.concatenate(([0], np.cumsum(kind == WORD)))
    found: dict[tuple[int, bool], list[np.ndarray]] = defaultdict(list)
    for i in range(len(items)):
        n = int(first[i + 1] - first[i])
        if not n:
            continue
        width = min(WINDOW, n)
        at = np.arange(first[i], first[i + 1] - width + 1)
        plain = literal[at + width] - literal[at]
        good = plain >= min(LITERALS, math.ceil(0.6 * width))
        good = good if good.any() else plain == plain.max()
        found[width, False].append(at[good])
        if not good.all():
            found[width, True].append(at[~good])
    by_width = {}
    for (width, own), parts in found.items():
        at = np.concatenate(parts)
        h = K.span_hash(sums[own], at, at + width)
        order = np.argsort(h, kind="stable")
        keys, start = np.unique(h[order], return_index=True)
        by_width[width, own] = (keys, np.append(start, len(order)), at[order])
    return Index(np.array([i for i, _ in items], np.int64), first, letters, kind, value, by_width)


def _judged(x: Index, letters: np.ndarray, n: int, width: int, runs: list[tuple[int, np.ndarray, int]]) -> tuple[int, float, float, bool]:
    """(windows, coverage, consistency, exact) of the item's tokens at their places in the document; a token counts once, at the first of the shifts."""
    covered, slots, consistent, same, windows = np.zeros(0, np.int64), 0, 0, True, np.zeros(0, np.int64)
    for shift, own, _ in runs:
        windows = np.union1d(windows, own[: len(own) - width + 1][own[width - 1 :] - own[: len(own) - width + 1] == width - 1])
        own = np.setdiff1d(own, covered, True)
        covered = np.union1d(covered, own)
        filled: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for q in own[x.kind[own] != WORD].tolist():
            filled[int(x.kind[q]), int(x.letters[q])][int(letters[q + shift])] += 1
            same &= bool(x.letters[q] == letters[q + shift])
        taken: set[tuple[int, int]] = set()
        for (k, _), values in sorted(filled.items(), key=lambda f: (-sum(f[1].values()), f[0])):
            slots += sum(values.values())
            best, times = max(values.items(), key=lambda v: (v[1], v[0]))
            if k != NAME or (k, best) not in taken:  # two names of the item aren't one name in the document
                consistent += times
            taken.add((k, best))
    return len(windows), len(covered) / n, consistent / slots if slots else 1.0, same


def matches(x: Index, data: np.ndarray, offsets: np.ndarray, coverage: float = COVERAGE, consistency: float = CONSISTENCY):
    """(row, item number, windows, coverage, consistency, exact) of each row and item with a matched window.

    A match is spread from its windows to all equal tokens beside them, so a whole copy covers its item. Shifts are
    judged together, those with most of the item's own words first, and each alone: a whole copy counts whatever else
    the row holds.
    """
    letters, kind, value, first = tokens(data, offsets)
    sums: dict[bool, np.ndarray] = {}
    hits: dict[tuple[int, int, int], set[int]] = defaultdict(set)  # row, item, shift: matched places of the item
    for (width, own), (keys, start, places) in x.by_width.items():
        n = len(value) - width + 1
        if n <= 0:
            continue
        if own not in sums:
            sums[own] = K.prefix(letters if own else value)
        low = np.arange(n)
        h = K.span_hash(sums[own], low, low + width)
        may = np.zeros(1 << 16, bool)
        may[keys >> K.U(48)] = True
        at = np.flatnonzero(may[h >> K.U(48)])
        number = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        good = keys[number] == h[at]
        at, number = at[good], number[good]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + width <= first[row + 1]
        for a, k, r in zip(at[inside].tolist(), number[inside].tolist(), row[inside].tolist()):
            for p in places[start[k] : start[k + 1]].tolist():
                item = int(np.searchsorted(x.first, p, "right")) - 1
                hits[r, item, a - p].add(p)
    joined: dict[tuple[int, int], list[tuple[int, np.ndarray, int]]] = defaultdict(list)
    for (r, item, shift), at in hits.items():
        q = np.arange(max(x.first[item], first[r] - shift), min(x.first[item + 1], first[r + 1] - shift))
        equal = x.letters[q] == letters[q + shift]
        run = np.cumsum(~(equal | (x.value[q] == value[q + shift])))  # equal tokens have the number of the last unequal one
        spread = (equal | (x.value[q] == value[q + shift])) & np.isin(run, run[np.array(sorted(at)) - q[0]])
        joined[r, item].append((shift, q[spread], int(equal[spread].sum())))
    for (r, item), runs in joined.items():
        n = int(x.first[item + 1] - x.first[item])
        width = min(WINDOW, n)
        runs.sort(key=lambda f: (-f[2], -len(f[1]), f[0]))
        judged = [_judged(x, letters, n, width, runs)]
        if len(runs) > 1 and not (judged[0][1] == 1 and judged[0][2] >= consistency):
            judged += [_judged(x, letters, n, width, [f]) for f in runs if len(f[1]) >= coverage * n]
        yield r, item, *max(judged, key=lambda f: (f[1] >= coverage and f[2] >= consistency, f[1], f[2]))


SCHEMA = "doc_id long, item_id long, windows long, coverage double, consistency double, exact boolean"


#: Bits of the filter for each window of the benchmark, and bits of the filter at most (32 MiB): what passes it by chance is settled by the join.
BITS, MOST_BITS, PROBES = 128, 1 << 28, 4


def _keys(h: np.ndarray, width: int, own: bool) -> np.ndarray:
    return K.mix(h ^ K.U(0x9E3779B97F4A7C15 * (2 * width + own) & 0xFFFFFFFFFFFFFFFF))


def windows_of(items: DataFrame) -> DataFrame:
    """key, width, own, item_id of the items' windows (see ``index``), each once an item."""

    def run(batch: pa.RecordBatch):
        x = index(list(zip(range(batch.num_rows), batch.column(1).to_pylist())))
        for (width, own), (keys, start, places) in x.by_width.items():
            item = np.searchsorted(x.first, places, "right") - 1
            key = np.repeat(_keys(keys, width, own), np.diff(start)).view(np.int64)
            each = np.unique(np.column_stack((key, item)), axis=0)
            n = len(each)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, own)), batch.column(0).take(pa.array(each[:, 1]))], names=["key", "width", "own", "item_id"])

    return map_arrow(items, "key long, width int, own boolean, item_id long", run)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys in a filter of a power of two bits."""
    step = K.mix(keys) | K.U(1)
    return ((keys + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & K.U(bits - 1)).astype(np.int64)


def window_filter(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, bool]]]:
    """Filter of the windows' keys, of MOST_BITS bits at most, and the kinds (width, own) of windows that there are, which are 2 * WINDOW at most."""
    kinds = windows.groupBy("width", "own").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in kinds)
    bits = min(MOST_BITS, 1 << max(16, (BITS * total).bit_length()))

    def run(batches):
        state = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _probes(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            np.bitwise_or.at(state, at >> 6, K.U(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(state)
        for low in range(0, len(used), 1 << 16):
            part = used[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(state[part].view(np.int64))], names=["at", "word"])

    state = np.zeros(bits // 64, np.uint64)
    merged = stream_arrow(windows.select("key").distinct(), "at long, word long", run).groupBy("at").agg(F.bit_or("word").alias("word"))
    for batch in merged.toArrow().to_batches():  # MOST_BITS / 64 rows at most
        state[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return state, sorted((int(r["width"]), bool(r["own"])) for r in kinds)


def _found(data: np.ndarray, offsets: np.ndarray, state: np.ndarray, kinds: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the windows that pass the filter, each once a row."""
    letters, _, value, first = tokens(data, offsets)
    sums: dict[bool, np.ndarray] = {}
    out = [np.zeros((0, 2), np.int64)]
    for width, own in kinds:
        if len(value) < width:
            continue
        if own not in sums:
            sums[own] = K.prefix(letters if own else value)
        low = np.arange(len(value) - width + 1)
        keys = _keys(K.span_hash(sums[own], low, low + width), width, own)
        at = np.arange(len(keys))
        for probe in range(PROBES):
            bit = (keys[at] + K.U(probe) * (K.mix(keys[at]) | K.U(1))) & K.U(len(state) * 64 - 1)
            at = at[(state[bit >> K.U(6)] >> (bit & K.U(63))) & K.U(1) > 0]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + width <= first[row + 1]
        out.append(np.column_stack((row[inside], keys[at[inside]].view(np.int64))))
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0], both[:, 1]


#: Items that are compared with a document at once at about; a document that shares windows with more goes to several rows.
TOGETHER = 512
SCHEMA = "doc_id long, item_id long, windows long, coverage double, consistency double, exact boolean"


def contamination(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row for each document row and benchmark item that it holds, whole or re-parameterised.

    coverage: share of the item's tokens in matched windows; consistency: share of matched slots that are filled like
    their item's value is elsewhere; exact: all slots hold the item's own values. Null and empty texts and items match
    nothing; repeated rows are reported each; of items that share an id, the one with the least text counts. Empty
    tables give no rows.

    Windows of documents that pass a filter of bounded size are hash-joined with the benchmark's windows; documents
    travel only if they have such a window. The pairs of a document and an item are then compared token by token.
    """
    check = Check(documents, benchmark, coverage, consistency)
    held = check.screened(clean_texts(documents), True)
    return check.compared(held).select(*(c.split()[0] for c in SCHEMA.split(", ")))


class Check:
    """The benchmark's windows and their filter, and the steps that documents go through."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, coverage: float, consistency: float):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
        self.items = saved(items.groupBy("item_id").agg(F.min("text").alias("text")), "leaks-items")
        self.windows = saved(windows_of(self.items), "leaks-windows")
        self.shared = documents.sparkSession.sparkContext.broadcast(window_filter(self.windows))
        self.coverage, self.consistency = coverage, consistency

    def screened(self, documents: DataFrame, hit: bool) -> DataFrame:
        """The rows whose text has a window that passes the filter, with the windows' keys (``__keys``) and a hash of id and text (``__doc``); or else the other rows as they are."""
        at, shared = documents.columns.index("text"), self.shared
        names = [*documents.columns, "__keys"]

        def run(batch: pa.RecordBatch):
            for low, high, data, offsets in K.pieces(batch.column(at)):
                row, key = _found(data, offsets, *shared.value)
                rows, begin = np.unique(row, return_index=True)
                if not hit:
                    clean = np.ones(high - low, bool)
                    clean[rows] = False
                    yield batch.slice(low, high - low).filter(pa.array(clean))
                elif len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)).astype(np.int32)), pa.array(key))
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).take(pa.array(rows)).columns, lists], names=names)

        if not hit:
            return map_arrow(documents, documents.schema, run)
        found = map_arrow(documents, StructType([*documents.schema.fields, StructField("__keys", ArrayType(LongType()))]), run)
        return saved(found.withColumn("__doc", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))), "leaks-documents")

    def compared(self, held: DataFrame) -> DataFrame:
        """Rows of SCHEMA and the document's ``__doc``: documents and items that share a window are compared token by token."""
        hits = held.select("__doc", F.explode("__keys").alias("key")).distinct()
        both = saved(joined(hits, self.windows.select("key", "item_id").distinct(), "key").select("__doc", "item_id").distinct(), "leaks-pairs")
        parts = both.groupBy("__doc").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
        dealt = joined(both, parts, "__doc").select("__doc", "item_id", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part"))
        with_items = joined(dealt, self.items, "item_id").groupBy("__doc", "part").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items"))
        texts = held.select("__doc", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = joined(texts, with_items, "__doc").select("__doc", "doc_id", "text", "items")
        coverage, consistency = self.coverage, self.consistency

        def run(batch: pa.RecordBatch):
            out = []
            for r in range(batch.num_rows):
                x = index([(i["item_id"], i["text"]) for i in batch.column(3)[r].as_py()])
                data, offsets = L.texts_of([batch.column(2)[r].as_py()])
                found = [m for m in matches(x, data, offsets, coverage, consistency) if m[3] >= coverage and m[4] >= consistency]
                out += [(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), int(x.ids[i]), w, c, s, e) for _, i, w, c, s, e in found]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["__doc", *(c.split()[0] for c in SCHEMA.split(", "))])

        return map_arrow(rows, f"__doc long, {SCHEMA}", run)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """The rows without a benchmark item, with all their columns. Rows without a window that passes the filter are kept where they are read; only the others are joined."""
    check = Check(documents, benchmark, coverage, consistency)
    held = check.screened(documents, True)
    gone = check.compared(held).select("__doc").distinct()
    return check.screened(documents, False).unionByName(joined(held, gone, "__doc", "left_anti").select(*documents.columns))
