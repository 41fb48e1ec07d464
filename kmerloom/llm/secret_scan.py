"""Secret scans: patterns, and password guess cost by dynamic programming for values in credential context.

Guess cost follows the public idea of password-strength estimators: a value is segmented at minimum total cost into
dictionary words, dates, repeated blocks, keyboard walks, sequences and brute-force characters. Costs are log10 of guesses.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import clean_texts, map_arrow

# Fixed patterns of the contract.
KEYWORD = r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider credential context: its value is judged by guess cost alone.
CONTEXT = re.compile(r"""(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|credentials?|auth(?:orization)?|private_?key|access_?key)["']?\x20*(?:[:=]|\bis\b)\x20*["']?([^\s"'<>]{6,})""")
#: Values that take at least 10 ** MIN_COST guesses are secrets.
MIN_COST = 8.0
#: Segments of up to so many characters are all tried; of longer repeats, walks and sequences, the longest one that ends at a place.
LONGEST = 40
#: Longest block of a repeat, and longest value whose cost is kept for the next time.
BLOCK, KEPT = 8, 64

# Common passwords and their parts, most common first.
WORDS = """password admin welcome letmein login master qwerty dragon monkey football baseball shadow sunshine princess secret token
changeme default example test user root guest public private super hello love summer winter spring autumn monday friday
january february march april june july august september october november december michael jennifer thomas jordan hunter
soccer batman trustno iloveyou whatever starwars killer pepper ginger cookie banana orange purple silver golden diamond
freedom computer internet server system access please enter your here insert value placeholder none null true false key
pass word my the and for you""".split()
def ranked(words) -> dict[str, int]:
    """Ranks, from 1, of words in lower case, most common first."""
    return {w.lower(): i + 1 for i, w in reversed(list(enumerate(words)))}


RANK = ranked(WORDS)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("@4310$57!", "aaelosstI".lower())

_NEAR: dict[str, set[str]] = {}
for _r, _row in enumerate(ROWS):
    for _c, _key in enumerate(_row):
        _NEAR[_key] = {x[j] for x in ROWS[max(0, _r - 1) : _r + 2] for j in range(max(0, _c - 1), min(len(x), _c + 2))} - {_key}
_DATE = re.compile(r"(?:19|20)\d\d|(?:[0-3]?\d[-/.]?[01]?\d[-/.]?(?:19|20)?\d\d)|(?:(?:19|20)\d\d[-/.]?[01]?\d[-/.]?[0-3]?\d)")


def _cardinality(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


STEP = math.log10(2)


def _lengths(run: int, least: int, unit: int = 1):
    """Lengths to try of a run that ends at a place: whole units, up to LONGEST, and the longest."""
    most = run // unit * unit
    yield from range(least, min(most, LONGEST) + 1, unit)
    if most > LONGEST:
        yield most


def segments(value: str, ranks: dict[str, int] = RANK):
    """(end, start, cost) of the segments of a value, by their ends: words, dates, repeated blocks, keyboard walks, sequences.

    Costs are log10 of guesses. Word: its rank, and two for each capital and for a spelling with look-alikes. Date: years
    of a span of 120, days of them. Repeat: the block's own cost, and the number of times. Walk: start and turns.
    Sequence (neighbouring code points): start, length and direction.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters become two in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    sizes = sorted({len(w) for w in ranks if 3 <= len(w) <= LONGEST})
    same = [0] * (BLOCK + 1)  # characters that equal the one q before them, up to here
    walk, whole, rise = 1, 0, {1: 1, -1: 1}
    for i in range(1, n + 1):
        c = low[i - 1]
        for q in range(1, min(BLOCK, i - 1) + 1):
            same[q] = same[q] + 1 if c == low[i - 1 - q] else 0
            for m in _lengths(same[q] + q, 3 if q == 1 else 2 * q, q) if same[q] >= (2 if q == 1 else q) else ():
                yield i, i - m, guess_cost(value[i - q : i], ranks) + math.log10(m // q) + STEP
        if i > 1 and c in _NEAR.get(low[i - 2], ()):
            turned = walk > 1 and _direction(low[i - 3], low[i - 2]) != _direction(low[i - 2], c)
            walk, whole = walk + 1, whole + turned
        else:
            walk, whole = 1, 0
        for m in _lengths(walk, 3) if walk >= 3 else ():
            bends = _bends(low[i - m : i]) if m <= LONGEST else whole
            yield i, i - m, math.log10(47 * m) + (bends + 1) * math.log10(4) + STEP
        for d in (1, -1):
            rise[d] = rise[d] + 1 if i > 1 and value[i - 1].isalnum() and value[i - 2].isalnum() and ord(value[i - 1]) - ord(value[i - 2]) == d else 1
            for m in _lengths(rise[d], 3) if rise[d] >= 3 else ():
                yield i, i - m, _cardinality(value[i - m]) + math.log10(m) + (d < 0) * STEP + STEP
        for m in sizes:
            j = i - m
            if j < 0:
                break
            exact = ranks.get(low[j:i])
            rank = exact or ranks.get(plain[j:i])
            if rank:
                changed = sum(a != b for a, b in zip(value[j:i], low[j:i])) + (0 if exact else 2)
                yield i, j, math.log10(rank + 1) + changed * STEP + STEP
        if c.isdigit():
            for m in range(4, min(10, i) + 1):
                if low[i - m].isdigit() and _DATE.fullmatch(low[i - m : i]):
                    yield i, i - m, math.log10(365 * 120 if m > 4 else 120) + STEP


def _cost(value: str, ranks: dict[str, int]) -> float:
    best, found = [0.0], iter(segments(value, ranks))
    end, start, cost = next(found, (0, 0, 0.0))
    for i, c in enumerate(value, 1):
        least = best[-1] + _cardinality(c)
        while end == i:
            least = min(least, best[start] + cost)
            end, start, cost = next(found, (0, 0, 0.0))
        best.append(least)
    return best[-1]


_kept: dict[str, float] = {}


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """Least log10 guesses over all segmentations of the whole value into ``segments`` and brute-force characters.

    Time grows with the value's length, by a factor that LONGEST, BLOCK and the words' lengths bound.
    """
    if ranks is not RANK or len(value) > KEPT:
        return _cost(value, ranks)
    if value not in _kept:
        if len(_kept) >= 1 << 14:
            _kept.clear()
        _kept[value] = _cost(value, ranks)
    return _kept[value]


def _bends(walk: str) -> int:
    """Changes of direction of a walk over the keyboard."""
    ways = [_direction(a, b) for a, b in zip(walk, walk[1:])]
    return sum(a != b for a, b in zip(ways, ways[1:]))


def _direction(a: str, b: str) -> tuple[int, int]:
    (r, c), (s, d) = _place(a), _place(b)
    return s - r, d - c


@lru_cache(maxsize=128)
def _place(key: str) -> tuple[int, int]:
    return next(((r, row.index(key)) for r, row in enumerate(ROWS) if key in row), (9, 9))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, number of the kind, ...) of the base patterns: leftmost and non-overlapping within each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found


def guess_spans(text: str) -> list[tuple[int, int, float]]:
    """Start, end and cost of the credential-context values that take at least 10 ** MIN_COST guesses."""
    out = []
    for m in CONTEXT.finditer(text):
        end = m.end(1)
        while end > m.start(1) and text[end - 1] in ".,;:!?)":
            end -= 1
        if end - m.start(1) >= 6 and (cost := guess_cost(text[m.start(1) : end])) >= MIN_COST:
            out.append((m.start(1), end, cost))
    return out


KINDS = ("assign", "access", "hex", "guess")


def find(text: str, hexes: bool = True) -> tuple[list[tuple[int, int, int, float]], list[int]]:
    """Spans as (start, kind, end, cost) in order, and counts of the base kinds."""
    spans = [(s, k, e, guess_cost(v)) for s, k, e, v in base_spans(text)]
    if hexes:
        spans += [(m.start(), 2, m.end(), guess_cost(m[0])) for m in HEX.finditer(text)]
    count = [sum(x[1] == k for x in spans) for k in range(3)]
    if ":" in text or "=" in text or " is " in text:
        spans += [(s, 3, e, c) for s, e, c in guess_spans(text)]
    return sorted(spans), count


_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b":=")] = True
_CUE = re.compile(rb"AKIA|(?i:pass|pwd|secret|token|api_?key|credential|auth|private_?key|access_?key)")


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can hold a span at all: with a run of 24 hexadecimal characters, and with a cue word."""
    hexes = np.zeros(len(offsets) - 1, bool)
    run = np.flatnonzero(~_HEXES[data])
    edges = np.union1d(run, np.concatenate((offsets - 1, [len(data)])))
    long = np.flatnonzero(np.diff(edges) >= 24)  # one more than needed, as an edge can be a hexadecimal character itself
    hexes[np.searchsorted(offsets, edges[long] + 1, "right") - 1] = True
    whole, bounds = memoryview(data), offsets.tolist()  # each row's own bytes: no match goes over a row's end
    cues = np.fromiter((_CUE.search(whole, low, high) is not None for low, high in zip(bounds, bounds[1:])), bool, len(bounds) - 1)
    return hexes, cues


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, max_cost double, base_sha256 string, spans string"


def scan(documents: DataFrame) -> DataFrame:
    """One row per input row, with SCHEMA's columns.

    spans: ``kind:start:end`` of all spans by start, then kind (assign, access, hex, guess), comma-joined, in code
    points, end exclusive. base_sha256: lowercase hex digest of the base spans joined likewise. max_cost: highest
    log10 guess cost of a span's value. Null and empty texts have none; rows are judged one by one, repeated ones too.
    """

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(1)):
            n = high - low
            hexes, cues = suspects(data, offsets)
            numbers = np.zeros((4, n), np.int64)
            cost = np.zeros(n)
            digest, joined = [_EMPTY] * n, [""] * n
            for i in np.flatnonzero(hexes | cues):
                text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
                spans, _ = find(text)
                names = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
                base = ",".join(x for x, span in zip(names, spans) if span[1] < 3)
                joined[i], digest[i] = ",".join(names), hashlib.sha256(base.encode()).hexdigest()
                for _, k, _, c in spans:
                    numbers[k, i] += 1
                    cost[i] = max(cost[i], c)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), *map(pa.array, numbers), pa.array(cost), pa.array(digest, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "max_cost", "base_sha256", "spans"])

    return map_arrow(clean_texts(documents), SCHEMA, run)


_EMPTY = hashlib.sha256(b"").hexdigest()


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end, _ in find(text)[0]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(documents: DataFrame) -> DataFrame:
    """All rows and columns, with secrets in ``text`` replaced and ``n_chars`` (if there) counted anew where they were."""
    names = documents.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(at)):
            part = batch.slice(low, high - low)
            hexes, cues = suspects(data, offsets)
            if not (hexes | cues).any():
                yield part
                continue
            texts, columns = part.column(at).to_pylist(), list(part.columns)
            counts = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i in np.flatnonzero(hexes | cues):
                new = redact(texts[i])
                if new != texts[i]:
                    texts[i] = new
                    if counts:
                        counts[i] = len(new)
            columns[at] = pa.array(texts, columns[at].type)
            if counts:
                columns[names.index("n_chars")] = pa.array(counts, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(documents, documents.schema, run)
