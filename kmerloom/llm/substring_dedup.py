"""Substring dedup by words: relative Lempel-Ziv parsing.

Reference blocks are the strips of all documents with one anchor (see ``spans``): every 50-word window of the corpus is
in exactly one block. A strip that equals an earlier document's is one factor as a whole. The others' blocks are indexed
by a suffix array over words, with common prefixes: it gives, for each place of a strip, the longest match that starts in
a document with a smaller id. The greedy parse takes the longest match at a window's start as a factor (source place and
length). At a factor's boundary, windows that start inside it and reach beyond it are checked: where one of them has a
longer match, a further factor starts. Factors of 50 words and more are duplicate spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import spans as S
from .common import clean_texts, stream_arrow

RULE = S.Rule(length=50, gram=6, words=True, within=False)


def ranks(symbols: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of the texts of 1, 2, 4, ... symbols at each place, until ``left`` (symbols to the end of the own strip) is reached everywhere; what lies beyond a strip's end ranks lowest."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    out, have = [rank], 1
    while have < left.max(initial=0):
        after = np.zeros(len(rank), np.int64)
        after[:-have] = np.where(left[:-have] > have, rank[have:], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        out.append(rank)
        have *= 2
    return out


def common_prefixes(levels: list[np.ndarray], left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix of the order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    same, room = np.zeros(len(a), np.int64), np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = same + step <= room
        at = np.where(fits, same, 0)
        same += step * (fits & (levels[k][a + at] == levels[k][b + at]))
    out[1:] = same
    return out


def parse(words: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(strip, place in the strip, length, source strip, place in the source) of the factors of at least ``length`` words.

    words: the words' hashes, strip by strip; first: each strip's first; doc, start: each strip's place in the corpus.
    """
    row = K.rows_of(first)
    left = first[row + 1] - np.arange(len(row))
    none = (np.zeros(0, np.int64),) * 5
    begin = np.flatnonzero(left >= length)
    if not len(begin):
        return none
    levels = ranks(words, left)
    order = begin[np.argsort(levels[-1][begin], kind="stable")]
    shared = common_prefixes(levels, left, order)
    # suffixes that share a window with a neighbour in the order
    near = shared >= length
    used = near | np.append(near[1:], False)
    order, shared = order[used], shared[used]
    if not len(order):
        return none
    place = np.empty(len(order), np.int64)  # order of the corpus
    place[np.lexsort((start[row[order]] + order - first[row[order]], doc[row[order]]))] = np.arange(len(order))
    by_place = np.empty(len(order), np.int64)
    by_place[place] = np.arange(len(order))
    match, source, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.arange(len(order))
    depth = length
    while len(at):  # classes of suffixes that share depth words, from the least depth on
        cut = shared < depth
        cut[0] = True
        head = np.flatnonzero(cut)
        size = np.diff(np.append(head, len(at)))
        least = np.repeat(by_place[np.minimum.reduceat(place[at], head)], size)
        known = doc[row[order[least]]] < doc[row[order[at]]]
        match[at[known]], source[at[known]] = depth, order[least[known]]
        on = np.repeat(np.logical_or.reduceat(known, head) & (size > 1), size)
        on_head = np.flatnonzero(on & cut)
        shared = shared.copy()
        shared[on_head] = 0
        at, shared = at[on], shared[on]
        depth += 1
    found = np.flatnonzero(match)
    found = found[np.argsort(order[found])]
    strip, where, match, source = row[order[found]], order[found], match[found], source[found]
    # a factor starts where a match ends beyond all factors before it in the strip
    end = where + match + strip * len(row)  # strips don't overlap
    before = np.maximum.accumulate(np.concatenate(([-1], end[:-1])))
    lead = end > np.maximum(before, strip * len(row) + first[strip])
    strip, where, match, source = strip[lead], where[lead], match[lead], source[lead]
    return strip, where - first[strip], match, row[source], source - first[row[source]]


def factors(texts: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, rule: S.Rule = RULE):
    """Duplicate factors of the strips of whole blocks: (documents, starts, ends) in words."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = K.words(data, offsets)
    words = K.span_hash(K.byte_prefix(data), starts, ends)
    may = S.paired(K.prefix(words), first, anchor, rule)
    if not may.any():
        return
    words = words[np.repeat(may, np.diff(first))]
    first = np.concatenate(([0], np.cumsum(np.diff(first)[may])))
    doc, start = doc[may], start[may]
    strip, place, length, _, _ = parse(words, first, doc, start, rule.length)
    if len(strip):
        low = start[strip] + place
        yield doc[strip], low, low + length


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dedup(documents: DataFrame, rule: S.Rule = RULE, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed (words in windows that also start in a document with a smaller id), the digest of the kept words joined by one space, and (``with_text``) these words.

    Windows are judged on the input. Null and empty texts have no words. Rows without id are neither judged nor
    references: nothing is removed from them. Rows that share an id are one document's: they never judge each other.
    """
    docs = clean_texts(documents)
    spans = S.removed_spans(docs, rule, lambda *x: factors(*x, rule), "words")
    schema = SCHEMA if with_text else SCHEMA.rpartition(",")[0]

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            for low, high, data, offsets in K.pieces(batch.column(1)):
                starts, ends, first = K.words(data, offsets)
                removed, digest, kept = np.zeros(high - low, np.int64), [], []
                for i in range(high - low):
                    own = spans[low + i].values if spans[low + i].is_valid else None
                    s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
                    if own is not None and len(own):
                        stay = ~S.covered(own.field(0).to_numpy(), own.field(1).to_numpy(), len(s))
                        removed[i] = len(s) - stay.sum()
                        s, e = s[stay], e[stay]
                    text = b" ".join([data[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist())])
                    digest.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text)
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(first)), pa.array(removed), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []), names=[x.split()[0] for x in schema.split(", ")])

    return stream_arrow(S.with_spans(docs, spans), schema, run)
