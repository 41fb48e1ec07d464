"""Suffix-array dedup over bytes by merged Burrows-Wheeler transforms.

Strips of the corpus that share an anchor (see ``spans``) are dealt to shards. Each shard's suffixes are sorted once, by
prefix doubling, which gives its Burrows-Wheeler transform and LF mapping. The shards' orders are then merged without
sorting suffixes again: starting from an interleave that only keeps each shard's own order, every round deals the rows
stably by the symbols before them and follows the LF mapping, which refines the interleave by a fixed number of symbols
(as in Holt and McMillan's merge; rounds take STRIDE symbols at once). The round that parts two neighbouring rows tells
their common prefix, up to 100 symbols; runs of rows whose common prefixes reach 100 are the repeated intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import spans as S
from .common import clean_texts, stream_arrow

RULE = S.Rule(length=100, gram=24, words=False, within=True)
STRIDE = 4
SHARDS = 4


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all rotations, by prefix doubling. Strips of a shard are different, so no two rotations are equal."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    have = 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -have)
        order = np.argsort(key)
        sorted_key = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        have *= 2
        if have >= n or rank[order[-1]] == n - 1:
            return order


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' sorted suffixes down to ``depth`` symbols (a multiple of STRIDE).

    Returns the merged order as positions in the concatenation of the shards, and the length of each row's common prefix
    with the row before it, ``depth`` at most (0 for the first row).
    """
    base = np.concatenate(([0], np.cumsum([len(s) for s in shards])))
    total = int(base[-1])
    suffix = np.empty(total, np.int64)  # rows, shard by shard, in their shard's order: position of the suffix
    before = np.empty(total, np.int64)  # row of the suffix that starts STRIDE symbols earlier
    code = np.empty(total, np.int64)  # those STRIDE symbols
    for s, low in zip(shards, base):
        n = len(s)
        order = suffix_array(s)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        suffix[low : low + n] = order + low
        back = (order - STRIDE) % n
        before[low : low + n] = place[back] + low
        value = np.zeros(n, np.int64)
        for j in range(STRIDE):
            value = value * 512 + s[(back + j) % n]
        code[low : low + n] = value
    kinds, code = np.unique(code, return_inverse=True)
    narrow = len(kinds) <= 1 << 16
    low_code, high_code = code.astype(np.uint16) if narrow else (code & 0xFFFF).astype(np.uint16), None if narrow else (code >> 16).astype(np.uint16)
    rows, block = np.arange(total), np.zeros(total, np.int64)
    common = np.full(total, depth)  # whole rounds before the row was parted from the one before it
    for d in range(0, depth, STRIDE):
        order = np.argsort(low_code[rows], kind="stable")
        if high_code is not None:
            order = order[np.argsort(high_code[rows[order]], kind="stable")]
        moved = rows[order]
        mark, part = code[moved], block[order]
        fresh = np.zeros(total, bool)
        fresh[1:] = (mark[1:] != mark[:-1]) | (part[1:] != part[:-1])
        rows, block = before[moved], np.cumsum(fresh)
        common[fresh & (common == depth)] = d  # parted rows stay parted, at the same places
    place = suffix[rows]
    common[:1] = 0
    row = np.flatnonzero(common[1:] < depth) + 1  # their first unequal symbol is one of the round's
    symbols, own = np.concatenate(shards), np.searchsorted(base, place, "right") - 1
    low, size, whole = base[own], np.diff(base)[own], common[row]
    equal = np.ones(len(row), bool)
    for j in range(STRIDE - 1):
        equal &= np.equal(*(symbols[low[r] + (place[r] - low[r] + whole + j) % size[r]] for r in (row - 1, row)))
        common[row] += equal
    return place, common


def repeats(texts: list[bytes], anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, rule: S.Rule = RULE):
    """Spans (documents, starts, ends) of the windows of the strips that another strip's window repeats earlier."""
    length, shards, places = rule.length, [], []
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    may = S.paired(K.byte_prefix(np.frombuffer(b"".join(texts), np.uint8)), offsets, anchor, rule)
    if not may.any():
        return
    texts, doc, start = [t for t, m in zip(texts, may) if m], doc[may], start[may]
    for k in range(SHARDS):
        own = range(k, len(texts), SHARDS)
        if not own:
            continue
        size = np.array([len(texts[i]) + 1 for i in own])
        symbols = np.frombuffer(b"\0".join([texts[i] for i in own]) + b"\0", np.uint8).astype(np.int64) + 1
        ends = np.cumsum(size)
        symbols[ends - 1] = 0  # parts strips; bytes are 1 to 256
        row = np.repeat(np.fromiter(own, np.int64), size)
        shards.append(symbols)
        places.append(np.column_stack((row, np.arange(len(symbols)) - np.repeat(ends - size, size), np.repeat(ends, size) - 1 - np.arange(len(symbols)))))
    at = np.concatenate(places)
    order, common = merge(shards, length)
    block = np.cumsum(common < length)  # the repeated interval
    row, offset, left = at[order].T
    whole = left >= length
    row, offset, block = row[whole], offset[whole], block[whole]
    if not len(row):
        return
    begin = start[row] + offset
    sort = np.lexsort((begin, doc[row], block))
    row, begin, block = row[sort], begin[sort], block[sort]
    again = np.zeros(len(row), bool)
    again[1:] = block[1:] == block[:-1]
    d, b = doc[row[again]], begin[again]
    sort = np.lexsort((b, d))
    d, b = d[sort], b[sort]
    if not len(d):
        return
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (b[1:] > b[:-1] + 1))))
    tail = np.append(head[1:], len(d)) - 1
    yield d[head], b[head], b[tail] + length


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(documents: DataFrame, rule: S.Rule = RULE, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes in 100-byte strings that also start earlier: smaller id, or same document and earlier start), n_spans (maximal removed runs), the digest of the other bytes, and (``with_kept``) these bytes.

    Strings are judged on the input. Null and empty texts have no bytes. Rows without id are neither judged nor
    references. Rows that share an id are taken for one document's parts that start alike: of equal strings at equal
    places the first stays in all of them.
    """
    docs = clean_texts(documents)
    spans = S.removed_spans(docs, rule, lambda *x: repeats(*x, rule), "bytes")
    schema = SCHEMA if with_kept else SCHEMA.rpartition(",")[0]

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            for low, high, data, offsets in K.pieces(batch.column(1)):
                removed, runs, digest, kept = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64), [], []
                for i in range(high - low):
                    own = spans[low + i].values if spans[low + i].is_valid else None
                    text = data[offsets[i] : offsets[i + 1]]
                    if own is not None and len(own):
                        gone = S.covered(own.field(0).to_numpy(), own.field(1).to_numpy(), len(text))
                        removed[i] = gone.sum()
                        runs[i] = (gone & ~np.concatenate(([False], gone[:-1]))).sum()
                        text = text[~gone]
                    text = text.tobytes()
                    digest.append(hashlib.sha256(text).hexdigest())
                    if with_kept:
                        kept.append(text)
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_kept else []), names=[x.split()[0] for x in schema.split(", ")])

    return stream_arrow(S.with_spans(docs, spans), schema, run)
