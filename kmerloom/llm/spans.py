"""Repeated spans of a fixed length across a corpus: the part that substring dedup by bytes and by words share.

All windows of ``length`` units (bytes or words) are grouped by their anchor, the least of their k-grams by hash
(leftmost if tied). The anchor depends on the window's content only, so equal windows have equal anchors at equal
offsets. A maximal run of windows with one anchor is a strip; strips are about 2 / (length - k + 2) as many as units,
and each window is in exactly one. Strips travel as hashes: strips that equal an earlier one are settled at once, and
only strips that differ but share an anchor send their text on, for a verdict window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import joined, of_groups, partitions, saved, stream_arrow

_PLACE = K.U((1 << 26) - 1)
#: Units of one block of a text; longer texts are cut into blocks that overlap by length - 1, so that each window is in one.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """length: units of a window. gram: units of an anchor. words: units are words, else bytes. within: whether a window may repeat an earlier one of its own document."""

    length: int
    gram: int
    words: bool
    within: bool


@dataclass
class Units:
    """Units of some rows: values, prefix hash, each row's first unit, and where units start and end in bytes."""

    sums: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None


def units(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> Units:
    if not rule.words:
        return Units(K.byte_prefix(data), offsets, None, None)
    starts, ends, first = K.words(data, offsets)
    return Units(K.prefix(K.span_hash(K.byte_prefix(data), starts, ends)), first, starts, ends)


def strips(sums: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(row, start within the row, number of windows, anchor hash, strip hash) of the strips of rows of units."""
    n = len(sums) - 1
    if n < rule.length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gram = K.gram_hash(sums, rule.gram)
    found = []
    for low in range(0, n - rule.length + 1, BLOCK):
        high = min(n - rule.length + 1, low + BLOCK)  # starts of windows
        own = gram[low : high + rule.length - rule.gram]
        at = K.sliding_min((own & ~_PLACE) | np.arange(len(own), dtype=np.uint64), rule.length - rule.gram + 1) & _PLACE
        start = np.arange(low, high)
        room = np.searchsorted(first, start, "right") if len(first) < 3 else None
        row = (room if room is not None else np.repeat(np.arange(1, len(first)), np.diff(first))[low:high]) - 1
        good = start + rule.length <= first[row + 1]
        start, row, at = start[good], row[good], at[: high - low][good].astype(np.int64) + low
        if not len(start):
            continue
        fresh = np.ones(len(start), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(fresh)
        count = np.diff(np.append(head, len(start)))
        s = start[head]
        found.append((row[head], s - first[row[head]], count, gram[at[head]], K.span_hash(sums, s, s + count + rule.length - 1)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2


#: kind 0: a strip, to be judged. kind 1: settled, its windows repeat earlier ones. kind 2: an anchor and how many strips of a batch have it, if these are many.
STRIPS = "kind int, anchor long, strip long, doc long, start long, windows int"


def _batch(kind, anchor, strip, doc, start, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int32)), pa.array(anchor), pa.array(strip), pa.array(doc), pa.array(start), pa.array(np.asarray(windows, np.int32))], names=["kind", "anchor", "strip", "doc", "start", "windows"])


def _runs(keys: tuple[np.ndarray, ...], start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of rows that have equal keys and follow one another in their text, and the runs' windows."""
    if not len(start):
        return np.zeros(0, np.int64), windows
    fresh = np.concatenate(([True], start[1:] != start[:-1] + windows[:-1]))
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    head = np.flatnonzero(fresh)
    return head, np.add.reduceat(windows, head)


def _merged(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head, windows = _runs((doc,), start, windows)
    return doc[head], start[head], windows


def scan(texts: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Strips of all texts. Copies within one Arrow batch are settled here, before the shuffle: only the earliest travels. Anchors of over 1/n of a batch's open strips are told."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for low, high, data, offsets in K.pieces(batch.column(1)):
                u = units(data, offsets, rule)
                row, start, windows, anchor, strip = strips(u.sums, u.first, rule)
                parts.append((ids[low:high][row], start, windows, anchor.view(np.int64), strip.view(np.int64)))
            doc, start, windows, anchor, strip = (np.concatenate(x) for x in zip(*parts))
            if not len(doc):
                continue
            order = np.lexsort((start, doc, strip, anchor))
            doc, start, windows, anchor, strip = doc[order], start[order], windows[order], anchor[order], strip[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (strip[1:] != strip[:-1])
            kind = ~fresh if rule.within else doc > doc[np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))]
            gone = np.lexsort((start[kind], doc[kind]))  # settled strips that follow one another become one
            d, s, w = _merged(doc[kind][gone], start[kind][gone], windows[kind][gone])
            yield _batch(np.ones(len(d)), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, s, w)
            # so do equal strips, as in a word's repetitions: what holds for one of them holds for all
            own, strip, doc, start, windows = anchor[~kind], strip[~kind], doc[~kind], start[~kind], windows[~kind]
            same = np.cumsum(np.concatenate(([True], (own[1:] != own[:-1]) | (strip[1:] != strip[:-1]))))
            head, windows = _runs((same, doc), start, windows)
            own, strip, doc, start = own[head], strip[head], doc[head], start[head]
            yield _batch(np.zeros(len(own)), own, strip, doc, start, windows)
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else head
            times = np.diff(np.append(head, len(own)))
            many = (times * n > len(own)) & (times > 1)
            if many.any():
                zero = np.zeros(many.sum(), np.int64)
                yield _batch(zero + 2, own[head[many]], zero, zero, zero, times[many])

    return stream_arrow(texts, STRIPS, run)


def judge(found: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Settles strips that equal an earlier one. Of the others, those whose anchor several different strips share stay open (kind 0), with their anchor.

    Rows stream by in order of anchor, strip, document and start; what is held between batches is the earliest strip of
    the current anchor (with the word rule: its places in one document). An anchor that the batches told of for over 1/n
    of all open strips is dealt by strip, too, and stays open: there are n such anchors at most, and any other has at
    most 2/n of the strips.
    """
    total = found.where("kind = 0").count()
    often = F.broadcast(found.where("kind = 2").groupBy("anchor").agg(F.sum("windows").alias("n")).where(F.col("n") * n > total).select("anchor", F.lit(True).alias("often")))  # n rows at most
    rows = found.where("kind = 0").join(often, "anchor", "left").select(*found.columns, F.coalesce("often", F.lit(False)).alias("often"))
    open_ = rows.repartition(n, "anchor", F.when(F.col("often"), F.col("strip")).otherwise(F.lit(0))).sortWithinPartitions("anchor", "strip", "doc", "start")

    def run(batches):
        anchor0 = strip0 = lead0 = None
        several = False
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            _, anchor, strip, doc, start, windows, often = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            n = len(anchor)
            at = np.arange(n)
            new_anchor = np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_anchor[0] = anchor0 is None or anchor[0] != anchor0
            new_strip = np.ones(n, bool)
            new_strip[1:] = new_anchor[1:] | (strip[1:] != strip[:-1])
            new_strip[0] = new_anchor[0] or strip[0] != strip0
            lead = np.maximum.accumulate(np.where(new_strip, at, -1))
            first_doc = np.where(lead >= 0, doc[np.maximum(lead, 0)], lead0 if lead0 is not None else 0)
            settled = ~new_strip if rule.within else doc > first_doc
            group = np.cumsum(new_anchor)  # 0 continues the last batch's anchor
            kinds = np.bincount(group, new_strip, group[-1] + 1)
            if not new_anchor[0]:
                kinds[0] += 2 if several else 1
            many = kinds > 1
            many[group[often]] = True
            if waiting and (new_anchor[0] or many[0] or group[-1] > 0):
                if not new_anchor[0] and many[0]:
                    yield from (_batch(np.zeros(len(w[0])), *w) for w in waiting)
                waiting = []
            last = group == group[-1]
            emit = ~settled & many[group]
            if not many[-1]:
                held = last & ~settled
                if held.any():
                    waiting.append((anchor[held], strip[held], doc[held], start[held], windows[held]))
            out = settled | emit
            yield _batch(settled[out], np.where(settled, 0, anchor)[out], strip[out], doc[out], start[out], windows[out])
            anchor0, strip0, lead0, several = anchor[-1], strip[-1], first_doc[-1], bool(many[-1])

    return stream_arrow(open_, STRIPS, run)


SPANS = "doc long, low long, high long"


def removed_spans(documents: DataFrame, rule: Rule, verdict: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, int]]], name: str) -> DataFrame:
    """(doc, low, high) in units of the windows that repeat earlier ones. ``verdict`` gets the texts, anchors, documents and starts of open strips, whole anchors at a time, and yields such spans."""
    spark = documents.sparkSession
    n = partitions(spark)
    texts = documents.where("doc_id is not null")
    found = scan(texts, rule, n)
    first = saved(found, f"{name}-strips")
    judged = saved(judge(first, rule, n), f"{name}-judged")
    length = rule.length
    span = lambda f: f.select("doc", F.col("start").alias("low"), (F.col("start") + F.col("windows") + (length - 1)).alias("high"))
    settled = span(first.where("kind = 1")).unionAll(span(judged.where("kind = 1")))

    open_ = judged.where("kind = 0")
    hot = saved(open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), f"{name}-hot")
    crowded = hot.limit(1).count() > 0
    marked = joined(open_, hot, "anchor", "left") if crowded else open_.withColumn("hot", F.lit(None).cast("boolean"))
    wanted = marked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("strips"))
    cut = cut_strips(joined(texts, wanted, texts["doc_id"] == wanted["doc"]).select("doc_id", "text", "strips"), rule)
    sent = ["anchor", "doc", "start", "text"]
    if crowded:
        cut = saved(cut, f"{name}-cut")
        parted, more = part_crowded(cut.where("hot").select(*sent), rule, n, name)
        cut, settled = cut.where("not hot").select(*sent).unionAll(parted), settled.unionAll(span(more))
    dealt = cut.select(*sent).repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "start")
    return settled.unionAll(saved(decide(dealt, rule, verdict), f"{name}-spans"))


#: Different strips of one anchor that are judged together at most. The strips of an anchor with more are parted first, see ``part_crowded``.
HOT = 4096


def part_crowded(strips: DataFrame, rule: Rule, n: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Parts the strips of crowded anchors until each anchor has HOT at most. Returns the strips to judge and those that equal an earlier one.

    What all windows of a strip share, at first the anchor, is its core. A window reaches beyond its core by half of its
    other units on one side at least. So a strip's windows part in two: those that reach so far to the left and the
    others, which reach so far to the right. The cores grow by these units, and the grown core is the new anchor; equal
    windows go the same way. After log2(length - gram) rounds at most the core is the window, and strips of one anchor
    are equal.
    """
    place = F.struct("doc", F.col("start").alias("at"))
    again = place > F.col("first.place") if rule.within else F.col("doc") > F.col("first.place.doc")
    rows, core, open_, settled = strips.withColumn("core", F.lit(-1).cast("long")), rule.gram, [], []
    while core < rule.length:
        side = (rule.length - core + 1) // 2
        halves = saved(part(rows, rule, core, side), f"{name}-halves")
        core += side
        by_doc = halves.groupBy("anchor", "strip", "doc").agg(F.min("start").alias("at"), F.count(F.lit(1)).alias("m"))
        firsts = by_doc.groupBy("anchor", "strip").agg(F.min(F.struct(F.struct("doc", "at").alias("place"), "m")).alias("first"), F.sum("m").alias("copies"))
        left = F.lit(1) if rule.within else F.col("first.m")  # copies that aren't settled
        firsts = saved(firsts.withColumn("left", left), f"{name}-firsts")
        kinds = firsts.groupBy("anchor").agg(F.sum("left").alias("n"), F.count(F.lit(1)).alias("size"))
        groups = of_groups(firsts, kinds, ["anchor"], n).select("anchor", "strip", "first", F.col("copies").alias("size"), "n", (F.col("size") > 1).alias("several"))
        judged = saved(of_groups(halves, groups, ["anchor", "strip"], n).select(*halves.columns, "n", "several", again.alias("again")), f"{name}-parted")
        settled.append(judged.where("again").select("doc", "start", "windows"))
        rest = judged.where("several and not again")
        open_.append(rest.where(F.col("n") <= HOT).select("anchor", "doc", "start", "text"))
        rows = rest.where(F.col("n") > HOT).select("anchor", "doc", "start", "text", "core")
        if not rows.limit(1).count():
            break
    union = lambda frames: reduce(DataFrame.unionAll, frames)
    return union(open_), union(settled)


PARTS = "anchor long, strip long, doc long, start long, windows int, core long, text binary"


def part(strips: DataFrame, rule: Rule, core: int, side: int) -> DataFrame:
    """The two parts of each strip, whose cores are ``side`` units longer. A negative place of the core stands for that of the anchor, its k-gram's first place in the strip."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors, docs, starts, cores = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            for low, high, data, offsets in K.pieces(batch.column(3)):
                u = units(data, offsets, rule)
                anchor, doc, start, at = anchors[low:high], docs[low:high], starts[low:high], cores[low:high]
                if (at < 0).any():
                    row, gram = K.rows_of(u.first), K.gram_hash(u.sums, rule.gram)
                    hit = np.flatnonzero(gram == anchor.view(np.uint64)[row[: len(gram)]])
                    own, where = np.unique(row[hit], return_index=True)
                    at = at.copy()
                    at[own] = hit[where] - u.first[own]
                count = np.diff(u.first) - rule.length + 1
                many = np.clip(at - side + 1, 0, count)
                out = []
                for right in (0, 1):
                    begin, number = (many, count - many) if right else (np.zeros_like(many), many)
                    ok = number > 0
                    b, w, f = begin[ok], number[ok], u.first[:-1][ok]
                    c = at[ok] - (0 if right else side)  # the longer core's place
                    key = K.mix(anchor.view(np.uint64)[ok] + K.U(right)) ^ K.span_hash(u.sums, f + c, f + c + core + side)
                    end = b + w + rule.length - 1
                    x, y = (u.starts[f + b], u.ends[f + end - 1]) if rule.words else (f + b, f + end)
                    strip = K.span_hash(u.sums, f + b, f + end)
                    out.append((key.view(np.int64), strip.view(np.int64), doc[ok], start[ok] + b, w.astype(np.int32), c - b, [bytes(data[i:j]) for i, j in zip(x, y)]))
                columns = [pa.array(np.concatenate(x)) for x in list(zip(*out))[:6]] + [pa.array(out[0][6] + out[1][6], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PARTS.split(", ")])

    return stream_arrow(strips, PARTS, run)


def cut_strips(rows: DataFrame, rule: Rule) -> DataFrame:
    """anchor, doc, start, text of each wanted strip, and whether its anchor is hot."""

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            for low, high, data, offsets in K.pieces(batch.column(1)):
                out = []
                if rule.words:
                    u = units(data, offsets, rule)
                for i in range(high - low):
                    own = wanted[low + i].values
                    anchor, start, windows, hot = (own.field(j).to_numpy(zero_copy_only=False) for j in range(4))
                    end = start + windows + rule.length - 1
                    if rule.words:
                        f = u.first[i]
                        b, e = u.starts[f + start], u.ends[f + end - 1]
                    else:
                        b, e = offsets[i] + start, offsets[i] + end
                    out.append((anchor, np.full(len(anchor), ids[low + i]), start, [bytes(data[x:y]) for x, y in zip(b, e)], hot))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out])), pa.array([t for x in out for t in x[3]], pa.binary()), pa.array(np.concatenate([x[4] for x in out]))], names=["anchor", "doc", "start", "text", "hot"])

    return stream_arrow(rows, "anchor long, doc long, start long, text binary, hot boolean", run)


def paired(sums: np.ndarray, first: np.ndarray, anchor: np.ndarray, rule: Rule) -> np.ndarray:
    """Which strips may share a window with another one of their anchor; ``sums`` and ``first`` are those of the strips' units.

    A window reaches beyond its anchor by half of its other units on one side at least, so strips that share one agree
    on so many units before, or after, the anchor. The anchor is its k-gram's first place in the strip.
    """
    n, side = len(first) - 1, (rule.length - rule.gram + 1) // 2
    row = K.rows_of(first)
    gram = K.gram_hash(sums, rule.gram)
    hit = np.flatnonzero(gram == anchor.view(np.uint64)[row[: len(gram)]])
    own, at = np.unique(row[hit], return_index=True)
    at = hit[at]
    may = np.ones(n, bool)
    may[own] = False
    for low, high in ((at - side, at), (at + rule.gram, at + rule.gram + side)):
        there = (low >= first[own]) & (high <= first[own + 1])
        key = K.span_hash(sums, low[there], high[there]) ^ K.mix(anchor[own[there]].view(np.uint64))
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        may[own[there][times[where] > 1]] = True
    return may


#: Bytes of strips that are judged together at about; one anchor's strips are never parted.
GROUP = 1 << 19


def decide(sent: DataFrame, rule: Rule, verdict) -> DataFrame:
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(t: pa.Table):
            spans = list(verdict(t["text"].to_pylist(), *(t[c].to_numpy() for c in ("anchor", "doc", "start"))))
            if spans:
                doc, low, high = (np.concatenate(x) for x in zip(*spans))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low), pa.array(high)], names=["doc", "low", "high"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                size += part.column(3).nbytes
                if size < GROUP:
                    continue
                t = pa.Table.from_batches(held)
                anchor = t["anchor"].to_numpy()
                edge = int(np.searchsorted(anchor == anchor[-1], True)) if anchor[0] != anchor[-1] else 0
                if edge:
                    yield from flush(t.slice(0, edge))
                    held = t.slice(edge).combine_chunks().to_batches()
                    size = sum(b.column(3).nbytes for b in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return stream_arrow(sent, SPANS, run)


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n units are in a span."""
    edge = np.bincount(low, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(high, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the array of the document's spans (null if it has none)."""
    gathered = spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return joined(documents, gathered, documents["doc_id"] == gathered["doc"], "left").select("doc_id", "text", "spans")
