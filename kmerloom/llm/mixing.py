"""Mixing sources to target weights by the cube method (balanced sampling).

Each document is taken floor(r) times, plus once more with probability r - floor(r), where r is its source's target over
its source's size. The fractional parts are settled by the flight phase of the cube method: move the inclusion
probabilities of a few documents along a direction in the null space of the constraints (words and documents stay as
they are) until one of them is 0 or 1, and so on. Flights run in many bounded groups at once; what each group leaves
(two documents at most) flies again in fewer groups, until a small landing problem remains in each source.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow, of_groups, partitions, saved, stream_arrow

CAP = 3.0
#: Documents of one flight group at about; a source's documents are drawn into as many groups by hash.
GROUP = 1_000


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and number of words of each row (null and empty texts: 0)."""

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(np.diff(K.words(data, offsets)[2]))], names=["doc_id", "source", "size"])

    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return map_arrow(frame, "doc_id long, source string, size long", run)


def flight(ids: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Flight phase over one group, in the given order: keeps sum(p * size) and sum(p) while it settles all but two documents at most.

    Three documents have a direction that changes neither total: (s2 - s3, s3 - s1, s1 - s2). Steps go either way with
    the probabilities that keep each document's expectation, drawn from the document's id, so reruns agree.
    """
    p = p.copy()
    draw = (K.mix(ids.astype(np.int64).view(np.uint64) ^ K.U(0x5DEECE66D)) >> K.U(11)).astype(np.float64) / 2.0**53
    live: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / d if d > 0 else -p[k] / d) for k, d in zip(live, u) if d)
        down = min((p[k] / d if d > 0 else (p[k] - 1) / d) for k, d in zip(live, u) if d)
        step = up if draw[i] * (up + down) < down else -down
        for k, d in zip(live, u):
            p[k] += step * d
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        live = [k for k in live if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The few documents left of a source: the choice whose words come nearest to the expected ones, then whose number does."""
    if len(p) > 12:
        raise ValueError("landing is for a few documents")
    want, number = float((size * p).sum()), float(p.sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(p)), key=lambda c: (abs(float(np.dot(c, size)) - want), abs(sum(c) - number), c))
    return np.array(best)


_FLIGHT = "doc_id long, source string, size long, source_size long, target double, whole long, p double, draw long, groups long"


def _fly(frame: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Sorts each group's rows by their draw and settles them; the group's rows are read as a stream, flown block by block."""
    names = [x.split()[0] for x in _FLIGHT.split(", ")]

    def run(batches):
        held, key = [], None

        def settle(end: bool):
            nonlocal held
            t = pa.Table.from_batches(held)
            ids, size, p = (t[c].to_numpy() for c in ("doc_id", "size", "p"))
            p = flight(np.where(np.isnan(ids.astype(float)), 0, ids) if ids.dtype.kind == "f" else ids, size, p)
            left = np.flatnonzero((p > 0) & (p < 1))
            if end and last:
                p[left] = landing(size[left], p[left])
                left = left[:0]
            t = t.set_column(t.schema.get_field_index("p"), t.schema.field("p"), pa.array(p))  # the field as it was: what is held joins later batches of its group
            held = [] if end else t.take(pa.array(left)).to_batches()
            if not end:
                mask = np.ones(len(p), bool)
                mask[left] = False
                t = t.filter(pa.array(mask))
            return t.select(names).to_batches()

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            change = np.zeros(rows, bool)
            for c in columns:
                code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(change), rows]
            for low, high in itertools.pairwise(cuts):
                own = tuple(c[low].as_py() for c in columns)
                if held and own != key:
                    yield from settle(True)
                key = own
                held.append(batch.slice(low, high - low))
            if held and sum(b.num_rows for b in held) > GROUP:
                yield from settle(False)
        if held:
            yield from settle(True)

    return stream_arrow(frame, _FLIGHT, run)


def source_table(sized: DataFrame, cap: float = CAP) -> DataFrame:
    """none, key (whether the source is null, and its name or ""), size (its rows), source_size, target and rate of each source.

    Weights 1, 2, 3, repeating, by code point (null last), share all words; a target stops at cap times its source's size, and the excess is shared anew by weight.

    Sources are ranked by range partitions and their counts, and the excess is shared anew by sums over the table, so that
    the driver sees a row a partition and a few numbers, however many sources there are. Sums are of whole numbers: reruns agree.
    """
    spark = sized.sparkSession
    totals = sized.groupBy(F.isnull("source").alias("none"), F.coalesce("source", F.lit("")).alias("key")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("size"))
    ordered = totals.repartitionByRange(partitions(spark), "none", "key").sortWithinPartitions("none", "key")
    placed = saved(ordered.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "mix-order")
    shift, before = [], 0
    for r in sorted(placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m")).collect()):
        shift.append((r["p"], before - r["m"]))
        before += r["n"]
    ranked = placed.join(F.broadcast(spark.createDataFrame(shift, "p int, shift long")), "p")
    table = saved(ranked.select("none", "key", "size", "source_size", (1 + (F.col("m") + F.col("shift")) % 3).alias("w")), "mix-sources")
    sums = table.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    total, rest, weights, known = sums["total"] or 0, float(sums["total"] or 0), sums["w"] or 1, 0
    while True:
        above = F.lit(rest) * F.col("w") / weights > cap * F.col("source_size")
        found = table.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("s"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if found["n"] == known or not found["w"]:
            break
        known, rest, weights = found["n"], total - cap * found["s"], found["w"]
    target = F.when(above, cap * F.col("source_size")).otherwise(F.lit(rest) * F.col("w") / weights)
    return table.select("none", "key", "size", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix_sources(documents: DataFrame, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's) and taken (words the mix takes, repeats counted), one row per input row.

    taken / size is a whole number from 0 to cap. Rows without words are never taken. Repeated rows and ids count as
    documents of their own; a null id is a document, too. An empty table gives no rows. Reruns agree: draws depend on
    ids and sizes only.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    sized = saved(sizes(documents), "mix-sizes")
    table = saved(source_table(sized, cap), "mix-targets")
    rate = F.when(F.col("words") > 0, F.col("rate")).otherwise(0.0)
    whole = F.least(F.floor(rate + 1e-12), F.lit(int(cap)))
    rows = sized.select("doc_id", "source", F.col("size").alias("words"), F.isnull("source").alias("none"), F.coalesce("source", F.lit("")).alias("key"))
    frame = of_groups(rows, table, ["none", "key"], n).select(
        "doc_id", "source", F.col("words").alias("size"), "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"),
        F.xxhash64(F.lit(7), F.coalesce("doc_id", F.lit(0)), "words").alias("draw"), F.ceil(F.col("size") / GROUP).alias("groups"),
    )
    most = table.agg(F.max("size").alias("n")).first()["n"] or 0
    most = -(-most // GROUP)  # groups of the largest source
    settled = []
    while True:
        # each round deals a source's documents over fewer groups; in the last, a source is one group of what few are left
        last = most <= 1
        dealt = frame.withColumn("g", F.pmod(F.col("draw"), F.greatest(F.lit(1), F.col("groups"))))
        dealt = dealt.repartition(n, "g", "source").sortWithinPartitions("g", "source", "draw", "doc_id", "size")
        flown = saved(_fly(dealt, ["g", "source"], last), "mix-flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(flown.where(~open_))
        if last:
            break
        frame, most = flown.where(open_).withColumn("groups", F.ceil(2 * F.col("groups") / GROUP)), -(-2 * most // GROUP)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.round("p").cast("long"))).alias("taken"))


def mix_documents(documents: DataFrame, cap: float = CAP) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with all their columns. Copies are equal rows.

    Ids tie a row to its number of copies; rows that share an id (or have none) share the largest number among them.
    """
    taken = mix_sources(documents, cap).where("taken > 0").groupBy("doc_id").agg(F.max(F.expr("taken div size")).cast("int").alias("__copies"))
    joined = documents.alias("d").join(taken.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    repeated = joined.select("d.*", F.explode(F.sequence(F.lit(1), F.col("m.__copies"))).alias("__copy"))
    return repeated.drop("__copy")
