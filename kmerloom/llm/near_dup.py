"""MinHash near-duplicates with b-bit signatures.

Each text's set of word shingles gives 128 minima. Bands of six minima propose pairs; only the low four bits of each
minimum are kept, packed, and their agreement (corrected for chance) estimates the similarity of a proposed pair. Pairs
that may reach the threshold are confirmed on the full sets.

Equal sets are one class, so copies are never paired. In a bucket every class is first paired with the least one, in two
levels, which links large groups by stars. Buckets that still hold several components are then dealt to cells of bounded
size, with signatures only. A cell with few pairs of different components that may reach the threshold leaves these pairs,
which are confirmed once, whatever number of buckets they share. Of a cell with many, the documents' texts are sent:
those that share one of their rarest shingles (the prefix that two similar sets must share) are compared on their full
sets, unless links found meanwhile join them, and only links leave. So no group is ever expanded into all its pairs, and
no link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import components
from . import kernels as K
from .common import clean_texts, joined, map_arrow, of_groups, partitions, saved, stream_arrow

WORDS = 5
MINIMA, BITS, BANDS, ROWS = 128, 4, 48, 6
#: Estimates below the threshold by up to so many of the estimate's standard deviations are still confirmed on the full sets.
DEVIATIONS = 5.0

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SUBSETS = np.array([_rng.choice(MINIMA, ROWS, replace=False) for _ in range(BANDS)])


def least_estimate(percent: int) -> float:
    """Pairs with a lower estimate can't reach the threshold, but for one in some millions."""
    share, chance = percent / 100, 1 / (1 << BITS)
    agree = share + (1 - share) * chance
    return share - DEVIATIONS * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes, sorted and distinct within each row, and each row's bounds.

    Letters A-Z are lower-cased. A row with fewer words than a shingle has them all as its one shingle; one without has none.
    """
    plain = K.LOWER[data]
    starts, ends, first = K.words(plain, offsets)
    sums = K.prefix(K.span_hash(K.byte_prefix(plain), starts, ends))
    count = np.diff(first)
    many = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), many)
    low = np.arange(many.sum()) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
    h = K.span_hash(sums, low, low + np.minimum(count, words)[row])
    order = np.argsort(h)
    order = order[np.argsort(row.astype(np.uint16)[order], kind="stable")]  # pieces have at most 65,535 rows: a radix sort
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(count) + 1))


def minima(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of each row's set under each hash; no row may be empty."""
    x = (keys >> K.U(32)).astype(np.uint32)
    out = np.empty((len(starts), MINIMA), np.uint32)
    for j, factor in enumerate(FACTORS):
        out[:, j] = np.minimum.reduceat(x * factor, starts)
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 16 to a long."""
    low = (values & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(values), MINIMA * BITS // 64, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * K.U(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = K.mix(key * K.U(0x9E3779B97F4A7C15) + values[:, SUBSETS[:, j]])
    return key


SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>"


def signatures(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """Size, fingerprint (two sums over the set), packed signature and band keys of each row; rows with an empty set have no bands."""

    def run(batch: pa.RecordBatch):
        for low, high, data, offsets in K.pieces(batch.column(1)):
            keys, bounds = shingle_sets(data, offsets, words)
            size = np.diff(bounds)
            used = np.flatnonzero(size)
            f1, f2 = (K.row_sums(K.mix(keys ^ K.U(salt)).view(np.int64), bounds) for salt in (0x1234567, 0x89ABCDEF01))
            m = minima(keys, bounds[used]) if len(used) else np.zeros((0, MINIMA), np.uint32)

            def lists(values: np.ndarray, width: int) -> pa.Array:
                ends = np.zeros(high - low + 1, np.int32)
                ends[used + 1] = width
                return pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(values.view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size.astype(np.int64)), pa.array(f1), pa.array(f2), lists(packed(m), MINIMA * BITS // 64), lists(band_keys(m), BANDS)], names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"])

    return map_arrow(clean_texts(documents), SIGNATURES, run)


def similarity(a: Column, b: Column) -> Column:
    """Collision-corrected estimate of the similarity from two packed signatures: unequal lanes are counted by bits."""

    def unequal(x: Column) -> Column:
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _similarities(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    x = sigs ^ one
    x = x | (x >> K.U(1))
    x = x | (x >> K.U(2))
    differ = np.bitwise_count(x & K.U(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


#: Bucket entries that are sorted together where they are read.
CHUNK = 1 << 20


def _leaders(rows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (band, doc), sorted, and for each the least document of its band among them."""
    band, doc = rows
    order = np.lexsort((doc, band))
    band, doc = band[order], doc[order]
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    return band, doc, doc[np.maximum.accumulate(np.where(first, np.arange(len(band)), 0))]


def stars(reps: DataFrame, n: int) -> DataFrame:
    """(a, b): links of each bucket's documents to its least one, by two levels of stars.

    Of a chunk's documents with one band, the least goes to the band's task, and the others are paired with it at once:
    a band's task gets a row for each chunk at most, however many documents share the band.
    """

    def spread(batches):
        held, size = [], 0

        def flush():
            band, doc, least = _leaders(tuple(np.concatenate(x) for x in zip(*held)))
            pair = doc != least
            fresh = np.concatenate(([True], (band[1:] != band[:-1]) | (doc[1:] != doc[:-1])))
            both = np.unique(np.column_stack((least[pair], doc[pair])), axis=0)
            key, of, other = (np.concatenate(x) for x in ((band[~pair & fresh], both[:, 0]), (doc[~pair & fresh], both[:, 0]), (doc[~pair & fresh], both[:, 1])))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(other)], names=["key", "a", "b"])

        for batch in batches:
            bands = batch.column(1)
            width = np.diff(bands.offsets.to_numpy())
            held.append((bands.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), width)))
            size += int(width.sum())
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def run(batches):
        band, least = None, None
        for batch in batches:
            key, a, b = (batch.column(i).to_numpy() for i in range(3))
            paired = a != b
            if paired.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[paired]), pa.array(b[paired])], names=["a", "b"])
            bands, docs = key[~paired], a[~paired]
            if not len(bands):
                continue
            first = np.ones(len(bands), bool)
            first[1:] = bands[1:] != bands[:-1]
            first[0] = band is None or bands[0] != band
            at = np.maximum.accumulate(np.where(first, np.arange(len(bands)), -1))
            to = np.where(at >= 0, docs[np.maximum(at, 0)], least if least is not None else 0)
            band, least = bands[-1], to[-1]
            keep = to != docs
            pair = np.unique(np.column_stack((to[keep], docs[keep])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    entries = stream_arrow(reps.select("doc", "bands"), "key long, a long, b long", spread)
    dealt = entries.repartition(n, F.when(F.col("a") == F.col("b"), F.col("key")).otherwise(F.xxhash64("b"))).sortWithinPartitions("key", "a", "b")
    return stream_arrow(dealt, "a long, b long", run).distinct()


class Forest:
    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(labels.tolist())]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def links_within(component: np.ndarray, sig: np.ndarray, keys: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose links join the components as all links among the rows would.

    Sets with 100 * intersection >= percent * union share one of their n - ceil(percent * n / 100) + 1 rarest shingles.
    """
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    _, kind, times = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((kind, times[kind], row))
    turn = np.arange(len(row)) - bounds[row]
    head = turn < (size - (percent * size + 99) // 100 + 1)[row]
    token, owner = kind[order][head], row[head]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    cuts = np.append(np.flatnonzero(np.diff(token, prepend=-1)), len(token))
    forest, least, tested, out = Forest(component), least_estimate(percent), set(), []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low < 2:
            continue
        docs = owner[low:high]
        roots = np.array([forest.root(i) for i in docs.tolist()])
        if (roots == roots[0]).all():
            continue
        kinds, where, count = np.unique(roots, return_inverse=True, return_counts=True)
        main = kinds[count.argmax()]
        for i in docs[roots != main].tolist():
            own = forest.root(i)
            good = docs[(_similarities(sig[docs], sig[i]) >= least) & (100 * np.minimum(size[docs], size[i]) >= percent * np.maximum(size[docs], size[i]))]
            for j in good.tolist():
                pair = (i, j) if i < j else (j, i)
                if pair in tested or forest.root(j) == own:
                    continue
                tested.add(pair)
                both = np.concatenate((keys[bounds[i] : bounds[i + 1]], keys[bounds[j] : bounds[j + 1]]))
                both.sort()
                inner = int((both[1:] == both[:-1]).sum())
                if 100 * inner >= percent * (len(both) - inner):
                    forest.join(i, j)
                    own = forest.root(i)
                    out.append(pair)
    return out


def of_cells(dealt: DataFrame, schema: str, judge: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Runs ``judge`` on each cell (band, kind, x, y), whole: cells are bounded however large a bucket is (see ``cells``)."""

    def run(batches):
        held, cell = [], None
        for batch in batches:
            at = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high == low:
                    continue
                if held and tuple(at[low]) != cell:
                    yield from judge(pa.Table.from_batches(held).combine_chunks())
                    held = []
                cell = tuple(at[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield from judge(pa.Table.from_batches(held).combine_chunks())

    return stream_arrow(dealt, schema, run)


CELL = ["band", "kind", "x", "y"]


def _signatures_of(t: pa.Table) -> np.ndarray:
    return t["sig"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).view(np.uint64)


#: Cells with at most so many plausible pairs a row leave the pairs themselves.
SPARSE = 4


def plausible(rows: DataFrame, percent: int, n: int) -> DataFrame:
    """What may, by signatures and sizes, be linked between the components of a cell: the pairs (doc, other) of a cell with few, else the cell's rows (other is null), whose texts are then compared inside the cell."""
    names = [*CELL, "doc", "component"]
    least = least_estimate(percent)

    def judge(t: pa.Table):
        component, size = t["component"].to_numpy(), t["n_shingles"].to_numpy()
        if (component == component[0]).all():
            return
        sig, may, pairs, number = _signatures_of(t), np.zeros(t.num_rows, bool), [], 0
        for low in range(0, t.num_rows, 64):
            own = slice(low, low + 64)
            pair = component[own, None] != component
            pair &= 100 * np.minimum(size[own, None], size) >= percent * np.maximum(size[own, None], size)
            i, j = np.nonzero(pair)
            good = _similarities(sig[low + i], sig[j]) >= least
            i, j = low + i[good], j[good]
            may[i] = True
            number += int((i < j).sum())
            if number <= SPARSE * t.num_rows:
                pairs.append((i[i < j], j[i < j]))
        if not number:
            return
        if number <= SPARSE * t.num_rows:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            doc = t["doc"].to_numpy()
            out = t.select(names).take(pa.array(i)).append_column("other", pa.array(np.maximum(doc[i], doc[j])))
            yield from out.set_column(names.index("doc"), "doc", pa.array(np.minimum(doc[i], doc[j]))).combine_chunks().to_batches()
        else:
            yield from t.select(names).append_column("other", pa.nulls(t.num_rows, pa.int64())).filter(pa.array(may)).combine_chunks().to_batches()

    dealt = rows.repartition(n, *CELL).sortWithinPartitions(*CELL)
    return of_cells(dealt.select(*names, "sig", "n_shingles"), "band long, kind long, x long, y long, doc long, component long, other long", judge)


def crossing(rows: DataFrame, percent: int, words: int, n: int) -> DataFrame:
    """Confirmed links (a, b) between components, from the plausible rows of cells and their texts."""

    def judge(t: pa.Table):
        component, doc = t["component"].to_numpy(), t["doc"].to_numpy()
        keys, bounds = [], [np.zeros(1, np.int64)]
        for _, _, data, offsets in K.pieces(t["text"].combine_chunks()):
            k, b = shingle_sets(data, offsets, words)
            keys.append(k)
            bounds.append(b[1:] + bounds[-1][-1])
        found = links_within(component, _signatures_of(t), np.concatenate(keys), np.concatenate(bounds), percent)
        if found:
            pair = np.sort(doc[np.array(found)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    dealt = rows.repartition(n, *CELL).sortWithinPartitions(*CELL)
    return of_cells(dealt.select(*CELL, "doc", "component", "sig", "text"), "a long, b long", judge).distinct()


#: Documents of one side of a cell at about.
BLOCK = 512


def cells(spread: DataFrame) -> DataFrame:
    """Rows (band, doc, component) of the buckets that hold several components, dealt to cells (kind, x, y).

    Documents of a bucket's largest component and all others are cut into blocks by hash. Cells of kind 0 join a block
    of others with a block of the largest component, cells of kind 1 two blocks of others. Two documents of the largest
    component need not meet.
    """
    sizes = spread.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = mixed.select("band", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("nv"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("nu"))
    rows = joined(spread, blocks, "band")
    own = lambda c: F.pmod(F.xxhash64("doc"), F.col(c))
    cell = lambda kind, x, y: F.struct(F.lit(kind).cast("long").alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    of_main = F.transform(upto("nu"), lambda u: cell(0, u, own("nv")))
    pairs = F.transform(F.filter(upto("nu"), lambda u: u != own("nu")), lambda u: cell(1, F.least(u, own("nu")), F.greatest(u, own("nu"))))
    of_other = F.concat(F.transform(upto("nv"), lambda v: cell(0, own("nu"), v)), pairs)
    return rows.select("band", "doc", "component", F.explode(F.when(F.col("component") == F.col("main"), of_main).otherwise(of_other)).alias("c")).select("band", "doc", "component", "c.*")


#: Pairs of one document that are confirmed in one group at about; documents with more partners are dealt over several groups.
GROUP = 64


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int, n: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets.

    The text of a is sent once to each of its groups, the text of each b once to its own; sets are made where they meet.
    """
    groups = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    dealt = of_groups(pairs, groups, ["a"], n).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / GROUP)).alias("g"))
    needs = dealt.select("a", "g").distinct().select(F.col("a").alias("doc_id"), "a", "g", F.lit(0).alias("role")).unionAll(dealt.select(F.col("b").alias("doc_id"), "a", "g", F.lit(1).alias("role")))
    rows = joined(texts, needs, "doc_id").select("a", "g", "role", "doc_id", "text")
    rows = rows.repartition(n, "a", "g").sortWithinPartitions("a", "g", "role")

    def run(batches):
        own, own_set = None, None
        for batch in batches:
            a, role, doc = (batch.column(i).to_numpy() for i in (0, 2, 3))
            found = []
            for low, high, data, offsets in K.pieces(batch.column(4)):
                keys, bounds = shingle_sets(data, offsets, words)
                for i in range(high - low):
                    k = keys[bounds[i] : bounds[i + 1]]
                    if role[low + i] == 0:
                        own, own_set = a[low + i], k.copy()
                    elif own == a[low + i]:
                        both = np.concatenate((own_set, k))
                        both.sort()
                        inner = int((both[1:] == both[:-1]).sum())
                        if 100 * inner >= percent * (len(both) - inner):
                            found.append((own, doc[low + i]))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return stream_arrow(rows, "a long, b long", run).distinct()


def merged(label: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """Labels after more links: only the components that these join are looked at again. A node without a label is a component of its own. No task gathers a component's labels."""
    for end in ("a", "b"):
        own = label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        more = joined(more, own, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    over = components(more).select(F.col("node").alias("m"), F.col("component").alias("over"))
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    groups = joined(sizes, over, sizes["component"] == over["m"], "left").select("component", "size", F.coalesce("over", "component").alias("over"))
    own = of_groups(label, groups, ["component"], n).select("node", F.col("over").alias("component"))
    new = joined(over, sizes.select(F.col("component").alias("m")), "m", "left_anti").select(F.col("m").alias("node"), F.col("over").alias("component"))
    return own.unionAll(new)


RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"


def near_duplicates(documents: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (least doc_id reachable by links), and kept (doc_id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Null and empty texts have an
    empty set and are linked with nothing. A row without id is never linked: its component is null and it is kept.
    Rows that share an id are judged each, in the id's name: a text that another document has, too, gets that one's
    component. An empty table gives no rows.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    texts = clean_texts(documents)
    table = saved(signatures(documents, words), "near-signatures")
    full = table.where("n_shingles > 0 and doc_id is not null")
    same = ["f1", "f2", "n_shingles"]
    classes = saved(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "near-classes")
    reps = joined(full, classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("doc"), "n_shingles", "sig", "bands")

    proposed = saved(stars(reps, n), "near-stars")
    in_play = proposed.select(F.col("a").alias("doc_id")).unionAll(proposed.select(F.col("b").alias("doc_id"))).distinct()
    signs = saved(joined(reps, in_play, reps["doc"] == in_play["doc_id"], "left_semi"), "near-in-play")
    kept_texts = saved(joined(texts, in_play, "doc_id", "left_semi"), "near-texts")

    sa, sb = signs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), signs.select(F.col("doc").alias("b"), F.col("sig").alias("sb"))
    alike = joined(joined(proposed, sa, "a"), sb, "b").where(similarity(F.col("sa"), F.col("sb")) >= least_estimate(percent)).select("a", "b").distinct()
    links = saved(confirm(saved(alike, "near-alike"), kept_texts, percent, words, n), "near-confirmed")
    label = components(links)

    named = joined(signs, label, signs["doc"] == label["node"], "left").select("doc", F.coalesce("component", "doc").alias("component"), "n_shingles", "sig", "bands")
    dealt = cells(named.select("doc", "component", F.explode("bands").alias("band")))
    likely = saved(plausible(joined(dealt, signs.select("doc", "n_shingles", "sig"), "doc"), percent, n), "near-likely")
    few = saved(likely.where("other is not null").select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct(), "near-few")
    rows = joined(likely.where("other is null").drop("other"), joined(signs.select("doc", "sig"), kept_texts.withColumnRenamed("doc_id", "doc"), "doc"), "doc")
    more = saved(confirm(few, kept_texts, percent, words, n).unionAll(crossing(rows, percent, words, n)), "near-confirmed")
    if more.limit(1).count():
        label = saved(merged(label, more, n), "near-labels")

    several = joined(classes.where("size > 1"), label, F.col("rep") == F.col("node"), "left").select(*same, "size", F.coalesce("component", "rep").alias("of_class"))
    copies = of_groups(full.select("doc_id", *same), several, same, n).select("doc_id", *same, "of_class").distinct()
    alone = label.select(F.col("node").alias("id"), "component")
    out = joined(joined(table.select("doc_id", *same), copies, ["doc_id", *same], "left"), alone, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("of_class", "component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_duplicates(documents: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """The rows of the documents that are kept (by one of their rows, if several share the id), with all their columns."""
    kept = near_duplicates(documents, percent, words).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = kept.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return joined(documents, gone, documents["doc_id"] == gone["__gone"], "left_anti")
