"""Golden vectors and properties of the column functions."""

import random
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import arrow, dna, hashes
from kmerloom.operators import align, sketches, variants


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_golden(spark):
    lit = F.lit
    assert one(spark, dna.reverse_complement(lit("GTCA")), dna.forward(lit("ACGT"), "T"), dna.backward(lit("ACGT"), "T"), dna.canonical(lit("TTTT"))) == ("TGAC", "CGTT", "TACG", "AAAA")
    assert one(spark, dna.links(lit("ACG")))[0] == ["CGA", "CGC", "CGG", "CGT", "AAC", "CAC", "GAC", "TAC"]
    assert one(spark, dna.pack(lit("ACGT")), dna.unpack(lit(27), 4), dna.bits(lit(5))) == (27, "ACGT", "0" * 61 + "101")
    assert one(spark, dna.minimizer(lit("TACGAAA"), 7, 3), dna.minimizer(lit("TACGAAA"), 7, 3, True)) == ("ACG", "AAA")
    assert one(spark, dna.fold(lit("A" * 120)))[0] == "A" * 50 + "\n" + "A" * 50 + "\n" + "A" * 20 + "\n"
    assert one(spark, dna.packed_bytes(lit(17)), dna.same_but_last(lit("ACGA"), lit("ACGT"))) == (5, True)
    assert one(spark, dna.translate_frame(lit("ATGGCCTAANNN"), 0))[0] == "MA*X"


def test_masking(spark):
    assert one(spark, dna.mask_ambiguous(F.lit("ACRYN-U")), dna.count_ambiguous(F.lit("ACRYN-U"))) == ("ACNNNNU", 3)
    with pytest.raises(Exception, match="invalid base"):
        one(spark, dna.mask_ambiguous(F.lit("ACX")))


@pytest.mark.parametrize(
    "line,name,base,end,index",
    [
        ("@n/1", "@n/1", "@n", 1, 3), ("@name/2 comment", "@name/2", "@name", 2, 6), ("@name 1:N:0:ACGT", "@name/1", "@name", 1, 6),
        ("@name 2:Y:0:", "@name/2", "@name", 2, 6), ("@name other", "@name", "@name", 0, 0), ("@name", "@name", "@name", 0, 0),
    ],
)
def test_pairs(spark, line, name, base, end, index):
    paired = dna.pair_name(F.lit(line))
    assert one(spark, paired, dna.pair_base(paired), dna.pair_end(paired), dna.pair_index(F.lit(line))) == (name, base, end, index)


def test_compact_id(spark):
    assert one(spark, dna.compact_id(F.lit("@x/2"), F.lit(3), F.lit(255)))[0] == "@03ff/2"


def test_extension_codes(spark):
    left = variants.best_extension(dict(zip("ACGT", map(F.lit, (2, 0, 10, 0)))))
    right = variants.best_extension(dict(zip("ACGT", map(F.lit, (3, 14, 0, 0)))))
    assert one(spark, variants.extended_code(left, right))[0] == "G[2,10]C[3,14]"
    for dmin, want in ((2, "FF"), (3, "GF"), (10, "GC"), (14, "XC"), (15, "XX")):
        assert one(spark, F.concat(variants.code(left, dmin), variants.code(right, dmin)))[0] == want


def test_hashes():
    assert hashes.murmur3_x64_128(b"", 0) == (0, 0)
    assert hashes.murmur3_x64_128(b"The quick brown fox jumps over the lazy dog", 0) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    assert hashes._fmix64(1) == int(hashes.fmix64(__import__("numpy").array([1]))[0]) == 0xB456BCFC34C2CB2C
    assert hashes.x31(b"ab") == 97 * 31 + 98


def test_bloom_shape():
    for entries, error in ((0, 0.1), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            sketches.bloom_shape(entries, error)
    assert sketches.bloom_shape(1000, 0.01)[1] == 7


def test_edit_modes():
    assert align.semiglobal("AACT", "AACTGGC", "prefix") == (0, 0, 3)
    assert align.semiglobal("ACT", "CGACTGAC", "infix") == (0, 2, 4)
    assert align.semiglobal("AAAA", "TTTT", "global", 2) == (-1, None, None)
    assert align.path("ACGT", "AGT") == (1, "1M1I2M") and align.path("ACGT", "ACTT", True) == (1, "2=1X1=")


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row2 = [i]
        for j, y in enumerate(b, 1):
            row2.append(min(row[j] + 1, row2[-1] + 1, row[j - 1] + (x != y)))
        row = row2
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=16))
def test_edit_properties(q, t):
    g, p, i = (align.semiglobal(q, t, m)[0] for m in ("global", "prefix", "infix"))
    assert g == plain(q, t) == align.path(q, t)[0]
    assert i <= p <= g
    assert p == min(plain(q, t[:e]) for e in range(len(t) + 1))
    assert i == min(plain(q, t[s:e]) for s in range(len(t) + 1) for e in range(s, len(t) + 1))


def test_extend_reaches_the_end():
    import numpy as np

    a = np.frombuffer(b"ACGTACGTTTGACCA" * 5, np.uint8)
    b = np.delete(a, 30)
    (score, x, y), (s2, *_), (s3, *_) = align.extend([(a, b), (a, a), (a[:0], a)])
    assert (x, y) == (len(a), len(b)) and score == len(b) - 1 and s2 == len(a) and s3 == 0


@settings(max_examples=300, deadline=None)
@example(["AAA"], 9)
@example(["A" * 31], 31)
@given(st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=6), st.integers(1, 31))
def test_packed_windows(rows, k):
    import numpy as np
    import pyarrow as pa

    data, offsets = arrow.utf8(pa.array(rows, pa.string()))
    code = arrow.CODE[data]
    at = arrow.valid_starts(code, offsets, k)
    got = arrow.letters(arrow.packed_windows(code, k)[at], k).to_pylist()
    want = [r[i : i + k] for r in rows for i in range(len(r) - k + 1) if "N" not in r[i : i + k]]
    assert got == want and np.all(at >= 0)


def test_paths_in_halves_and_modes(monkeypatch):
    """Small tables only, so that queries are halved: the path is still a best one, and spells both texts."""
    rng = random.Random(12)
    for cells in (1 << 20, 40):
        monkeypatch.setattr(align, "CELLS", cells)
        for _ in range(60):
            q, t = ("".join(rng.choice("ACé") for _ in range(rng.randrange(0, 25))) for _ in range(2))
            for mode in align.MODES:
                want, start, end = align.semiglobal(q, t, mode)
                got, cigar = align.path(q, t, True, mode)
                assert got == want
                i, j = 0, start
                for n, x in re.findall(r"(\d+)([=XID])", cigar):
                    for _ in range(int(n)):
                        assert x in "ID" or (q[i] == t[j]) == (x == "=")
                        i, j = i + (x != "D"), j + (x != "I")
                assert (i, j) == (len(q), end + 1)


def test_banded_and_local():
    rng = random.Random(13)
    for _ in range(80):
        q, t = ("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 20))) for _ in range(2))
        whole = align.semiglobal(q, t, "global")[0]
        assert align.banded_distance(q, t, 20) == whole
        for width in (0, 2, 5):
            got = align.banded_distance(q, t, width)
            assert got >= whole if abs(len(q) - len(t)) <= width else got == -1
            assert got == whole or whole > width
        score, a, b, c, d = align.local_align(q, t)
        table = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                table[i][j] = max(0, table[i - 1][j] - 1, table[i][j - 1] - 1, table[i - 1][j - 1] + (1 if q[i - 1] == t[j - 1] else -1))
        assert score == max(map(max, table))
        inner = align.local_align(q[a:b], t[c:d])
        assert inner[0] == score and (score == 0 or inner[1:] == (0, b - a, 0, d - c))
