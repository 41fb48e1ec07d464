"""Column functions on DNA sequences and read names. All are built-in expressions: no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMBIGUOUS = "RYKMSWBDHV-"  # IUPAC codes that mean more than one base


def text_to_dna(text: Column) -> Column:
    """Deterministic projection of prose to DNA: letters only, mapped to A, C, G, T and (j, q, x, z) N."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTANCGTACGNTACGTANCN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def forward(kmer: Column, base: Column | str) -> Column:
    """Shifts one base out on the left and ``base`` in on the right."""
    return F.concat(F.substring(kmer, 2, 2**30), F.lit(base) if isinstance(base, str) else base)


def backward(kmer: Column, base: Column | str) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) else base, F.left(kmer, F.length(kmer) - 1))


def links(kmer: Column) -> Column:
    """The eight neighbours: forward by A, C, G, T, then backward by A, C, G, T."""
    return F.array(*(forward(kmer, b) for b in "ACGT"), *(backward(kmer, b) for b in "ACGT"))


def same_but_last(a: Column, b: Column) -> Column:
    return F.left(a, F.length(a) - 1) == F.left(b, F.length(b) - 1)


def pack(kmer: Column) -> Column:
    """2 bits a base, right-aligned; k up to 31 (a long is signed)."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def bits(packed: Column) -> Column:
    return F.lpad(F.bin(packed), 64, "0")


def gpu_order(kmer: Column) -> Column:
    """Letters whose order is that of the alternative code C, A, T, G."""
    return F.translate(kmer, "ACGT", "BADC")


def minimizer(kmer: Column, k: int, m: int, inclusive: bool = False) -> Column:
    """Least m-mer of a k-mer; the last start counts only if ``inclusive``."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - m + inclusive)), lambda i: F.substr(kmer, i, F.lit(m))))


def packed_bytes(length: Column) -> Column:
    return F.floor((length + 3) / 4).cast("long")


def is_acgt(seq: Column, with_n: bool = False) -> Column:
    return seq.rlike("^[ACGTN]+$" if with_n else "^[ACGT]+$")


def count_ambiguous(seq: Column) -> Column:
    return F.regexp_count(F.upper(seq), F.lit(f"[{AMBIGUOUS}]"))


def mask_ambiguous(seq: Column) -> Column:
    """IUPAC codes to N; A, C, G, T, N and U stay; anything else raises an error."""
    valid = F.coalesce(F.upper(seq), F.lit("")).rlike(f"^[ACGTNU{AMBIGUOUS}]*$")
    return F.when(valid, F.regexp_replace(seq, f"(?i)[{AMBIGUOUS}]", "N")).otherwise(F.raise_error(F.concat(F.lit("invalid base in sequence: "), F.left(seq, F.lit(80)))))


def trim_name(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S+)", 1)


def chomp(line: Column) -> Column:
    return F.rtrim(F.regexp_replace(line, r"\s+$", ""))


def pair_name(header: Column) -> Column:
    """``@x 1:N:0:..`` to ``@x/1``; comments go; a name that ends in /1 or the like stays as it is."""
    line = F.regexp_replace(header, r"\s+$", "")
    plain = F.regexp_extract(line, r"^([^\t ]*)", 1)
    end = F.regexp_extract(line, r"^[^\t ]*[\t ]([12]):.:.:", 1)
    return (
        F.when(F.length(line) < 2, line)
        .when(line.rlike(r"/.$") | ~line.rlike(r"[\t ]"), line)
        .when(plain.rlike(r"..+/[12]$") | (end == ""), plain)
        .otherwise(F.concat(plain, F.lit("/"), end))
    )


def pair_base(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)/[12]$", "$1")


def pair_end(name: Column) -> Column:
    """1 or 2, or 0 without a known pair."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r".+/([12])$", 1), F.lit("")).cast("int"), F.lit(0))


def pair_index(line: Column) -> Column:
    """Offset of the 1 or 2 that tells the end of a pair in a header line (commented, plain, or Casava form), else 0."""
    space = F.length(F.regexp_extract(line, r"^(\S+)\s", 1))
    return (
        F.when(F.length(line) <= 3, 0)
        .when(line.rlike(r"^\S{2,}/[12]\s"), space - 1)
        .when(line.rlike(r"/[12]$"), F.length(line) - 1)
        .when(line.rlike(r"^\S+\s[12]:[YN]:.:"), space + 1)
        .otherwise(0)
    )


def compact_id(name: Column, library: Column, number: Column) -> Column:
    """``@``, two hexadecimal digits of the library, the running number in hexadecimal, and the pair's ending."""
    return F.concat(F.lit("@"), F.lower(F.lpad(F.hex(library), 2, "0")), F.lower(F.hex(number)), F.regexp_extract(name, r"(/.)$", 1))


def fold(seq: Column, width: int = 50) -> Column:
    """Line feeds after each ``width`` letters, and one at the end."""
    return F.concat(F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"), F.lit("\n"))


# The standard genetic code, by codons in order of A, C, G, T.
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


def translate_frame(seq: Column, frame: int) -> Column:
    """Amino acids of one reading frame (0 to 2); codons with other letters give X."""
    binary = F.encode(seq, "utf-8")
    starts = F.when(F.length(seq) >= frame + 3, F.sequence(F.lit(frame + 1), F.length(seq) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    codon = lambda i: F.decode(F.substr(binary, i, F.lit(3)), "utf-8")
    letter = lambda c: F.when(c.rlike("^[ACGT]{3}$"), F.substr(F.lit(CODONS), pack(c).cast("int") + 1, F.lit(1))).otherwise("X")
    return F.array_join(F.transform(starts, lambda i: letter(codon(i))), "")


def six_frames(seq: Column) -> Column:
    rc = reverse_complement(seq)
    return F.array(*(translate_frame(s, f) for s in (seq, rc) for f in range(3)))
