"""Scalar kernels, Column to Column: positions, CIGAR strings, sequences, genotypes, tours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_id(pos: Column, width: int, mode: str = "floor") -> Column:
    """The window of a position: floor(pos/w), one (1-based floor), or ceil, which names a window by its last position."""
    if mode == "ceil":
        return (F.ceil(pos / width) * width).cast("long")
    at = F.floor(pos / width).cast("long")
    return at + 1 if mode == "one" else at


def overlap_len(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared positions of two closed intervals, 0 if they are apart."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op), empty for ``*`` and null."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(F.coalesce(n, F.array().cast("array<string>")), F.coalesce(op, F.array().cast("array<string>")), lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Total length of the named operations."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.instr(F.lit(ops), x["op"]) > 0), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def cigar_events(cigar: Column, ops: str) -> Column:
    """How many of the named operations there are."""
    return F.size(F.filter(cigar_ops(cigar), lambda x: F.instr(F.lit(ops), x["op"]) > 0)).cast("long")


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment covers."""
    return cigar_sum(cigar, "MDN=X")


def project_read(seq: Column, cigar: Column) -> Column:
    """A read laid on the reference: soft clips and insertions dropped, deletions and skips as dashes."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        op, n, at = x["op"], x["n"], a["at"]
        taken = F.substr(seq, at.cast("int"), n.cast("int"))
        out = F.when(op.isin("M", "=", "X"), F.concat(a["out"], taken)).when(op.isin("D", "N"), F.concat(a["out"], F.repeat(F.lit("-"), n.cast("int")))).otherwise(a["out"])
        return F.struct(F.when(op.isin("M", "=", "X", "I", "S"), at + n).otherwise(at).alias("at"), out.alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTU", "TGCAA"))


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Positions start..end, 1-based and closed."""
    return F.substr(seq, start.cast("int"), (end - start + 1).cast("int"))


def read_end(flag: Column) -> Column:
    """R1, R2 or RU from the flag bits 0x40 and 0x80."""
    return F.when(flag.bitwiseAND(0x40) > 0, "R1").when(flag.bitwiseAND(0x80) > 0, "R2").otherwise("RU")


def primary(flag: Column, cigar: Column, mask: int = 3840) -> Column:
    """Mapped, and neither secondary, supplementary, duplicate nor failed."""
    return (cigar != "*") & (flag.bitwiseAND(mask) == 0)


def ploidy_class(depth: Column, half: float) -> Column:
    """hap, dip, trip, tetrap or rep by half-step cutoffs ceil(k * half + half / 2) over the rounded depth."""
    d = F.round(depth)
    out = F.lit("rep")
    for k, name in reversed(list(enumerate(("hap", "dip", "trip", "tetrap"), 1))):
        out = F.when(d <= F.ceil(F.lit(k * half + half / 2)), name).otherwise(out)
    return out


def presence(x: Column) -> Column:
    """0 for a dash, numbers as they are, 1 for anything else."""
    return F.when(x == "-", "0").when(x.try_cast("double").isNotNull(), x).otherwise("1")


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum of 1/i^power for i from 1 to n - 1; 0 if n is at most 1."""
    steps = F.when(n > 1, F.sequence(F.lit(1).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1.0 / F.pow(i.cast("double"), F.lit(float(power))))


def normal_genotype(gt: Column) -> Column:
    return F.translate(gt, "|", "/")


def is_het(gt: Column) -> Column:
    return normal_genotype(gt).isin("0/1", "1/0")


def is_missing(gt: Column) -> Column:
    return normal_genotype(gt) == "./."


def genotype_bases(gt: Column, alleles: Column) -> Column:
    """Allele letters of an index genotype, joined by a slash; N where missing."""
    return F.array_join(F.transform(F.split(normal_genotype(gt), "/"), lambda i: F.coalesce(F.try_element_at(alleles, i.try_cast("int") + 1), F.lit("N"))), "/")


def is_alternate(alt: Column, ref: Column, ratio: float = 0.65) -> Column:
    """Whether a read's bases mostly are the alternate ones."""
    return alt / (alt + ref + 1e-7) > ratio


def tour(text: Column) -> Column:
    """Signed contig numbers of an assembly line."""
    return F.transform(F.filter(F.split(text, " +"), lambda x: x != ""), lambda x: x.cast("int"))


def tour_text(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: x.cast("string")), " ")


def reverse_tour(t: Column) -> Column:
    return F.reverse(F.transform(t, lambda x: -x))


def insert_after(t: Column, target: Column, new: Column) -> Column:
    """A tour with new put behind the contig target, whatever its strand."""
    return F.flatten(F.transform(t, lambda x: F.when(F.abs(x) == target, F.array(x, new)).otherwise(F.array(x))))


def concat_tours(tours: Column) -> Column:
    """One tour of several (an array of them), in their order."""
    return F.flatten(F.filter(tours, lambda t: t.isNotNull()))


def strands(t: Column) -> Column:
    """A tour's contigs and strands: an array of structs ctg, strand; of a contig that comes twice, the first."""
    pairs = F.transform(t, lambda x, i: F.struct(F.abs(x).alias("ctg"), F.when(x < 0, "-").otherwise("+").alias("strand"), i.alias("i")))
    first = F.filter(pairs, lambda p: F.array_position(F.transform(t, lambda x: F.abs(x)), p["ctg"]) == p["i"] + 1)
    return F.transform(first, lambda p: F.struct(p["ctg"].alias("ctg"), p["strand"].alias("strand")))


def label_of_path(path: Column, *drop: str) -> Column:
    """A label from a path: each pattern is deleted in turn."""
    for p in drop:
        path = F.regexp_replace(path, p, "")
    return path


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.array_join(F.regexp_extract_all(seq, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def fields(line: Column, sep: str = "\t") -> Column:
    """Fields of a line without the empty ones: separators in a row count as one."""
    return F.filter(F.split(line, sep), lambda x: x != "")


def count_or_zero(text: Column) -> Column:
    """A whole number, decimal or 0x-hexadecimal; 0 for anything else."""
    low = F.lower(text)
    hexa = F.conv(F.substring(low, 3, 16), 16, 10).cast("long")
    return F.coalesce(F.when(low.rlike("^0x[0-9a-f]+$"), hexa).otherwise(text.try_cast("long")), F.lit(0).cast("long"))
