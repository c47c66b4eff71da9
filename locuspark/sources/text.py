"""Text formats as tables. parse_* take lines (a column ``value``, and ``line_no`` where order matters); read_* take a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locuspark.functions.kernels import fields


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and file of each line; gzip is read as it is."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and line_no, which grows along each file."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("_block", "_i")).cast("long")).drop("_block", "_i")


def parse_fields(df: DataFrame, columns: list[tuple[str, str]], sep: str = "\t", least: int | None = None, comment: str = "#") -> DataFrame:
    """Named, typed columns by position. Blank lines, comments and lines with fewer than ``least`` fields are skipped; empty fields do not count."""
    f = df.where((F.trim("value") != "") & ~F.col("value").startswith(comment)).withColumn("_f", fields(F.col("value"), sep)).where(F.size("_f") >= (least or len(columns)))
    rest = [c for c in df.columns if c != "value"]
    return f.select(*rest, *[F.get("_f", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])


PAF = [(n, "long" if n in {"qlen", "qsta", "qend", "tlen", "tsta", "tend", "nmatch", "blocklen"} else "int" if n == "mapq" else "string") for n in "qname qlen qsta qend strand tname tlen tsta tend nmatch blocklen mapq".split()]
SAM = [(n, "int" if n in {"flag", "mapq"} else "long" if n in {"pos", "pnext", "tlen"} else "string") for n in "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()]
COVERAGE = [("ctg", "string"), ("wsta", "long"), ("wend", "long"), ("ignore", "string"), ("norm_dep", "double"), ("raw_dep", "double"), ("ctg_size", "long")]
MARKER = [("ctg", "string"), ("sta", "long"), ("end", "long"), ("avg_depth", "double"), ("n_win", "long"), ("ctg_size", "long"), ("type", "string")]


def parse_paf(df: DataFrame) -> DataFrame:
    return parse_fields(df, PAF)


def long_targets(paf: DataFrame, contigs: DataFrame, least: int = 3000) -> DataFrame:
    """Alignments of listed contigs (ctg) whose target span is longer than ``least``."""
    return paf.where(F.col("tend") - F.col("tsta") > least).join(contigs.select(F.col("ctg").alias("qname")), "qname", "left_semi")


def parse_sam(df: DataFrame) -> DataFrame:
    return parse_fields(df, SAM, least=11, comment="@")


def sam_counts(df: DataFrame) -> DataFrame:
    """lines, headers, short, records, unmapped, secondary, supplementary: what a scan of SAM lines sees and skips.

    short are lines that are neither headers nor blank and have fewer than 11 fields; the others are records.
    """
    head, blank = F.col("value").startswith("@"), F.trim("value") == ""
    n = F.size(fields(F.col("value")))
    flag = F.get(F.split("value", "\t"), F.lit(1)).try_cast("int")
    record = ~head & ~blank & (n >= 11)
    bit = lambda k: F.count_if(record & (flag.bitwiseAND(k) != 0))
    return df.agg(F.count(F.lit(1)).alias("lines"), F.count_if(head).alias("headers"), F.count_if(~head & ~blank & (n < 11)).alias("short"), F.count_if(record).alias("records"), bit(4).alias("unmapped"), bit(256).alias("secondary"), bit(2048).alias("supplementary"))


def parse_sizes(df: DataFrame) -> DataFrame:
    """ctg, size, conflict: true where a name comes with different sizes (the smallest is given)."""
    return parse_fields(df, [("ctg", "string"), ("size", "long")]).groupBy("ctg").agg(F.min("size").alias("size"), (F.count_distinct("size") > 1).alias("conflict"))


def vcf_samples(df: DataFrame) -> list[str]:
    """Sample names of the header line."""
    head = df.where(F.col("value").startswith("#CHROM")).first()
    return head["value"].split("\t")[9:] if head else []


def parse_vcf(df: DataFrame, samples: list[str]) -> DataFrame:
    """chr, pos, ref, alt, qual, sample, gt: one row for each call; gt is what stands before the first colon."""
    f = df.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") > 9)
    names = F.array(*map(F.lit, samples)) if samples else F.array().cast("array<string>")
    calls = f.select(*[F.col("f")[i].alias(n) for i, n in ((0, "chr"), (1, "pos"), (3, "ref"), (4, "alt"), (5, "qual"))], F.posexplode(F.slice("f", 10, 1_000_000)).alias("i", "call"))
    return calls.select("chr", F.col("pos").cast("long").alias("pos"), "ref", "alt", F.col("qual").try_cast("double").alias("qual"), F.get(names, F.col("i")).alias("sample"), F.split("call", ":")[0].alias("gt"))


def genotype_tuple(gt: Column) -> Column:
    """Allele numbers of a genotype; null where one is missing."""
    return F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: records cut at >, their lines joined."""
    return parse_fasta(spark.read.text(path, lineSep=">"))


def parse_fasta(df: DataFrame) -> DataFrame:
    """Records without their >: the first line is the name up to white space, the others are the sequence."""
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return df.where(F.trim("value") != "").select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), body.alias("seq"))


def parse_gfa_nodes(df: DataFrame) -> DataFrame:
    """node, size of S lines."""
    f = df.where(F.col("value").startswith("S\t")).select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[1].alias("node"), F.length(F.col("f")[2]).cast("long").alias("size"))


def parse_gfa_links(df: DataFrame) -> DataFrame:
    """a, a_end, b, b_end, ovl of L lines with a real overlap: the ends of the nodes that meet."""
    f = df.where(F.col("value").startswith("L\t")).select(F.split("value", "\t").alias("f"))
    ovl = F.regexp_extract(F.col("f")[5], r"^(\d+)M", 1).try_cast("long")
    a_end, b_end = F.when(F.col("f")[2] == "+", "r").otherwise("l"), F.when(F.col("f")[4] == "+", "l").otherwise("r")
    return f.select(F.col("f")[1].alias("a"), a_end.alias("a_end"), F.col("f")[3].alias("b"), b_end.alias("b_end"), ovl.alias("ovl")).where("ovl > 0")


def parse_genes(df: DataFrame) -> DataFrame:
    """chr, sta, end, strand, id of gene lines of a GFF."""
    rows = parse_fields(df, [("chr", "string"), ("src", "string"), ("type", "string"), ("sta", "long"), ("end", "long"), ("score", "string"), ("strand", "string"), ("phase", "string"), ("attrs", "string")])
    return rows.where("type = 'gene'").select("chr", "sta", "end", "strand", F.regexp_extract("attrs", "ID=([^;]*)", 1).alias("id"))


def parse_dot_edges(df: DataFrame) -> DataFrame:
    """a, b, weight, cluster of edge lines."""
    p = r"^\s*(\S+)\s+--\s+(\S+)\s+\[.*label=([0-9.]+).*\];(?:\s*/\*\s*cluster\s+(\d+)\s*\*/)?"
    e = df.where(F.col("value").contains(" -- "))
    return e.select(F.regexp_extract("value", p, 1).alias("a"), F.regexp_extract("value", p, 2).alias("b"), F.regexp_extract("value", p, 3).try_cast("double").alias("weight"), F.regexp_extract("value", p, 4).try_cast("int").alias("cluster"))


def parse_dot_groups(df: DataFrame) -> DataFrame:
    """cluster, label of group lines, which follow their cluster's edge lines (lines of one graph: value, file, line_no)."""
    w = Window.partitionBy("file").orderBy("line_no")
    edge = F.when(F.col("value").contains(" -- "), F.regexp_extract("value", r"/\*\s*cluster\s+(\d+)", 1).try_cast("int"))
    rows = df.select("value", "file", F.last(edge, ignorenulls=True).over(w).alias("cluster"))
    p = r'^\s*label="(G[^"]*)"'
    return rows.where(F.col("value").rlike(p)).select("file", "cluster", F.regexp_extract("value", p, 1).alias("label"))


def parse_blast(df: DataFrame) -> DataFrame:
    """query, subject, same, length of each identity line, with the names last seen above it (lines of one report: value, file, line_no)."""
    w = Window.partitionBy("file").orderBy("line_no")
    carry = lambda p: F.last(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)), ignorenulls=True).over(w)
    rows = df.select("value", "line_no", carry(r"^Query=\s*(\S+)").alias("query"), carry(r"^>\s*(\S+)").alias("subject"))
    p = r"Identities = (\d+)/(\d+)"
    return rows.where(F.col("value").rlike(p)).select("line_no", "query", "subject", F.regexp_extract("value", p, 1).cast("long").alias("same"), F.regexp_extract("value", p, 2).cast("long").alias("length"))


def parse_matrix_blocks(df: DataFrame) -> DataFrame:
    """block, row, column, value of square matrices, one after the other; a line of at most one token begins a block (value, file, line_no)."""
    w = Window.partitionBy("file").orderBy("line_no")
    f = df.withColumn("f", fields(F.col("value"), r"\s+")).withColumn("block", F.sum(F.when(F.size("f") <= 1, 1).otherwise(0)).over(w))
    return f.where(F.size("f") > 1).select("file", "block", F.col("f")[0].alias("row"), F.posexplode(F.slice("f", 2, 1_000_000)).alias("column", "v")).select("file", "block", "row", "column", F.col("v").try_cast("double").alias("dist"))


def parse_agp(df: DataFrame) -> DataFrame:
    """chr, sta, end, part, type, ctg of AGP lines that are not gaps."""
    rows = parse_fields(df, [("chr", "string"), ("sta", "long"), ("end", "long"), ("part", "int"), ("type", "string"), ("ctg", "string")])
    return rows.where("type not in ('U', 'N')")


def parse_assembly(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contigs (ctg, idx, size) and tours (value) of an assembly file."""
    p = r"^>(\S+)\s+(\d+)\s+(\d+)"
    named = df.where(F.col("value").startswith(">")).select(F.regexp_extract("value", p, 1).alias("ctg"), F.regexp_extract("value", p, 2).cast("int").alias("idx"), F.regexp_extract("value", p, 3).cast("long").alias("size"))
    return named, df.where((F.trim("value") != "") & ~F.col("value").startswith(">"))


def labelled(df: DataFrame, *drop: str) -> DataFrame:
    """df with ``label``: the file's name without the given patterns."""
    out = F.regexp_extract("file", r"([^/]*)$", 1)
    for p in drop:
        out = F.regexp_replace(out, p, "")
    return df.withColumn("label", out)


def read_headed(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema)
