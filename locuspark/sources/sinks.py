"""Sinks: files by group, tab-separated tables, FASTA, DOT, and other tools' genotype formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.kernels import wrapped


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys, each written by few tasks."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, nullValue="NA", emptyValue="")


def bed_lines(df: DataFrame, chr: str, sta: str, end: str, *more: str) -> DataFrame:
    """Half-open, 0-based lines of closed, 1-based intervals."""
    return df.select(F.concat_ws("\t", F.col(chr), (F.col(sta) - 1).cast("string"), *[F.col(c).cast("string") for c in (end, *more)]).alias("value"))


def fasta_lines(df: DataFrame, name: str, seq: str, width: int = 80) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def sam_header(sizes: DataFrame) -> DataFrame:
    return sizes.select(F.concat(F.lit("@SQ\tSN:"), F.col("ctg"), F.lit("\tLN:"), F.col("size").cast("string")).alias("value"))


def dot_edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("\t"), F.col("a"), F.lit(" -- "), F.col("b"), F.lit(" [label="), F.col("weight").cast("string"), F.lit("]; /* cluster "), F.col("cluster").cast("string"), F.lit(" */")).alias("value"))


def cluster_lines(members: DataFrame, cluster: str, node: str, size: str) -> DataFrame:
    """cluster, nodes (in order, by comma), total: one row for each cluster of contigs."""
    return members.groupBy(cluster).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col(node).cast("string")))).alias("nodes"), F.sum(size).alias("total"))


def dot_clusters(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """cluster, line_no, value: a DOT subgraph of each cluster (edges a, b, weight, cluster), its contigs and their total size.

    sizes: node, size; a node without one counts 0. line_no orders the lines of a cluster; label numbers are the clusters'.
    """
    c = F.col("cluster").cast("string")
    line = lambda df, no, *parts: df.select("cluster", no.cast("long").alias("line_no"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))
    nodes = edges.select("cluster", F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes, "node", "left")
    total = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
    w = Window.partitionBy("cluster")
    nth = edges.select("cluster", "a", "b", "weight", F.row_number().over(w.orderBy("a", "b", "weight")).alias("k"))
    mth = nodes.select("cluster", "node", F.row_number().over(w.orderBy("node")).alias("k"))
    far = 1 << 40  # edges come first, then contigs, then what closes the subgraph
    out = line(total, F.lit(0), "\tsubgraph cluster_", c, " {")
    out = out.unionByName(line(nth, F.col("k"), "\t", F.col("a").cast("string"), " -- ", F.col("b").cast("string"), " [label=", F.col("weight").cast("string"), "]; /* cluster ", c, " */"))
    out = out.unionByName(line(mth, F.lit(far) + F.col("k"), "\t", F.col("node").cast("string"), " [style=filled];"))
    tail = [("\tlabel=\"G_", c, "\";"), ("\t/* ", F.col("n").cast("string"), " contigs with total size of ", F.col("size").cast("string"), " bp */"), ("\t}",)]
    for k, parts in enumerate(tail):
        out = out.unionByName(line(total, F.lit(2 * far + k), *parts))
    return out


def eigenstrat_map(sites: DataFrame, step: float = 0.0001) -> DataFrame:
    """chr, id, genetic, at: chromosomes laid end to end; a site's genetic position grows by ``step`` from site to site.

    sites: chr, pos, id, each (chr, pos) once. at is the position behind the last site of all chromosomes before.
    """
    ends = sites.groupBy("chr").agg(F.max("pos").alias("_last"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    ends = ends.select("chr", F.coalesce(F.sum("_last").over(w), F.lit(0)).alias("_add"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("chr").orderBy("pos"))
    return sites.withColumn("_k", nth).join(ends, "chr").select("chr", "id", F.round((F.col("_before") + F.col("_k")) * F.lit(step), 6).alias("genetic"), (F.col("_add") + F.col("pos")).alias("at"))


def ped_lines(g: DataFrame, order: list[str]) -> DataFrame:
    """sample, value: a line of a PED file for each sample: its number, name, 0, 0, 0, 1, and two alleles (a1, a2) for each site."""
    cell = F.struct(*order, F.concat_ws("\t", F.coalesce("a1", F.lit("0")), F.coalesce("a2", F.lit("0"))).alias("_s"))
    lines = g.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["_s"]), "\t").alias("_l"))
    number = F.row_number().over(Window.orderBy("sample")).cast("string")  # a row for each sample
    return lines.select("sample", F.concat_ws("\t", number, "sample", F.lit("0\t0\t0\t1"), "_l").alias("value"))


def geno_lines(g: DataFrame, site: list[str], samples: list[str]) -> DataFrame:
    """site, value: a line of a geno table: each sample's alleles (a1, a2) by a slash, N where missing."""
    call = F.concat_ws("/", F.coalesce("a1", F.lit("N")), F.coalesce("a2", F.lit("N")))
    wide = g.withColumn("_c", call).groupBy(*site).pivot("sample", samples).agg(F.first("_c"))
    return wide.select(*site, F.concat_ws("\t", *[F.col(c).cast("string") for c in site], *[F.coalesce(F.col(f"`{x}`"), F.lit("N/N")) for x in samples]).alias("value"))


def allele_count_lines(g: DataFrame, site: list[str], pop: str, state: str, pops: list[str]) -> DataFrame:
    """site and, for each population, "derived,ancestral" counts of states 1 and 0."""
    pair = F.concat_ws(",", F.count(F.when(F.col(state) == 1, 1)).cast("string"), F.count(F.when(F.col(state) == 0, 1)).cast("string"))
    return g.groupBy(*site).pivot(pop, pops).agg(pair).fillna("0,0")


def haplotype_lines(g: DataFrame, sample: str, order: list[str], state: str) -> DataFrame:
    """sample, line: its states in site order, by space; 9 where missing."""
    cell = F.struct(*order, F.coalesce(F.col(state), F.lit(9)).cast("string").alias("_s"))
    return g.groupBy(sample).agg(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["_s"]), " ").alias("line"))


def map_lines(sites: DataFrame, step: float = 0.0001) -> DataFrame:
    """chr, pos, genetic: a running map position, ``step`` for each site of a chromosome."""
    return sites.select("chr", "pos", (F.row_number().over(Window.partitionBy("chr").orderBy("pos")) * F.lit(step)).alias("genetic"))
