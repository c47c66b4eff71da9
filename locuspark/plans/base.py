"""The driver's tables as the engine's concepts, in DataFrames and, word for word, in SQL.

iv: intervals (seq, id, sta, end, grp) from lineitem: ship day and quantity by supplier; ivp: the same by part.
gt: genotypes (chr, pos, sample, gt) from lineitem: an order is a site, a line a sample, the return flag an allele.
edge: contacts (a, b, w) between suppliers and parts' brands through lineitem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iv(spark: SparkSession, d: str, seq: str = "l_suppkey") -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    return table(spark, d, "lineitem").select(F.col(seq).alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("sta"), (day + F.col("l_quantity").cast("long")).alias("end"), F.col("l_returnflag").alias("grp"))


IV = """iv AS (SELECT l_suppkey AS seq, l_orderkey * 10 + l_linenumber AS id, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS sta,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS "end", l_returnflag AS grp FROM lineitem)"""


def ivp(spark: SparkSession, d: str) -> DataFrame:
    return iv(spark, d, "l_partkey")


IVP = IV.replace("iv AS (SELECT l_suppkey AS seq", "ivp AS (SELECT l_partkey AS seq")


def gt(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("l_quantity") < 4, None).when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).cast("int").alias("chr"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("sample"), call.cast("int").alias("gt")).groupBy("chr", "pos", "sample").agg(F.max("gt").alias("gt"))


GT = """gt AS (SELECT (l_orderkey % 4)::INT AS chr, l_orderkey AS pos, l_linenumber AS sample,
  max(CASE WHEN l_quantity < 4 THEN NULL WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END) AS gt FROM lineitem GROUP BY ALL)"""


def bi(spark: SparkSession, d: str) -> DataFrame:
    """Biallelic genotypes of one site for each part, a sample for each supplier class."""
    row = table(spark, d, "lineitem").select((F.col("l_partkey") % 3).cast("int").alias("chr"), F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 12).cast("int").alias("sample"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("gt"))
    return row.groupBy("chr", "pos", "sample").agg(F.max("gt").alias("gt"))


BI = """bi AS (SELECT (l_partkey % 3)::INT AS chr, l_partkey AS pos, (l_suppkey % 12)::INT AS sample, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS gt
  FROM lineitem GROUP BY ALL)"""


def edge(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of suppliers that ship lines of one order: a < b, w lines."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"))
    y = x.select("l_orderkey", F.col("a").alias("b"))
    return x.join(y, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


EDGE = """edge AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS w FROM lineitem x JOIN lineitem y USING (l_orderkey)
  WHERE x.l_suppkey < y.l_suppkey GROUP BY ALL)"""


def depth(spark: SparkSession, d: str) -> DataFrame:
    """A depth track: windows of 10 along an order's customer, two depths."""
    return table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("ctg"), (F.col("o_orderkey") * 10 + 1).alias("sta"), (F.col("o_orderkey") * 10 + 10).alias("end"), F.round(F.col("o_totalprice") / 4000).alias("dep"), F.round(F.col("o_totalprice") / 5000).alias("dep2"))


DEPTH = """dep AS (SELECT 'c' || (o_custkey % 50)::VARCHAR AS ctg, o_orderkey * 10 + 1 AS sta, o_orderkey * 10 + 10 AS "end", round(o_totalprice / 4000) AS dep,
  round(o_totalprice / 5000) AS dep2 FROM orders)"""


GROUPS = ["1", "2", "3", "4"]


def ploidy(x: str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("hap", "dip", "trip", "tetrap", "rep"))), (F.expr(x) % 5 + 1).cast("int"))


def class_sql(x: str) -> str:
    return f"['hap', 'dip', 'trip', 'tetrap', 'rep'][(({x}) % 5 + 1)::INT]"


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Window markers of contigs (suppliers) and the contigs (parts) and groups that they are linked to."""
    w = F.col("l_partkey") % 20
    lg = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber") % 2).otherwise(F.col("l_linenumber") % 4) + 1
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ctg"), (w * 1000 + 1).alias("sta"), (w * 1000 + 1000 - w % 3 * 100).alias("end"), ploidy("l_suppkey + l_partkey % 20").alias("type"), F.col("l_partkey").alias("lctg"), lg.cast("string").alias("lg"), F.col("l_quantity").alias("hic"), (F.col("l_tax") < 0.06).alias("long"))


MARKERS = f"""mk AS (SELECT l_suppkey AS ctg, l_partkey % 20 * 1000 + 1 AS sta, l_partkey % 20 * 1000 + 1000 - l_partkey % 20 % 3 * 100 AS "end", {class_sql("l_suppkey + l_partkey % 20")} AS type,
  l_partkey AS lctg, (CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber % 2 ELSE l_linenumber % 4 END + 1)::VARCHAR AS lg, l_quantity AS hic, l_tax < 0.06 AS long FROM lineitem),
  sc AS (SELECT ctg, lg, sum(hic * ("end" - sta + 1)) AS score, count(*) AS links FROM mk WHERE long GROUP BY ALL), bc AS (SELECT ctg, lg, lctg AS best, hic AS best_hic FROM mk WHERE long QUALIFY row_number() OVER (PARTITION BY ctg, lg ORDER BY hic DESC, lctg) = 1)"""
