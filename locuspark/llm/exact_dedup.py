"""Exact duplicates by distributed most-significant-digit radix partitioning.

Each round looks at the next bytes of every text still in question and splits its group by them. A group that has become a
single text is done, and so is one whose texts end together: they are equal, byte for byte, without any digest. Digits
widen eightfold, so few rounds reach the longest texts. Groups are counted with map-side aggregation and the counts joined
back by sort and merge, which spills. A group with over a thousandth of the rows in question, of which there are fewer than a
thousand, is dealt over many tasks by a salt: its one counted row is repeated for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch

#: Bytes of the first digit and the factor by which each further one is wider.
FIRST, WIDEN = 48, 8
#: A group with more than 1 / HOT of the rows is dealt over SALTS parts.
HOT, SALTS = 1000, 64


def _salted(cut: DataFrame, nodes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on key with a column _salt: 0, but for rows of hot groups one of SALTS, and their nodes for each.

    Hot groups are told by a hash of their key on both sides alike, so groups that share a hash are salted together.
    """
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    code = F.xxhash64(*key)
    hot = [r[0] for r in nodes.where(F.col("_n") * HOT > total).select(code).distinct().collect()]  # fewer than HOT numbers
    among = code.isin(hot) if hot else F.lit(False)
    cut = cut.withColumn("_salt", F.when(among, F.pmod(F.xxhash64("doc_id", "_sha"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(among, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return cut, nodes.withColumn("_salt", F.explode(salts))


def exact_dedup(docs: DataFrame, first: int = FIRST, widen: int = WIDEN, tagged: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text; other columns take no part).

    Null text counts as empty. Of equal texts the row with the largest doc_id stays; repeated rows are counted each, share
    keep_id and are kept alike, since doc_id cannot tell them apart. A row with null doc_id takes no part: keep_id null,
    group_size 1, kept. An empty table gives none. The digest is reported, never compared. With ``tagged`` the column tag
    follows, the 64-bit hash of the text, which with doc_id tells rows apart.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    also = ["tag"] if tagged else []
    rows = docs.select("doc_id", *[F.xxhash64("text").alias(x) for x in also], text.alias("_rest"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    id_type = docs.schema["doc_id"].dataType
    # a group is known by its largest doc_id; _path only tells groups apart whose rows share that id
    active = rows.where(F.col("doc_id").isNotNull()).select("*", F.lit(0).cast(id_type).alias("_group"), F.lit(0).cast("long").alias("_path"))
    done = [rows.where(F.col("doc_id").isNull()).select("doc_id", *also, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_sha")]
    key, width = ["_group", "_path", "_digit", "_ended"], first
    while True:
        cut = active.select("doc_id", *also, "_group", "_path", "_sha", F.substring("_rest", 1, width).alias("_digit"), (F.octet_length("_rest") <= width).alias("_ended"), F.expr(f"substring(_rest, {width + 1})").alias("_rest"))
        nodes = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_top"))
        nodes = scratch.write(nodes, "nodes")
        dealt, counted = _salted(cut, nodes, key)
        goes_on = ~F.col("_ended") & (F.col("_n") > 1)
        split = dealt.join(counted.hint("merge"), [*key, "_salt"]).select("doc_id", *also, "_sha", "_n", F.col("_top").alias("_group"), F.xxhash64("_path", "_digit").alias("_path"), F.when(goes_on, F.col("_rest")).alias("_rest"))
        split = scratch.write(split, "round")
        scratch.release()
        done.append(split.where("_rest is null").select("doc_id", *also, F.col("_group").alias("keep_id"), F.col("_n").alias("group_size"), "_sha"))
        active = split.where("_rest is not null")
        if active.isEmpty():
            break
        width *= widen
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), *also)
