"""A corpus pipeline: quality filter, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. Rows with null ids or texts go through like others; an empty table gives an empty result. Each row is
judged by its own text: doc_id and a hash of the text tell rows apart, so of rows that repeat an id with different texts some
can go and others stay; other columns, whatever their names, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch
from locuspark.llm.exact_dedup import exact_dedup
from locuspark.llm.minhash_dedup import minhash_dedup
from locuspark.llm.mixing import TARGETS, mix
from locuspark.llm.packing import pack
from locuspark.llm.quality import quality_scores
from locuspark.llm.registry import table, tokenizer_path


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_tag", F.xxhash64("text"))


def _rows(some: DataFrame) -> DataFrame:
    return some.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_its_tag")).distinct()


_SAME = "doc_id <=> _id and _tag = _its_tag"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, tag): an id that repeats with another text stays."""
    return _tagged(docs).join(_rows(gone), F.expr(_SAME), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled rows of its bounded sample."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), fold=None, tagged=True)
    return _without(docs, scored.where("predicted = 0"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows one stays. Rows with null ids stay."""
    found = Scratch(spark).write(exact_dedup(docs, tagged=True).select("doc_id", "tag", "group_size", "kept"), "exact")
    left = _without(docs, found.where("not kept"))
    again = found.where("kept and group_size > 1 and doc_id is not null").groupBy("doc_id", "tag").count().where("count > 1")
    if again.isEmpty():
        return left
    once = _tagged(left).join(_rows(again), F.expr(_SAME), "left_semi").dropDuplicates(["doc_id", "_tag"]).select(*docs.columns)
    return _without(left, again).unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. Rows with null ids stay."""
    return _without(docs, minhash_dedup(docs, words=5, percent=80, tagged=True).where("not kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose rate in the mixture is at least a half, each once: a copy would be a duplicate again.

    All weight is on clean documents, so toxic and low ones go.
    """
    return _without(docs, mix(docs, table(spark, sf_dir, "labels"), TARGETS, tagged=True).where("rate < 0.5"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows with their ids."""
    return pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("minhash near-dedup", near), ("mixing", mixing), ("packing", packing)]

#: Trained models, components and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, so that a lost executor costs one stage at most."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.write(out, name.replace(" ", "-"))
        scratch.release()
