"""The corpus operators' queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.mixing import MIXTURE, mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIXTURE, share=1.0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The verdict and the host/path of each fixed rule.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.url_rules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.context_tree import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locuspark.llm.minhash_dedup import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents"), words=2)


_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
