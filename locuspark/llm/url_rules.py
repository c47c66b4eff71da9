"""URL verdicts: fixed rules by host and path, and association rules that FP-growth mines from labelled pages.

A page is a set of tokens: its scheme, host, the host's suffixes, path segments, numbers and query keys. Frequent token
sets that go with a bad label often enough, among enough labelled pages, become blocking rules, however many there are.
They are matched by an inverted index, a table from each rule's rarest token to the rule: only urls with that token are
compared with it. Spark broadcasts the index if it is small and otherwise joins it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of rules (verdict, host/path) that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer one goes before
        at, _, _ = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(rule[len(at) :])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url; a number stands for all numbers."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([A-Za-z]*)://", 1)))
    return F.array_distinct(F.concat(F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), segments, keys, scheme))


def mine(items: DataFrame, support: float = 0.002, confidence: float = 0.6) -> DataFrame:
    """rule (sorted tokens), token (its rarest one among items): rules with consequent BAD, from items (items: distinct strings).

    support is the rule's share of rows, confidence the share of rows with its tokens that are bad. A rule that holds all
    tokens of another one is dropped, as it decides nothing. Rows without items count as rows; an empty table gives no rule.
    """
    spark = items.sparkSession
    if items.isEmpty():
        return spark.createDataFrame([], "rule array<string>, token string")
    scratch = Scratch(spark)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("rule")).distinct()
    rules = scratch.write(rules, "rules")
    often = items.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = rules.select("rule", F.explode("rule").alias("token")).join(often, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    index = scratch.write(rarest.select("rule", F.col("t.token").alias("token")), "index")
    wider = matched(index.select(F.col("rule").alias("items")), index, proper=True)
    return index.join(wider.withColumnRenamed("items", "rule"), "rule", "left_anti")


def matched(sets: DataFrame, index: DataFrame, proper: bool = False) -> DataFrame:
    """The distinct items of sets (items) that hold all tokens of a rule of the index (rule, token); with proper, and others too."""
    rows = sets.select("items", F.explode("items").alias("token")).join(index, "token")
    rows = rows.where(F.size(F.array_except("rule", "items")) == 0)
    return (rows.where(F.size("rule") < F.size("items")) if proper else rows).select("items").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], support: float = 0.002, confidence: float = 0.6, least: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for each row of pages (page_id, url; other columns take no part).

    verdict is that of the longest fixed rule that fits; without one it is block where a mined rule matches, else allow.
    Mining learns from pages whose page_id has labels (doc_id, quality, toxic): bad is quality 0 or toxic 1, rows with both
    null teach nothing. A rule needs ``support`` of the labelled pages, and ``least`` of them. mined tells whether a mined rule
    matches. A null url, or one without ``://``, has empty host and path and no rule; null ids stay, and ids may be of any
    type; repeated rows have the same answer, as a url decides; empty tables give none, or teach nothing.
    """
    scratch = Scratch(pages.sparkSession)
    pages = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    url_tokens = tokens(F.col("_url"), F.col("host"), F.col("path"))
    id = F.col("doc_id").cast(pages.schema["page_id"].dataType)
    known = labels.where("quality is not null or toxic is not null").groupBy(id.alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    taught = pages.join(known, "page_id").select(F.concat(url_tokens, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    taught = scratch.write(taught, "taught")
    index = scratch.write(mine(taught, max(support, least / max(taught.count(), 1)), confidence), "index")
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    urls = pages.select("_url", "host", "path").distinct().select("_url", url_tokens.alias("items"))
    bad = scratch.write(urls.join(matched(urls, index), "items", "left_semi").select(F.col("_url"), F.lit(True).alias("_hit")), "bad")
    out = pages.join(bad, "_url", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("mined"))
