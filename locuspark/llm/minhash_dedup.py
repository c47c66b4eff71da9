"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates: sigma scatters a document's shingles over a fixed universe, and coordinate k is the
smallest value of pi, shifted circularly by k, on them. The shifts of one shingle lie side by side in pi, so a signature
is the minimum of contiguous rows. Coordinates form bands; documents that agree in a band may be linked.

Documents with the same shingles are one node. In a band's bucket every node is compared with the bucket's smallest one, its
head. Where that leaves the nodes that meet a head in several components, a link across components can only be between sets
that differ from the head's set in the same shingles: if W = 100 * (shingles of the head that a set lacks) + percent * (shingles
that the head lacks), two sets are alike exactly when (100 + percent) * (differences that both have) is at least the sum of
their W less (100 - percent) * (size of the head's set), and of two nodes in different components one at least is unlike the
head, which makes that bound positive. So differences are indexed, rarest first, only as far as a partner could still reach
the bound (a prefix filter with positions), and only pairs that meet there are compared: first each node with two of those
that it meets, then, where that has left different components, all pairs across them, each at the first difference they share. Every two nodes that share a bucket
thus end in one component, have been compared, or cannot be alike; a large group of near copies costs one comparison for each
member. Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, as_bytes, mix, run_codes, word_codes
from locuspark.operators.components import connected_components

#: 40 bands of 6 coordinates: two documents at similarity 0.8 share no band with probability 0.738^40 = 5e-6.
BANDS, ROWS = 40, 6
UNIVERSE = 1 << 20

_TABLES: dict[int, tuple] = {}


def _permutations(k: int) -> tuple:
    if k not in _TABLES:
        rng = np.random.default_rng(20)
        sigma = rng.permutation(UNIVERSE).astype(np.int64)
        pi = rng.permutation(UNIVERSE).astype(np.uint32)
        around = np.concatenate([pi, pi[: k - 1]])
        _TABLES[k] = sigma, np.lib.stride_tricks.sliding_window_view(around, k)
    return _TABLES[k]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct codes of a text's shingles; with fewer words the whole sequence is one."""
    codes = word_codes(text, lower=True)
    return np.unique(run_codes(codes, min(words, len(codes)))) if len(codes) else codes


def signature(codes: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of a set."""
    sigma, shifts = _permutations(k)
    at = sigma[(codes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, shifts[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tag, n, set_key (a 128-bit digest of the whole set), bands for each row of docs (doc_id, tag, text).

    An empty set (null, empty or blank text) has no bands; a null id, and repeated rows, are rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, out = [], [], []
            for text in as_bytes(batch.column(2)):
                codes = shingle_set(text, words)
                n.append(len(codes))
                keys.append(blake2b(codes.tobytes(), digest_size=16).digest())
                out.append(band_keys(signature(codes, bands * rows), bands) if len(codes) else np.empty(0, np.int64))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
            values = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(cuts, values)], ["doc_id", "tag", "n", "set_key", "bands"])

    docs = docs.select("doc_id", "tag", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, n long, set_key binary, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with text_a and text_b; a node without text is not in it."""
    t = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    u = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(u, "b").join(t, "a")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 * intersection >= percent * union; texts: node, text, one row a node.

    Pairs with a node that has no text are left out; repeated pairs are answered each; no pairs give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, one = [], None, None
            for ta, tb in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if ta != last:
                    last, one = ta, shingle_set(ta, words)
                two = shingle_set(tb, words)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return _with_texts(pairs, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _differences(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """head, node, root, size (of the head's set), w, codes for pairs (a: head, b: node, root): where their sets differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, w, codes, last, one = [], [], [], None, None
            for ta, tb in zip(as_bytes(batch.column(3)), as_bytes(batch.column(4))):
                if ta != last:
                    last, one = ta, shingle_set(ta, words)
                two = shingle_set(tb, words)
                gone, new = np.setdiff1d(one, two, assume_unique=True), np.setdiff1d(two, one, assume_unique=True)
                size.append(len(one))
                w.append(100 * len(gone) + percent * len(new))
                codes.append(np.concatenate([gone, new]).view(np.int64))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int32))
            values = pa.array(np.concatenate(codes) if codes else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(w, pa.int64()), pa.ListArray.from_arrays(cuts, values)], ["head", "node", "root", "size", "w", "codes"])

    kind = pairs.schema["a"].dataType.simpleString()
    rows = _with_texts(pairs, texts).select("a", "b", "root", "text_a", "text_b")
    return rows.mapInArrow(run, f"head {kind}, node {kind}, root {kind}, size long, w long, codes array<long>")


def across(pools: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that met the same head, are in different components, and may be alike.

    pools: first (a head), node, each pair once, the head with itself too; links between a head and its nodes are in roots (node,
    root) already. A node that roots lacks is a component of its own. Nothing is left out but pairs that cannot be alike.
    """
    at = scratch.write(pools.join(roots, "node", "left").select("first", "node", F.coalesce("root", "node").alias("root")), "at")
    # the largest component of each head's nodes: pairs across components have a node outside it
    counts = at.groupBy("first", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("first").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"))
    # with two nodes there is only the pair with the head, which has been compared
    largest = scratch.write(largest.where("parts > 1 and c > 2").select("first", "main"), "largest")
    open_ = at.join(largest.select("first"), "first").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), "root")
    table = scratch.write(_differences(open_, texts, words, percent), "differences")
    scratch.release()

    both, spare = 100 + percent, 100 - percent
    found = table.join(largest.withColumnRenamed("first", "head"), "head").withColumn("other", F.col("root") != F.col("main"))
    least = found.groupBy("head").agg(F.min("w").alias("least"), F.min(F.when(F.col("other"), F.col("w"))).alias("least_other"))
    least = scratch.write(least.where("least_other is not null"), "least")
    frequent = found.select("head", F.explode("codes").alias("code")).groupBy("head", "code").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    frequent = scratch.write(frequent, "frequent")  # a difference that one node alone has meets nobody
    single = found.select("head", "node", F.explode("codes").alias("code")).join(frequent, ["head", "code"])
    common = single.groupBy("head", "node").agg(F.sort_array(F.collect_list(F.struct("df", "code"))).alias("common"))
    rows = found.select("head", "node", "root", "other", "size", "w", F.size("codes").alias("n")).join(common, ["head", "node"]).join(least, "head")
    over = F.col("w") - spare * F.col("size")
    # the bound on shared differences that the easiest partner leaves; a partner's w is percent of its differences at least
    alone = F.col("n") - F.size("common")
    for name, easiest in (("upto_other", "least"), ("upto", "least_other")):
        bound = over + F.greatest(F.col(easiest), F.ceil(over * percent / 100))
        rows = rows.withColumn(name, (F.col("n") - F.greatest(F.lit(1), F.ceil(bound / both)) + 1 - alone).cast("int"))
    rows = rows.select("head", "node", "root", "other", "size", "w", F.col("common.code").alias("codes"), "upto", "upto_other")
    rows = scratch.write(rows, "ranked")
    scratch.drop(table, frequent)

    def index(df: DataFrame, upto: Column) -> DataFrame:
        df = df.select("head", "node", "root", "size", "w", F.size("codes").alias("m"), F.slice("codes", F.lit(1), F.greatest(upto, F.lit(0))).alias("prefix"))
        return df.select("*", F.posexplode("prefix").alias("at", "code")).withColumn("left", F.col("m") - F.col("at")).drop("m", "at")

    def may(x: str, y: str) -> str:
        return f"{x}root <> {y}root and {both} * least({x}left, {y}left) >= {x}w + {y}w - {spare} * {x}size"

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # first every node with two others at each difference: the one nearest to the head, and the one before it in the order
    # of what they have besides. Links found so join components, within which no pairs are compared.
    met = index(rows, F.when(F.col("other"), F.col("upto_other")).otherwise(F.col("upto")))
    one = F.struct("node", "root", "size", "w", "left")
    group = Window.partitionBy("head", "code")
    met = met.select(one.alias("x"), F.min_by(one, F.struct("w", "node")).over(group).alias("y"), F.lag(one).over(group.orderBy("prefix", "node")).alias("z"))
    few = met.select("x", F.explode(F.array("y", "z")).alias("y")).where("y is not null").where(may("x.", "y."))
    links = scratch.write(verify(few.select(*ordered("x.node", "y.node")).distinct(), texts, words, percent), "few")
    of = rows.select("node", "root").distinct()
    side = lambda k: of.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    joined = links.join(side("a"), "a").join(side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    joined = connected_components(joined, scratch).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rows = rows.join(largest.withColumnRenamed("first", "head"), "head")
    rows = rows.join(joined, "root", "left").join(joined.select(F.col("root").alias("main"), F.col("whole").alias("main_whole")), "main", "left")
    rows = rows.withColumn("root", F.coalesce("whole", "root")).withColumn("other", F.col("root") != F.coalesce("main_whole", "main"))
    rows = scratch.write(rows.drop("main", "whole", "main_whole"), "joined")

    # then all pairs that are left, each at the first difference that both have
    prefixed = lambda df, p: df.select("head", "code", *[F.col(c).alias(p + c) for c in df.columns if c not in ("head", "code")])
    xs, ys = prefixed(index(rows.where("other"), F.col("upto_other")), "x_"), prefixed(index(rows, F.col("upto")), "y_")
    pairs = xs.join(ys, ["head", "code"]).where(may("x_", "y_") + " and code = get(array_intersect(x_prefix, y_prefix), 0)")
    return links.unionByName(pairs.select(*ordered("x_node", "y_node")).distinct())


def _alike(a: str, b: str, percent: int) -> str:
    """Sizes that allow the similarity: the smaller set must have percent of the larger."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def minhash_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tagged: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns take no part).

    Texts are lower-cased in A-Z; a set holds the distinct runs of ``words`` words, or the whole sequence if it is
    shorter. A text without words (null, empty, white space) has an empty set and is linked with nothing. component_id is
    the smallest doc_id that links reach; kept is true there. Every row is judged by its own text: repeated rows have the same
    answer each, and rows that repeat a doc_id with different texts are documents of their own. A row with null doc_id
    takes no part: component_id null, kept. An empty table gives none. With ``tagged`` the column tag follows, the 64-bit
    hash of the text, which with doc_id tells rows apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    found = scratch.write(signatures(docs, words, bands, rows), "signatures")
    some = found.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "tag")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.write(nodes.select("set_key", "row.doc_id", "row.tag", "n", "bands"), "nodes")
    scratch.release()
    # an id that repeats with different texts can stand for several nodes, which its tag then tells apart
    twins = not nodes.groupBy("doc_id").count().where("count > 1").isEmpty()
    nodes = nodes.withColumn("node", F.struct("doc_id", "tag") if twins else F.col("doc_id"))

    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = entries.join(buckets.select("key", F.col("least.node").alias("first"), F.col("least.n").alias("first_n")), "key")
    pools = shared.groupBy("first", "node").agg(F.first("first_n").alias("first_n"), F.first("n").alias("n"))
    pools = scratch.write(pools, "pools")
    scratch.release()

    star = pools.where("node <> first").where(_alike("n", "first_n", percent)).select(F.col("first").alias("a"), F.col("node").alias("b"))
    # every node that a comparison of either kind may need
    wanted = pools.select("node").distinct().join(nodes.select("node", "doc_id", "tag"), "node")
    texts = docs.join(wanted, ["doc_id", "tag"]).select("node", "text").dropDuplicates(["node"])
    texts = scratch.write(texts, "texts")
    scratch.release()
    links = scratch.write(verify(star, texts, words, percent), "links")
    roots = scratch.write(connected_components(links, scratch), "roots")
    rest = scratch.write(across(pools.select("first", "node"), roots, texts, words, percent, scratch), "rest")
    more = scratch.write(verify(rest, texts, words, percent), "links")
    if not more.isEmpty():
        roots = scratch.write(connected_components(links.unionByName(more), scratch), "roots")
    scratch.release()

    # members of a node share its component
    root = F.coalesce("root", "node")
    of = nodes.select("set_key", "node").join(roots, "node", "left").select("set_key", (root["doc_id"] if twins else root).alias("root"))
    out = found.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(of, "set_key", "left")
    id = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), id.alias("component_id"), F.col("doc_id").eqNullSafe(id).alias("kept"), "tag")
    return out if tagged else out.drop("tag")
