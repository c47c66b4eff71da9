"""Repeated passages by seed and extend, over words.

Seeds are winnowed anchors: of every 7 consecutive runs of 7 words, the one with the smallest code. Any 13-word window
holds 7 such runs, so two documents that share a window share its anchor: joining documents on anchors loses no match.
Where an anchor is shared, each document extends it both ways to every window whose anchor it is. These windows are matched by
codes of their whole word sequence, not pair by pair: first by 64 bits, then those that match by 128 (two polynomials over
different word codes); a window is repeated if its sequence also starts in a document with a smaller doc_id. Among 10^13
windows the chance of one false match is about 10^-13. Overlapping repeated windows chain into maximal repeats, which are kept.

Each join is an aggregation by code (with map-side combine, so a passage that a third of all documents share arrives as
one row from each task) followed by an equi-join back, whose large side Spark may split; no pairs of documents are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, as_bytes, run_codes, word_codes

WINDOW, SEED = 13, 7
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and positions of the winnowed anchors of a text (none if it is shorter than a window)."""
    runs = run_codes(words, seed)
    at = np.unique(_lowest(runs, window - seed + 1))
    return runs[at].view(np.int64), at.astype(np.int32)


def _lowest(runs: np.ndarray, span: int) -> np.ndarray:
    """Where each window's anchor lies: the first of its runs with the smallest code."""
    if len(runs) < span:
        return np.empty(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1)
    return low + np.arange(len(low))


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


#: Runs and windows are coded twice, over word codes that differ by this salt.
SALT = 0x5851F42D4C957F2D


def _describe(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, tag, n_words, sha (of the words joined by spaces), anchor codes and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, codes, at = [], [], [], []
            for text in as_bytes(batch.column(2)):
                words = text.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                c, p = anchors(word_codes(text), window, seed) if len(words) >= window else (np.empty(0, np.int64), np.empty(0, np.int32))
                codes.append(c)
                at.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), _lists(codes, pa.int64()), _lists(at, pa.int32())], ["doc_id", "tag", "n_words", "sha", "codes", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tag long, n_words long, sha binary, codes array<long>, at array<int>")


def window_codes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit codes of a text's windows, from its word codes."""
    return run_codes(words, window).view(np.int64), run_codes(words, window, SALT).view(np.int64)


def _windows(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """Every window whose anchor is shared: its 64-bit code, doc_id, twin and first word; texts: doc_id, twin, text, at."""

    def starts(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        s = np.flatnonzero(np.isin(_lowest(run_codes(words, seed), window - seed + 1), at))
        return s, [run_codes(words, window).view(np.int64)[s]]

    return _coded(texts.select("doc_id", "twin", "text", "at"), starts, ["code"])


def _confirm(texts: DataFrame, window: int) -> DataFrame:
    """The 128-bit codes of the windows at given first words; texts: doc_id, twin, text, starts."""

    def codes(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return starts, [x[starts] for x in window_codes(words, window)]

    return _coded(texts.select("doc_id", "twin", "text", "starts"), codes, ["code", "code2"])


def _coded(texts: DataFrame, work: Callable, names: list[str]) -> DataFrame:
    """names, doc_id, twin, start for the windows that work(word codes, numbers) picks, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ids, starts, held = [[] for _ in names], [], [], 0
            for k, (text, at) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3))):
                s, found = work(word_codes(text), np.asarray(at.values))
                for out, x in zip(codes, found):
                    out.append(x)
                ids.append(np.full(len(s), k))
                starts.append(s)
                held += len(s)
                if held > 200_000 or k == batch.num_rows - 1:
                    rows = pa.array(np.concatenate(ids))
                    columns = [*(pa.array(np.concatenate(x)) for x in codes), *(batch.column(j).take(rows) for j in (0, 1)), pa.array(np.concatenate(starts).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "doc_id", "twin", "start"])
                    codes, ids, starts, held = [[] for _ in names], [], [], 0

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, "".join(f"{x} long, " for x in names) + f"doc_id {kind}, twin int, start int")


def _shared(found: DataFrame, key: list[str]) -> DataFrame:
    """key, low: the codes that start in several documents, and the smallest of these."""
    return found.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*key, "low")


def spans(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal repeats [first word, past the last] from the starts of repeated windows."""
    s = np.unique(starts)
    new = np.flatnonzero(np.diff(s, prepend=s[:1] - window - 1) > window)
    return np.column_stack([s[new], np.append(s[new[1:] - 1], s[-1:]) + window]) if len(s) else np.empty((0, 2), np.int64)


def _remove(texts: DataFrame, window: int) -> DataFrame:
    """Cut maximal repeats out of texts (doc_id, tag, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, where = [], [], []
            for text, starts in zip(as_bytes(batch.column(2)), batch.column(3)):
                words, kept, last = text.split(), [], 0
                cut = spans(np.asarray(starts.values), window)
                for a, b in cut.tolist():
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                where.append(cut.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(sha), _lists(where, pa.int32())], ["doc_id", "tag", "n_removed", "kept_sha256", "repeats"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "tag", "text", "starts").mapInArrow(run, f"doc_id {kind}, tag long, n_removed long, kept_sha256 string, repeats array<int>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats for each row of docs (doc_id, text; other columns take no part).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. repeats holds the maximal removed stretches as first, past-last, first, past-last ... word
    numbers. Null and empty texts have no words; texts shorter than a window keep all. Every row is judged by its own text:
    repeated rows have the same answer each, rows that share a doc_id take nothing from each other whatever their texts, and
    a row with null doc_id neither loses words nor takes any. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")  # the tag tells texts of one id apart
    row = ["doc_id", "tag"]
    base = scratch.write(_describe(docs, window, seed), "base")

    summary = scratch.write(base.select(*row, "n_words", "sha"), "summary")

    # a copy of a document with a smaller id loses every word; only first copies go further
    whole = base.where("doc_id is not null").where(F.col("n_words") >= window)
    first = scratch.write(whole.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "first")
    copies = whole.select(*row, "sha").join(first, "sha").where("doc_id > first").select(*row).distinct()
    copies = scratch.write(copies, "copies")

    seeds = whole.select(*row, F.explode(F.arrays_zip("codes", "at")).alias("s")).select(*row, F.col("s.codes").alias("code"), F.col("s.at").alias("at"))
    shared = seeds.groupBy("code").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("code")
    shared = scratch.write(shared, "shared")  # apart from its aggregation, so that Spark can split the join's other side
    scratch.release()
    hits = seeds.join(shared.hint("shuffle_hash"), "code").select(*row, "at")
    hits = scratch.write(hits.groupBy(*row).agg(F.sort_array(F.collect_set("at")).alias("at")), "hits")
    scratch.drop(base, shared)
    scratch.release()
    hits = hits.join(copies, row, "left_anti").withColumn("twin", F.row_number().over(Window.partitionBy("doc_id").orderBy("tag")))
    texts = scratch.write(docs.join(hits.hint("shuffle_hash"), row).dropDuplicates(row), "texts")
    scratch.release()

    text = ["doc_id", "twin"]
    found = scratch.write(_windows(texts, window, seed), "windows")
    lowest = scratch.write(_shared(found, ["code"]), "lowest")
    scratch.release()
    some = found.join(lowest.select("code").hint("shuffle_hash"), "code")
    some = scratch.write(some.groupBy(*text).agg(F.collect_list("start").alias("starts")), "some")
    scratch.drop(found, lowest)
    scratch.release()
    found = scratch.write(_confirm(texts.join(some, text), window), "confirmed")
    lowest = scratch.write(_shared(found, ["code", "code2"]), "lowest")
    scratch.drop(some)
    scratch.release()
    repeated = found.join(lowest.hint("shuffle_hash"), ["code", "code2"]).where("doc_id > low")
    starts = scratch.write(repeated.groupBy(*text).agg(F.collect_list("start").alias("starts")), "starts")
    scratch.drop(found, lowest)
    scratch.release()
    cut = scratch.write(_remove(texts.select(*row, "twin", "text").join(starts, text), window), "cut")
    scratch.drop(texts, starts)

    out = summary.select(*row, "n_words", F.lower(F.hex("sha")).alias("sha")).join(cut, row, "left").join(copies.withColumn("copy", F.lit(True)), row, "left")
    n = F.col("n_words")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), n).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.array(F.lit(0), n.cast("int"))).otherwise(F.coalesce("repeats", F.array().cast("array<int>"))).alias("repeats"),
    )
