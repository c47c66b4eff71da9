"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts, a vector for each document. Trees are grown on histograms of binned values from a
bounded sample of labelled rows, then flattened into arrays (split feature, threshold, children, value), which numpy walks
for all documents of a batch at once, level by level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import Words, as_bytes, held_out, run_codes
from locuspark.llm.token_counts import slices

#: Labelled rows that a fit looks at, at most; those with the smallest hash of their id.
SAMPLE = 30_000

_KIND = np.zeros(256, np.int64)
for _set, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), ((32, 9, 11, 12), 4), ((10, 13), 5), (b".,;:?'\"-()", 6), (b"!", 7), (range(128, 256), 8), (b"#$%&*+/<=>@[\\]^_`{|}~", 9)):
    _KIND[list(_set)] = _k
_KINDS = np.eye(10, dtype=np.int64)[_KIND]

#: Or-ed over a word's bytes: 1 with upper-case letters, 2 with lower-case ones.
_CASE = bytes(1 if 65 <= x < 91 else 2 if 97 <= x < 123 else 0 for x in range(256))

FEATURES = [
    "log_bytes", "lower", "upper", "digit", "space", "newline", "plain_punct", "exclaim", "high", "symbol", "control",
    "log_words", "word_len", "word_len_sd", "longest", "distinct_words", "top_word", "short_words", "long_words", "upper_words",
    "lines", "distinct_lines", "words_a_line", "ends_with_stop", "most_lines", "distinct_pairs", "top_byte", "byte_entropy",
]


def statistics(text: bytes) -> list[float]:
    """The statistics named in FEATURES; all 0 for an empty text."""
    return matrix([text])[0].tolist()


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty((0, len(FEATURES))), *[measure(Words(block)) for block in slices(texts)]])


def _runs(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each of the spans first[i]:last[i] has, and how often its most frequent one is there."""
    new = np.ones(len(codes) + 1, np.int64)
    for f, g in zip(first.tolist(), last.tolist()):
        codes[f:g].sort()
    new[1:-1] = codes[1:] != codes[:-1]
    new[first] = new[last] = 1
    before = np.cumsum(new) - new  # of the runs, how many begin earlier
    runs = np.append(np.diff(np.flatnonzero(new)), 0)
    most = np.zeros(len(first), np.int64)
    some = np.flatnonzero(last > first)
    if len(some):  # what lies between two spans would be counted with the first of them, so each span's end is given too
        most[some] = np.maximum.reduceat(runs, np.column_stack([before[first[some]], before[last[some]]]).ravel())[::2]
    return before[last] - before[first], most


def measure(words: Words) -> np.ndarray:
    """The statistics of each text. Words and pairs of words are told apart by 64-bit codes."""
    starts, ends, first = words.starts, words.ends, words.first
    w, sizes, codes = np.diff(first), ends - starts, words.codes()
    pairs = run_codes(codes, 2)
    last = np.maximum(first[1:] - 1, first[:-1])  # a text's last word begins no pair
    distinct_pairs, _ = _runs(pairs, np.minimum(first[:-1], len(pairs)), np.minimum(last, len(pairs)))
    distinct, top = _runs(codes, first[:-1], first[1:])
    case = np.bitwise_or.reduceat(np.frombuffer(words.raw.translate(_CASE), np.uint8), starts) if len(starts) else starts

    def among(which: np.ndarray) -> np.ndarray:
        n = np.concatenate([[0], np.cumsum(which)])[first]
        return np.diff(n)

    short, long, upper = among(sizes <= 2), among(sizes > 12), among(case == 1)
    longest = np.zeros(len(w), np.int64)
    if len(sizes):
        longest[w > 0] = np.maximum.reduceat(sizes, first[:-1][w > 0])
    mean = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first]) / np.maximum(w, 1)
    counts, entropy, sd = np.zeros((len(w), 256), np.int64), [], []
    lines, different, most, stops = np.zeros((4, len(w)), np.int64)
    for i, (at, n, f, g, m) in enumerate(zip(words.at.tolist(), words.sizes.tolist(), first.tolist(), first[1:].tolist(), mean.tolist())):
        counts[i] = c = np.bincount(words.bytes[at : at + n], minlength=256)
        used = c[c > 0] / max(n, 1)
        entropy.append(float(-(used * np.log2(used)).sum()))
        apart = sizes[f:g] - m
        sd.append(math.sqrt(float((apart * apart).sum()) / max(g - f, 1)))
        has = [x for x in words.raw[at : at + n].split(b"\n") if x]
        seen = Counter(has)
        lines[i], different[i], most[i] = len(has), len(seen), max(seen.values(), default=0)
        stops[i] = sum([x.endswith((b".", b"!", b"?")) for x in has])
    n, k, rows = np.maximum(words.sizes, 1), np.maximum(w, 1), np.maximum(lines, 1)
    kinds = (counts @ _KINDS) / n[:, None]
    columns = [np.log1p(words.sizes), *kinds.T[1:10], kinds[:, 0]]
    columns += [np.log1p(w), mean, sd, np.log1p(longest), distinct / k, top / k, short / k, long / k, upper / k]
    columns += [np.log1p(lines), different / rows, w / rows, stops / rows, most / rows]
    columns += [distinct_pairs / np.maximum(1, w - 1), counts.max(1) / n, entropy]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Flattened trees; a leaf is its own child, so a walk of ``depth`` steps ends in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smallest: float = 3.0, l2: float = 2.0) -> Trees:
    """Boost logistic loss; splits are chosen on histograms of at most ``bins`` quantile bins."""
    n, f = x.shape if x.size else (0, len(FEATURES))
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.empty(0) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1) if n else np.empty((0, f), np.int64)
    offset = np.arange(f) * bins
    nodes: list[list] = []  # feature, threshold, left, right, value

    def leaf(v: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, left: int) -> int:
        g, h = grad[rows], hess[rows]
        G, H = g.sum(), h.sum()
        if left and len(rows):
            flat = (binned[rows] + offset).ravel()
            hg = np.bincount(flat, np.repeat(g, f), f * bins).reshape(f, bins).cumsum(1)
            hh = np.bincount(flat, np.repeat(h, f), f * bins).reshape(f, bins).cumsum(1)
            ok = (hh >= smallest) & (H - hh >= smallest)
            gain = np.where(ok, hg**2 / (hh + l2) + (G - hg) ** 2 / (H - hh + l2) - G**2 / (H + l2), 0)
            for j in range(f):
                gain[j, len(edges[j]) :] = 0
            j, b = divmod(int(gain.argmax()), bins)
            if gain[j, b] > 1e-6:
                me = leaf(0.0)
                goes = binned[rows, j] <= b
                a, c = grow(rows[goes], left - 1), grow(rows[~goes], left - 1)
                nodes[me] = [j, float(edges[j][b]), a, c, 0.0]
                return me
        return leaf(float(-rate * G / (H + l2)))

    roots, raw = [], np.full(n, base)
    everyone = np.arange(n)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = q - y, q * (1 - q)
        roots.append(grow(everyone, depth))
        one = _pack(nodes, roots[-1:], depth, 0.0)
        raw += one.raw(x)
    return _pack(nodes, roots, depth, base)


def _pack(nodes: list[list], roots: list[int], depth: int, base: float) -> Trees:
    a = np.asarray(nodes, np.float64).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.asarray(roots, np.int64), depth, base)


def usable_labels(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """doc_id (of the type it has in docs), _y: one known label for each id; of several the largest."""
    id = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    return labels.select(id.alias("doc_id"), F.col(target).cast("double").alias("_y")).where("_y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("_y").alias("_y"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, target: str, sample: int, fold: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` labelled rows outside the fold: the only rows that reach the driver."""
    known = usable_labels(docs, labels, target)
    if fold is not None:
        known = known.where(~held_out(F.col("doc_id"), fold))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so small that broadcasting it is safe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), batch.column(2)], ["y", "x", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "_y", "doc_id").mapInArrow(run, f"y double, x array<double>, doc_id {kind}").toPandas()
    got["key"] = [tuple(v) for v in got["x"]]
    got = got.sort_values(["doc_id", "key"])  # the same trees whatever the order of partitions
    x = np.stack(got["x"].to_numpy()) if len(got) else np.empty((0, len(FEATURES)))
    return x, got["y"].to_numpy(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", fold: int | None = 0, threshold: float = 0.3, sample: int = SAMPLE, tagged: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; other columns take no part).

    The model learns from labels (doc_id, target) of rows whose crc32(doc_id as text) mod 5 is not ``fold``; a label that
    is null or whose document is missing is not used. Null and empty texts have statistics 0 and a score like any other.
    A null doc_id is scored and in no fold; ids may be of any type; repeated rows score alike, each row by its own text; of
    repeated labels the largest counts. A score equal to the threshold is predicted 1. Without usable labels of both kinds
    every score is the smoothed share of label 1. An empty table gives none. With ``tagged`` the column tag follows, the 64-bit
    hash of the text, which with doc_id tells rows apart.
    """
    model = fit(*labelled_statistics(docs, labels, target, sample, fold))
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.predict(matrix(as_bytes(batch.column(2))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["doc_id", "tag", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, tag long, score double")
    return scored.select(*(["tag"] if tagged else []), "doc_id", held_out(F.col("doc_id"), -1 if fold is None else fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
