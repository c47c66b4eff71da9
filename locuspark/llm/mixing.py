"""Mixing to target weights with soft membership.

Domains come from the labelled table: low (quality 0), toxic (quality 1, toxic 1) and clean. A classifier fitted on a
bounded sample of labelled rows predicts each document's posteriors over domains: boosted trees on its statistics say how
likely it is low, a logistic model on words, and beginnings of words, that set toxic rows apart says how likely it is toxic. Document rates r >= 0
then minimise the squared distance of expected domain token totals, sum_i r_i t_i p_ik, from the targets, each as a share of
what its domain holds, so that a small domain counts like a large one, with a small pull towards 1, by projected gradient
steps with momentum, until rates settle. A step needs only one residual for each domain, so each is one small aggregation
over the table of posteriors, and a document's rate follows from the residuals so far: no rates are kept or moved.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, Words, as_bytes
from locuspark.llm.quality import FEATURES, SAMPLE, fit, labelled_statistics, measure, usable_labels
from locuspark.llm.token_counts import slices

DOMAINS = ["clean", "toxic", "low"]
#: All weight on clean documents; the budget is what they hold: a filter, for the pipeline.
TARGETS = {"clean": 1.0, "toxic": 0.0, "low": 0.0}
#: A mixture of as many tokens as there are: clean documents more than once, low ones less often, toxic ones not at all.
MIXTURE = {"clean": 0.9, "toxic": 0.0, "low": 0.1}
WORDS, PULL = 3000, 0.01
#: A feature counts this often in a text at most; that is part of what a feature is, not a limit on texts.
MOST = 3
#: Steps go on until none moves a rate by more than TOLERANCE, which leaves rates within TOLERANCE / PULL of the solution, as
#: the objective's curvature is at least PULL and at most 1 + PULL. That takes some tens of steps; STEPS without it is an error.
TOLERANCE, STEPS = 1e-5, 1000
_PUNCTUATION = string.punctuation.encode()


def _features(text: bytes) -> dict[bytes, int]:
    """How often a text has each word, without the punctuation around it, and each beginning of 5 and of 8 bytes; at most MOST."""
    counts: Counter[bytes] = Counter()
    for word, n in Counter(text.lower().split()).items():
        for x in _parts(word):
            counts[x] += n
    counts.pop(b"", None)
    return {w: min(n, MOST) for w, n in counts.items()}


def _parts(word: bytes) -> list[bytes]:
    """The features of one word."""
    w = word.strip(_PUNCTUATION)
    return [w, *[b"^" + w[:k] for k in (5, 8) if len(w) > k]]


#: Words whose features a worker remembers, at most.
SEEN = 300_000


class Parts(dict):
    """The features of words, each word taken apart once while at most ``limit`` are remembered."""

    limit = SEEN

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple([x for x in _parts(word) if x])
        return found

    def of(self, text: bytes) -> set[bytes]:
        """The features that a text has."""
        return set().union(*map(self.__getitem__, set(text.lower().split())))


class Weighted(Parts):
    """Of the features of words, those with weights."""

    def __init__(self, weights: dict[bytes, float], limit: int):
        self.weights, self.limit = weights, limit
        self.starts = {x[1:] for x in weights if x[:1] == b"^"}  # beginnings of 5 and of 8 bytes; no word begins with ^

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= self.limit:
            self.clear()
        w, weights, starts = word.strip(_PUNCTUATION), self.weights, self.starts
        found = ()
        if w in weights or w[:5] in starts or w[:8] in starts:
            found = tuple([x for x in _parts(word) if x in weights and x])
        self[word] = found
        return found


#: Rounds of stripping all words together; longer runs of punctuation are stripped word by word.
ROUNDS = 4
_IS_PUNCTUATION = np.isin(np.arange(256), list(_PUNCTUATION))
#: By size, which of a word's first 8 bytes are its own.
_MASK = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _stripped(low: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end without the punctuation around them. A word of punctuation alone ends where it begins."""
    b, a, z = np.frombuffer(low, np.uint8), starts.copy(), ends.copy()
    some = np.flatnonzero(_IS_PUNCTUATION[b[a]])
    for _ in range(ROUNDS):
        a[some] += 1
        some = some[a[some] < z[some]]
        some = some[_IS_PUNCTUATION[b[a[some]]]]
    for k in some.tolist():
        a[k] = z[k] - len(low[a[k] : z[k]].lstrip(_PUNCTUATION))
    some = np.flatnonzero((a < z) & _IS_PUNCTUATION[b[z - 1]])  # these hold something else too
    for _ in range(ROUNDS):
        z[some] -= 1
        some = some[_IS_PUNCTUATION[b[z[some] - 1]]]
    for k in some.tolist():
        z[k] = a[k] + len(low[a[k] : z[k]].rstrip(_PUNCTUATION))
    return a, z


def _heads(low: bytes, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; low has 8 bytes more behind its words."""
    return np.ndarray(len(low) - 7, "<u8", low, strides=(1,))[at]


class Among:
    """Which numbers may be among some, by a table of bits of their hashes: never false for one that is."""

    def __init__(self, members: list[int]):
        self.table = np.zeros(1 << 16, bool)
        self.table[self._places(np.asarray(members, np.uint64))] = True

    @staticmethod
    def _places(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.table[self._places(x)]


class WordScorer:
    """Log-odds of texts from the weights of their features; words that have been seen are not taken apart again."""

    def __init__(self, weights: dict[bytes, float], limit: int = SEEN):
        self.weights, self.known = weights, Weighted(weights, limit)

        def among(words: Iterable[bytes], k: int) -> Among:
            return Among([int.from_bytes(w[:k], "little") for w in words])

        starts, whole = self.known.starts, [w for w in weights if w and w[:1] != b"^"]
        self.five, self.eight = among([*whole, *starts], 5), among(whole, 8)
        self.start_five, self.start_eight = among([x for x in starts if len(x) == 5], 5), among([x for x in starts if len(x) == 8], 8)

    def telling(self, words: Words) -> list[list[bytes]]:
        """Of each text's words, in lower case, those that may have weighted features; all that have some are among them.

        A word's first bytes tell most others from them, for all words at once.
        """
        low = words.raw.lower() + bytes(8)
        a, z = _stripped(low, words.starts, words.ends)
        size, x = z - a, _heads(low, a)
        at = np.flatnonzero(self.five(x & _MASK[np.minimum(size, 5)]))
        size, x = size[at], x[at]
        may = self.eight(x & _MASK[np.minimum(size, 8)])
        may |= (size > 5) & self.start_five(x & _MASK[5])
        may |= (size > 8) & self.start_eight(x)
        at = at[may]
        found = [low[i:j] for i, j in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        cut = np.searchsorted(at, words.first).tolist()
        return [found[i:j] for i, j in zip(cut, cut[1:])]

    def find(self, words: list[bytes]) -> dict[bytes, int]:
        """The weighted features of a text's lower-case words, and how often each is there, at most MOST."""
        total = Counter(chain.from_iterable(map(self.known.__getitem__, words)))
        return {x: n if n < MOST else MOST for x, n in total.items()}

    def score_words(self, words: list[bytes]) -> float:
        weights = self.weights
        # exactly rounded, so that the order of a set's members does not matter
        return math.fsum([weights[b""], *[weights[x] * n for x, n in self.find(words).items()]])

    def score(self, text: bytes) -> float:
        return self.score_words(text.lower().split())


def fit_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = WORDS) -> dict[bytes, float]:
    """Weights of at most ``most`` words, and under b"" the intercept: log-odds of toxic 1 by words and beginnings of words.

    Learns from at most ``sample`` labelled rows. Without rows of both kinds there are no words, and no toxic documents.
    """
    known = usable_labels(docs, labels, "toxic")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "_y")  # at most ``sample`` small rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts = (Counter(), Counter()), Parts()
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                seen[y > 0].update(parts.of(text))
                seen[y > 0][b""] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c.get(w, 0) for w in words], pa.int64()) for c in seen)], ["word", "no", "yes"])

    counts = taught.mapInArrow(count, "word binary, no long, yes long").groupBy("word").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    counts = counts.persist()  # of the sample only
    total = counts.where(F.col("word") == F.lit(b"")).first()
    if total is None or not total["yes"] or not total["no"]:
        return {b"": -35.0}
    odds = F.log((F.col("yes") + 0.5) / (total["yes"] + 1)) - F.log((F.col("no") + 0.5) / (total["no"] + 1))
    top = counts.where("yes >= 4").orderBy(F.desc(odds * F.sqrt("yes")), "word").limit(most + 1)
    vocabulary = {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in top.collect() if r["word"]))}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScorer(vocabulary)
        for batch in batches:
            found = [words.find(some) for block in slices(as_bytes(batch.column(0))) for some in words.telling(Words(block))]
            at = [sorted([4 * vocabulary[w] + n for w, n in f.items()]) for f in found]  # place and count
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), batch.column(1)], ["at", "y"])

    got = taught.mapInArrow(find, "at array<int>, y double").toPandas()
    counts.unpersist()
    rows = sorted((tuple(a), y) for a, y in zip(got["at"], got["y"]))  # the same weights whatever the order of partitions
    y = np.asarray([r[1] for r in rows])
    i = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    j = np.asarray([x for r in rows for x in r[0]], np.int64)
    j, n = j // 4, j % 4
    w, b = descend(i, j, n, y, len(vocabulary))
    return {b"": b} | {x: float(w[k]) for x, k in vocabulary.items()}


def descend(i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of y, by rows i, features j and their counts n: Adagrad on the penalised loss."""
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    step_w, step_b = np.full(size, 1e-8), 1e-8
    for _ in range(300):
        p = 1 / (1 + np.exp(-(b + np.bincount(i, w[j] * n, len(y)))))
        gw = np.bincount(j, (p - y)[i] * n, size) + 0.3 * w
        gb = float((p - y).sum())
        step_w, step_b = step_w + gw**2, step_b + gb**2
        w, b = w - 0.3 * gw / np.sqrt(step_w), b - 0.3 * gb / np.sqrt(step_b)
    return w, b


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, tag (the text's hash), tokens (words), p_clean, p_toxic, p_low, summing to 1, for each row of docs."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    trees = fit(*labelled_statistics(docs, labels, "quality", sample, None))
    shared = docs.sparkSession.sparkContext.broadcast((trees, fit_words(docs, labels, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, weights = shared.value
        words = WordScorer(weights)
        for batch in batches:
            x, raw, tokens = [np.empty((0, len(FEATURES)))], [], []
            for block in slices(as_bytes(batch.column(2))):
                found = Words(block)
                x.append(measure(found))
                raw += [words.score_words(some) for some in words.telling(found)]
                tokens += np.diff(found.first).tolist()
            low = 1 - trees.predict(np.concatenate(x))
            raw = np.asarray(raw, np.float64)
            toxic = (1 - low) / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.int64()), pa.array(1 - low - toxic), pa.array(toxic), pa.array(low)], ["doc_id", "tag", "tokens", "p_clean", "p_toxic", "p_low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tag long, tokens long, p_clean double, p_toxic double, p_low double")


def _settle(p: np.ndarray, residuals: list[np.ndarray], pull: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After a projected step for each residual so far: rates, where the next residual is taken, and the last step's moves."""
    rate, step = np.ones(len(p)), 1 / (1 + pull)
    root = np.sqrt(pull * step)
    at, moved = rate, np.full(len(p), np.inf)
    for e in residuals:
        after = np.maximum(0, at - step * (p @ e + pull * (at - 1)))
        moved = np.abs(after - at)
        at, rate = after + (1 - root) / (1 + root) * (after - rate), after
    return rate, at, moved


def _rates(p: np.ndarray, residuals: list[np.ndarray], pull: float) -> np.ndarray:
    """Rates after a projected step for each residual so far."""
    return _settle(p, residuals, pull)[0]


def fit_rates(table: DataFrame, targets: dict[str, float], budget: float | None = None, steps: int = STEPS, pull: float = PULL, tolerance: float = TOLERANCE, own: bool = False, share: float | None = None) -> list[np.ndarray]:
    """Residuals of each step: with them any document's rate follows from its posteriors.

    table: tokens, p_<domain>. The budget (expected tokens after mixing) is, unless given, what the domain of the largest
    target holds divided by its weight, or the given share of all expected tokens. Residuals are shares of all tokens or, with ``own``, of what the domain itself holds.
    """
    names = list(targets)
    columns = [F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{k}")), F.lit(0.0)) for k in names]
    held = np.asarray(table.agg(*columns).first(), np.float64)
    weights = np.asarray([targets[k] for k in names]) / max(sum(targets.values()), 1e-300)
    everything = max(held.sum(), 1.0)
    most = int(weights.argmax())
    if budget is None:
        budget = held[most] / weights[most] if share is None else share * held.sum()
    goal = weights * budget
    # a domain that holds nothing has no documents to move
    unit = np.where(held > 0, held, np.inf) if own else np.full(len(names), everything)
    residuals: list[np.ndarray] = []
    for _ in range(steps + 1):

        def sums(batches: Iterator[pa.RecordBatch], past=tuple(residuals)) -> Iterator[pa.RecordBatch]:
            total, most = np.zeros(len(names)), 0.0
            for batch in batches:
                p = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(names))])
                _, at, moved = _settle(p, list(past), pull)
                total += (at * batch.column(0).to_numpy()) @ p
                most = max(most, moved.max(initial=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*total, most]], [*names, "moved"])

        schema = ", ".join(f"{k} double" for k in [*names, "moved"])
        got = table.select("tokens", *[f"p_{k}" for k in names]).mapInArrow(sums, schema)
        *rows, moved = got.agg(*[F.coalesce(F.sum(k), F.lit(0.0)) for k in names], F.coalesce(F.max("moved"), F.lit(0.0))).first()
        if moved <= tolerance:
            return residuals
        residuals.append((np.asarray(rows, np.float64) - goal) / unit)
    raise RuntimeError(f"rates still move by {moved} after {steps} steps")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, sample: int = SAMPLE, steps: int = STEPS, pull: float = PULL, share: float | None = None, tagged: bool = False) -> DataFrame:
    """doc_id, tokens, p_clean, p_toxic, p_low, rate, copies for each row of docs (doc_id, text; other columns take no part).

    rate is how often the mixture should hold the document, copies the whole number below or above it that the document's
    hash chooses, so that the copies of many documents add up to their rates. Budget and share as for fit_rates. Null and empty texts have no
    tokens and a rate like any other. Null ids stay null, and ids may be of any type; repeated rows count each and have equal
    rates, each row by its own text; labels whose document is missing, and null labels, teach nothing. An empty table gives none. Posteriors are written once to the shared folder; all steps
    and the result read them there. With ``tagged`` the text's hash, tag, follows doc_id.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.write(posteriors(docs, labels, sample), "posteriors")
    names = list(targets)
    residuals = fit_rates(table, targets, budget, steps, pull, own=True, share=share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(f"p_{k}").to_numpy() for k in names]) if batch.num_rows else np.empty((0, len(names)))
            r = _rates(p, residuals, pull)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], [*batch.schema.names, "rate"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    out = table.mapInArrow(run, schema + ", rate double")
    lot = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(1 << 20)) / float(1 << 20)
    out = out.withColumn("copies", F.floor(F.col("rate") + lot).cast("long"))
    return out if tagged else out.drop("tag")


def totals(mixed: DataFrame, names: list[str] = DOMAINS) -> DataFrame:
    """domain, held, expected, drawn: the domains' expected tokens before mixing, by rates, and in the copies."""
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("domain"), F.col(f"p_{k}").alias("p")) for k in names])).alias("x")
    each = mixed.select("tokens", "rate", "copies", p)
    amount = F.col("tokens") * F.col("x.p")
    return each.groupBy("x.domain").agg(F.sum(amount).alias("held"), F.sum(amount * F.col("rate")).alias("expected"), F.sum(amount * F.col("copies")).alias("drawn"))
