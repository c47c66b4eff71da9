"""Context-tree weighting over bytes.

A text is its words, lower-cased in A-Z, each followed by a space, then a newline as its end. Every byte is eight binary
decisions, most significant bit first. For each decision and each context of the last 0..D bytes the model has a
Krichevsky-Trofimov estimate (a + 1/2) / (a + b + 1) from counts over the whole training corpus; a node's weight against
its deeper contexts is the posterior of its own block probability, as in context-tree weighting with prior 1/2. A
prediction mixes the estimates of all depths along the path, down to the deepest context that training saw.

Counts of (D + 1)-grams hold all of this: shallower contexts are their marginals, and a binary node's counts are sums over a
range of next bytes. All grams stay in a table. Contexts that share their nearest bytes make a subtree of their own, so tasks
build the tree in parts by these bytes; above the parts are only contexts of fewer bytes, whose number does not grow. Values
of the most frequent grams are broadcast, those of others, seen or not, are computed by the parts and joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, as_bytes, held_out
from locuspark.llm.token_counts import slices

DEPTH = 5
#: Grams whose values are broadcast; the others are joined.
GRAMS = 4_000_000
#: Nearest bytes by which the tree is parted, and grams at which a part ends.
NEAR, PART = 2, 500_000
#: Words whose counts are broadcast; the others are joined.
FREQUENT = 1 << 17
_U = np.uint64


def normal(text: bytes) -> bytes:
    """The bytes that the model codes."""
    words = text.lower().split()
    return b" ".join(words) + b" \n" if words else b"\n"


def gram_codes(text: bytes, depth: int) -> np.ndarray:
    """A code for each byte of normal texts, one after the other: its context, nearest byte highest, then the byte.

    A text's first bytes have newlines as context, as if another text had just ended.
    """
    b = np.frombuffer(b"\n" * depth + text, np.uint8).astype(np.int64)
    n = len(text)
    out = b[depth - 1 : depth - 1 + n].copy()
    # behind an end of text nothing older is seen
    for d in range(2, depth + 1):
        out <<= 8
        out |= b[depth - d : depth - d + n]
    out <<= 8
    out |= b[depth:]
    return out


def text_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of several normal texts and where each begins; texts are kept apart by depth newlines."""
    gap = b"\n" * (depth - 1)
    joined = gap.join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = gram_codes(joined, depth)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + depth - 1)]) if len(texts) else np.empty(0, np.int64)
    keep = np.ones(len(codes), bool)
    ends = (starts + sizes)[:-1]
    for d in range(depth - 1):
        keep[ends + d] = False
    return codes[keep], np.concatenate([[0], np.cumsum(sizes[:-1])]) if len(texts) else starts


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 1/2, by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    z = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + z * (1 / 12 - z * z * (1 / 360 - z * z / 1260)) - shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


class Lookup:
    """An open-addressed table from codes to values."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(codes) * 2).bit_length())
        self.shift, mask = _U(64 - bits), (1 << bits) - 1
        keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = keys[slot] == -1
            keys[slot[free]] = codes[left[free]]  # of several, one stays
            placed = keys[slot] == codes[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & mask
        self.keys = keys

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's value, 0 for those not here, and the places of these."""
        mask = len(self.keys) - 1
        slot = self._slot(codes)
        found = self.keys[slot]
        out = self.values[slot].astype(np.float64)
        left = np.flatnonzero(found != codes)
        slot = slot[left]
        unknown = [np.empty(0, np.int64)]
        out[left] = 0
        while len(left):
            empty = self.keys[slot] == -1
            unknown.append(left[empty])
            left, slot = left[~empty], (slot[~empty] + 1) & mask
            hit = self.keys[slot] == codes[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out, np.concatenate(unknown)


class ContextTree:
    """A trained model, or the part of one from depth ``least`` down. codes: sorted grams of ``depth`` bytes of context, counts: theirs."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, least: int = 0, below: tuple[np.ndarray, np.ndarray] | None = None):
        """below: nodes at ``depth`` and the summed log values of their children, which are in other parts."""
        self.depth, self.least, self.below, self.lookup = depth, least, below, None
        self.grams, self.sums = [None] * (depth + 1), [None] * (depth + 1)
        level = (codes, counts.astype(np.float64))
        for d in range(depth, least - 1, -1):
            if d < depth:
                c, n = level
                c = ((c >> np.int64(16)) << np.int64(8)) | (c & np.int64(255))  # drop the oldest byte of context
                u, i = np.unique(c, return_inverse=True)
                level = (u, np.bincount(i, n, len(u)))
            self.grams[d], self.sums[d] = level[0], np.concatenate([[0.0], np.cumsum(level[1])])
        self._weigh()

    def _counts(self, d: int, context: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
        """How often one of the bytes low..low+width-1 followed the context of d bytes."""
        first = (context << 8) | low
        a = np.searchsorted(self.grams[d], first)
        return self.sums[d][np.searchsorted(self.grams[d], first + width)] - self.sums[d][a]

    def _weigh(self) -> None:
        """Weights of nodes above the deepest, bottom up; a node's key is its context, then its bits behind a leading 1.

        Nodes of different bits never meet in a tree, so the eight places of a bit are weighed one after the other. ``above``
        are the nodes one byte shallower than the part, and the summed log values of their children in it.
        """
        self.nodes, self.weights = [[None] * 8 for _ in range(self.depth + 1)], [[None] * 8 for _ in range(self.depth + 1)]
        tops, values = [], []
        for k in range(8):
            child = value = None
            if self.below is not None:
                at = (self.below[0] & 255) >> k == 1
                child, value = self.below[0][at], self.below[1][at]
            for d in range(self.depth, self.least - 1, -1):
                codes = self.grams[d]
                keys = np.unique(((codes >> 8) << 8) | (1 << k) | ((codes & 255) >> (8 - k)))
                low, half = ((keys & 255) << (8 - k)) & 255, 128 >> k
                own = _log_kt(self._counts(d, keys >> 8, low, half), self._counts(d, keys >> 8, low + half, half))
                if child is not None:
                    up = child if d == self.depth else _parents(child)
                    deep = np.bincount(np.searchsorted(keys, up), value, len(keys))
                    self.nodes[d][k], self.weights[d][k] = keys, (1 / (1 + np.exp(np.clip(deep - own, -700, 700)))).astype(np.float32)
                    own = np.logaddexp(own, deep) - np.log(2)
                child, value = keys, own
            tops.append(child)
            values.append(value)
        nodes, i = np.unique(_parents(np.concatenate(tops)), return_inverse=True)
        self.above = nodes, np.bincount(i, np.concatenate(values), len(nodes))

    def log10(self, codes: np.ndarray, top: ContextTree | None = None) -> np.ndarray:
        """log10 probability of each code's byte in its context: all depths mixed, from the definition; a part's need the top."""
        total = np.zeros(len(codes))
        context, byte = codes >> 8, codes & 255
        for k in range(8):
            node = (1 << k) | (byte >> (8 - k))
            low = (node << (8 - k)) & 255
            half = 128 >> k
            bit = (byte >> (7 - k)) & 1
            p = np.full(len(codes), np.nan)
            for tree in (self,) if top is None else (self, top):
                for d in range(tree.depth, tree.least - 1, -1):
                    c = context >> (8 * (self.depth - d))
                    zero, one = tree._counts(d, c, low, half), tree._counts(d, c, low + half, half)
                    kt = (np.where(bit, one, zero) + 0.5) / (zero + one + 1)
                    deeper = ~np.isnan(p)
                    nodes = tree.nodes[d][k]
                    if nodes is not None and len(nodes):
                        at = np.minimum(np.searchsorted(nodes, (c << 8) | node), len(nodes) - 1)
                        w = tree.weights[d][k][at]
                        mixed = w * kt + (1 - w) * p
                    else:
                        mixed = kt
                    # the deepest context that has seen this decision starts the mixture; depth 0 always has an estimate
                    p = np.where(deeper, mixed, np.where((zero + one > 0) | (d == 0), kt, np.nan))
            total += np.log10(p)
        return total

    def score(self, codes: np.ndarray) -> np.ndarray:
        """As log10; grams seen in training come from a table."""
        if self.lookup is None:
            self.lookup = Lookup(self.grams[self.depth], self.log10(self.grams[self.depth]))
        out, unseen = self.lookup.find(codes)
        if len(unseen):
            u, i = np.unique(codes[unseen], return_inverse=True)
            out[unseen] = self.log10(u)[i]
        return out


def _parents(nodes: np.ndarray) -> np.ndarray:
    """Nodes without the oldest byte of their contexts."""
    return ((nodes >> np.int64(16)) << np.int64(8)) | (nodes & np.int64(255))


def _count_grams(docs: DataFrame, depth: int) -> DataFrame:
    """code, n: the grams of all texts, summed over each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for block in slices(as_bytes(batch.column(0))):
                u, n = np.unique(text_codes([normal(t) for t in block], depth)[0], return_counts=True)
                at = np.searchsorted(codes, u)
                known = codes[np.minimum(at, max(0, len(codes) - 1))] == u if len(codes) else np.zeros(len(u), bool)
                counts[at[known]] += n[known]
                if not known.all():
                    codes, counts = np.insert(codes, at[~known], u[~known]), np.insert(counts, at[~known], n[~known])
                if len(codes) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])
                    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                counts.update(text.lower().split())
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _floor(words: DataFrame, most: int) -> float:
    """A count that at most ``most`` words reach, from a histogram with sixteen steps to a doubling."""
    step = F.floor(F.log2("n") * 16).cast("long")
    left, floor = most, None
    for step, n in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        floor = step
    return float("inf") if floor is None else 2 ** (floor / 16) - 1e-6


def _cut(batches: Iterator[pa.RecordBatch], shift: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """code, n of a partition sorted by code, in parts of about ``size`` rows that hold all rows of a code >> shift."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        cut = int(np.searchsorted(code >> shift, code[-1] >> shift))  # the last may go on
        if rows + cut >= size and (cut or held[-1][0][-1] >> shift != code[0] >> shift):
            yield tuple(np.concatenate(x) for x in zip(*held, (code[:cut], n[:cut])))
            held, rows, code, n = [], 0, code[cut:], n[cut:]
        held.append((code, n))
        rows += len(code)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _by_parts(rows: DataFrame, depth: int, size: int, work, schema: str) -> DataFrame:
    """work(tree, codes, n) over parts of rows (code, n); n is 0 for codes that are asked for and not in the tree."""
    near = min(NEAR, depth)
    shift = 8 * (depth + 1 - near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _cut(batches, shift, size):
            yield from work(lambda: ContextTree(code[n > 0], n[n > 0], depth, near), code, n)

    return rows.select("code", "n").repartition(F.shiftright("code", shift)).sortWithinPartitions("code").mapInArrow(run, schema)


def _batch(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _fetch(df: DataFrame, *kinds: type) -> list[np.ndarray]:
    """The columns of df on the driver, which sees one binary row for each Arrow batch, not a row object for each number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], names)

    names = df.columns
    parts: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for row in df.mapInArrow(pack, ", ".join(f"{x} binary" for x in names)).toLocalIterator():
        for part, raw, kind in zip(parts, row, kinds):
            part.append(np.frombuffer(raw, kind))
    return [np.concatenate(x) for x in parts]


def _top(grams: DataFrame, depth: int, size: int) -> ContextTree:
    """The tree above the parts: contexts of less than NEAR bytes, 2^16 nodes at most, with what all parts tell of theirs."""
    d = min(NEAR, depth) - 1
    short = F.shiftleft(F.shiftright("code", 8 * (depth + 1 - d)), 8) + F.col("code").bitwiseAND(255)
    code, n = _fetch(grams.groupBy(short.alias("code")).agg(F.sum("n").alias("n")).coalesce(1), np.int64, np.int64)
    nodes = _by_parts(grams, depth, size, lambda tree, code, n: _batch(["node", "value"], *tree().above), "node long, value double")
    below = _fetch(nodes.groupBy("node").agg(F.sum("value").alias("value")).coalesce(1), np.int64, np.float64)
    order = np.argsort(code)
    return ContextTree(code[order], n[order], d, 0, tuple(below))


def _values(rows: DataFrame, depth: int, size: int, shared, floor: float) -> DataFrame:
    """code, value of the rows asked for (n = 0) and of grams that are seen at least ``floor`` times."""

    def work(tree, code, n):
        want = code[(n == 0) | (n >= floor)]
        if len(want):
            tree, top = tree(), shared.value
            for i in range(0, len(want), 100_000):
                yield from _batch(["code", "value"], want[i : i + 100_000], tree.log10(want[i : i + 100_000], top).astype(np.float32))

    return _by_parts(rows, depth, size, work, "code long, value float")


_TABLES: dict[str, Lookup] = {}


def _table(token: str, codes: np.ndarray, values: np.ndarray) -> Lookup:
    """This worker's table of the broadcast values; one at a time."""
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = Lookup(codes, values)
    return _TABLES[token]


def lm_scores(docs: DataFrame, fold: int = 1, depth: int = DEPTH, frequent: int = FREQUENT, most: int = GRAMS, size: int = PART) -> DataFrame:
    """Score each row of docs (doc_id, text; other columns take no part) by a model of the rows outside the fold.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. A token is a word, lower-cased in
    A-Z, or the end of a text. base_score is the smoothed unigram log10 probability; score the context tree's. A null or
    empty text is its end alone. A null doc_id is in no fold. Repeated rows count, and are scored, each. With nothing to learn
    from, every decision has probability 1/2. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), fold).alias("held_out"))
    learn = docs.where("not held_out")
    words = scratch.write(_count_words(learn), "words")
    total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learn.count()
    total, different = total + ends, different + (ends > 0)
    scale = total + 0.5 * (different + 1)
    top = words.where(F.col("n") >= _floor(words, frequent)).toPandas()
    known = dict(zip(map(bytes, top["word"]), np.log10((top["n"].to_numpy(np.float64) + 0.5) / scale).tolist()))
    end = float(np.log10((ends + 0.5) / scale))
    scratch.release()
    grams = scratch.write(_count_grams(learn, depth), "grams")
    top = spark.sparkContext.broadcast(_top(grams, depth, size))
    often = scratch.write(_values(grams, depth, size, top, _floor(grams, most)), "often")
    shared = spark.sparkContext.broadcast((*_fetch(often, np.int64, np.float32), known))
    scratch.drop(often)
    scratch.release()
    token = scratch.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values, known = shared.value
        table = _table(token, codes, values)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_tokens, n_known, base, score, size, rare, tf, cuts = [], [], [], [], [], [], [], [0]
            odd, odd_n = [], []
            for block in slices(as_bytes(batch.column(1))):
                normals = [normal(t) for t in block]
                codes, starts = text_codes(normals, depth)
                value, unknown = table.find(codes)
                score += np.add.reduceat(value, starts).tolist()
                unknown.sort()
                ends_at = np.searchsorted(unknown, [*starts[1:], len(codes)])
                for i, j in zip([0, *ends_at[:-1]], ends_at):
                    u, n = np.unique(codes[unknown[i:j]], return_counts=True)
                    odd.append(u)
                    odd_n.append(n)
                size += map(len, normals)
                for t in normals:
                    ws = t.split()
                    got = list(map(known.get, ws))
                    if None in got:
                        misses = Counter([w for w, v in zip(ws, got) if v is None])
                        rare += misses
                        tf += misses.values()
                        got = [v for v in got if v is not None]
                    cuts.append(len(rare))
                    n_tokens.append(len(ws) + 1)
                    n_known.append(len(got) + (ends > 0))
                    base.append(sum(got) + end)
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            score = np.asarray(score, np.float64)
            cuts = pa.array(np.asarray(cuts, np.int32))
            odd_cuts = pa.array(np.cumsum([0, *map(len, odd)]).astype(np.int32))
            odd, odd_n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (odd, odd_n))
            columns = [pa.array(ids), batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cuts, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64())), pa.ListArray.from_arrays(odd_cuts, pa.array(odd)), pa.ListArray.from_arrays(odd_cuts, pa.array(odd_n))], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "size", "rare", "tf", "odd", "odd_n"]
    found = scratch.write(docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, size long, rare array<binary>, tf array<long>, odd array<long>, odd_n array<long>"), "scored")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.tf").alias("tf"))
    value = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(scale)))
    sums = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * value).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    sums = scratch.write(sums, "sums")
    scratch.drop(words)
    scratch.release()
    odd = found.select("row", F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).select("row", F.col("x.odd").alias("code"), F.col("x.odd_n").alias("times"))
    asked = grams.unionByName(odd.select("code").distinct().withColumn("n", F.lit(0).cast("long")))
    values = scratch.write(_values(asked, depth, size, top, float("inf")), "values")
    odd = scratch.write(odd.join(values, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more_score")), "odd")
    scratch.drop(grams, values)
    scratch.release()
    out = found.drop("rare", "tf", "odd", "odd_n").join(sums, "row", "left").join(odd, "row", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
