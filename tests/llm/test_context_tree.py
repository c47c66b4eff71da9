import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from locuspark.llm.context_tree import ContextTree, lm_scores, normal, text_codes


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Slow:
    """The tree by its definition, one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            t = b"\n" * depth + t
            for i in range(depth, len(t)):
                node = 1
                for k in range(8):
                    bit = (t[i] >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.n[(t[i - d : i], node)][bit] += 1
                    node = 2 * node + bit
        self.children = defaultdict(list)
        for c, node in list(self.n):
            if c:
                self.children[(c[1:], node)].append((c, node))
        self.memo = {}

    def deep(self, key):
        return sum(self.weighted(x) for x in self.children[key])

    def weighted(self, key):
        if key not in self.memo:
            own = kt(*self.n[key])
            self.memo[key] = own if len(key[0]) == self.depth else np.logaddexp(own, self.deep(key)) - math.log(2)
        return self.memo[key]

    def log10(self, t):
        t, total = b"\n" * self.depth + t, 0.0
        for i in range(self.depth, len(t)):
            node = 1
            for k in range(8):
                bit = (t[i] >> (7 - k)) & 1
                p = None
                for d in range(self.depth, -1, -1):
                    key = (t[i - d : i], node)
                    a, b = self.n.get(key, (0, 0))
                    if a + b == 0 and d:
                        continue
                    est = ((b if bit else a) + 0.5) / (a + b + 1)
                    if p is None:
                        p = est
                    else:
                        w = 1 / (1 + math.exp(self.deep(key) - kt(a, b)))
                        p = w * est + (1 - w) * p
                total += math.log10(p)
                node = 2 * node + bit
        return total


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tree_is_its_definition(depth):
    texts = [normal(t) for t in (b"the cat sat on the mat", b"the dog", b"", b"a cat \xc3\xa9\xc3\xa9")]
    codes, _ = text_codes(texts, depth)
    u, n = np.unique(codes, return_counts=True)
    tree, slow = ContextTree(u, n, depth), Slow(texts, depth)
    for t in [*texts, normal(b"the rat sat"), normal(b"zebra \xff\xfe")]:
        c, _ = text_codes([t], depth)
        assert tree.score(c).sum() == pytest.approx(slow.log10(t), abs=2e-3)
        assert tree.log10(c).sum() == pytest.approx(slow.log10(t), abs=1e-6)


def test_predictions_sum_to_one():
    texts = [normal(b"abab abba banana band")] * 3
    u, n = np.unique(text_codes(texts, 3)[0], return_counts=True)
    tree = ContextTree(u, n, 3)
    for context in (b"aba", b"ban", b"\n\n\n", b"zzz", b"xba"):
        k = int.from_bytes(context[::-1], "big")
        assert (10 ** tree.log10((k << 8) + np.arange(256, dtype=np.int64))).sum() == pytest.approx(1)


def test_no_training():
    tree = ContextTree(np.empty(0, np.int64), np.empty(0, np.int64), 3)
    assert tree.score(text_codes([b"ab\n"], 3)[0]).sum() == pytest.approx(-24 * math.log10(2))


def test_codes_keep_texts_apart():
    texts = [b"ab\n", b"\n", b"c d \n"]
    together, starts = text_codes(texts, 4)
    alone = [text_codes([t], 4)[0] for t in texts]
    assert together.tolist() == np.concatenate(alone).tolist() and starts.tolist() == [0, 3, 4]


def test_scores(spark):
    rows = [(i, f"word{i % 7} the The a{i % 3} café\tnew{i}") for i in range(60)] + [(60, None), (61, ""), (None, "the end"), (5, "word5 the"), (5, "word5 the")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, row long, score int")
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, ends = Counter(), 0
    for (_, t), h in zip(rows, held):
        if not h:
            c.update((t or "").encode().lower().split())
            ends += 1
    N, V = sum(c.values()) + ends, len(c) + 1
    value = lambda n: math.log10((n + 0.5) / (N + 0.5 * (V + 1)))
    want = []
    for (i, t), h in zip(rows, held):
        w = (t or "").encode().lower().split()
        want.append((i, h, len(w) + 1, sum(c[x] > 0 for x in w) + 1, N, round(sum(value(c[x]) for x in w) + value(ends), 6)))
    for frequent in (3, 1000):
        got = lm_scores(docs, frequent=frequent).collect()
        assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == sorted(want, key=str)
        assert all(r.score < 0 for r in got)
    assert lm_scores(docs.limit(0)).collect() == []


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_every_gram_counts_however_few_are_broadcast(spark, depth):
    """Scores are those of the whole tree when most grams are joined, and when the tree is built in many parts."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 9))) for _ in range(150)] + ["éé", "ß"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(120)] + [(None, "zz top"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    texts = [normal((t or "").encode()) for _, t in rows]
    u, n = np.unique(text_codes([t for t, h in zip(texts, held) if not h], depth)[0], return_counts=True)
    tree = ContextTree(u, n, depth)
    want = sorted(tree.log10(text_codes([t], depth)[0]).sum() for t in texts)
    for most, size in ((0, 50), (60, 50), (10**6, 10**6)):
        got = lm_scores(docs, depth=depth, most=most, size=size).collect()
        assert sorted(r.score for r in got) == pytest.approx(want, rel=1e-5)
        assert all(r.bits_per_byte > 0 for r in got)


def test_held_out_texts_code_shorter_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm_scores(docs).where("held_out").toPandas()
    print("held-out log10 per text: base", got.base_score.mean(), "tree", got.score.mean(), "bits a byte", got.bits_per_byte.median())
    assert got.score.sum() > got.base_score.sum()
