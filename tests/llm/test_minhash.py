import random

import numpy as np
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, run_codes, word_codes
from locuspark.operators.components import connected_components
from locuspark.llm.minhash_dedup import minhash_dedup, shingle_set, signature


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    s = {i: sets(t, k) for i, t in rows if i is not None}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(sets(t, k)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"W{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two"), (7, "é É"), (8, "É é")]
    i = 9
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice((4, 12, 60, 300)))]
        for _ in range(rng.choice((1, 2, 6))):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    chain = [rng.choice(vocab) for _ in range(120)]
    for n in range(8):  # neighbours are alike, ends are not
        rows.append((i, " ".join(chain[n * 5 : n * 5 + 90])))
        i += 1
    rows += [(i + n, "hot " * 5 + "group of copies") for n in range(50)] + [(3, "one"), (None, "one two")]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, set_key string")
    for k in (2, 5):
        assert sorted(map(tuple, minhash_dedup(docs, words=k).collect()), key=str) == brute(rows, k)


def crowd(seed=5, copies=300, changed=80):
    """One text in many near copies, many that are changed more, and pairs of near copies among those."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(90)]

    def edit(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = rng.choice(vocab)
        return words

    rows = [" ".join(edit(base, rng.randrange(0, 5))) for _ in range(copies)]
    for _ in range(changed):
        far = edit(base, rng.randrange(5, 16))
        rows += [" ".join(far)] + [" ".join(edit(far, rng.randrange(0, 4))) for _ in range(rng.randrange(3))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_crowd_of_near_copies(spark):
    """Links between the components of a hot bucket are all found, in far fewer comparisons than there are pairs."""
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 3):
        want = brute(rows, k)
        assert 30 < len({r[2] for r in want}) < 150
        assert sorted(map(tuple, minhash_dedup(docs, words=k).collect()), key=str) == want


def test_across_compares_few_pairs(spark, monkeypatch):
    from locuspark.llm import minhash_dedup as m

    seen, plain = [], m.across
    monkeypatch.setattr(m, "across", lambda *a: seen.append(plain(*a)) or seen[-1])
    rows = crowd(copies=400, changed=100)
    m.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert seen[0].count() < 0.05 * 400 * 100


def test_across_joins_alike_nodes_by_few_pairs(spark):
    """Nodes that are alike, but unlike their head, come together without all pairs of them."""
    from locuspark.llm import minhash_dedup as m

    base = [f"w{i}" for i in range(100)]
    other = [*base[:40], *[f"x{i}" for i in range(11)], *base[51:]]
    texts = [(0, " ".join(base))] + [(k, " ".join([*other[: k % 35], f"y{k}", *other[k % 35 + 1 :]])) for k in range(1, 61)]
    pools = spark.createDataFrame([(0, k) for k in range(61)], "first long, node long")
    texts, none = spark.createDataFrame(texts, "node long, text string"), spark.createDataFrame([], "node long, root long")
    scratch = m.Scratch(spark)
    pairs = m.across(pools, none, texts, 2, 80, scratch).collect()
    assert len(pairs) < 200  # of 1,770
    links = m.verify(spark.createDataFrame(pairs, "a long, b long"), texts, 2, 80)
    assert sorted(map(tuple, m.connected_components(links, scratch).collect())) == [(k, 1) for k in range(1, 61)]


def test_repeated_ids_with_different_texts(spark):
    """Every row is judged by its own text."""
    rng = random.Random(6)
    a, b, c = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (5, a), (7, b + " x"), (9, c), (9, a + " y"), (9, c), (8, c + " z")]
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2, tagged=True)
    tag = {r.tag: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("tag")).collect()}
    assert sorted((r.doc_id, tag[r.tag], r.component_id, r.kept) for r in got.collect()) == sorted(
        [(1, a, 1, True), (5, b, 5, True), (5, a, 1, False), (7, b + " x", 5, False), (9, c, 8, False), (9, a + " y", 1, False), (9, c, 8, False), (8, c + " z", 8, True)]
    )
    rows = [(5, a), (5, b), (3, b + " x"), (6, a + " y")]  # one id stands for two sets
    got = minhash_dedup(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string"), words=2)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [("3", "3"), ("5", "3"), ("5", "5"), ("6", "5")]


def test_empty(spark):
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signature_is_circulant_and_estimates_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    x, y = signature(a, 240), signature(b, 240)
    assert abs((x == y).mean() - 2400 / 3600) < 0.12


def test_word_codes():
    t = "Ab ab aB\x0bab\x1cx é a a\xa0b".encode()
    w, low = word_codes(t), word_codes(t, lower=True)
    words = t.split()
    assert len(w) == len(words)
    assert [(x == y) for x in w for y in w] == [(x == y) for x in words for y in words]
    lower = t.lower().split()
    assert [(x == y) for x in low for y in low] == [(x == y) for x in lower for y in lower]
    assert len(run_codes(w, 3)) == len(w) - 2 and len(run_codes(w, 99)) == 0
    assert len(shingle_set(b"one", 5)) == 1 and len(shingle_set(b" ", 5)) == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
