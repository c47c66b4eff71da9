import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.llm import mixing
from locuspark.llm.mixing import TARGETS, _rates, fit_rates, mix


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 0.3, 0.3], 400)
    t = rng.integers(1, 1000, 400)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p)], "tokens long, p_a double, p_b double, p_c double").repartition(3)
    targets = {"a": 0.5, "b": 0.4, "c": 0.1}
    got = _rates(p, fit_rates(table, targets, budget=float(t.sum()), steps=200), 0.01)
    # the same problem, by many plain steps in memory
    share, goal, r = t / t.sum(), np.array([0.5, 0.4, 0.1]), np.ones(400)
    for _ in range(20000):
        r = np.maximum(0, r - 0.5 * (p @ ((share * r) @ p - goal) + 0.01 * (r - 1)))

    def loss(r):
        return 0.5 * (((share * r) @ p - goal) ** 2).sum() + 0.005 * (share * (r - 1) ** 2).sum()

    assert (got >= 0).all() and loss(got) <= loss(r) + 1e-5
    assert np.abs((share * got) @ p - goal).max() < 0.03


def test_toxic_goes_and_clean_stays(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = mix(docs, labels.where(F.col("doc_id") % 3 != 0)).join(labels, "doc_id").where(F.col("doc_id") % 3 == 0).toPandas()
    got["low"] = got.quality == 0
    kept = got.rate >= 0.5
    clean, toxic = (got.quality == 1) & (got.toxic == 0), (got.quality == 1) & (got.toxic == 1)
    print("kept: clean", kept[clean].mean(), "toxic", kept[toxic].mean(), "low", kept[got.low].mean(), "rate", got.rate.max())
    assert kept[clean].mean() > 0.995 and kept[toxic].mean() < 0.1 and kept[got.low].mean() < 0.1
    assert (got.rate[clean] < 1.1).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x y", 5), (3, "x y", 5)], "doc_id long, text string, tokens int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, None, None), (99, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = mix(docs, labels).collect()
    assert len(got) == 5 and all(r.rate >= 0 and abs(r.p_clean + r.p_toxic + r.p_low - 1) < 1e-9 for r in got)
    assert mix(docs.limit(0), labels.limit(0)).collect() == []
    assert sum(TARGETS.values()) == 1


@pytest.mark.parametrize("toxic", [1, 10, 100, 300])
def test_a_small_domain_goes_by_its_posteriors(spark, monkeypatch, toxic):
    """With the query's own settings, whatever share of the tokens is toxic: 0.01, 0.1, 1 and 3 %."""
    p = [(0.005, 0.99, 0.005)] * toxic + [(0.998, 0.001, 0.001)] * (10000 - toxic)
    table = spark.createDataFrame([(i, 100, *x) for i, x in enumerate(p)], "doc_id long, tokens long, p_clean double, p_toxic double, p_low double").withColumn("tag", F.col("doc_id")).repartition(3)
    monkeypatch.setattr(mixing, "posteriors", lambda docs, labels, sample: table)
    got = sorted(mix(table, table).collect())
    assert all(r.rate < 0.5 for r in got[:toxic]) and all(0.5 <= r.rate < 1.5 for r in got[toxic:])
    # where the projected gradient is zero, to the tolerance: the rates solve it, so no further step would change them
    p, r, share = np.asarray(p), np.array([x.rate for x in got]), 1 / len(p)
    held = share * p.sum(0)
    e = (share * (r @ p) - held * [1, 0, 0]) / held
    assert np.abs(np.maximum(0, r - (p @ e + 0.01 * (r - 1))) - r).max() < 1e-4


def test_a_stop_short_of_the_solution_is_an_error(spark):
    table = spark.createDataFrame([(100, 0.9, 0.1), (10, 0.2, 0.8)], "tokens long, p_a double, p_b double")
    with pytest.raises(RuntimeError):
        fit_rates(table, {"a": 1.0, "b": 0.0}, steps=2)


def test_the_query_meets_its_targets(spark):
    """The totals of the registered query are within 1 % of the whole of what its targets ask, by rates and in copies."""
    from locuspark.llm.registry import op2_mixing

    mixed = op2_mixing(spark, "/root/testdata/sf0.1").persist()
    got = {r.domain: r for r in mixing.totals(mixed).collect()}
    whole = sum(r.held for r in got.values())
    print({k: (r.held / whole, r.expected / whole, r.drawn / whole) for k, r in got.items()})
    for k, share in mixing.MIXTURE.items():
        assert abs(got[k].expected / whole - share) < 0.01 and abs(got[k].drawn / whole - share) < 0.02
    assert mixed.where("copies > 1").count() > 0
    mixed.unpersist()


def test_words_are_fitted_as_by_plain_descent():
    """The adaptive steps end where plain gradient descent on the same penalised loss does."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (400, 12)).astype(float)
    y = (1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + 0.3 * x[:, 2] - 0.5))) > rng.random(400)).astype(float)
    i, j = np.nonzero(x)
    w, b = mixing.descend(i, j, x[i, j], y, 12)
    v, c = np.zeros(12), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(c + x @ v)))
        v, c = v - 0.0005 * (x.T @ (p - y) + 0.3 * v), c - 0.0005 * (p - y).sum()

    def loss(w, b):
        z = b + x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.15 * (w**2).sum()

    assert loss(v, c) <= loss(w, b) < 1.01 * loss(v, c) < 0.9 * loss(0 * v, 0)
    assert np.corrcoef(x @ w, x @ v)[0, 1] > 0.995


def test_scorer_remembers_words():
    texts = [b"Bad, bad badly-made things! (good) good", b"", b"  ", b"bad " * 5000, "é É bad.".encode(), b"goodness goodness"]
    weights = {b"": -1.0, b"bad": 0.5, b"^badly": 0.25, b"good": -0.75, b"^goodn": 0.1, b"x": 3.0}
    want = [weights[b""] + sum(weights[k] * n for k, n in mixing._features(t).items() if k in weights) for t in texts]
    for limit in (0, 2, 100):
        scorer = mixing.WordScorer(weights, limit)
        assert np.allclose([scorer.score(t) for t in texts * 3], want * 3)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(str(i), f"word{i} and more words {i % 3}") for i in range(30)], "doc_id string, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert mix(docs, labels).count() == 30


def test_words_are_taken_apart_once(monkeypatch):
    calls, parts = [], mixing._parts
    monkeypatch.setattr(mixing, "_parts", lambda word: calls.append(word) or parts(word))
    texts = [b"Alpha, beta! alphabetical (gamma)", b"alpha, BETA! ... ^caret alphabetical", b"", b"...", b"alpha, alpha, alpha, alpha, beta!"]
    known = mixing.Parts()
    found = [known.of(t) for t in texts]
    assert len(calls) == len(set(calls)) == len({w for t in texts for w in t.lower().split()})
    assert found == [set(mixing._features(t)) for t in texts]
    small = mixing.Parts()
    small.limit = 1
    assert [small.of(t) for t in texts] == found
    weights = {w: 1.0 for w in (b"", b"alpha", b"^alpha", b"^alphabet", b"gamma", b"caret")}
    for limit in (1, 100):
        scorer = mixing.WordScorer(weights, limit)
        assert [scorer.find(t.lower().split()) for t in texts] == [{w: n for w, n in mixing._features(t).items() if w in weights} for t in texts]


def test_only_words_that_may_tell_are_looked_at():
    """Texts scored by blocks score as their features say, and a word without features does not reach the scorer's memory."""
    from locuspark.llm.common import Words

    weights = {b"": -1.0, b"bad": 0.5, b"^badly": 0.25, b"good": -0.75, b"^goodn": 0.1, b"^unspeaka": 2.0, b"unspeakable-things": 1.5, b"\xc3\xa9": 0.3}
    odd = [b"Bad, bad badly-made badly things! (good) good", b"", b"  ", b"bad " * 50, "é É bad.".encode(), b"goodn goodness ^goodn", b"...", b"-" * 99 + b"bad" + b"!" * 99]
    odd += [b"unspeaka unspeakable UNSPEAKABLE-THINGS? unspeak", b"\x0bbad\x1cgood\x0c good\r\n", b"ba", b"'bad'", b"bad"]
    plain = [b" ".join(b"word%d, Other%d." % (i, k) for i in range(200)) for k in range(20)]
    texts = odd + plain + odd
    scorer = mixing.WordScorer(weights)
    got = [scorer.score_words(some) for some in scorer.telling(Words(texts))]
    want = [weights[b""] + sum(weights[k] * n for k, n in mixing._features(t).items() if k in weights) for t in texts]
    assert np.allclose(got, want, rtol=0, atol=1e-12) and got == [scorer.score(t) for t in texts]
    few = mixing.WordScorer(weights)
    found = {w for some in few.telling(Words(plain)) for w in some}
    assert len(found) < 0.02 * len(set(b" ".join(plain).split()))
    assert few.telling(Words([])) == [] and few.telling(Words([b""])) == [[]]
    assert [scorer.score_words(s) for s in mixing.WordScorer({b"": -35.0}).telling(Words(texts))][1] == -1.0
