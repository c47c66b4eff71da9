import numpy as np

from locuspark.llm.quality import FEATURES, fit, matrix, quality_scores, statistics


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_trees_fit_and_walk_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit(x[:2000], y[:2000])
    p = model.predict(x[2000:])
    assert auc(y[2000:], p) > 0.97

    def walk(root, row):
        while model.left[root] != root:
            root = model.left[root] if row[model.feature[root]] <= model.threshold[root] else model.right[root]
        return model.value[root]

    for row in x[:20]:
        raw = model.base + sum(walk(r, row) for r in model.roots)
        assert abs(raw - model.raw(row[None])[0]) < 1e-9


def test_statistics_are_finite():
    for t in (b"", b" ", b"\n\n", "é".encode() * 9, b"a" * 100_000, b"x\n" * 5000):
        s = statistics(t)
        assert len(s) == len(FEATURES) and np.isfinite(s).all()
    assert matrix([]).shape == (0, len(FEATURES))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = got["quality"].to_numpy(), got["score"].to_numpy()
    print("held out auc", auc(y, s), "accuracy", ((s >= 0.3) == y).mean())
    assert auc(y, s) > 0.9
    assert (got["predicted"][got["quality"] == 1]).mean() > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x y", 5), (3, "x y", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, None), (99, 0), (None, 0)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(docs.limit(0), labels.limit(0)).collect() == []


def test_statistics_of_many_texts_at_once():
    """Texts measured together have the statistics that each has by plain counting, whatever stands beside it."""
    from collections import Counter

    from locuspark.llm.common import Words
    from locuspark.llm.quality import measure

    texts = [b"", b" ", b"one", b"", b"One TWO one two TWO", b"a b a b a b.", b"\n\n", b"x\n" * 50, b"A1 B-2 c3", b"\x0b\x0c\r one\x1c two", b"q " + b"Z" * 70_000 + b" q " + b"Z" * 70_000, b"last"]
    texts += [" ".join(f"W{i % k} é{i % 3}" for i in range(400)).encode() for k in range(1, 9)]
    for some in (texts, texts[::-1], texts[:1], texts[2:3]):
        got = measure(Words(some))
        assert (got == np.concatenate([matrix([t]) for t in some])).all()
        for t, row in zip(some, got):
            s, words = dict(zip(FEATURES, row.tolist())), t.split()
            n, lines = max(1, len(words)), [x for x in t.split(b"\n") if x]
            assert np.isclose(s["log_words"], np.log1p(len(words))) and np.isclose(s["longest"], np.log1p(max(map(len, words), default=0)))
            assert s["distinct_words"] == len(set(words)) / n and s["top_word"] == max(Counter(words).values(), default=0) / n
            assert s["distinct_pairs"] == len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
            assert s["upper_words"] == sum(map(bytes.isupper, words)) / n and s["short_words"] == sum(len(w) <= 2 for w in words) / n
            assert s["top_byte"] == max(Counter(t).values(), default=0) / max(1, len(t)) and s["distinct_lines"] == len(set(lines)) / max(1, len(lines))
            assert np.isclose(s["word_len_sd"], np.std([len(w) for w in words]) if words else 0)
