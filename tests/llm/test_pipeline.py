import hashlib
import random

import pytest

import corpus_pipeline
from locuspark.llm.registry import table


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    d, out = "/root/testdata/sf0.01", []
    docs = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return d, out


def test_stages(spark, steps):
    d, out = steps
    before = table(spark, d, "documents")
    columns = before.columns
    labels = {r.doc_id: r for r in table(spark, d, "labels").collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    ids = [set(texts), *[{r.doc_id for r in x.select("doc_id").collect()} for x in out]]
    assert all(x.columns == columns for x in out[:-1])
    gone = ids[0] - ids[1]
    assert gone and all(labels[i].quality == 0 for i in gone if i in labels)
    assert not {i for i in ids[1] if i in labels and labels[i].quality == 0}

    best = {}
    for i in ids[1]:
        h = hashlib.sha256((texts[i] or "").encode()).digest()
        best[h] = max(best.get(h, -1), i)
    assert ids[2] == set(best.values())

    left = sorted(ids[2])
    s = {i: shingles(texts[i]) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(left):
        for j in left[n + 1 :]:
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * 5 >= max(len(s[i]), len(s[j])) * 4 and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids[3] == {i for i in left if find(i) == i}

    kept = [i for i in ids[3] if i in labels and labels[i].quality == 1]
    assert sum(i in ids[4] for i in kept if not labels[i].toxic) >= 0.99 * sum(not labels[i].toxic for i in kept)
    assert sum(i in ids[4] for i in kept if labels[i].toxic) <= 0.1 * sum(labels[i].toxic for i in kept)
    assert ids[5] == ids[4]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, tmp_path, monkeypatch):
    """Null ids and texts, repeated rows, ids that repeat with other texts, a very long text, clashing columns."""
    rng = random.Random(3)
    d = "/root/testdata/sf0.001"
    plain = [r for r in table(spark, d, "documents").collect() if r.lang == "en" and len(r.text or "") > 300][:30]
    a, b = plain[0].text, plain[1].text
    long = " ".join(rng.choice(b.split()) for _ in range(300_000))
    rows = [(r.doc_id, r.text) for r in plain] + [(9001, a), (9001, b + " and more"), (9002, "A " + a), (9003, long), (9003, long), (None, None), (None, a), (9004, None), (9005, ""), (9006, " ")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, tag long, kept int, copies int")
    texts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert out.columns == docs.columns
            texts.append(sorted(((r.doc_id, r.text) for r in out.collect()), key=str))
            docs = out
    quality, exact, near, _ = texts
    assert set(quality) <= set(rows)
    best = {}
    for i, t in quality:
        if i is not None:
            best[t or ""] = max(i, best.get(t or "", i))
    assert [x for x in exact if x[0] is not None] == sorted({(i, t) for i, t in quality if i is not None and best[t or ""] == i}, key=str)
    assert [x for x in exact if x[0] is None] == [x for x in quality if x[0] is None]
    assert (9001, b + " and more") in exact and (9001, a) in exact
    # near copies of a and b: the smallest id of each group stays
    assert not {(9002, "A " + a)} & set(near)
    assert (9001, a) in near and (9001, b + " and more") not in near and (plain[1].doc_id, b) in near


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
