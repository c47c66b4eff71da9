import hashlib
from collections import defaultdict

from locuspark.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        if i is not None:
            groups[t or ""].append(i)
    out = []
    for i, t in rows:
        sha = hashlib.sha256((t or "").encode()).hexdigest()
        g = groups[t or ""]
        out.append((i, None, 1, True, sha) if i is None else (i, max(g), len(g), i == max(g), sha))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    long = "prefix " * 9000
    texts = [None, "", "a", "a", "ab", "a" * 48, "a" * 48, "a" * 49, "é" * 24, long, long, long + "x", long + "y", long[:-1], "tail", "a" * 384, "a" * 384, "a" * 383]
    rows = list(enumerate(texts)) + [(2, "a"), (None, "a"), (None, None), (7, "different text, same id"), (100, "hot")] + [(i, "hot") for i in range(200, 300)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, group_size int, _rest string")
    got = sorted(map(tuple, exact_dedup(docs).collect()), key=str)
    assert got == brute(rows)
    got = sorted(map(tuple, exact_dedup(docs, first=1, widen=3).collect()), key=str)
    assert got == brute(rows)


def test_same_id_at_the_top_of_two_groups(spark):
    rows = [(9, "a" * 60 + "z"), (9, "b" * 60 + "z"), (1, "a" * 60 + "y"), (1, "b" * 60 + "z")]
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
