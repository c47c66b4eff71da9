import hashlib
import random

import numpy as np

from locuspark.llm.substring_dedup import anchors, spans, substring_dedup


def brute(rows, k=13):
    low = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[s : s + k])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and low[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{n}" for n in range(400)]
    passage = [[rng.choice(vocab) for _ in range(n)] for n in (12, 13, 14, 60, 30)]
    rows = [(0, None), (1, ""), (2, " ".join(["again"] * 40)), (3, " ".join(["again"] * 13)), (4, " ".join(["again"] * 12))]
    for i in range(5, 60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [rng.choice(vocab) for _ in range(rng.choice((0, 3, 20, 80)))]
            w += rng.choice(passage)[rng.choice((0, 0, 0, 3)) :]
        rows.append((i, rng.choice((" ", "\n", " \t")).join(w)))
    rows += [(60 + n, rows[20][1]) for n in range(3)] + [(90, rows[21][1] + " one more"), (91, "first " + rows[21][1])]
    rows += [(20, rows[20][1]), (None, rows[20][1]), (100, " ".join(rng.choice("ab") for _ in range(3000))), (101, " ".join(rng.choice("ab") for _ in range(3000)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, codes int")
    got = substring_dedup(docs).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows)
    for r in got:
        assert sum(b - a for a, b in zip(r.repeats[::2], r.repeats[1::2])) == r.n_removed


def test_repeated_ids_with_different_texts(spark):
    """Each row loses words by its own text; rows of one id take nothing from each other."""
    rng = random.Random(8)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(30)) for x in "ab")
    rows = [(1, a), (5, b), (5, a + " tail"), (5, b + " more"), (6, b), (6, a), (7, "x " + b + " y")]
    got = substring_dedup(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")).collect()
    assert sorted([(int(r.doc_id), *r[1:4]) for r in got]) == brute(rows)


def test_half_a_code_does_not_match(spark, monkeypatch):
    """Where all windows agree in the first half of their codes, the second keeps them apart."""
    from locuspark.llm import substring_dedup as m

    runs = m.run_codes
    monkeypatch.setattr(m, "run_codes", lambda words, k, salt=0: runs(words, k, salt) * np.uint64(k != 13 or salt != 0))
    rng = random.Random(9)
    same = [rng.choice("abcdefgh") for _ in range(40)]
    rows = [(i, " ".join([rng.choice("abcdefgh") for _ in range(60)] + same[i:])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    codes = m._windows(docs.selectExpr("doc_id", "1 twin", "text", "sequence(0, 80) at"), 13, 5).toPandas()
    assert len(codes) > 100 and set(codes["code"]) == {0}
    assert sorted([tuple(r)[:4] for r in substring_dedup(docs).collect()], key=str) == brute(rows)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 500).astype(np.uint64)
    _, at = anchors(words, 13, 5)
    assert all(((at >= s) & (at <= s + 8)).any() for s in range(len(words) - 12))
    assert len(anchors(words[:12], 13, 5)[0]) == 0


def test_spans():
    assert spans(np.array([30, 4, 5, 17, 31, 31]), 13).tolist() == [[4, 44]]
    assert spans(np.array([0, 20]), 13).tolist() == [[0, 13], [20, 33]]
    assert spans(np.empty(0, int), 13).tolist() == []
