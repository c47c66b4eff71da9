import numpy as np

from locuspark.llm.nn_descent import nearest


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.asarray(v, np.float32).astype(np.float64)
    ids = sorted(ok)
    m = np.stack([ok[i] for i in ids])
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = m @ m[n]
            order = sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-s[j], ids[j]))[:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def recall(got, want):
    hits = total = 0
    for q, answers in want.items():
        mine = {r.vec_id for r in got if r.query_id == q}
        hits += len(mine & {i for i, _ in answers})
        total += len(answers)
    return hits / total


def rows_of(n, seed=0, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, n)]
    if scale:
        x *= rng.uniform(0.2, 3, (n, 1))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_recall_and_exact_scores(spark):
    rows = rows_of(3000, scale=True)
    hot = rows[7][1]
    rows = [(i, hot if i % 5 == 0 else v) for i, v in rows]  # a fifth of all vectors are equal
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0]), (None, hot), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int").repartition(6)
    got = nearest(df, "vec_id % 20 = 0").collect()
    want = brute(rows, 20, 20)
    assert recall(got, want) > 0.95
    vectors = dict(rows)
    for q in list(want)[:20]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        assert all(abs(r.score - np.dot(np.float64(vectors[q]), np.float64(vectors[r.vec_id]))) < 1e-9 for r in mine)


def test_small_and_empty(spark):
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, "vec_id % 2 = 0").collect()
    want = brute(rows, 20, 2)
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == {q: [i for i, _ in a] for q, a in want.items()}
    assert nearest(df.limit(0), "vec_id % 2 = 0").collect() == []
    assert nearest(df.limit(1), "vec_id % 2 = 0").collect() == []


def test_queries_share_what_they_reach(spark, monkeypatch):
    from locuspark.llm import nn_descent

    rows = rows_of(2000, seed=3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    written, write = [], nn_descent.Scratch.write

    def watch(self, table, name):
        out = write(self, table, name)
        if name == "fresh":
            written.append(out.selectExpr("sum(size(near)) as n").first().n or 0 if "near" in out.columns else out.count())
        return out

    monkeypatch.setattr(nn_descent.Scratch, "write", watch)
    got = nearest(df, "vec_id % 5 = 0").collect()
    assert recall(got, brute(rows, 20, 5)) > 0.95
    # 400 queries in cells of up to 64, dealt over up to 8 partitions: no cell is sent a node's vector twice
    assert sum(written) < (400 // 64 + 8) * 2000


def test_ids_of_any_type(spark):
    rows = rows_of(300, seed=4)
    df = spark.createDataFrame([(f"{i:05d}", v) for i, v in rows], "vec_id string, embedding array<float>")
    got = nearest(df, "cast(vec_id as int) % 20 = 0").collect()
    want = brute(rows, 20, 20)
    assert {int(r.query_id) for r in got} == set(want)
    assert all([int(r.vec_id) for r in sorted(got, key=lambda r: r.rank) if int(r.query_id) == q] == [i for i, _ in a] for q, a in want.items())


def test_search_goes_on_where_the_best_lead_nowhere(spark):
    from locuspark.llm.common import Scratch
    from locuspark.llm.nn_descent import search

    vec = {i: np.asarray(v, np.float32).tobytes() for i, v in {0: [1, 0], 1: [0.9, 0], 2: [0.8, 0], 3: [2, 0]}.items()}
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in vec.items()], "node long, vec binary")
    graph = spark.createDataFrame([(0, [1, 2]), (1, [0, 2]), (2, [3]), (3, [2])], "node long, near array<long>")
    queries = nodes.where("node = 0").withColumnRenamed("node", "q")
    # 0 and 1, expanded first, lead to nothing new; 2 leads to the best
    found = search(graph, nodes, 2, queries, Scratch(spark), beam=8, expand=1).collect()
    assert [r.node for r in sorted(found, key=lambda r: -r.sim)] == [3, 0, 1, 2]


def test_few_passes_through_python(spark, monkeypatch):
    from locuspark.llm import nn_descent

    passes, write = {}, nn_descent.Scratch.write

    def watch(self, table, name):
        n = table._jdf.queryExecution().analyzed().toString().count("MapInArrow")
        passes[name] = max(n, passes.get(name, 0))
        return write(self, table, name)

    monkeypatch.setattr(nn_descent.Scratch, "write", watch)
    df = spark.createDataFrame(rows_of(500, seed=5), "vec_id long, embedding array<float>")
    nearest(df, "vec_id % 20 = 0").collect()
    # each costs every partition a worker's start, however few rows it has
    assert passes["graph"] == 3 and passes["fresh"] == 0 and passes["beam"] == 1


def test_cells_are_even(spark):
    from locuspark.llm.common import Scratch
    from locuspark.llm.nn_descent import _cells

    x = np.random.default_rng(6).normal(size=(65, 4)).astype(np.float32)
    queries = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "q long, vec binary").repartition(5)
    cells = {}
    for r in _cells(queries, 4, 16, Scratch(spark)).collect():
        cells.setdefault(r.cell, set()).add(r.q)
    assert sorted(len(c) for c in cells.values()) == [13] * 5 and len(set().union(*cells.values())) == 65
    assert _cells(queries.limit(0), 4, 16, Scratch(spark)).collect() == []
