"""Operators on small literals and against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.functions import kernels as K
from locuspark.operators import genotypes as G
from locuspark.operators import graphs, ordered, selection
from locuspark.operators import intervals as I
from locuspark.sources import sinks, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_keeps_adjacent_apart(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 9, 12), ("c", 2, 3), ("d", 1, 1)], "k string, sta long, end long")
    assert rows(I.merge_intervals(df, ["k"], "sta", "end")) == [("c", 1, 8, 3), ("c", 9, 12, 1), ("d", 1, 1, 1)]
    assert rows(I.merge_intervals(df, ["k"], "sta", "end", 1)) == [("c", 1, 12, 4), ("d", 1, 1, 1)]


def test_range_join_against_brute_force(spark):
    rng = random.Random(0)
    a = [(rng.choice("xy"), i, s := rng.randrange(500), s + rng.randrange(80)) for i in range(80)]
    b = [(rng.choice("xy"), i, s := rng.randrange(500), s + rng.randrange(80)) for i in range(80)]
    x, y = spark.createDataFrame(a, "k string, i long, s1 long, e1 long"), spark.createDataFrame(b, "k string, j long, s2 long, e2 long")
    for width in (1, 7, 1000):
        got = rows(I.range_join(x, y, ["k"], "s1", "e1", "s2", "e2", width).select("i", "j"))
        assert got == sorted(((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3]), key=repr)
    left = I.range_join(x, y, ["k"], "s1", "e1", "s2", "e2", 20, how="left")
    assert {r.i for r in left.collect()} == set(range(80))


def test_run_length_and_sessions(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 4, "a"), (1, 5, "b")], "hap int, pos int, v string")
    assert rows(I.run_length(df, ["hap"], "pos", "v")) == [(1, "a", 1, 2, 2), (1, "a", 4, 4, 1), (1, "b", 5, 5, 1)]
    p = spark.createDataFrame([(1, x) for x in (1, 5, 14, 24)], "k int, pos int")
    assert rows(I.sessions(p, ["k"], "pos", 10)) == [(1, 1, 14, 3), (1, 24, 24, 1)]


def test_tiles_partition_a_segment(spark):
    df = spark.createDataFrame([(1, 10, 10 + n) for n in (0, 3, 14, 15, 99, 104)], "k int, sta long, end long").withColumn("k", F.col("end"))
    for k, part in itertools.groupby(sorted(I.tile(df, "sta", "end", 10).collect(), key=lambda r: (r.k, r.tile)), key=lambda r: r.k):
        part = list(part)
        assert part[0].tile_sta == 10 and part[-1].tile_end == k
        assert all(a.tile_end + 1 == b.tile_sta for a, b in zip(part, part[1:]))


def test_nearest(spark):
    rng = random.Random(3)
    a = [(rng.choice("xyz"), i, rng.randrange(300)) for i in range(60)]
    b = [(rng.choice("xy"), i, rng.randrange(300)) for i in range(40)]
    got = {r.i: (r.j, r.p2) for r in I.nearest(spark.createDataFrame(a, "k string, i long, p1 long"), spark.createDataFrame(b, "k string, j long, p2 long"), ["k"], "i", "p1", "j", "p2").collect()}
    for k, i, p in a:
        want = min(((abs(p - q), q, j) for kk, j, q in b if kk == k), default=None)
        assert got[i] == ((want[2], want[1]) if want else (None, None))


def test_flank_hits_against_brute_force(spark):
    rng = random.Random(3)
    spans = sorted({(rng.choice("xyz"), s := rng.randrange(400), s + rng.randrange(25)) for _ in range(150)})
    marks = [(rng.choice("xy"), s := rng.randrange(400), s + rng.choice([0, 1, 3, 30])) for _ in range(25)]
    want = []
    for k, s, e in spans:
        near = [(a, b) for c, a, b in marks if c == k and not (a <= s and e <= b)]
        want.append((k, s, e, any(a <= e and s <= b for a, b in near), any(s - 4 <= b < s for a, b in near), any(e < a <= e + 4 for a, b in near)))
    got = I.flank_hits(spark.createDataFrame(spans, "k string, s long, e long"), spark.createDataFrame([*marks, ("x", 9, 5)], "k string, a long, b long"), ["k"], "s", "e", "a", "b", 4)
    assert rows(got) == sorted(want, key=repr)
    assert "BroadcastNestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan


def test_thin(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(2000)) for k in (1, 2) for _ in range(200)]
    kept = []
    for k in (1, 2):
        last = None
        for p in sorted({p for kk, p in data if kk == k}):
            if last is None or p - last > 25:
                kept.append((k, p))
                last = p
    got = ordered.thin(spark.createDataFrame(data, "k int, p long").distinct(), "k", "p", 25)
    assert rows(got) == sorted(kept, key=repr)


def test_segments(spark):
    df = spark.createDataFrame([("c", 1, "a", "a", 1.0), ("c", 2, "b", "a", 3.0), ("c", 3, "b", "b", 5.0), ("d", 1, "a", "b", 2.0)], "ctg string, sta long, one string, two string, dep double")
    assert rows(ordered.segment_by_class(df, "ctg", "sta", "one", "two", "dep")) == [("c", 1, 2, "a", 2, 2.0), ("c", 3, 3, "b", 1, 5.0), ("d", 1, 1, "a", 1, 2.0)]


def test_nonredundant(spark):
    df = spark.createDataFrame([("c", 1, 1, 100), ("c", 2, 5, 95), ("c", 3, 90, 200), ("c", 4, 300, 310), ("c", 5, 290, 320)], "ctg string, i int, s long, e long")
    assert [r.kept for r in sorted(ordered.nonredundant_targets(df, "ctg", "i", "s", "e").collect(), key=lambda r: r.i)] == [True, False, True, True, False]
    # equal starts: the second loses the shared part and [101, 120] is kept, so [110, 120] is inside it; held ones all go
    df = spark.createDataFrame([("c", 1, 1, 100), ("c", 2, 1, 120), ("c", 3, 110, 115), ("c", 4, 200, 210), ("c", 5, 220, 225), ("c", 6, 195, 230), ("c", 7, 221, 222)], "ctg string, i int, s long, e long")
    assert [r.kept for r in sorted(ordered.nonredundant_targets(df, "ctg", "i", "s", "e").collect(), key=lambda r: r.i)] == [True, False, True, True, True, False, True]


def test_thin_sites(spark):
    rng = random.Random(5)
    calls = [(k, p, s, rng.choice([0, 0, 0, 1, 2, None])) for k in "xy" for p in rng.sample(range(900), 90) for s in range(rng.choice((4, 13, 16)))]
    want = []
    for k in "xy":
        last = None
        for p in sorted({c[1] for c in calls if c[0] == k}):
            at = [c for c in calls if c[:2] == (k, p)]
            known = [c[3] for c in at if c[3] is not None]
            if len(known) <= 10 or last is not None and p - last <= 15:
                continue
            major = min(set(known), key=lambda a: (-known.count(a), a))
            if known.count(major) < len(known) - 1:
                want += [(k, p, c[2], None if c[3] is None else int(c[3] == major)) for c in at]
                last = p
    got = ordered.thin_sites(spark.createDataFrame(calls, "chr string, pos int, sample int, gt int"), "chr", "pos", "sample", "gt", 15)
    assert want and rows(got) == sorted(want, key=repr)


def test_label_propagation(spark):
    data = [(1, w, m, c) for w, cs in enumerate([(1, 1, 2, 2), (1, 1, 1, 2), (2, 2, 1, 1)]) for m, c in enumerate(cs)]
    got = {(r.w, r.m): r.label for r in ordered.propagate_labels(spark.createDataFrame(data, "chr int, w int, m int, c int"), "chr", "w", "m", "c").collect()}
    assert [got[1, m] for m in range(4)] == [1, 1, 1, 2]
    assert got[2, 0] == got[2, 1] == 1 and got[2, 2] == got[2, 3] == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    for shuffled in (edges, edges[::-1]):
        assert rows(graphs.components(spark.createDataFrame(shuffled, "a long, b long"), "a", "b")) == sorted(((x, find(x)) for x in root), key=repr)


def test_complete_linkage_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9):
        d = rng.integers(1, 50, (n, n)).astype(float)
        d = d + d.T
        np.fill_diagonal(d, 0)
        for cut in (0, 20, 45, 200):
            sets = [{i} for i in range(n)]
            while len(sets) > 1:
                far, i, j = min((max(d[a, b] for a in x for b in y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2))
                if far > cut:
                    break
                sets[i] |= sets.pop(j)
            got = graphs.complete_linkage(d, cut)
            assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == {frozenset(s) for s in sets}


def test_merge_clusters():
    contacts = {(1, 2): 10.0, (1, 3): 50.0, (2, 3): 60.0, (3, 4): 5.0}
    sizes = {i: 100 for i in range(1, 5)}
    assert graphs.merge_clusters(contacts, {}, sizes, {i: {i} for i in sizes}, most=2) == {1: {1, 2, 3}, 4: {4}}
    assert graphs.merge_clusters(contacts, {(2, 3): 90}, sizes, {i: {i} for i in sizes}, most=3) == {1: {1, 3}, 2: {2}, 4: {4}}
    assert graphs.attach([(1, 9, 5.0), (2, 9, 4.0), (8, 9, 9.0)], {0: {1}, 1: {2}}, {}, {}, least=3.3) == {1: 0, 2: 1, 9: 0, 8: 0}


def test_merge_counts_the_sizes_of_overlapping_members_only():
    """An overlap of 2 between members of 100 and 100 bars a merge at 0.01, however large another member is."""
    contacts, sizes = {(1, 2): 10.0, (1, 3): 50.0}, {1: 100, 2: 100, 3: 1000}
    assert graphs.merge_clusters(contacts, {(1, 2): 2}, sizes, {1: {1, 3}, 2: {2}}, most=1) == {1: {1, 3}, 2: {2}}
    assert graphs.merge_clusters(contacts, {(1, 2): 2}, sizes, {1: {1, 3}, 2: {2}}, most=1, ratio=0.03) == {1: {1, 2, 3}}
    # means over contributing pairs: 2 and 4 merge, then their mean with 1 is 4 and with 3 is 6; a tie goes to the lowest ids
    contacts = {(1, 2): 6.0, (1, 4): 2.0, (2, 4): 10.0, (3, 4): 6.0}
    assert graphs.merge_clusters(contacts, {}, {}, {i: {i} for i in (1, 2, 3, 4)}, most=2) == {1: {1}, 2: {2, 3, 4}}
    assert graphs.merge_clusters({(3, 4): 5.0, (1, 2): 5.0}, {}, {}, {i: {i} for i in (1, 2, 3, 4)}, most=3) == {1: {1, 2}, 3: {3}, 4: {4}}


def test_attach_passes_over_groups_that_share_sequence():
    groups = {0: {1, 2, 3, 4, 5, 6}, 1: {7}}
    edges = [(m, 9, 20.0) for m in range(1, 7)] + [(7, 9, 5.0)]
    sizes = {m: 100.0 for m in range(1, 10)}
    shared = {(m, 9): 2.0 for m in range(1, 7)}
    assert graphs.attach(edges, groups, {}, sizes)[9] == 0
    assert graphs.attach(edges, groups, shared, sizes)[9] == 1
    assert graphs.attach(edges, groups, {p: v for p, v in shared.items() if p[0] != 6}, sizes)[9] == 0  # five are not enough
    assert 9 not in graphs.attach(edges, groups, shared, sizes, least=5.0)


def test_cluster_groups(spark):
    edges = [("x", 1, 2, 9.0), ("x", 3, 4, 9.0), ("x", 2, 3, 4.0), ("x", 5, 6, 9.0), ("x", 5, 4, 2.0), ("x", 7, 1, 3.5), ("x", 8, 6, 3.0), ("y", 1, 2, 9.0)]
    e = spark.createDataFrame(edges, "chr string, a long, b long, w double")
    sizes = spark.createDataFrame([(i, 100) for i in range(1, 9)], "node long, size long")
    none = spark.createDataFrame([], "chr string, a long, b long, overlap long")
    some = spark.createDataFrame([("x", 2, 3, 50)], "chr string, a long, b long, overlap long")
    got = lambda o, n: rows(graphs.cluster_groups(e, "chr", "a", "b", "w", 5.0, n, o, sizes))
    assert got(none, 2) == [("x", 1, 1), ("x", 2, 1), ("x", 3, 1), ("x", 4, 1), ("x", 5, 5), ("x", 6, 5), ("x", 7, 1), ("y", 1, 1), ("y", 2, 1)]
    assert got(some, 2) == [("x", 1, 1), ("x", 2, 1), ("x", 3, 3), ("x", 4, 3), ("x", 5, 3), ("x", 6, 3), ("x", 7, 1), ("y", 1, 1), ("y", 2, 1)]


def test_cluster_shared_against_tables_of_pairs(spark):
    """From what nodes share the same clusters come as from pairs, and with all runs at once; pairs are made in blocks."""
    rng = random.Random(5)
    lines = sorted((f"c{i % 3}", i, rng.randrange(60), rng.randrange(200)) for i in range(360) for _ in range(rng.randrange(1, 7)))
    li = spark.createDataFrame(lines, "chr string, o long, node long, p long")
    contacts, overlaps = li.select("chr", F.col("o").alias("item"), "node"), li.select("chr", F.col("p").alias("item"), "node")
    sizes = spark.createDataFrame([(i, 50 + 7 * i % 40) for i in range(55)], "node long, size long")  # some have none

    def pairs(x, name):
        return x.withColumnRenamed("node", "a").join(x.withColumnRenamed("node", "b"), ["chr", "item"]).where("a < b").groupBy("chr", "a", "b").agg(F.count(F.lit(1)).alias(name))

    e, o = pairs(contacts, "w").cache(), pairs(overlaps.distinct(), "overlap").cache()
    runs = [(2.0, 3, 0.03, 1.0), (2.0, 3, 0.001, 1.0), (3.0, 2, 0.03, 1.5), (1.0, 2, 0.02, float("inf"))]
    want = [(k, *r) for k, (least, most, ratio, join) in enumerate(runs) for r in rows(graphs.cluster_groups(e, "chr", "a", "b", "w", least, most, o, sizes, ratio, join))]
    got = graphs.cluster_shared(contacts, overlaps, "chr", "item", "node", runs, sizes)
    assert rows(got) == sorted(want, key=repr)
    item, node = np.asarray([r[1] for r in lines]), np.asarray([r[2] for r in lines])
    blocks = list(graphs._shared_pairs(item, node, 60))
    old, graphs.BLOCK = graphs.BLOCK, 50
    try:
        small = list(graphs._shared_pairs(item, node, 60))
    finally:
        graphs.BLOCK = old
    assert len(small) > 5 and all((np.concatenate(x) == np.concatenate(y)).all() for x, y in zip(zip(*blocks), zip(*small)))


def test_merging_and_attaching_against_the_plain_rules():
    """Pairs in a heap and ends looked at when they can join give what going through all of them each time gives."""
    rng = random.Random(7)
    for turn in range(60):
        nodes = range(rng.randrange(4, 16))
        every = list(itertools.combinations(nodes, 2))
        contacts = {p: float(rng.randrange(1, 5)) for p in every if rng.random() < 0.4}
        overlaps = {p: rng.randrange(1, 4) for p in every if rng.random() < 0.5}
        sizes = {x: rng.randrange(20, 90) for x in nodes}
        start = {x: {x} for x in nodes if rng.random() < 0.7}
        ratio, least, most = rng.choice([0.02, 0.05, 0.5]), rng.choice([0.0, 1.0, 2.0, 3.5]), rng.randrange(1, 4)
        want = {k: set(v) for k, v in start.items()}
        while len(want) > most:
            best = None
            for x, y in itertools.combinations(sorted(want), 2):
                between = [p for p in every if (p[0] in want[x]) != (p[1] in want[x]) and (p[0] in want[y]) != (p[1] in want[y]) and {*p} <= want[x] | want[y]]
                w, o = [contacts[p] for p in between if p in contacts], [p for p in between if p in overlaps]
                if w and (not o or 2 * sum(overlaps[p] for p in o) < ratio * sum(sizes[a] + sizes[b] for a, b in o)) and (best is None or sum(w) / len(w) > best[0]):
                    best = sum(w) / len(w), x, y
            if best is None:
                break
            want[best[1]] |= want.pop(best[2])
        assert graphs.merge_clusters(contacts, overlaps, sizes, start, most, ratio) == want
        edges = [(a, b, w) for (a, b), w in contacts.items()]
        rng.shuffle(edges)
        of = {m: g for g, ms in want.items() for m in ms}
        value = lambda t, x, y: t.get((min(x, y), max(x, y)))
        for x in [x for a, b, _ in sorted(edges) for x in (a, b)]:
            if x not in of:
                best = None
                for g in sorted(set(of.values())):
                    w = [v for y in of if of[y] == g and (v := value(contacts, x, y))]
                    o = [(v, sizes[x] + sizes[y]) for y in of if of[y] == g and (v := value(overlaps, x, y))]
                    if w and not (len(o) > 5 and 2 * sum(v for v, _ in o) > ratio * sum(z for _, z in o)) and (best is None or sum(w) / len(w) > best[0]):
                        best = sum(w) / len(w), g
                if best and best[0] > least:
                    of[x] = best[1]
        assert graphs.attach(edges, want, overlaps, sizes, least, ratio) == of


def test_refinement(spark):
    m = [("c", 1, 10, "dip", "u", "1", 2.0, True), ("c", 1, 10, "dip", "v", "2", 3.0, True), ("c", 11, 30, "hap", "w", "1", 2.0, True), ("c", 11, 30, "hap", "x", "3", 9.0, False), ("c", 31, 40, "trip", "u", "2", 1.0, True), ("c", 41, 50, "rep", "u", "2", 1.0, False), ("c", 51, 60, "tetrap", "u", "2", 1.0, False)]
    m = spark.createDataFrame(m, "ctg string, sta int, end int, type string, lctg string, lg string, hic double, long boolean")
    assert rows(graphs.contig_scores(m)) == [("c", "1", 60.0, 2, "u", 2.0), ("c", "2", 40.0, 2, "v", 3.0)]
    got = rows(graphs.refine_contigs(m, ["1", "2", "3", "4"]).select("sta", "slot", "lg", "best"))
    assert got == sorted([(1, 1, "1", "u"), (1, 2, "2", "v"), (11, 1, "1", "u"), *[(31, k, "-1", None) for k in (1, 2, 3)], (41, 1, "-1", None), *[(51, k, str(k), None) for k in (1, 2, 3, 4)]], key=repr)
    r = spark.createDataFrame([("a", 0, "dip", "9"), ("a", 1, "dip", "8"), ("a", 2, "dip", "7"), ("b", 0, "trip", "9"), ("b", 1, "trip", "8"), ("d", 0, "hap", "9")], "win string, r int, type string, lg string")
    c = spark.createDataFrame([("a", "2", 1.0), ("a", "1", 5.0), ("a", "3", 1.0), ("b", "1", 2.0)], "win string, lg string, hic double")
    # a keeps 1 and (of equals the later) 3, in their own order; b lacks groups: -1 in its first row only; d has no contacts
    assert rows(graphs.refine_windows(r, c, ["1", "2", "3", "4"])) == [("a", 0, "1"), ("a", 1, "3"), ("a", 2, "7"), ("b", 0, "-1"), ("b", 1, "8"), ("d", 0, "9")]


def test_purge(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 10)], "node string, size long")
    overlaps = spark.createDataFrame([("a", "r", "b", "l", 20), ("b", "r", "c", "l", 10), ("d", "l", "a", "l", 8)], "a string, a_end string, b string, b_end string, ovl long")
    assert rows(graphs.purge_overlaps(overlaps, sizes, 5)) == [("a", 1, 100), ("b", 21, 50), ("c", 11, 50)]


def test_kernels(spark):
    df = spark.createDataFrame([("2S3M1I2D2M", "AACGTGCA")], "cigar string, seq string")
    c, s = F.col("cigar"), F.col("seq")
    r = df.select(K.reference_length(c).alias("n"), K.project_read(s, c).alias("laid"), K.reverse_complement(s).alias("rc"), K.cigar_events(c, "D").alias("d"), K.reference_length(F.lit("*")).alias("none")).first()
    assert tuple(r) == (7, "CGT--CA", "TGCACGTT", 1, 0)
    one = spark.range(1)
    r = one.select(*[K.ploidy_class(F.lit(float(x)), 20).alias(f"p{x}") for x in (30, 31, 70, 91)], K.count_or_zero(F.lit("0x1F")).alias("h"), K.count_or_zero(F.lit("no")).alias("z"), K.harmonic(F.lit(4)).alias("a"), K.harmonic(F.lit(1)).alias("b")).first()
    assert tuple(r)[:6] == ("hap", "dip", "trip", "rep", 31, 0) and abs(r["a"] - 11 / 6) < 1e-12 and r["b"] == 0


def test_tours(spark):
    r = spark.range(1).select(K.tour(F.lit("1 -2  3")).alias("t")).select(K.reverse_tour(F.col("t")).alias("r"), K.insert_after(F.col("t"), F.lit(2), F.lit(9)).alias("i")).first()
    assert r.r == [-3, 2, -1] and r.i == [1, -2, 9, 3]


def test_t_distribution():
    assert G.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert G.t_two_sided(0.0, 5) == pytest.approx(1)
    assert G.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-9)


def test_selection(spark):
    df = spark.createDataFrame([("w", "dip", g, v) for g, v in ((1, 5.0), (2, 5.0), (3, 1.0))] + [("v", "trip", 1, 2.0)], "win string, cls string, grp int, hic double")
    keep = lambda partial: rows(selection.keep_by_class(df, ["win"], "cls", {"dip": 2, "trip": 3}, [F.desc("hic"), F.desc("grp")], "grp", partial))
    assert keep(True) == [("v", 1, 1), ("v", 2, -1), ("v", 3, -1), ("w", 1, 2), ("w", 2, 1)]
    assert keep(False) == [("v", 1, -1), ("v", 2, -1), ("v", 3, -1), ("w", 1, 2), ("w", 2, 1)]
    many = spark.range(20000)
    tens = selection.with_replacement(many, ["id"], 10.0).groupBy("id").count().agg(F.avg("count"), F.max("count"), F.count("id")).first()
    assert abs(tens[0] - 10) < 0.15 and tens[1] > 20 and tens[2] > 19980  # nothing is cut off at large numbers
    assert selection.poisson_steps(0.0) == [1.0]
    names = [(f"n{i}",) for i in range(101)] + [(None,)]
    pairs = selection.pair_up(spark.createDataFrame(names, "name string"), "name").collect()
    assert len(pairs) == 50 and len({x for p in pairs for x in (p.first, p.second)}) == 100
    drawn = selection.draws_with_replacement(many.where("id < 50"), "id", 400)
    assert drawn.count() == 400 and drawn.select("draw").distinct().count() == 400 and 45 < drawn.select("id").distinct().count() <= 50
    assert selection.draws_with_replacement(many.limit(0), "id", 5).count() == 0
    assert abs(selection.with_replacement(many, ["id"], 0.5).count() - 10000) < 500
    assert abs(selection.hash_sample(many, ["id"], 10).count() - 2000) < 250


def test_text_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nAC\n>y\nTT\n")
    assert rows(text.read_fasta(spark, str(tmp_path / "a.fa"))) == [("x", "ACGTAC"), ("y", "TT")]
    (tmp_path / "r.txt").write_text("Query= q1\n> s1 desc\n Identities = 5/9 (55%)\n> s2\n Identities = 7/8\nQuery= q2\n> s3\n Identities = 1/2\n")
    got = text.parse_blast(text.numbered_lines(spark, str(tmp_path / "r.txt"))).select("query", "subject", "same", "length")
    assert rows(got) == [("q1", "s1", 5, 9), ("q1", "s2", 7, 8), ("q2", "s3", 1, 2)]
    df = spark.createDataFrame([("c1", 1, "p"), ("c2", 2, "q")], "ctg string, n int, lg string")
    sinks.write_by(df, str(tmp_path / "by"), "lg")
    assert rows(spark.read.parquet(str(tmp_path / "by")).select("ctg", "n", "lg")) == rows(df)
    sinks.write_tsv(df, str(tmp_path / "tsv"), header=True)
    assert rows(text.read_headed(spark, str(tmp_path / "tsv"), "ctg string, n int, lg string")) == rows(df)
    gfa = spark.createDataFrame([("S\tu1\tACGT",), ("L\tu1\t+\tu2\t-\t12M",), ("L\tu1\t+\tu2\t-\t0M",)], "value string")
    assert rows(text.parse_gfa_nodes(gfa)) == [("u1", 4)] and rows(text.parse_gfa_links(gfa)) == [("u1", "r", "u2", "r", 12)]
    named, tours = text.parse_assembly(spark.createDataFrame([(">c1 1 50",), ("1 -2",)], "value string"))
    assert rows(named) == [("c1", 1, 50)] and rows(tours) == [("1 -2",)]
