"""Interval, window and join queries (SURVEY C and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuspark.functions.kernels import overlap_len, window_id
from locuspark.operators import intervals as I
from locuspark.operators import ordered
from locuspark.plans.base import DEPTH, EDGE, IV, IVP, depth, edge, iv, ivp, table
from locuspark.plans.registry import query

W = 30  # days of a bin: near the median length of an interval


def windows(s, d):
    """Quarters of 90 days for each seq, a class and a group each."""
    x = iv(s, d).groupBy("seq").agg(F.min("sta").alias("lo"), F.max("end").alias("hi"))
    w = x.select("seq", F.explode(F.sequence(F.floor(F.col("lo") / 90), F.floor(F.col("hi") / 90))).alias("k"))
    return w.select("seq", (F.col("k") * 90).alias("w_sta"), (F.col("k") * 90 + 89).alias("w_end"), (F.col("k") % 3).cast("int").alias("cls"))


WINDOWS = f"""{IV}, win AS (SELECT seq, k * 90 AS w_sta, k * 90 + 89 AS w_end, (k % 3)::INT AS cls FROM (
  SELECT seq, unnest(generate_series(min(sta) // 90, max("end") // 90)) AS k FROM iv GROUP BY seq))"""


@query("E1_tumbling_windows", f"""WITH {IV} SELECT seq, sta // 100 AS win_floor, count(*) AS n, sum("end" - sta) AS total FROM iv GROUP BY ALL""")
def e1(s, d):
    return iv(s, d).groupBy("seq", window_id(F.col("sta"), 100).alias("win_floor")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("sta")).alias("total"))


@query("E1_window_modes", f"""WITH {IV} SELECT (ceil(sta / 100.0) * 100)::BIGINT AS win_ceil, sta // 100 + 1 AS win_one, count(*) AS n FROM iv GROUP BY ALL""")
def e1_modes(s, d):
    return iv(s, d).groupBy(window_id(F.col("sta"), 100, "ceil").alias("win_ceil"), window_id(F.col("sta"), 100, "one").alias("win_one")).agg(F.count(F.lit(1)).alias("n"))


@query("E2_spine", f"""WITH {IV} SELECT seq, unnest(generate_series(0, max("end"), 500)) AS "window" FROM iv GROUP BY seq""")
def e2(s, d):
    return I.spine(iv(s, d).groupBy("seq").agg(F.max("end").alias("last")), ["seq"], "last", 500)


_ISLANDS = """SELECT seq, min(sta) AS sta, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY sta, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN sta <= max("end") OVER (PARTITION BY seq ORDER BY sta, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack} THEN 0 ELSE 1 END AS fresh FROM {src})) GROUP BY seq, island"""


@query("E3_merge_intervals", f"WITH {IVP} " + _ISLANDS.format(slack=0, src="ivp"))
def e3(s, d):
    return I.merge_intervals(ivp(s, d), ["seq"], "sta", "end")


@query("E3_merge_bookended", f"WITH {IVP} " + _ISLANDS.format(slack=1, src="ivp"))
def e3_book(s, d):
    return I.merge_intervals(ivp(s, d), ["seq"], "sta", "end", 1)


@query("E4_merge_with_slack", f"WITH {IVP} " + _ISLANDS.format(slack="12", src="ivp"))
def e4(s, d):
    return I.merge_intervals(ivp(s, d), ["seq"], "sta", "end", F.lit(12))


@query("E5_merge_adjacent", f"""WITH {WINDOWS}, c AS (SELECT *, (w_sta // 180) % 3 AS grp FROM win) SELECT seq, any_value(grp) AS grp, min(w_sta) AS w_sta, max(w_end) AS w_end, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY w_sta ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(w_end) OVER o + 1 = w_sta AND lag(grp) OVER o = grp THEN 0 ELSE 1 END AS fresh FROM c
  WINDOW o AS (PARTITION BY seq ORDER BY w_sta))) GROUP BY seq, run""")
def e5(s, d):
    c = windows(s, d).withColumn("grp", F.floor(F.col("w_sta") / 180) % 3)
    return I.merge_adjacent(c, ["seq"], "w_sta", "w_end", ["grp"])


@query("E6_sliding_windows", f"""WITH {IV} SELECT seq, k * 50 AS "window", count(*) AS n FROM (SELECT seq, unnest(generate_series(greatest((sta - 200) // 50 + 1, 0), sta // 50)) AS k FROM iv) GROUP BY ALL""")
def e6(s, d):
    return I.sliding(iv(s, d), "sta", 200, 50).groupBy("seq", "window").agg(F.count(F.lit(1)).alias("n"))


@query("E7_nonredundant")
def e7(s, d):
    return ordered.nonredundant_targets(iv(s, d), "seq", "id", "sta", "end").select("seq", "id", "kept")


@query("E7_target_coverage")
def e7_coverage(s, d):
    """What the intervals that count cover of each target (a class of the sequence), overlaps once."""
    kept = ordered.nonredundant_targets(iv(s, d), "seq", "id", "sta", "end").where("kept")
    return I.merge_intervals(kept.select("seq", "grp", "sta", "end"), ["seq", "grp"], "sta", "end").groupBy("seq", "grp").agg(F.sum(F.col("end") - F.col("sta") + 1).alias("bp"))


@query("E8_window_coverage", f"""WITH {IV} SELECT seq, k * 100 AS "window", round(sum(least("end", k * 100 + 99) - greatest(sta, k * 100) + 1) / 100.0, 6) AS cov
  FROM (SELECT *, unnest(generate_series(sta // 100, "end" // 100)) AS k FROM iv) GROUP BY seq, k""")
def e8(s, d):
    return I.over_windows(iv(s, d), "sta", "end", 100).groupBy("seq", "window").agg(F.round(F.sum("overlap") / 100.0, 6).alias("cov"))


@query("E9_run_length", """WITH p AS (SELECT o_custkey % 20 AS hap, o_orderkey AS pos, o_orderstatus AS v FROM orders), q AS (SELECT hap, row_number() OVER (PARTITION BY hap ORDER BY pos) + (pos // 1000) AS pos, v FROM p)
  SELECT hap, any_value(v) AS v, min(pos) AS sta, max(pos) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY hap ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(v) OVER o = v AND lag(pos) OVER o + 1 = pos THEN 0 ELSE 1 END AS fresh FROM q WINDOW o AS (PARTITION BY hap ORDER BY pos))) GROUP BY hap, run""")
def e9(s, d):
    from pyspark.sql import Window

    p = table(s, d, "orders").select((F.col("o_custkey") % 20).alias("hap"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("v"))
    q = p.withColumn("pos", F.row_number().over(Window.partitionBy("hap").orderBy("pos")) + F.floor(F.col("pos") / 1000))
    return I.run_length(q, ["hap"], "pos", "v")


@query("E10_sessions", f"""WITH {IVP}, p AS (SELECT DISTINCT seq, sta FROM ivp) SELECT seq, min(sta) AS sta, max(sta) AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY sta ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN sta - lag(sta) OVER (PARTITION BY seq ORDER BY sta) < 60 THEN 0 ELSE 1 END AS fresh FROM p)) GROUP BY seq, run""")
def e10(s, d):
    return I.sessions(ivp(s, d).select("seq", "sta").distinct(), ["seq"], "sta", 60)


@query("E11_depth_segments", f"""WITH RECURSIVE {DEPTH}, r AS (SELECT ctg, sta, floor(dep / 40)::INT AS one, floor(dep2 / 40)::INT AS two, dep, row_number() OVER (PARTITION BY ctg ORDER BY sta) AS i FROM dep),
  s AS (SELECT ctg, i, sta, dep, one AS cls, 1 AS seg FROM r WHERE i = 1 UNION ALL SELECT r.ctg, r.i, r.sta, r.dep, CASE WHEN s.cls IN (r.one, r.two) THEN s.cls ELSE r.one END, CASE WHEN s.cls IN (r.one, r.two) THEN s.seg ELSE s.seg + 1 END FROM s JOIN r ON r.ctg = s.ctg AND r.i = s.i + 1)
  SELECT ctg, min(sta) AS sta, max(sta) AS "end", any_value(cls) AS class, count(*) AS n, round(avg(dep), 6) AS depth FROM s GROUP BY ctg, seg""")
def e11(s, d):
    x = depth(s, d).withColumn("one", F.floor(F.col("dep") / 40).cast("int")).withColumn("two", F.floor(F.col("dep2") / 40).cast("int"))
    return ordered.segment_by_class(x, "ctg", "sta", "one", "two", "dep").withColumn("depth", F.round("depth", 6))


@query("E12_tile", f"""WITH {DEPTH}, g AS (SELECT ctg, min(sta) AS sta, max("end") AS "end" FROM dep GROUP BY ctg), t AS (SELECT *, greatest(round(("end" - sta + 1) / 5000.0), 1)::BIGINT AS n FROM g)
  SELECT ctg, k AS tile, sta + k * 5000 AS tile_sta, CASE WHEN k = n - 1 THEN "end" ELSE sta + k * 5000 + 4999 END AS tile_end FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM t)""")
def e12(s, d):
    g = depth(s, d).groupBy("ctg").agg(F.min("sta").alias("sta"), F.max("end").alias("end"))
    return I.tile(g, "sta", "end", 5000).select("ctg", "tile", "tile_sta", "tile_end")


@query("E13_trim_ends", f"""WITH {DEPTH}, e AS (SELECT ctg, min(sta) AS a, max("end") AS z, min(CASE WHEN dep >= 100 THEN sta END) AS l, max(CASE WHEN dep >= 100 THEN "end" END) AS r FROM dep GROUP BY ctg)
  SELECT ctg, 'all' AS piece, a AS sta, z AS "end" FROM e WHERE l IS NULL OR (l = a AND r = z) UNION ALL SELECT ctg, 'left', a, l - 1 FROM e WHERE l > a UNION ALL
  SELECT ctg, 'middle', l, r FROM e WHERE l > a OR r < z UNION ALL SELECT ctg, 'right', r + 1, z FROM e WHERE r < z""")
def e13(s, d):
    return I.trim_ends(depth(s, d), ["ctg"], "sta", "end", "dep", 100)


@query("E13_selected", f"""WITH {DEPTH}, e AS (SELECT ctg, min(sta) AS a, max("end") AS z, min(CASE WHEN dep >= 100 THEN sta END) AS l, max(CASE WHEN dep >= 100 THEN "end" END) AS r FROM dep GROUP BY ctg),
  p AS (SELECT ctg, 'all' AS piece, a AS sta, z AS "end" FROM e WHERE l IS NULL OR (l = a AND r = z) UNION ALL SELECT ctg, 'left', a, l - 1 FROM e WHERE l > a UNION ALL SELECT ctg, 'middle', l, r FROM e WHERE l > a OR r < z UNION ALL SELECT ctg, 'right', r + 1, z FROM e WHERE r < z)
  SELECT p.ctg, piece, p.sta, p."end" FROM p LEFT JOIN dep ON dep.ctg = p.ctg AND dep.sta >= p.sta AND dep."end" <= p."end" GROUP BY ALL HAVING NOT (p.ctg IN (SELECT ctg FROM dep WHERE dep2 > 90) AND avg(dep) < 60)""")
def e13_selected(s, d):
    x = depth(s, d)
    pieces = I.trim_ends(x, ["ctg"], "sta", "end", "dep", 100)
    return I.drop_low_pieces(pieces, x.where("dep2 > 90").select("ctg"), x, ["ctg"], "sta", "end", "dep", 60)


@query("E14_map_rate", """WITH m AS (SELECT o_custkey % 7 AS chr, o_orderkey AS pos, sum(o_totalprice) OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) / 1e6 AS map FROM orders), g AS (
  SELECT chr, lag(pos) OVER o AS a, pos AS b, map - lag(map) OVER o AS d FROM m WINDOW o AS (PARTITION BY chr ORDER BY pos)), x AS (SELECT *, unnest(generate_series(a // 300, (b - 1) // 300)) * 300 AS w FROM g WHERE b > a)
  SELECT chr, w AS "window", round(sum(d * (least(b, w + 300) - greatest(a, w)) / (b - a)), 4) AS rate FROM x GROUP BY chr, w""")
def e14(s, d):
    from pyspark.sql import Window

    from locuspark.operators.genotypes import map_rate

    o = table(s, d, "orders").select((F.col("o_custkey") % 7).alias("chr"), F.col("o_orderkey").alias("pos"), "o_totalprice")
    m = o.withColumn("map", F.sum("o_totalprice").over(Window.partitionBy("chr").orderBy("pos")) / 1e6)
    return map_rate(m, 300).withColumn("rate", F.round("rate", 4))


@query("E15_spread_over_windows", f"""WITH {IV} SELECT seq, id, k * 20 AS "window", least("end", k * 20 + 19) - greatest(sta, k * 20) + 1 AS overlap FROM (SELECT *, unnest(generate_series(sta // 20, "end" // 20)) AS k FROM iv)""")
def e15(s, d):
    return I.over_windows(iv(s, d), "sta", "end", 20).select("seq", "id", "window", "overlap")


@query("E16_thin", f"""WITH RECURSIVE {IVP}, p AS (SELECT DISTINCT seq, sta FROM ivp), t AS (SELECT seq, min(sta) AS sta FROM p GROUP BY seq UNION ALL
  SELECT * FROM (SELECT t.seq, (SELECT min(p.sta) FROM p WHERE p.seq = t.seq AND p.sta > t.sta + 45) AS sta FROM t) WHERE sta IS NOT NULL) SELECT seq, sta FROM t""")
def e16(s, d):
    p = ivp(s, d).select("seq", "sta").distinct()
    return ordered.thin(p, "seq", "sta", 45)


_CALLS = """cl AS (SELECT l_partkey % 3 AS chr, l_partkey * 10 AS pos, l_orderkey % 30 AS sample, max(CASE WHEN l_quantity < 4 THEN NULL WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS gt FROM lineitem GROUP BY ALL)"""


@query("E16_thin_sites", f"""WITH RECURSIVE {_CALLS}, n AS (SELECT chr, pos, gt, count(*) AS n FROM cl WHERE gt IS NOT NULL GROUP BY ALL), z AS (SELECT chr, pos, sum(n) AS total, max(n) AS top FROM n GROUP BY ALL),
  p AS (SELECT chr, pos, (SELECT min(gt) FROM n WHERE n.chr = z.chr AND n.pos = z.pos AND n.n = z.top) AS major FROM z WHERE total > 10 AND top < total - 1),
  t AS (SELECT chr, min(pos) AS pos FROM p GROUP BY chr UNION ALL SELECT * FROM (SELECT t.chr, (SELECT min(p.pos) FROM p WHERE p.chr = t.chr AND p.pos > t.pos + 45) AS pos FROM t) WHERE pos IS NOT NULL)
  SELECT cl.chr, cl.pos, sample, (gt = major)::INT AS state FROM cl JOIN t USING (chr, pos) JOIN p USING (chr, pos)""")
def e16_sites(s, d):
    call = F.when(F.col("l_quantity") < 4, None).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    c = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 3).alias("chr"), (F.col("l_partkey") * 10).alias("pos"), (F.col("l_orderkey") % 30).alias("sample")).agg(F.max(call).alias("gt"))
    return ordered.thin_sites(c, "chr", "pos", "sample", "gt", 45)


@query("E17_shared_blocks", """WITH p AS (SELECT l_orderkey % 4 AS chr, l_linenumber AS s, l_orderkey AS pos, min(l_returnflag) AS h FROM lineitem GROUP BY ALL), q AS (SELECT a.chr, a.pos, (a.h = b.h)::INT AS same FROM p a JOIN p b USING (chr, pos) WHERE a.s = 1 AND b.s = 2),
  r AS (SELECT *, same + coalesce(lag(same) OVER (PARTITION BY chr ORDER BY pos), 0) > 0 AS ok FROM q), t AS (SELECT *, sum(CASE WHEN ok = lag_ok THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(ok) OVER (PARTITION BY chr ORDER BY pos) AS lag_ok FROM r))
  SELECT chr, 1 AS s1, 2 AS s2, min(pos) AS sta, max(pos) AS "end", count(*) AS n FROM t WHERE ok GROUP BY chr, run""")
def e17(s, d):
    p = table(s, d, "lineitem").select((F.col("l_orderkey") % 4).alias("chr"), F.col("l_linenumber").alias("s"), F.col("l_orderkey").alias("pos"), "l_returnflag").groupBy("chr", "s", "pos").agg(F.min("l_returnflag").alias("h"))
    q = p.where("s = 1").join(p.where("s = 2").select("chr", "pos", F.col("h").alias("h2")), ["chr", "pos"]).select("chr", F.lit(1).alias("s1"), F.lit(2).alias("s2"), "pos", F.when(F.col("h") == F.col("h2"), 1).otherwise(0).alias("same"))
    key = ["chr", "s1", "s2"]
    r = q.withColumn("ok", F.col("same") + F.coalesce(I.before("same", key, ["pos"]), F.lit(0)) > 0)
    t = I.runs(r, key, ["pos"], I.before("ok", key, ["pos"]) == F.col("ok"))
    return t.where("ok").groupBy(*key, "run").agg(F.min("pos").alias("sta"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


@query("E18_large_gaps", f"WITH {IVP}, m AS (" + _ISLANDS.format(slack=0, src="ivp") + """) SELECT * FROM (SELECT seq, lag(sta) OVER o AS sta_before, lag("end") OVER o AS end_before, sta AS sta_after, "end" AS end_after,
  sta - lag("end") OVER o - 1 AS gap FROM m WINDOW o AS (PARTITION BY seq ORDER BY sta, "end")) WHERE gap > 60""")
def e18(s, d):
    return I.large_gaps(I.merge_intervals(ivp(s, d), ["seq"], "sta", "end"), ["seq"], "sta", "end", 60)


@query("E19_rank_and_jitter", """WITH h AS (SELECT l_orderkey // 100 AS win, l_linenumber AS sample, l_orderkey, (l_partkey % 30)::VARCHAR AS hap FROM lineitem)
  SELECT win, l_orderkey, sample, hap, dense_rank() OVER (PARTITION BY win ORDER BY hap) AS rank, round(dense_rank() OVER (PARTITION BY win ORDER BY hap) + 0.02 * (row_number() OVER (PARTITION BY win, hap ORDER BY l_orderkey, sample) - 1), 6) AS shown FROM h""")
def e19(s, d):
    from pyspark.sql import Window

    h = table(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("win"), "l_orderkey", F.col("l_linenumber").alias("sample"), (F.col("l_partkey") % 30).cast("string").alias("hap"))
    rank = F.dense_rank().over(Window.partitionBy("win").orderBy("hap"))
    nth = F.row_number().over(Window.partitionBy("win", "hap").orderBy("l_orderkey", "sample")) - 1
    return h.select("*", rank.alias("rank"), F.round(rank + nth * 0.02, 6).alias("shown"))


@query("E20_main_region", f"""WITH {IV} SELECT seq, region, bp FROM (SELECT seq, k * 400 AS region, sum(least("end", k * 400 + 399) - greatest(sta, k * 400) + 1) AS bp, row_number() OVER (PARTITION BY seq ORDER BY sum(least("end", k * 400 + 399) - greatest(sta, k * 400) + 1) DESC, k) AS rn
  FROM (SELECT *, unnest(generate_series(sta // 400, "end" // 400)) AS k FROM iv) GROUP BY seq, k) WHERE rn = 1""")
def e20(s, d):
    bp = I.over_windows(iv(s, d), "sta", "end", 400).groupBy("seq", F.col("window").alias("region")).agg(F.sum("overlap").alias("bp"))
    return I.first_by(bp, ["seq"], [F.desc("bp"), F.col("region")])


@query("C1_semi_lookup", """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def c1(s, d):
    good = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(good, "l_suppkey", "left_semi")


@query("C2_exclude_pairs", f"""WITH {EDGE} SELECT a, b, w FROM edge WHERE NOT EXISTS (SELECT 1 FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey = a AND y.s_suppkey = b)""")
def c2(s, d):
    nation = table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("n"))
    of = lambda k: nation.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"))
    e = edge(s, d).join(of("a"), "a", "left").join(of("b"), "b", "left")  # a pair is excluded if both ends have one nation
    return e.where(~F.coalesce(F.col("n_a") == F.col("n_b"), F.lit(False))).select("a", "b", "w")


@query("C3_point_in_interval", f"""WITH {WINDOWS} SELECT id, iv.seq, sta, w_sta, cls FROM iv JOIN win ON iv.seq = win.seq AND sta BETWEEN w_sta AND w_end""")
def c3(s, d):
    return I.point_in_interval(iv(s, d).select("seq", "id", "sta"), windows(s, d), ["seq"], "sta", "w_sta", "w_end", 90).select("id", "seq", "sta", "w_sta", "cls")


@query("C4_best_overlap", f"""WITH {WINDOWS} SELECT id, seq, w_sta, overlap FROM (SELECT id, iv.seq, w_sta, least("end", w_end) - greatest(sta, w_sta) + 1 AS overlap, row_number() OVER (PARTITION BY id, iv.seq, sta, "end" ORDER BY least("end", w_end) - greatest(sta, w_sta) DESC, w_sta, w_end) AS rn
  FROM iv JOIN win ON iv.seq = win.seq AND sta <= w_end AND w_sta <= "end") WHERE rn = 1""")
def c4(s, d):
    return I.best_overlap(iv(s, d), windows(s, d), ["seq"], ["id", "seq", "sta", "end"], "sta", "end", "w_sta", "w_end", 90).select("id", "seq", "w_sta", "overlap")


_MERGED = _ISLANDS.replace("SELECT seq,", "SELECT seq, pt,").replace("PARTITION BY seq", "PARTITION BY seq, pt").replace("GROUP BY seq, island", "GROUP BY seq, pt, island")
_PT = """pt0 AS (SELECT l_suppkey AS seq, l_partkey % 25 AS pt, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS sta, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS "end" FROM lineitem)"""


def _parts(s, d):
    day = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    p = table(s, d, "lineitem").select(F.col("l_suppkey").alias("seq"), (F.col("l_partkey") % 25).alias("pt"), day.alias("sta"), (day + F.col("l_quantity").cast("long")).alias("end"))
    return I.merge_intervals(p, ["seq", "pt"], "sta", "end")


_PAIRS = f"""WITH {_PT}, m AS ({_MERGED.format(slack=0, src="pt0")}), p AS (SELECT x.pt AS name1, y.pt AS name2, sum(least(x."end", y."end") - greatest(x.sta, y.sta) + 1)::BIGINT AS overlap FROM m x JOIN m y ON x.seq = y.seq AND x.pt < y.pt
  AND x.sta <= y."end" AND y.sta <= x."end" GROUP BY ALL)"""


@query("C5_pair_overlap", _PAIRS + " SELECT * FROM p")
def c5(s, d):
    return I.pair_overlaps(_parts(s, d), ["seq"], "pt", "sta", "end", 60)


@query("C6_allelic_pairs", _PAIRS + """, z AS (SELECT pt, sum("end" - sta + 1) AS size FROM m GROUP BY pt) SELECT name1, name2, overlap FROM p JOIN z a ON a.pt = name1 JOIN z b ON b.pt = name2 WHERE overlap > 5 AND (overlap > 0.02 * a.size OR overlap > 0.02 * b.size)""")
def c6(s, d):
    m = _parts(s, d)
    size = m.groupBy("pt").agg(F.sum(F.col("end") - F.col("sta") + 1).alias("size"))
    p = I.pair_overlaps(m, ["seq"], "pt", "sta", "end", 60)
    p = p.join(size.select(F.col("pt").alias("name1"), F.col("size").alias("z1")), "name1").join(size.select(F.col("pt").alias("name2"), F.col("size").alias("z2")), "name2")
    return p.where("overlap > 5 and (overlap > 0.02 * z1 or overlap > 0.02 * z2)").select("name1", "name2", "overlap")


@query("C7_pairs_of_a_row", """WITH r AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS l FROM lineitem GROUP BY 1) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT unnest(l) AS x, l FROM r) CROSS JOIN unnest(l) AS t(y) WHERE x < y""")
def c7(s, d):
    r = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("l"))
    x = r.select("l", F.posexplode("l").alias("i", "a"))
    return x.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).distinct()


@query("C8_gene_annotation", f"""WITH {IV}, gene AS (SELECT o_orderkey AS gid, o_custkey % 40 AS seq, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS g_sta, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 15 AS g_end, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders),
  v AS (SELECT seq % 40 AS seq, id, sta, least("end", sta + 6) AS "end" FROM iv), h AS (SELECT gid, CASE WHEN sta <= g_end AND g_sta <= "end" THEN 1 WHEN ("end" < g_sta) = (strand = '+') THEN 2 ELSE 3 END AS k FROM gene JOIN v ON v.seq = gene.seq AND sta <= g_end + 10 AND g_sta - 10 <= "end" AND NOT (sta <= g_sta AND g_end <= "end"))
  SELECT gene.gid, CASE min(k) WHEN 1 THEN 'body' WHEN 2 THEN 'upstream' WHEN 3 THEN 'downstream' ELSE 'intergenic' END AS hit FROM gene LEFT JOIN h ON h.gid = gene.gid GROUP BY gene.gid""")
def c8(s, d):
    day = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long")
    gene = table(s, d, "orders").select(F.col("o_orderkey").alias("gid"), (F.col("o_custkey") % 40).alias("seq"), day.alias("g_sta"), (day + 15).alias("g_end"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    v = iv(s, d).select((F.col("seq") % 40).alias("seq"), "id", "sta", F.least("end", F.col("sta") + 6).alias("end"))
    hits = I.flank_hits(gene, v, ["seq"], "g_sta", "g_end", "sta", "end", 10)
    up = F.when(F.col("strand") == "+", F.col("before")).otherwise(F.col("after"))
    k = F.when(F.col("inside"), 1).when(up, 2).when(F.col("before") | F.col("after"), 3)
    best = gene.join(hits, ["seq", "g_sta", "g_end"], "left").groupBy("gid").agg(F.min(k).alias("k"))
    name = F.when(F.col("k") == 1, "body").when(F.col("k") == 2, "upstream").when(F.col("k") == 3, "downstream").otherwise("intergenic")
    return best.select("gid", name.alias("hit"))


@query("C9_intersect_not_self", f"""WITH {IVP} SELECT a.id AS id1, b.id AS id2 FROM ivp a JOIN ivp b ON a.seq = b.seq AND a.sta <= b."end" AND b.sta <= a."end" WHERE a."end" - a.sta <> b."end" - b.sta""")
def c9(s, d):
    a = ivp(s, d).select("seq", F.col("id").alias("id1"), F.col("sta").alias("s1"), F.col("end").alias("e1"))
    b = ivp(s, d).select("seq", F.col("id").alias("id2"), F.col("sta").alias("s2"), F.col("end").alias("e2"))
    return I.range_join(a, b, ["seq"], "s1", "e1", "s2", "e2", W).where("e1 - s1 <> e2 - s2").select("id1", "id2")


@query("C11_base_in_read", f"""WITH {IVP}, r AS (SELECT *, substr(repeat('ACGTTGCA', 8), (id % 8)::INT + 1, ("end" - sta + 1)::INT) AS seq_text FROM ivp), m AS (SELECT DISTINCT seq, sta AS pos FROM ivp)
  SELECT id, pos, substr(seq_text, (pos - sta + 1)::INT, 1) AS base FROM r JOIN m ON r.seq = m.seq AND pos BETWEEN sta AND "end" """)
def c11(s, d):
    r = ivp(s, d).withColumn("text", F.substr(F.repeat(F.lit("ACGTTGCA"), F.lit(8)), (F.col("id") % 8 + 1).cast("int"), (F.col("end") - F.col("sta") + 1).cast("int")))
    m = ivp(s, d).select("seq", F.col("sta").alias("pos")).distinct()
    hit = I.point_in_interval(m, r, ["seq"], "pos", "sta", "end", W)
    return hit.select("id", "pos", F.substr("text", (F.col("pos") - F.col("sta") + 1).cast("int"), F.lit(1)).alias("base"))


@query("C12_common_groups", """WITH r AS (SELECT l_orderkey, l_linenumber, list_distinct([l_suppkey % 5, l_partkey % 5]) AS g FROM lineitem WHERE l_linenumber <= 2) SELECT a.l_orderkey, CASE WHEN len(list_intersect(a.g, b.g)) = 0 THEN 'inter' ELSE array_to_string(list_sort(list_intersect(a.g, b.g)), ',') END AS common
  FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def c12(s, d):
    r = table(s, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.array_distinct(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5)).alias("g"))
    p = r.where("l_linenumber = 1").join(r.where("l_linenumber = 2").select("l_orderkey", F.col("g").alias("h")), "l_orderkey")
    both = F.array_sort(F.array_intersect("g", "h"))
    return p.select("l_orderkey", F.when(F.size(both) == 0, "inter").otherwise(F.array_join(both.cast("array<string>"), ",")).alias("common"))


@query("C13_names_of_a_gene", """SELECT p_brand AS gene, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS ctgs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48 GROUP BY 1""")
def c13(s, d):
    x = table(s, d, "lineitem").where("l_quantity > 48").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_brand").alias("gene")).agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("ctgs"))


@query("C14_nearest", f"""WITH {IVP}, a AS (SELECT seq, id, sta AS pos FROM ivp), b AS (SELECT seq, id AS bid, "end" AS bpos FROM ivp) SELECT seq, id, pos, bid, bpos, distance FROM (SELECT a.*, bid, bpos, abs(pos - bpos) AS distance,
  row_number() OVER (PARTITION BY a.seq, id, pos ORDER BY abs(pos - bpos), bpos, bid) AS rn FROM a LEFT JOIN b ON a.seq = b.seq) WHERE rn = 1""")
def c14(s, d):
    a = ivp(s, d).select("seq", "id", F.col("sta").alias("pos"))
    b = ivp(s, d).select("seq", F.col("id").alias("bid"), F.col("end").alias("bpos"))
    return I.nearest(a, b, ["seq"], "id", "pos", "bid", "bpos")


@query("C15_window_key_joins", f"""WITH {IV}, x AS (SELECT seq, sta // 100 AS win, count(*) AS n FROM iv GROUP BY ALL), y AS (SELECT seq, "end" // 100 AS win, round(avg("end" - sta), 6) AS mean FROM iv WHERE grp = 'A' GROUP BY ALL) SELECT x.seq, x.win, n, mean, s_nationkey FROM x LEFT JOIN y USING (seq, win) LEFT JOIN supplier ON s_suppkey = x.seq""")
def c15(s, d):
    x = iv(s, d).groupBy("seq", window_id(F.col("sta"), 100).alias("win")).agg(F.count(F.lit(1)).alias("n"))
    y = iv(s, d).where("grp = 'A'").groupBy("seq", window_id(F.col("end"), 100).alias("win")).agg(F.round(F.avg(F.col("end") - F.col("sta")), 6).alias("mean"))
    return x.join(y, ["seq", "win"], "left").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("seq"), "s_nationkey"), "seq", "left")


@query("C18_cluster_overlap", """WITH q AS (SELECT c_custkey AS ctg, c_nationkey AS q FROM customer), r AS (SELECT c_custkey AS ctg, c_mktsegment AS r FROM customer) SELECT q, r, count(*) AS n, min(ctg) AS first FROM q JOIN r USING (ctg) GROUP BY ALL""")
def c18(s, d):
    c = table(s, d, "customer")
    q, r = c.select(F.col("c_custkey").alias("ctg"), F.col("c_nationkey").alias("q")), c.select(F.col("c_custkey").alias("ctg"), F.col("c_mktsegment").alias("r"))
    return q.join(r, "ctg").groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.min("ctg").alias("first"))


_GROUPS = """grp AS (SELECT s_suppkey AS node, s_nationkey AS g FROM supplier WHERE s_suppkey % 3 = 0)"""


def groups(s, d):
    return table(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("g"))


@query("C19_contact_to_groups", f"""WITH {EDGE}, {_GROUPS}, e AS (SELECT a AS x, b AS y, w FROM edge UNION ALL SELECT b, a, w FROM edge) SELECT x AS node, g, count(*) AS n, sum(w)::BIGINT AS total, max(w) AS best FROM e JOIN grp ON y = node WHERE x NOT IN (SELECT node FROM grp) GROUP BY ALL""")
def c19(s, d):
    e = edge(s, d)
    e = e.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y"), "w"))
    g = groups(s, d)
    out = e.join(g, F.col("y") == F.col("node")).drop("node").join(g.select(F.col("node").alias("x")), "x", "left_anti")
    return out.groupBy(F.col("x").alias("node"), "g").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.max("w").alias("best"))


@query("C20_allelic_evidence", f"""WITH {EDGE}, {_GROUPS}, e AS (SELECT a AS x, b AS y, w FROM edge WHERE w > 1 UNION ALL SELECT b, a, w FROM edge WHERE w > 1) SELECT x AS node, g, array_to_string(list_sort(list(DISTINCT y)), ',') AS allelic FROM e JOIN grp ON y = node WHERE x NOT IN (SELECT node FROM grp) GROUP BY ALL""")
def c20(s, d):
    e = edge(s, d).where("w > 1")
    e = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    g = groups(s, d)
    out = e.join(g, F.col("y") == F.col("node")).drop("node").join(g.select(F.col("node").alias("x")), "x", "left_anti")
    return out.groupBy(F.col("x").alias("node"), "g").agg(F.array_join(F.array_sort(F.collect_set("y")).cast("array<string>"), ",").alias("allelic"))
