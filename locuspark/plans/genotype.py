"""Genotype, diversity and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from locuspark.functions.kernels import window_id
from locuspark.operators import genotypes as G
from locuspark.operators.graphs import class_sizes, contig_scores, group_contacts
from locuspark.operators.intervals import first_by
from locuspark.plans.base import BI, EDGE, GT, IV, MARKERS, bi, edge, gt, iv, markers, table
from locuspark.plans.registry import query
from locuspark.sources.sinks import allele_count_lines, haplotype_lines

_SITE = f"""{GT}, ac AS (SELECT chr, pos, gt, count(*) AS n FROM gt WHERE gt IS NOT NULL GROUP BY ALL), site AS (SELECT chr, pos, sum(n)::BIGINT AS n, max(n) AS major, count(*) AS alleles,
  CASE WHEN sum(n) > 1 THEN (sum(n) * sum(n) - sum(n * n)) / (sum(n) * (sum(n) - 1)) END AS pi FROM ac GROUP BY ALL)"""


@query("D9_window_pi", f"""WITH {_SITE} SELECT chr, (ceil(pos / 500.0) * 500)::BIGINT AS win, count(*) AS sites, round(sum(coalesce(pi, 0)), 6) AS sum_pi, round(avg(pi), 6) AS mean_pi FROM site GROUP BY ALL""")
def d9(s, d):
    x = G.site_diversity(gt(s, d)).groupBy("chr", window_id(F.col("pos"), 500, "ceil").alias("win"))
    return x.agg(F.count(F.lit(1)).alias("sites"), F.round(F.sum(F.coalesce("pi", F.lit(0.0))), 6).alias("sum_pi"), F.round(F.avg("pi"), 6).alias("mean_pi"))


@query("D9_site_pi", f"""WITH {_SITE} SELECT chr, pos, n, major, alleles, round(pi, 6) AS pi FROM site""")
def d9_site(s, d):
    return G.site_diversity(gt(s, d)).withColumn("pi", F.round("pi", 6))


@query("D1_totals", f"""WITH {IV} SELECT seq, sum("end" - sta + 1)::BIGINT AS bp FROM iv WHERE grp <> 'N' GROUP BY seq""")
def d1(s, d):
    return iv(s, d).where("grp <> 'N'").groupBy("seq").agg(F.sum(F.col("end") - F.col("sta") + 1).alias("bp"))


@query("D2_best_group", f"""WITH {IV} SELECT seq, grp, bp FROM (SELECT seq, grp, sum("end" - sta)::BIGINT AS bp, row_number() OVER (PARTITION BY seq ORDER BY sum("end" - sta) DESC, grp) AS rn FROM iv GROUP BY seq, grp) WHERE rn = 1""")
def d2(s, d):
    return first_by(iv(s, d).groupBy("seq", "grp").agg(F.sum(F.col("end") - F.col("sta")).alias("bp")), ["seq"], [F.desc("bp"), F.col("grp")])


_ENDS = """e AS (SELECT l_suppkey % 20 AS a, l_partkey % 20 AS b, CASE WHEN l_quantity <= 25 THEN 'L' ELSE 'R' END || CASE WHEN l_extendedprice <= 40000 THEN 'L' ELSE 'R' END AS cls FROM lineitem WHERE l_suppkey % 20 < l_partkey % 20)"""


@query("D3_end_classes", f"""WITH {_ENDS} SELECT a, b, count(*) FILTER (cls = 'LL') AS ll, count(*) FILTER (cls = 'LR') AS lr, count(*) FILTER (cls = 'RL') AS rl, count(*) FILTER (cls = 'RR') AS rr FROM e GROUP BY ALL""")
def d3(s, d):
    end = lambda c, t: F.when(F.col(c) <= t, "L").otherwise("R")
    e = table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b"), F.concat(end("l_quantity", 25), end("l_extendedprice", 40000)).alias("cls")).where("a < b")
    return e.groupBy("a", "b").agg(*[F.count_if(F.col("cls") == k).alias(k.lower()) for k in ("LL", "LR", "RL", "RR")])


@query("D3_compat_classes", f"""WITH {_ENDS} SELECT a, b, count(*) FILTER (cls <> 'LL') AS ll, count(*) FILTER (cls = 'LL') AS lr FROM e GROUP BY ALL""")
def d3_compat(s, d):
    x = d3(s, d)
    return x.select("a", "b", (F.col("lr") + F.col("rl") + F.col("rr")).alias("ll"), F.col("ll").alias("lr"))


@query("D4_window_contacts", """SELECT least(l_suppkey, l_partkey) AS c1, greatest(l_suppkey, l_partkey) AS c2, l_linenumber AS win, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL""")
def d4(s, d):
    x = table(s, d, "lineitem").where("l_suppkey <> l_partkey")
    return x.groupBy(F.least("l_suppkey", "l_partkey").alias("c1"), F.greatest("l_suppkey", "l_partkey").alias("c2"), F.col("l_linenumber").alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query("D5_normalised_contact", f"""WITH {_ENDS}, c AS (SELECT a, b, cls, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, cls) AS rn FROM c) SELECT a, b, cls, round(n / (a + b + 100) * 100000, 6) AS contact FROM r WHERE rn = 1 AND n / (a + b + 100) * 100000 > 1000""")
def d5(s, d):
    end = lambda c, t: F.when(F.col(c) <= t, "L").otherwise("R")
    e = table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b"), F.concat(end("l_quantity", 25), end("l_extendedprice", 40000)).alias("cls")).where("a < b")
    best = first_by(e.groupBy("a", "b", "cls").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], [F.desc("n"), F.col("cls")])
    contact = F.col("n") / (F.col("a") + F.col("b") + 100) * 100000
    return best.where(contact > 1000).select("a", "b", "cls", F.round(contact, 6).alias("contact"))


@query("D6_group_contacts", f"""WITH {EDGE}, g AS (SELECT s_suppkey AS node, s_nationkey % 6 AS g FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 6 FROM supplier WHERE s_suppkey % 3 = 0), e AS (SELECT a, b, w, x.g AS ga, y.g AS gb FROM edge JOIN g x ON a = x.node JOIN g y ON b = y.node)
  SELECT least(ga, gb) AS g1, greatest(ga, gb) AS g2, sum(w)::BIGINT AS total, round(avg(w), 6) AS mean, count(*) AS n FROM e WHERE ga = gb OR NOT ((a, gb) IN (SELECT (node, g) FROM g) OR (b, ga) IN (SELECT (node, g) FROM g)) GROUP BY ALL""")
def d6(s, d):
    p = table(s, d, "supplier")
    g = p.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 6).alias("g")).union(p.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_nationkey") + 1) % 6))
    return group_contacts(edge(s, d), g).withColumn("mean", F.round("mean", 6))


@query("D7_spectrum", f"""WITH {_SITE} SELECT CASE WHEN f < 50 THEN f ELSE 100 - f END AS folded, count(*) AS sites FROM (SELECT round_even(major / n * 100, 0)::INT AS f FROM site) GROUP BY ALL""")
def d7(s, d):
    return G.frequency_spectrum(G.site_diversity(gt(s, d)))


@query("D8_biallelic_pi", f"""WITH {BI} SELECT chr, pos, round(count(*) / (count(*) - 1) * 2 * avg(gt) * (1 - avg(gt)), 6) AS pi FROM bi GROUP BY ALL HAVING count(*) > 1""")
def d8(s, d):
    x = bi(s, d).groupBy("chr", "pos").agg(F.sum("gt").alias("alt"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.select("chr", "pos", F.round(G.biallelic_pi(F.col("alt"), F.col("n")), 6).alias("pi"))


_K = G.tajima_constants(7)
_STAT = f"""WITH {_SITE}, h AS (SELECT *, (SELECT sum(1.0 / i) FROM generate_series(1, n - 1) t(i)) AS a1 FROM site), w AS (SELECT chr, pos // 1000 AS "window", count(*) AS sites, count(*) FILTER (alleles > 1) AS segregating, sum(coalesce(pi, 0)) AS sum_pi, avg(n) AS mean_n,
  sum(CASE WHEN alleles > 1 AND n > 1 THEN 1 / a1 ELSE 0 END) AS theta FROM h GROUP BY ALL)"""


@query("D10_theta", _STAT + """ SELECT chr, "window", sites, segregating, round(theta, 6) AS theta FROM w""")
def d10(s, d):
    x = G.window_statistics(gt(s, d), window_id(F.col("pos"), 1000), 7)
    return x.select("chr", "window", "sites", "segregating", F.round("theta", 6).alias("theta"))


@query("D11_tajima", _STAT + f""" SELECT chr, "window", round(sum_pi, 6) AS sum_pi, round(mean_n, 6) AS mean_n, CASE WHEN segregating > 0 THEN round((sum_pi - segregating / {_K['a1']!r}::DOUBLE) / sqrt({_K['e1']!r}::DOUBLE * segregating + {_K['e2']!r}::DOUBLE * segregating * (segregating - 1)), 5) END AS tajima_d FROM w""")
def d11(s, d):
    x = G.window_statistics(gt(s, d), window_id(F.col("pos"), 1000), 7)
    return x.select("chr", "window", F.round("sum_pi", 6).alias("sum_pi"), F.round("mean_n", 6).alias("mean_n"), F.round("tajima_d", 5).alias("tajima_d"))


_LD = """p AS (SELECT x.chr, x.pos AS pos1, y.pos AS pos2, count(*) AS total, avg(x.gt) AS p1, avg(y.gt) AS q1, avg(x.gt * y.gt) AS p1q1 FROM bi x JOIN bi y ON x.chr = y.chr AND x.sample = y.sample AND x.pos < y.pos AND y.pos <= x.pos + 15 GROUP BY ALL),
  ld AS (SELECT *, p1q1 - p1 * q1 AS dd, power(p1q1 - p1 * q1, 2) / (p1 * (1 - p1) * q1 * (1 - q1)) AS r2 FROM p WHERE total > 4 AND p1 > 0 AND p1 < 1 AND q1 > 0 AND q1 < 1)"""


@query("D12_linkage", f"""WITH {BI}, {_LD} SELECT chr, pos1, pos2, total, round(p1, 6) AS p1, round(q1, 6) AS q1, round(dd, 6) AS d, round(r2, 6) AS r2 FROM ld""")
def d12(s, d):
    x = G.linkage(bi(s, d), 15, 4)
    return x.select("chr", "pos1", "pos2", F.col("total").cast("long").alias("total"), *[F.round(c, 6).alias(c) for c in ("p1", "q1", "d", "r2")])


@query("C16_band_pairs", f"""WITH {BI}, s AS (SELECT DISTINCT chr, pos FROM bi) SELECT x.chr, x.pos AS pos1, count(*) AS n FROM s x JOIN s y ON x.chr = y.chr AND x.pos < y.pos AND y.pos <= x.pos + 40 GROUP BY ALL""")
def c16(s, d):
    x = bi(s, d).select("chr", "pos").distinct()
    one = x.select("chr", F.col("pos").alias("pos1"), F.explode(F.array(F.floor(F.col("pos") / 40), F.floor(F.col("pos") / 40) + 1)).alias("bin"))
    two = x.select("chr", F.col("pos").alias("pos2"), F.floor(F.col("pos") / 40).alias("bin"))
    return one.join(two, ["chr", "bin"]).where("pos1 < pos2 and pos2 <= pos1 + 40").groupBy("chr", "pos1").agg(F.count(F.lit(1)).alias("n"))


@query("D13_mean_linkage", f"""WITH {BI}, {_LD} SELECT chr, pos1 // 50 AS w1, pos2 // 50 AS w2, round(avg(r2), 6) AS mean_r2, count(*) AS n FROM ld GROUP BY ALL""")
def d13(s, d):
    x = G.linkage(bi(s, d), 15, 4)
    return x.groupBy("chr", window_id(F.col("pos1"), 50).alias("w1"), window_id(F.col("pos2"), 50).alias("w2")).agg(F.round(F.avg("r2"), 6).alias("mean_r2"), F.count(F.lit(1)).alias("n"))


_PAIR = """SELECT chr, x.sample AS s1, y.sample AS s2, count(*) AS sites, count(*) FILTER ({differs}) AS mismatches FROM {src} x JOIN {src} y USING (chr, pos) WHERE x.sample < y.sample{known} GROUP BY ALL"""


@query("D14_mismatches_masked", f"WITH {GT} " + _PAIR.format(src="gt", differs="x.gt <> y.gt", known=" AND x.gt IS NOT NULL AND y.gt IS NOT NULL"))
def d14(s, d):
    return G.pair_mismatches(gt(s, d), ["chr"])


@query("D14_mismatches_na_allele", f"WITH {GT} " + _PAIR.format(src="gt", differs="x.gt IS DISTINCT FROM y.gt", known=""))
def d14_na(s, d):
    return G.pair_mismatches(gt(s, d), ["chr"], missing_is_allele=True)


@query("C17_sample_pairs", f"""WITH {GT} SELECT chr, x.sample AS s1, y.sample AS s2, count(*) AS n FROM gt x JOIN gt y USING (chr, pos) WHERE x.sample < y.sample GROUP BY ALL""")
def c17(s, d):
    return G.pair_mismatches(gt(s, d), ["chr"], missing_is_allele=True).select("chr", "s1", "s2", F.col("sites").alias("n"))


@query("D15_sliding_mismatches", f"""WITH {GT}, w AS (SELECT pos, sample, gt, unnest(generate_series(greatest((pos + 4000) // 500 - 9, 0), pos // 500)) * 500 AS win FROM gt WHERE gt IS NOT NULL), m AS (SELECT win, x.sample AS s1, y.sample AS s2, count(*) AS sites, count(*) FILTER (x.gt <> y.gt) AS mismatches FROM w x JOIN w y USING (win, pos)
  WHERE x.sample < y.sample GROUP BY ALL) SELECT * FROM m""")
def d15(s, d):
    from locuspark.operators.intervals import sliding

    w = sliding(gt(s, d), "pos", 1000, 500).withColumnRenamed("window", "win")
    return G.pair_mismatches(w, ["win"], site=["pos"])


@query("D15_gap_masked", f"""WITH {GT}, f AS (SELECT pos // 8 AS place, sample, avg((gt IS NULL)::INT) AS missing FROM gt GROUP BY ALL), k AS (SELECT gt.pos, gt.sample, CASE WHEN missing > 0.5 THEN NULL ELSE gt END AS gt FROM gt JOIN f ON f.place = gt.pos // 8 AND f.sample = gt.sample),
  w AS (SELECT *, unnest(generate_series(greatest((pos + 4000) // 500 - 9, 0), pos // 500)) * 500 AS win FROM k WHERE gt IS NOT NULL) SELECT win, x.sample AS s1, y.sample AS s2, count(*) AS sites, count(*) FILTER (x.gt <> y.gt) AS mismatches FROM w x JOIN w y USING (win, pos) WHERE x.sample < y.sample GROUP BY ALL""")
def d15_masked(s, d):
    from locuspark.operators.intervals import sliding

    g = gt(s, d).withColumn("place", F.floor(F.col("pos") / 8))
    missing = g.groupBy("place", "sample").agg(F.avg(F.col("gt").isNull().cast("int")).alias("missing"))
    w = sliding(G.gap_masked(g, missing, ["place", "sample"]), "pos", 1000, 500).withColumnRenamed("window", "win")
    return G.pair_mismatches(w, ["win"], site=["pos"])


@query("D16_missing_fraction", f"""WITH {GT} SELECT pos // 500 AS win, sample, round(avg((gt IS NULL)::INT), 6) AS missing FROM gt GROUP BY ALL""")
def d16(s, d):
    return gt(s, d).groupBy(window_id(F.col("pos"), 500).alias("win"), "sample").agg(F.round(F.avg(F.col("gt").isNull().cast("int")), 6).alias("missing"))


@query("D17_heterozygosity", """WITH g AS (SELECT l_orderkey // 500 AS win, l_linenumber AS sample, CASE WHEN l_quantity < 8 THEN './.' ELSE (l_suppkey % 2)::VARCHAR || CASE WHEN l_tax < 0.04 THEN '|' ELSE '/' END || (l_partkey % 3)::VARCHAR END AS gt FROM lineitem)
  SELECT win, sample, CASE WHEN count(*) FILTER (gt <> './.') > 0 THEN round(count(*) FILTER (replace(gt, '|', '/') IN ('0/1', '1/0')) / count(*) FILTER (gt <> './.'), 6) ELSE 0 END AS het FROM g GROUP BY ALL""")
def d17(s, d):
    from locuspark.functions.kernels import is_het, is_missing

    gt_text = F.when(F.col("l_quantity") < 8, "./.").otherwise(F.concat((F.col("l_suppkey") % 2).cast("string"), F.when(F.col("l_tax") < 0.04, "|").otherwise("/"), (F.col("l_partkey") % 3).cast("string")))
    g = table(s, d, "lineitem").select(window_id(F.col("l_orderkey"), 500).alias("win"), F.col("l_linenumber").alias("sample"), gt_text.alias("gt"))
    return G.heterozygosity(g, ["win", "sample"], is_het(F.col("gt")), is_missing(F.col("gt"))).withColumn("het", F.round("het", 6))


_POP = """st AS (SELECT l_partkey AS pos, l_suppkey % 3 AS pop, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS state FROM lineitem)"""


def _states(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 3).alias("pop"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).alias("state"))


@query("D18_counts_by_population", f"""WITH {_POP}, c AS (SELECT pos, pop, count(*) FILTER (state = 1) || ',' || count(*) FILTER (state = 0) AS c FROM st GROUP BY ALL) SELECT pos, coalesce(max(c) FILTER (pop = 0), '0,0') AS "0", coalesce(max(c) FILTER (pop = 1), '0,0') AS "1", coalesce(max(c) FILTER (pop = 2), '0,0') AS "2" FROM c GROUP BY pos""")
def d18(s, d):
    return allele_count_lines(_states(s, d), ["pos"], "pop", "state", [0, 1, 2])


_SUP = f"""{GT}, two AS (SELECT chr, pos, sample, gt AS a, lead(gt) OVER (PARTITION BY chr, pos ORDER BY sample) AS b FROM gt), x AS (SELECT c.chr, c.pos // 1000 AS win, c.sample AS hap, w.sample AS wild, coalesce((c.a = w.a)::INT, 0) + coalesce((c.a = w.b)::INT, 0) AS one, coalesce((c.b = w.a)::INT, 0) + coalesce((c.b = w.b)::INT, 0) AS two
  FROM two c JOIN two w USING (chr, pos) WHERE c.sample <= 3 AND w.sample > 3 AND (c.a IS NOT NULL OR c.b IS NOT NULL)), sup AS (SELECT chr, win, hap, wild, count(*) AS sites, avg(((one > 0)::INT + (two > 0)::INT) / 2.0) AS support, avg((one + two) / 4.0) AS dosage FROM x GROUP BY ALL)"""


def _support(s, d):
    """Samples up to 3 are cultivated, the others wild; a sample's second allele is that of the next sample at the site."""
    from pyspark.sql import Window

    g = gt(s, d).withColumn("other", F.lead("gt").over(Window.partitionBy("chr", "pos").orderBy("sample")))
    c = g.where("sample <= 3").select("chr", "pos", F.col("sample").alias("hap"), F.col("gt").alias("a1"), F.col("other").alias("a2"))
    w = g.where("sample > 3").select("chr", "pos", F.col("sample").alias("wild"), F.col("gt").alias("b1"), F.col("other").alias("b2"))
    return G.wild_support(c, w, ["chr", "pos"], [F.col("chr"), window_id(F.col("pos"), 1000).alias("win")])


@query("D19_wild_support", f"WITH {_SUP} SELECT chr, win, hap, wild, sites, round(support, 6) AS support, round(dosage, 6) AS dosage FROM sup")
def d19(s, d):
    return _support(s, d).withColumn("support", F.round("support", 6)).withColumn("dosage", F.round("dosage", 6))


@query("D20_quantile_filter", f"""WITH {_SUP}, r AS (SELECT chr, win, hap, wild, round(dosage, 6) AS dosage FROM sup), q AS (SELECT hap, quantile_cont(dosage, 0.9) AS q FROM r GROUP BY hap) SELECT chr, win, hap, wild, dosage FROM r JOIN q USING (hap) WHERE dosage >= q - 1e-9""")
def d20(s, d):
    r = d19(s, d)
    q = r.groupBy("hap").agg(F.percentile("dosage", 0.9).alias("q"))
    return r.join(q, "hap").where("dosage >= q - 1e-9").select("chr", "win", "hap", "wild", "dosage")


@query("D21_distinct_variants", """SELECT l_linenumber AS sample, count(*) AS total, count(DISTINCT (l_suppkey, l_returnflag, l_linestatus)) AS different, round(count(DISTINCT (l_suppkey, l_returnflag, l_linestatus)) / count(*), 6) AS ratio FROM lineitem GROUP BY 1""")
def d21(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("sample")).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.struct("l_suppkey", "l_returnflag", "l_linestatus")).alias("different"))
    return x.withColumn("ratio", F.round(F.col("different") / F.col("total"), 6))


_HAP = """hap AS (SELECT l_suppkey AS pos, l_linenumber AS sample, l_partkey % 6 AS h FROM lineitem)"""


def _haps(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("pos"), F.col("l_linenumber").alias("sample"), (F.col("l_partkey") % 6).alias("h"))


@query("D22_sharing", f"""WITH {_HAP}, n AS (SELECT pos, h, count(*) AS n FROM hap GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY pos ORDER BY n DESC) AS k FROM n) SELECT pos, max(n) AS largest, max(n) FILTER (k = 2) AS second, count(*) AS haplotypes FROM r GROUP BY pos""")
def d22(s, d):
    return G.sharing(_haps(s, d), ["pos"], "h")


@query("D35_sample_sharing", f"""WITH {_HAP}, n AS (SELECT *, count(*) OVER (PARTITION BY pos, h) AS n FROM hap) SELECT sample, pos // 10 AS win, round(avg(n), 6) AS mean FROM n GROUP BY ALL""")
def d35(s, d):
    from pyspark.sql import Window

    n = _haps(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pos", "h")))
    return n.groupBy("sample", window_id(F.col("pos"), 10).alias("win")).agg(F.round(F.avg("n"), 6).alias("mean"))


@query("D23_deciles", """WITH f AS (SELECT p_partkey % 5 AS chr, (p_size - 1) / 49.0 AS fq FROM part) SELECT chr, least(floor(fq * 10)::INT, 9) AS bucket, count(*) AS n FROM f GROUP BY ALL""")
def d23(s, d):
    f = table(s, d, "part").select((F.col("p_partkey") % 5).alias("chr"), ((F.col("p_size") - 1) / 49.0).alias("fq"))
    return f.groupBy("chr", F.least(F.floor(F.col("fq") * 10).cast("int"), F.lit(9)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("D23_density", """WITH f AS (SELECT p_partkey % 5 AS chr, (p_size - 1) / 49.0 AS fq, p_retailprice FROM part), z AS (SELECT chr, sum(p_retailprice) AS size FROM f GROUP BY chr) SELECT f.chr, least(floor(fq * 10)::INT, 9) AS bucket, round(count(*) / any_value(size) * 1e6, 4) AS density FROM f JOIN z USING (chr) GROUP BY ALL""")
def d23_density(s, d):
    """Counts of each decile as a share of the chromosome's size."""
    size = table(s, d, "part").groupBy((F.col("p_partkey") % 5).alias("chr")).agg(F.sum("p_retailprice").alias("size"))
    return d23(s, d).join(size, "chr").select("chr", "bucket", F.round(F.col("n") / F.col("size") * 1e6, 4).alias("density"))


@query("D24_value_counts", """SELECT l_returnflag AS chr, l_quantity::INT AS qual, count(*) AS n FROM lineitem GROUP BY ALL""")
def d24(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("chr"), F.col("l_quantity").cast("int").alias("qual")).agg(F.count(F.lit(1)).alias("n"))


@query("D25_weighted_mean", f"""WITH {IV}, x AS (SELECT seq, (id % 7) / 10.0 AS pi, k AS win, least("end", k * 100 + 99) - greatest(sta, k * 100) + 1 AS bp FROM (SELECT *, unnest(generate_series(sta // 100, "end" // 100)) AS k FROM iv)), m AS (SELECT seq, win, sum(pi * bp / 100) AS v FROM x GROUP BY ALL),
  sp AS (SELECT seq, unnest(generate_series(min(sta) // 100 - 2, max("end") // 100 + 1)) AS win FROM iv GROUP BY seq) SELECT seq, win, round(coalesce(v, 0), 6) AS v FROM sp LEFT JOIN m USING (seq, win)""")
def d25(s, d):
    from locuspark.operators.intervals import over_windows

    x = over_windows(iv(s, d), "sta", "end", 100).withColumn("win", F.floor(F.col("window") / 100))
    m = x.groupBy("seq", "win").agg(F.sum((F.col("id") % 7) / 10.0 * F.col("overlap") / 100).alias("v"))
    sp = iv(s, d).groupBy("seq").agg((F.floor(F.min("sta") / 100) - 2).alias("lo"), (F.floor(F.max("end") / 100) + 1).alias("hi")).select("seq", F.explode(F.sequence("lo", "hi")).alias("win"))
    return sp.join(m, ["seq", "win"], "left").select("seq", "win", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"))


@query("D26_regression", """SELECT l_returnflag AS chr, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2 FROM lineitem GROUP BY 1""")
def d26(s, d):
    x = G.regression(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "chr"), ["chr"], "l_quantity", "l_extendedprice")
    return x.select("chr", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round("adj_r2", 6).alias("adj_r2"))


@query("D26_regression_p")
def d26_p(s, d):
    x = G.with_p_value(G.regression(table(s, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax"))
    return x.select("l_returnflag", F.round("p", 6).alias("p"))


@query("D27_summary", """SELECT l_returnflag AS chr, round(avg(l_discount), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1""")
def d27(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("chr")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("D29_region_density", """WITH v AS (SELECT l_orderkey AS rid, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) SELECT o_orderkey AS rid, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) = 0 THEN o_totalprice ELSE o_totalprice / (n + 1e-6) END, 3) AS density,
  CASE WHEN CASE WHEN coalesce(n, 0) = 0 THEN o_totalprice ELSE o_totalprice / (n + 1e-6) END > 100000 THEN 'IBD' ELSE 'SYN' END AS label FROM orders LEFT JOIN v ON rid = o_orderkey""")
def d29(s, d):
    v = table(s, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("rid")).agg(F.count_distinct("l_partkey").alias("n"))
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("rid"), "o_totalprice").join(v, "rid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    density = F.when(F.col("n") == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") / (F.col("n") + 1e-6))
    return x.select("rid", "n", F.round(density, 3).alias("density"), F.when(density > 100000, "IBD").otherwise("SYN").alias("label"))


@query("D30_clustering_quality", """WITH x AS (SELECT l_suppkey % 9 AS run, l_linenumber % 4 AS g1, l_partkey % 4 AS g2, l_quantity AS c FROM lineitem), q AS (SELECT run, avg(c) FILTER (g1 = g2) / (avg(c) FILTER (g1 <> g2) + 0.1) AS ratio FROM x GROUP BY run), z AS (SELECT run, stddev_samp(n) AS sd FROM (SELECT run, g1, count(*) AS n FROM x GROUP BY ALL) GROUP BY run)
  SELECT run, round(ratio, 6) AS ratio, round(sd, 6) AS sd FROM q JOIN z USING (run)""")
def d30(s, d):
    x = table(s, d, "lineitem").select((F.col("l_suppkey") % 9).alias("run"), (F.col("l_linenumber") % 4).alias("g1"), (F.col("l_partkey") % 4).alias("g2"), F.col("l_quantity").alias("c"))
    same = F.col("g1") == F.col("g2")
    q = x.groupBy("run").agg((F.avg(F.when(same, F.col("c"))) / (F.avg(F.when(~same, F.col("c"))) + 0.1)).alias("ratio"))
    z = x.groupBy("run", "g1").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.stddev_samp("n").alias("sd"))
    return q.join(z, "run").select("run", F.round("ratio", 6).alias("ratio"), F.round("sd", 6).alias("sd"))


@query("D31_mode", f"""WITH {GT} SELECT chr, pos, gt, n FROM (SELECT chr, pos, gt, count(*) AS n, row_number() OVER (PARTITION BY chr, pos ORDER BY count(*) DESC, gt) AS rn FROM gt WHERE gt IS NOT NULL GROUP BY chr, pos, gt) WHERE rn = 1""")
def d31(s, d):
    return G.mode_allele(gt(s, d), ["chr", "pos"])


_ANC = f"""{GT}, o AS (SELECT chr, pos, gt AS ancestral FROM (SELECT chr, pos, gt, row_number() OVER (PARTITION BY chr, pos ORDER BY count(*) DESC, gt) AS rn FROM gt WHERE gt IS NOT NULL AND sample <= 2 GROUP BY chr, pos, gt) WHERE rn = 1),
  i AS (SELECT chr, pos, gt AS derived FROM (SELECT gt.chr, gt.pos, gt, count(*) AS n, row_number() OVER (PARTITION BY gt.chr, gt.pos ORDER BY count(*) DESC, gt) AS rn FROM gt JOIN o USING (chr, pos) WHERE gt IS NOT NULL AND sample > 2 AND gt <> ancestral GROUP BY gt.chr, gt.pos, gt) WHERE rn = 1 AND n > 2)"""


def _ancestral(s, d):
    g = gt(s, d)
    return G.ancestral_derived(g.where("sample <= 2"), g.where("sample > 2"))


@query("D32_ancestral", f"WITH {_ANC} SELECT chr, pos, ancestral, derived FROM o LEFT JOIN i USING (chr, pos)")
def d32(s, d):
    return _ancestral(s, d)


@query("D32_recode", f"WITH {_ANC} SELECT chr, pos, sample, CASE WHEN gt = ancestral THEN 0 WHEN gt = derived THEN 1 END AS state FROM gt JOIN (SELECT * FROM o LEFT JOIN i USING (chr, pos)) USING (chr, pos)")
def d32_recode(s, d):
    return G.recode(gt(s, d), _ancestral(s, d))


@query("D33_represented_size", """SELECT l_returnflag AS cls, sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE round(l_quantity / 10) END)::BIGINT AS size FROM lineitem GROUP BY 1""")
def d33(s, d):
    mult = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(F.round(F.col("l_quantity") / 10))
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("cls")).agg(F.sum(F.col("l_quantity") * mult).cast("long").alias("size"))


@query("D34_refined_score", f"WITH {MARKERS} SELECT ctg, lg, score, links, best, best_hic FROM sc JOIN bc USING (ctg, lg)")
def d34(s, d):
    return contig_scores(markers(s, d))


@query("D34_class_sizes", f"""WITH {MARKERS} SELECT ctg, type, sum("end" - sta + 1)::BIGINT AS size FROM (SELECT DISTINCT ctg, sta, "end", type FROM mk) GROUP BY ALL""")
def d34_sizes(s, d):
    return class_sizes(markers(s, d))


@query("D36_shared_blocks", """WITH b AS (SELECT l_suppkey AS chr, l_linenumber AS pair, l_quantity AS len FROM lineitem) SELECT chr, pair, count(*) AS n, sum(len) AS total, round(sum(len) / any_value(s_acctbal + 2000), 6) AS share FROM b JOIN supplier ON s_suppkey = chr GROUP BY chr, pair""")
def d36(s, d):
    b = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("chr"), F.col("l_linenumber").alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    x = b.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("chr"), "s_acctbal"), "chr")
    return x.select("chr", "pair", "n", "total", F.round(F.col("total") / (F.col("s_acctbal") + 2000), 6).alias("share"))


@query("D37_mismatch_histogram", f"WITH {GT}, m AS (" + _PAIR.format(src="gt", differs="x.gt <> y.gt", known=" AND x.gt IS NOT NULL AND y.gt IS NOT NULL").replace("SELECT chr,", "SELECT chr, pos // 2000 AS win,") + """) SELECT mismatches // 5 AS bucket, count(*) AS n FROM m WHERE mismatches BETWEEN 1 AND 500 GROUP BY ALL""")
def d37(s, d):
    g = gt(s, d).withColumn("win", window_id(F.col("pos"), 2000))
    m = G.pair_mismatches(g, ["chr", "win"]).where("mismatches between 1 and 500")
    return m.groupBy(window_id(F.col("mismatches"), 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("D38_clamped_coverage", """WITH c AS (SELECT l_suppkey AS ctg, sum(l_quantity) AS cov FROM lineitem GROUP BY 1) SELECT ctg, round(least(cov / (s_acctbal + 3000), 1), 6) AS ratio, round(least(cov, s_acctbal + 3000), 3) AS covered FROM c JOIN supplier ON ctg = s_suppkey""")
def d38(s, d):
    c = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("cov")).join(table(s, d, "supplier"), "s_suppkey")
    size = F.col("s_acctbal") + 3000
    return c.select(F.col("s_suppkey").alias("ctg"), F.round(F.least(F.col("cov") / size, F.lit(1.0)), 6).alias("ratio"), F.round(F.least(F.col("cov"), size), 3).alias("covered"))


@query("D39_burn_in", """SELECT chain, i FROM (SELECT o_custkey % 5 AS chain, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders) WHERE rn > round_even(0.35 * n, 0)""")
def d39(s, d):
    from pyspark.sql import Window

    x = table(s, d, "orders").select((F.col("o_custkey") % 5).alias("chain"), F.col("o_orderkey").alias("i"))
    w = Window.partitionBy("chain")
    return x.withColumn("rn", F.row_number().over(w.orderBy("i"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("rn") > F.bround(F.lit(0.35) * F.col("n"), 0)).select("chain", "i")


_CALL = """call AS (SELECT DISTINCT l_suppkey % 4 AS chr, l_partkey AS start, l_partkey + 1 AS "end", 'R' AS ref, l_returnflag AS alt, 's' || l_linenumber AS sample FROM lineitem)"""


def _calls(s, d):
    return table(s, d, "lineitem").select((F.col("l_suppkey") % 4).alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.lit("R").alias("ref"), F.col("l_returnflag").alias("alt"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample")).distinct()


@query("E21_coalesce_samples", f"""WITH {_CALL} SELECT chr, start, "end", ref, alt, array_to_string(list_sort(list(sample)), ',') AS samples FROM call GROUP BY ALL""")
def e21(s, d):
    return G.coalesce_samples(_calls(s, d), ["chr", "start", "end", "ref", "alt"])


@query("E22_code_alleles", f"""WITH {_CALL} SELECT DISTINCT chr, start, "end", ref, alt, dense_rank() OVER (PARTITION BY chr, start, "end" ORDER BY ref, alt)::INT AS code FROM call""")
def e22(s, d):
    return G.code_alleles(_calls(s, d).select("chr", "start", "end", "ref", "alt").distinct(), ["chr", "start", "end"], ["ref", "alt"])


@query("E22_genotype_table", f"""WITH {_CALL}, k AS (SELECT *, dense_rank() OVER (PARTITION BY chr, start, "end" ORDER BY ref, alt)::INT AS code FROM call), n AS (SELECT DISTINCT sample FROM call), t AS (SELECT DISTINCT chr, start, "end" FROM call) SELECT t.chr, t.start, t."end", n.sample, coalesce(max(code), 0) AS gt FROM t CROSS JOIN n LEFT JOIN k USING (chr, start, "end", sample) GROUP BY ALL""")
def e22_table(s, d):
    a = G.code_alleles(e21(s, d), ["chr", "start", "end"], ["ref", "alt"])
    return G.genotype_rows(a, _calls(s, d).select("sample").distinct(), ["chr", "start", "end"])


@query("C10_set_missing", f"""WITH {GT} SELECT chr, pos, sample, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = pos AND o_custkey % 7 = sample - 1) THEN NULL ELSE gt END AS gt FROM gt""")
def c10(s, d):
    m = table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 7 + 1).cast("int").alias("sample"))
    return G.set_missing(gt(s, d), m, ["pos", "sample"]).select("chr", "pos", "sample", "gt")


@query("J1_pivot", f"""WITH {GT} SELECT pos, max(gt) FILTER (sample = 1) AS "1", max(gt) FILTER (sample = 2) AS "2", max(gt) FILTER (sample = 3) AS "3" FROM gt GROUP BY pos""")
def j1(s, d):
    return gt(s, d).groupBy("pos").pivot("sample", [1, 2, 3]).agg(F.max("gt"))


@query("J2_indicators", f"""WITH {_CALL} SELECT chr, start, alt, (list_contains(list(sample), 's1'))::INT AS s1, (list_contains(list(sample), 's2'))::INT AS s2 FROM call GROUP BY ALL""")
def j2(s, d):
    names = F.split("samples", ",")
    return e21(s, d).select("chr", "start", "alt", *[F.array_contains(names, n).cast("int").alias(n) for n in ("s1", "s2")])


@query("J3_unpivot", """SELECT o_orderkey AS id, k, v FROM (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS cust FROM orders) UNPIVOT (v FOR k IN (price, cust))""")
def j3(s, d):
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return x.unpivot("id", ["price", "cust"], "k", "v")


@query("J4_transpose", f"""WITH {BI} SELECT sample, array_to_string(list(gt::VARCHAR ORDER BY chr, pos), ' ') AS line FROM bi GROUP BY sample""")
def j4(s, d):
    return haplotype_lines(bi(s, d), "sample", ["chr", "pos"], "gt")


@query("J5_submatrix", """SELECT l_suppkey AS r, l_partkey AS c, max(l_quantity) AS v FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY ALL""")
def j5(s, d):
    r = table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    c = table(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    x = table(s, d, "lineitem").join(r, "l_suppkey", "left_semi").join(c, "l_partkey", "left_semi")
    return x.groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.max("l_quantity").alias("v"))


@query("J6_fold_lines", """SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS roles FROM conversations GROUP BY 1""")
def j6(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return x.select("conv_id", F.array_join(F.transform("t", lambda v: v["role"]), ">").alias("roles"))
