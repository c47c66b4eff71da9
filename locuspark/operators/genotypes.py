"""Genotype tables in long form: chr, pos (or start, end), sample, gt (null where missing)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.kernels import harmonic
from locuspark.operators.intervals import first_by

SITE = ["chr", "pos"]


def allele_counts(g: DataFrame, site: list[str] = SITE, allele: str = "gt") -> DataFrame:
    """site, allele, n over non-missing genotypes."""
    return g.where(F.col(allele).isNotNull()).groupBy(*site, allele).agg(F.count(F.lit(1)).alias("n"))


def site_diversity(g: DataFrame, site: list[str] = SITE, allele: str = "gt") -> DataFrame:
    """site, n, major, alleles, pi: mismatching pairs as a share of all pairs of non-missing genotypes (null for fewer than 2)."""
    s = allele_counts(g, site, allele).groupBy(*site).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.max("n").alias("major"), F.count(F.lit(1)).alias("alleles"))
    return s.select(*site, "n", "major", "alleles", F.when(F.col("n") > 1, (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))).alias("pi"))


def biallelic_pi(n_alt: Column, n: Column) -> Column:
    """n/(n-1) 2 p q of one site."""
    p = n_alt / n
    return n / (n - 1) * 2 * p * (1 - p)


def frequency_spectrum(sites: DataFrame) -> DataFrame:
    """folded, sites: how many sites have each folded major-allele percentage (half-even; 0 where one allele is fixed)."""
    percent = F.bround(F.col("major") / F.col("n") * 100).cast("int")
    return sites.select(F.when(percent < 50, percent).otherwise(100 - percent).alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("sites"))


def tajima_constants(n: int) -> dict[str, float]:
    a1 = sum(1 / i for i in range(1, n))
    a2 = sum(1 / i**2 for i in range(1, n))
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    return {"a1": a1, "e1": c1 / a1, "e2": c2 / (a1 * a1 + a2)}


def window_statistics(g: DataFrame, window: Column, samples: int, by: list[str] = ["chr"]) -> DataFrame:
    """chr, window: sites, segregating, sum_pi, mean_n, theta (per-site harmonic sums), tajima_d (null without segregating sites)."""
    sites = site_diversity(g).withColumn("window", window)
    seg = F.when(F.col("alleles") > 1, 1).otherwise(0)
    out = sites.groupBy(*by, "window").agg(
        F.count(F.lit(1)).alias("sites"), F.sum(seg).alias("segregating"), F.sum(F.coalesce("pi", F.lit(0.0))).alias("sum_pi"), F.avg("n").alias("mean_n"),
        F.sum(F.when((F.col("alleles") > 1) & (F.col("n") > 1), 1.0 / harmonic(F.col("n"))).otherwise(0.0)).alias("theta"),
    )
    k = tajima_constants(samples)
    s = F.col("segregating")
    spread = F.sqrt(F.lit(k["e1"]) * s + F.lit(k["e2"]) * s * (s - 1))
    return out.withColumn("tajima_d", F.when(s > 0, (F.col("sum_pi") - s / F.lit(k["a1"])) / spread))


def mode_allele(g: DataFrame, by: list[str], allele: str = "gt") -> DataFrame:
    """by, allele, n: the commonest allele; of equal ones the smallest."""
    return first_by(allele_counts(g, by, allele), by, [F.desc("n"), F.col(allele)])


def ancestral_derived(outgroup: DataFrame, ingroup: DataFrame, site: list[str] = SITE, least: int = 2) -> DataFrame:
    """site, ancestral, derived: the outgroup's commonest allele; the ingroup's commonest other one if seen more than ``least`` times."""
    anc = mode_allele(outgroup, site).select(*site, F.col("gt").alias("ancestral"))
    other = allele_counts(ingroup, site).join(anc, site).where(F.col("gt") != F.col("ancestral"))
    der = first_by(other, site, [F.desc("n"), F.col("gt")]).where(F.col("n") > least).select(*site, F.col("gt").alias("derived"))
    return anc.join(der, site, "left")


def recode(g: DataFrame, states: DataFrame, site: list[str] = SITE) -> DataFrame:
    """gt to 0 (ancestral), 1 (derived), null otherwise."""
    code = F.when(F.col("gt") == F.col("ancestral"), 0).when(F.col("gt") == F.col("derived"), 1)
    return g.join(states, site).select(*site, "sample", code.alias("state"))


def set_missing(g: DataFrame, missing: DataFrame, on: list[str]) -> DataFrame:
    """gt becomes null where (sample, start, end) is in missing."""
    flags = missing.select(*on).distinct().withColumn("_gone", F.lit(True))
    return g.join(flags, on, "left").withColumn("gt", F.when(F.col("_gone"), None).otherwise(F.col("gt"))).drop("_gone")


def coalesce_samples(calls: DataFrame, allele: list[str]) -> DataFrame:
    """One row per allele with its samples, in order, joined by commas."""
    return calls.groupBy(*allele).agg(F.concat_ws(",", F.sort_array(F.collect_set("sample"))).alias("samples"))


def code_alleles(alleles: DataFrame, site: list[str], order: list[str]) -> DataFrame:
    """The k-th alternative of a site is allele k; the reference is 0."""
    return alleles.withColumn("code", F.dense_rank().over(Window.partitionBy(*site).orderBy(*order)))


#: Samples of a genotype table, at most: their names go into the plan.
SAMPLES = 100_000


def genotype_rows(alleles: DataFrame, samples: DataFrame, site: list[str]) -> DataFrame:
    """Long genotypes of coded alleles (site, samples, code): every one of ``samples`` at every site, 0 if it has no allele.

    A file's samples are its header's; their names, without null, may be SAMPLES at most, or it is an error.
    """
    names = [r[0] for r in samples.select("sample").where("sample is not null").distinct().limit(SAMPLES + 1).collect()]
    if len(names) > SAMPLES:
        raise ValueError(f"more than {SAMPLES} samples")
    has = alleles.select(*site, F.explode(F.split("samples", ",")).alias("sample"), "code").groupBy(*site, "sample").agg(F.max("code").alias("code"))
    all_names = F.split(F.lit("\x1f".join(sorted(names))), "\x1f") if names else F.array().cast("array<string>")
    every = alleles.select(*site).distinct().select(*site, F.explode(all_names).alias("sample"))
    return every.join(has, [*site, "sample"], "left").select(*site, "sample", F.coalesce("code", F.lit(0)).alias("gt"))


def gap_masked(g: DataFrame, missing: DataFrame, on: list[str], most: float = 0.5) -> DataFrame:
    """g with gt null where missing (on, missing) says that more than ``most`` of the place is a gap."""
    gaps = missing.where(F.col("missing") > most).select(*on).distinct()
    return set_missing(g, gaps, on)


def wild_support(haplotypes: DataFrame, wild: DataFrame, site: list[str], by: list[Column]) -> DataFrame:
    """by, hap, wild, sites, support, dosage: how far wild samples carry a haplotype sample's two alleles, averaged over sites.

    haplotypes: site, hap, a1, a2; wild: site, wild, b1, b2. At a site support is the share of the two alleles that the wild
    sample has in at least one copy, dosage the share of its copies that equal them. Sites where both alleles are null are
    left out; a null equals nothing.
    """
    x = haplotypes.where("a1 is not null or a2 is not null").join(wild, site)
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    one, two = same("a1", "b1") + same("a1", "b2"), same("a2", "b1") + same("a2", "b2")
    share = ((one > 0).cast("int") + (two > 0).cast("int")) / 2
    return x.groupBy(*by, "hap", "wild").agg(F.count(F.lit(1)).alias("sites"), F.avg(share).alias("support"), F.avg((one + two) / 4).alias("dosage"))


def pair_mismatches(g: DataFrame, by: list[str], missing_is_allele: bool = False, site: list[str] = SITE) -> DataFrame:
    """by, s1, s2, sites, mismatches over pairs s1 < s2 of samples at a site.

    A site is one row of parallel arrays, so pairs are made inside it, as many as its samples allow; sums combine map-side.
    """
    call = F.struct(F.col("sample").alias("s"), (F.coalesce("gt", F.lit(-1)) if missing_is_allele else F.col("gt")).alias("g"))
    rows = (g if missing_is_allele else g.where("gt is not null")).groupBy(*dict.fromkeys([*by, *site])).agg(F.sort_array(F.collect_list(call)).alias("c"))
    pairs = rows.select(*by, "c", F.posexplode("c").alias("i", "x")).select(*by, "x", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y"))
    return pairs.groupBy(*by, F.col("x.s").alias("s1"), F.col("y.s").alias("s2")).agg(F.count(F.lit(1)).alias("sites"), F.sum(F.when(F.col("x.g") != F.col("y.g"), 1).otherwise(0)).alias("mismatches"))


def linkage(g: DataFrame, reach: int, least: int = 0) -> DataFrame:
    """chr, pos1, pos2, total, p1, q1, p1q1, d, r2 for biallelic (0/1) sites at most ``reach`` apart, over samples not missing in either.

    A site is one row with a map from sample to allele; pairs come from an equi-join on bins of ``reach`` positions.
    """
    sites = g.where("gt is not null").groupBy("chr", "pos").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("sample", "gt")))).alias("m"))
    one = sites.select("chr", F.col("pos").alias("pos1"), F.col("m").alias("m1"), F.explode(F.array(F.floor(F.col("pos") / reach), F.floor(F.col("pos") / reach) + 1)).alias("bin"))
    two = sites.select("chr", F.col("pos").alias("pos2"), F.col("m").alias("m2"), F.floor(F.col("pos") / reach).alias("bin"))
    pairs = one.join(two, ["chr", "bin"]).where((F.col("pos1") < F.col("pos2")) & (F.col("pos2") <= F.col("pos1") + reach))
    both = F.array_intersect(F.map_keys("m1"), F.map_keys("m2"))
    pairs = pairs.withColumn("both", both).withColumn("total", F.size("both")).where(F.col("total") > least)
    count = lambda f: F.aggregate("both", F.lit(0), lambda a, s: a + f(s))
    a, b = (lambda s: F.element_at("m1", s)), (lambda s: F.element_at("m2", s))
    share = pairs.select("chr", "pos1", "pos2", "total", (count(a) / F.col("total")).alias("p1"), (count(b) / F.col("total")).alias("q1"), (count(lambda s: a(s) * b(s)) / F.col("total")).alias("p1q1"))
    share = share.where("p1 > 0 and p1 < 1 and q1 > 0 and q1 < 1").withColumn("d", F.col("p1q1") - F.col("p1") * F.col("q1"))
    return share.withColumn("r2", F.col("d") * F.col("d") / (F.col("p1") * (1 - F.col("p1")) * F.col("q1") * (1 - F.col("q1"))))


def sharing(h: DataFrame, by: list[str], hap: str) -> DataFrame:
    """by: largest, second (next distinct size, null if none), haplotypes."""
    n = h.groupBy(*by, hap).agg(F.count(F.lit(1)).alias("n"))
    sizes = F.sort_array(F.collect_set("n"), asc=False)
    return n.groupBy(*by).agg(F.max("n").alias("largest"), F.try_element_at(sizes, F.lit(2)).alias("second"), F.count(F.lit(1)).alias("haplotypes"))


def heterozygosity(g: DataFrame, by: list[str], het: Column, missing: Column) -> DataFrame:
    """het / (total - missing) for each group, 0 where nothing is known."""
    known = F.count(F.when(~missing, 1))
    return g.groupBy(*by).agg(F.when(known > 0, F.count(F.when(het & ~missing, 1)) / known).otherwise(0.0).alias("het"))


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, r2, adj_r2, t: simple least squares; t is the slope's statistic (null where undefined)."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    n, r2 = F.col("n"), F.col("r2")
    return out.withColumn("adj_r2", F.when(n > 2, 1 - (1 - r2) * (n - 1) / (n - 2))).withColumn("t", F.when((n > 2) & (r2 < 1), F.signum("slope") * F.sqrt(r2 * (n - 2) / (1 - r2))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Probability of a larger absolute value of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x <= 0 or x >= 1:
        return float(x >= 1)
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p_value(fit: DataFrame) -> DataFrame:
    """regression's rows with the slope's p-value."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_two_sided(abs(a), b - 2) for a, b in zip(t, n)], dtype="float64")

    return fit.withColumn("p", p("t", "n"))


def map_rate(markers: DataFrame, width: int) -> DataFrame:
    """chr, window, rate: map distance of each interval between markers, spread over the windows that it overlaps by share."""
    w = Window.partitionBy("chr").orderBy("pos")
    gaps = markers.select("chr", F.lag("pos").over(w).alias("a"), F.col("pos").alias("b"), (F.col("map") - F.lag("map").over(w)).alias("d")).where("a is not null and b > a")
    out = gaps.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / width).cast("long"), F.floor((F.col("b") - 1) / width).cast("long")))).withColumn("window", F.col("k") * width)
    share = (F.least("b", F.col("window") + width) - F.greatest("a", "window")) / (F.col("b") - F.col("a"))
    return out.groupBy("chr", "window").agg(F.sum(F.col("d") * share).alias("rate"))
