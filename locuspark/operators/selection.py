"""Top-k with explicit ties, cascaded selection, and sampling that repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.operators.intervals import first_by


def keep_by_class(df: DataFrame, by: list[str], cls: str, sizes: dict[str, int], order: list[Column], group: str, partial: bool = True) -> DataFrame:
    """by, slot, group: as many of the best groups as a row's class allows, padded with -1.

    partial false: all slots are -1 unless every one can be filled.
    """
    n = F.lit(0)
    for name, k in sizes.items():
        n = F.when(F.col(cls) == name, k).otherwise(n)
    ranked = df.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_n", n)
    slots = ranked.groupBy(*by).agg(F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_have")).where("_n > 0").select(*by, "_have", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("slot"))
    best = ranked.where("slot <= _n").select(*by, "slot", group)
    ok = F.lit(True) if partial else F.col("_have") >= F.col("_n")
    return slots.join(best, [*by, "slot"], "left").select(*by, "slot", F.when(ok, F.coalesce(group, F.lit(-1))).otherwise(-1).alias(group))


def lowest_with_ties(df: DataFrame, by: list[str], value: str, k: int, most: int = 10) -> DataFrame:
    """Rows whose value is at most the group's k-th lowest; groups with ``most`` or more such rows are dropped."""
    w = Window.partitionBy(*by)
    kept = df.withColumn("_r", F.rank().over(w.orderBy(value))).where(F.col("_r") <= k)  # rank ties share a place: the k-th value's rows all have rank <= k
    return kept.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") < most).drop("_r", "_n")


def cascade(df: DataFrame, by: list[str], steps: list[tuple[list[Column], int]]) -> DataFrame:
    """The best n by the first order, of these the best by the next, and so on."""
    for order, n in steps:
        df = first_by(df, by, order, n)
    return df


#: Draws are numbers below 2^28, the first seven hexadecimal digits of a digest.
DRAWS = 1 << 28


def draw(*key: Column | str, seed: int = 0) -> Column:
    """A number below DRAWS that the key decides: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key], F.lit(str(seed)))), 1, 7), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: list[str], one_in: int, seed: int = 0) -> DataFrame:
    """The same rows each time: those whose key's draw falls in one of ``one_in`` classes."""
    return df.where(draw(*key, seed=seed) % one_in == 0)


def poisson_steps(mean: float) -> list[float]:
    """Where the distribution function of a Poisson number steps up, as far as a draw can tell."""
    p, total, steps = 2.718281828459045 ** -mean, 0.0, []
    if not 0 <= mean <= 600:
        raise ValueError("the mean must be between 0 and 600")
    while total < 1 - 0.5 / DRAWS and (p > 1e-300 or len(steps) < mean):
        total += p
        steps.append(total)
        p *= mean / len(steps)
    return steps


def global_rank(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with rank, from 0, in the order of the key's digest, then key: rows are ranked in 4,096 parts, whose sizes are added up."""
    x = df.withColumn("_d", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_p", F.substring("_d", 1, 3))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))  # 4,096 rows at most
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_d", key)) - 1
    return x.join(F.broadcast(parts), "_p").withColumn("rank", (F.col("_before") + place).cast("long")).drop("_d", "_p", "_before")


def draws_with_replacement(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """draw (from 0 to n - 1), key: n rows of df drawn evenly with replacement; none from an empty table."""
    ranked = global_rank(df, key, seed)
    many = ranked.count()
    if not many:
        return df.sparkSession.range(0).select(F.col("id").alias("draw")).join(df.select(key).limit(0))
    wanted = df.sparkSession.range(n).select(F.col("id").alias("draw"), (draw("id", seed=seed + 1) % many).alias("rank"))
    return wanted.join(ranked.select("rank", key), "rank").select("draw", key)


def with_replacement(df: DataFrame, key: list[str], mean: float, seed: int = 0) -> DataFrame:
    """Rows repeated a Poisson number of times of the given mean, decided by the key's draw; no number is cut off."""
    steps = F.array(*[F.lit(x) for x in poisson_steps(mean)])
    count = F.size(F.filter(steps, lambda x: x <= F.col("_u")))
    df = df.withColumn("_u", draw(*key, seed=seed) / float(DRAWS))
    return df.withColumn("_c", count).where("_c > 0").drop("_u").select("*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("copy")).drop("_c")


def choose(options: Column, *key: Column) -> Column:
    """One element of an array, evenly by the key's draw; null for an empty one."""
    return F.try_element_at(options, (draw(*key) % F.greatest(F.size(options), F.lit(1)) + 1).cast("int"))


def pair_up(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """pair, first, second: names put in pairs in the order of their digests; an odd one out is left."""
    r = global_rank(df.select(name).where(F.col(name).isNotNull()).distinct(), name, seed).withColumnRenamed("rank", "_i")
    return r.groupBy(F.floor(F.col("_i") / 2).alias("pair")).agg(F.min(F.when(F.col("_i") % 2 == 0, F.col(name))).alias("first"), F.min(F.when(F.col("_i") % 2 == 1, F.col(name))).alias("second")).where("second is not null")
