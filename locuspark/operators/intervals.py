"""Interval algebra on closed integer intervals: joins by bins, merging, tiling, runs, sessions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.kernels import overlap_len


def _bins(sta: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(sta / width).cast("long"), F.floor(end / width).cast("long")))


def range_join(a: DataFrame, b: DataFrame, key: list[str], a_sta: str, a_end: str, b_sta: str, b_end: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals with equal keys, as an equi-join on (key, bin).

    Both sides are laid out over bins of ``width``; a pair is kept in the first bin that both reach, so it comes once and
    nothing has to be made distinct. Column names other than the key must differ. how: inner or left.
    """
    x = a.where(F.col(a_end) >= F.col(a_sta)).withColumn("_bin", _bins(F.col(a_sta), F.col(a_end), width))
    y = b.where(F.col(b_end) >= F.col(b_sta)).withColumn("_bin", _bins(F.col(b_sta), F.col(b_end), width))
    pairs = x.join(y, [*key, "_bin"]).where((F.col(a_sta) <= F.col(b_end)) & (F.col(b_sta) <= F.col(a_end)))
    pairs = pairs.where(F.col("_bin") == F.greatest(F.floor(F.col(a_sta) / width), F.floor(F.col(b_sta) / width))).drop("_bin")
    if how == "inner":
        return pairs
    extra = [c for c in b.columns if c not in key]
    return pairs.unionByName(a.join(pairs.select(*key, a_sta, a_end).distinct(), [*key, a_sta, a_end], "left_anti").select("*", *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in extra]))


def point_in_interval(points: DataFrame, windows: DataFrame, key: list[str], pos: str, sta: str, end: str, width: int, first: list[str] | None = None) -> DataFrame:
    """Each point with a window that holds it; with ``first`` (columns that tell points apart) the lowest one only."""
    found = range_join(points.withColumn("_p", F.col(pos)), windows, key, pos, "_p", sta, end, width).drop("_p")
    return first_by(found, first, [F.col(sta), F.col(end)]) if first else found


def first_by(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a full order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def best_overlap(reads: DataFrame, windows: DataFrame, key: list[str], read: list[str], sta: str, end: str, w_sta: str, w_end: str, width: int) -> DataFrame:
    """The window of largest overlap for each read; of equal ones the lowest start, then end."""
    found = range_join(reads, windows, key, sta, end, w_sta, w_end, width)
    found = found.withColumn("overlap", overlap_len(F.col(sta), F.col(end), F.col(w_sta), F.col(w_end)))
    return first_by(found, read, [F.desc("overlap"), F.col(w_sta), F.col(w_end)])


def nearest(a: DataFrame, b: DataFrame, key: list[str], a_id: str, a_pos: str, b_id: str, b_pos: str) -> DataFrame:
    """The nearest b of each a with equal key, on either side; of equal distances the smaller (position, id).

    One union sorted by position carries the last b forward and the next backward: no pairs are made.
    """
    rows = a.select(*key, F.col(a_pos).alias("_pos"), F.col(a_id).alias("_a"), F.lit(None).cast("struct<p:bigint,i:bigint>").alias("_b"))
    rows = rows.unionByName(b.select(*key, F.col(b_pos).alias("_pos"), F.lit(None).cast(a.schema[a_id].dataType).alias("_a"), F.struct(F.col(b_pos).cast("long").alias("p"), F.col(b_id).cast("long").alias("i")).alias("_b")))
    w = Window.partitionBy(*key).orderBy("_pos")
    before = F.max("_b").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("_b").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    # of the b at the position before, the smallest id
    low = b.groupBy(*key, F.col(b_pos).cast("long").alias("_bp")).agg(F.min(F.col(b_id).cast("long")).alias("_bi"))
    near = rows.select("*", before.alias("_l"), after.alias("_r")).where(F.col("_a").isNotNull())
    left, right = F.col("_pos") - F.col("_l.p"), F.col("_r.p") - F.col("_pos")
    near = near.withColumn("_bp", F.when(F.col("_r").isNull() | (left <= right), F.col("_l.p")).otherwise(F.col("_r.p")))
    return near.join(low, [*key, "_bp"], "left").select(*key, F.col("_a").alias(a_id), F.col("_pos").alias(a_pos), F.col("_bi").alias(b_id), F.col("_bp").alias(b_pos), F.abs(F.col("_pos") - F.col("_bp")).alias("distance"))


def merge_intervals(df: DataFrame, key: list[str], sta: str, end: str, slack: Column | int = 0) -> DataFrame:
    """Islands of overlapping intervals: key, sta, end, n. An interval joins if it starts at most ``slack`` past the largest end."""
    w = Window.partitionBy(*key).orderBy(sta, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(sta) > reach + slack), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_island").agg(F.min(sta).alias(sta), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def runs(df: DataFrame, key: list[str], order: list[str], same: Column) -> DataFrame:
    """df with ``run``: a number that grows where ``same`` is not true of a row (null counts as not)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_start", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def before(column: str, key: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*key).orderBy(*order))


def run_length(df: DataFrame, key: list[str], pos: str, value: str) -> DataFrame:
    """Runs of equal value at consecutive positions: key, value, sta, end, n."""
    same = before(value, key, [pos]).eqNullSafe(F.col(value)) & (before(pos, key, [pos]) + 1 == F.col(pos))
    return runs(df, key, [pos], same).groupBy(*key, "run").agg(F.first(value).alias(value), F.min(pos).alias("sta"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def sessions(df: DataFrame, key: list[str], pos: str, gap: int) -> DataFrame:
    """Clusters of positions: a cluster goes on while the next is less than ``gap`` past the last. key, sta, end, n."""
    return runs(df, key, [pos], F.col(pos) - before(pos, key, [pos]) < gap).groupBy(*key, "run").agg(F.min(pos).alias("sta"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def merge_adjacent(df: DataFrame, key: list[str], sta: str, end: str, same: list[str]) -> DataFrame:
    """Neighbouring windows that touch (start = last end + 1) and agree in ``same`` become one."""
    ok = before(end, key, [sta]) + 1 == F.col(sta)
    for c in same:
        ok &= before(c, key, [sta]).eqNullSafe(F.col(c))
    return runs(df, key, [sta, end], ok).groupBy(*key, "run").agg(*[F.first(c).alias(c) for c in same], F.min(sta).alias(sta), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("run")


def over_windows(df: DataFrame, sta: str, end: str, width: int) -> DataFrame:
    """One row for each window [i w, (i + 1) w - 1] that an interval meets: window (its start) and overlap."""
    out = df.withColumn("_w", F.explode(F.sequence(F.floor(F.col(sta) / width).cast("long"), F.floor(F.col(end) / width).cast("long")))).withColumn("window", F.col("_w") * width).drop("_w")
    return out.withColumn("overlap", overlap_len(F.col(sta), F.col(end), F.col("window"), F.col("window") + width - 1))


def sliding(df: DataFrame, pos: str, width: int, step: int) -> DataFrame:
    """One row for each window [i step, i step + width) that holds a position, i >= 0."""
    low = F.greatest(F.floor((F.col(pos) - width) / step) + 1, F.lit(0)).cast("long")
    return df.withColumn("_w", F.explode(F.sequence(low, F.floor(F.col(pos) / step).cast("long")))).withColumn("window", F.col("_w") * step).drop("_w")


def spine(top: DataFrame, key: list[str], last: str, width: int) -> DataFrame:
    """Window starts 0, w, 2w ... up to each key's last position."""
    return top.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(last).cast("long"), F.lit(width).cast("long"))).alias("window"))


def tile(df: DataFrame, sta: str, end: str, width: int) -> DataFrame:
    """About len/width tiles of each segment, at least one; the last takes what remains."""
    size = F.col(end) - F.col(sta) + 1
    n = F.greatest(F.round(size / width), F.lit(1)).cast("long")
    out = df.withColumn("_n", n).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    low = F.col(sta) + F.col("tile") * width
    return out.withColumn("tile_sta", low).withColumn("tile_end", F.when(F.col("tile") == F.col("_n") - 1, F.col(end)).otherwise(low + width - 1)).drop("_n")


def trim_ends(df: DataFrame, key: list[str], sta: str, end: str, cov: str, least: float) -> DataFrame:
    """Pieces of a sequence cut where runs of low coverage at its ends stop: left, middle, right as far as they exist."""
    good = F.col(cov) >= least
    ends = df.groupBy(*key).agg(F.min(sta).alias("_a"), F.max(end).alias("_z"), F.min(F.when(good, F.col(sta))).alias("_l"), F.max(F.when(good, F.col(end))).alias("_r"))
    whole = F.struct(F.lit("all").alias("piece"), F.col("_a").alias("sta"), F.col("_z").alias("end"))
    left = F.when(F.col("_l") > F.col("_a"), F.struct(F.lit("left").alias("piece"), F.col("_a").alias("sta"), (F.col("_l") - 1).alias("end")))
    right = F.when(F.col("_r") < F.col("_z"), F.struct(F.lit("right").alias("piece"), (F.col("_r") + 1).alias("sta"), F.col("_z").alias("end")))
    middle = F.struct(F.lit("middle").alias("piece"), F.col("_l").alias("sta"), F.col("_r").alias("end"))
    pieces = F.when(F.col("_l").isNull() | ((F.col("_l") == F.col("_a")) & (F.col("_r") == F.col("_z"))), F.array(whole)).otherwise(F.filter(F.array(left, middle, right), lambda x: x.isNotNull()))
    return ends.select(*key, F.explode(pieces).alias("p")).select(*key, "p.piece", "p.sta", "p.end")


def drop_low_pieces(pieces: DataFrame, listed: DataFrame, df: DataFrame, key: list[str], sta: str, end: str, cov: str, least: float) -> DataFrame:
    """pieces (key, piece, sta, end) without those of listed keys whose windows' mean coverage is below ``least``."""
    inside = pieces.join(listed.select(*key).distinct(), key, "left_semi").join(df.select(*key, F.col(sta).alias("_s"), F.col(end).alias("_e"), F.col(cov).alias("_c")), key)
    low = inside.where("_s >= sta and _e <= end").groupBy(*key, "piece").agg(F.avg("_c").alias("_m")).where(F.col("_m") < least)
    return pieces.join(low, [*key, "piece"], "left_anti")


def large_gaps(df: DataFrame, key: list[str], sta: str, end: str, least: int) -> DataFrame:
    """Gaps longer than ``least`` between neighbours, with the interval before and after each."""
    w = Window.partitionBy(*key).orderBy(sta, end)
    out = df.select(*key, F.lag(sta).over(w).alias("sta_before"), F.lag(end).over(w).alias("end_before"), F.col(sta).alias("sta_after"), F.col(end).alias("end_after"))
    return out.withColumn("gap", F.col("sta_after") - F.col("end_before") - 1).where(F.col("gap") > least)


def pair_overlaps(df: DataFrame, key: list[str], name: str, sta: str, end: str, width: int) -> DataFrame:
    """Total overlap of every two names' intervals with equal key (each name's intervals must be disjoint)."""
    other = df.select(*key, F.col(name).alias("name2"), F.col(sta).alias("_s2"), F.col(end).alias("_e2"))
    pairs = range_join(df.select(*key, F.col(name).alias("name1"), F.col(sta).alias("_s1"), F.col(end).alias("_e1")), other, key, "_s1", "_e1", "_s2", "_e2", width)
    return pairs.where("name1 < name2").groupBy("name1", "name2").agg(F.sum(overlap_len(F.col("_s1"), F.col("_e1"), F.col("_s2"), F.col("_e2"))).alias("overlap"))


def flank_hits(spans: DataFrame, marks: DataFrame, key: list[str], sta: str, end: str, m_sta: str, m_end: str, flank: int) -> DataFrame:
    """key, sta, end, inside, before, after for each different span: whether marks of its key meet it, but do not hold it whole,
    or lie wholly before or after it within ``flank``.

    A mark that meets a span and does not hold it starts past its start or ends before its end. So the nearest start or end on
    each side tells all, and one union sorted by position carries those along both ways: no pairs are made.
    """
    held = [*key, "_s", "_e"]
    place = lambda p, t, left: F.struct(F.col(p).cast("long").alias("p"), F.lit(t).alias("t"), F.lit(left).alias("left"))
    m = marks.where(F.col(m_end) >= F.col(m_sta)).select(*key, F.explode(F.array(place(m_end, 0, False), place(m_sta, 2, False))).alias("x")).distinct()
    q = spans.select(*key, F.col(sta).alias("_s"), F.col(end).alias("_e")).distinct()
    q = q.select(*held, F.explode(F.array(place("_s", 1, True), place("_e", 1, False))).alias("x"))
    rows = q.unionByName(m, allowMissingColumns=True).select(*held, "x.*")
    # at a position going down: ends, spans, starts; going up it is the other way round
    down = Window.partitionBy(*key).orderBy(F.desc("p"), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*key).orderBy("p", F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends, starts = F.when(F.col("t") == 0, F.col("p")), F.when(F.col("t") == 2, F.col("p"))
    rows = rows.select("*", F.min(starts).over(down).alias("next_start"), F.min(ends).over(down).alias("next_end"), F.max(ends).over(up).alias("last_end")).where("t = 1")
    left = F.col("left")
    inside = left & (F.coalesce(F.col("next_start") <= F.col("_e"), F.lit(False)) | F.coalesce(F.col("next_end") < F.col("_e"), F.lit(False)))
    before = left & F.coalesce(F.col("last_end") >= F.col("_s") - flank, F.lit(False))
    after = ~left & F.coalesce(F.col("next_start") <= F.col("_e") + flank, F.lit(False))
    out = rows.groupBy(*held).agg(F.max(inside).alias("inside"), F.max(before).alias("before"), F.max(after).alias("after"))
    return out.withColumnsRenamed({"_s": sta, "_e": end})
