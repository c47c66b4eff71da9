"""Operators whose state depends on order: one group at a time, in an explicit order, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thin_sites(calls: DataFrame, key: str, pos: str, sample: str, allele: str, gap: int, known: int = 5, least: int = 10) -> DataFrame:
    """key, pos, sample, state: calls of sites that are well known, not singletons, and more than ``gap`` past the last one kept.

    A site counts with more than ``known`` and more than ``least`` calls that are not null, and if at least two of them are not
    its commonest allele (of equal ones the smallest). state is 1 for that allele, 0 for others, null where missing.
    """
    n = calls.where(F.col(allele).isNotNull()).groupBy(key, pos, allele).agg(F.count(F.lit(1)).alias("_n"))
    sites = n.groupBy(key, pos).agg(F.sum("_n").alias("_total"), F.min(F.struct((-F.col("_n")).alias("m"), F.col(allele).alias("a"))).alias("_major"))
    sites = sites.where(f"_total > {known} and _total > {least} and -_major.m < _total - 1")
    kept = thin(sites, key, pos, gap)
    state = F.when(F.col(allele).isNotNull(), (F.col(allele) == F.col("_major.a")).cast("int"))
    return calls.join(kept, [key, pos]).select(key, pos, sample, state.alias("state"))


def thin(df: DataFrame, key: str, pos: str, gap: int) -> DataFrame:
    """Rows kept greedily along each key: one is kept if it lies more than ``gap`` past the last kept one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = np.sort(g["_p"].to_numpy())
        keep, i = [], 0
        while i < len(p):
            keep.append(p[i])
            i = int(np.searchsorted(p, p[i] + gap, side="right"))  # the next that may stay, without a step for each row
        return pd.DataFrame({"_k": g["_k"].iloc[: 1].repeat(len(keep)).to_numpy(), "_p": keep})

    kind, at = df.schema[key].dataType.simpleString(), df.schema[pos].dataType.simpleString()
    kept = df.select(F.col(key).alias("_k"), F.col(pos).alias("_p")).distinct().groupBy("_k").applyInPandas(run, f"_k {kind}, _p {at}")
    return df.join(kept, (df[key] == kept["_k"]) & (df[pos] == kept["_p"]), "left_semi")


def segment_by_class(df: DataFrame, key: str, order: str, one: str, two: str, depth: str) -> DataFrame:
    """Segments of rows: a row goes on while either of its two classes is the segment's, which is its first row's class one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        out, now = [], None
        for o, a, b, d in zip(g[order], g[one], g[two], g[depth]):
            if now is not None and now in (a, b):
                out[-1][2], out[-1][4], out[-1][5] = o, out[-1][4] + 1, out[-1][5] + d
            else:
                now = a
                out.append([g[key].iloc[0], o, o, a, 1, d])
        return pd.DataFrame([[k, s, e, c, n, t / n] for k, s, e, c, n, t in out], columns=[key, "sta", "end", "class", "n", "depth"])

    f = df.schema
    schema = f"{key} {f[key].dataType.simpleString()}, sta {f[order].dataType.simpleString()}, end {f[order].dataType.simpleString()}, class {f[one].dataType.simpleString()}, n long, depth double"
    return df.select(key, order, one, two, depth).groupBy(key).applyInPandas(run, schema)


def nonredundant_targets(df: DataFrame, key: str, order: str, sta: str, end: str, most: float = 0.8) -> DataFrame:
    """df with ``kept``: false where an interval, in order, is redundant to one kept before.

    The new interval [s, e] meets the kept ones [a, b] that it overlaps from left to right. It loses what it shares with one
    that reaches it from the left (a <= s <= b <= e) or, where that does not hold and it is not inside the kept one, from
    the right (s <= a <= e <= b); inside a kept one (a <= s, e <= b) it is not recorded; one that it holds is dropped, every
    one that it comes to. The part concerned, as a share of the kept interval, tells how redundant the new one is; the first
    share above ``most`` ends the comparison, and such an interval does not count (kept is false), though what is left
    of it is recorded. Of equal places in the order the smaller interval goes first.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([order, sta, end], kind="stable")
        kept: list[list[int]] = []
        verdict = []
        for s, e in zip(g[sta].tolist(), g[end].tolist()):
            ratio, record = 0.0, True
            for iv in sorted(kept):
                a, b = iv
                if e < a or s > b:
                    continue
                size = b - a + 1
                if a <= s <= b <= e:
                    ratio, s = (b - s + 1) / size, b + 1
                elif a <= s and e <= b:
                    ratio, record = (e - s + 1) / size, False
                elif s <= a <= e <= b:
                    ratio, e = (e - a + 1) / size, a - 1
                else:
                    ratio = (e - s + 1) / size
                    kept.remove(iv)
                if ratio > most or s > e:
                    break
            if record and s <= e:
                kept.append([s, e])
            verdict.append(ratio <= most)
        return g.assign(kept=verdict)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", kept boolean"
    return df.groupBy(key).applyInPandas(run, schema)


def propagate_labels(df: DataFrame, key: str, window: str, member: str, cluster: str) -> DataFrame:
    """key, window, member, label: clusters of consecutive windows take the label they share most members with.

    A cluster and a label match if each is the other's largest overlap (of equal ones the smaller); an unmatched cluster's
    label is its number plus the largest label before.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, last = [], {}
        for w, part in g.sort_values([window, member]).groupby(window, sort=True):
            top = max(last.values(), default=0)
            new = {m: int(c) + top for m, c in zip(part[member], part[cluster])}
            n: dict[tuple[int, int], int] = {}
            for m, c in new.items():
                if m in last:
                    n[c, last[m]] = n.get((c, last[m]), 0) + 1
            by_new: dict[int, int] = {}
            by_old: dict[int, int] = {}
            for (c, o), k in n.items():
                by_new[c] = max(by_new.get(c, 0), k)
            best = {p: k for p, k in n.items() if k == by_new[p[0]]}
            for (c, o), k in best.items():
                by_old[o] = max(by_old.get(o, 0), k)
            match: dict[int, int] = {}
            taken: set[int] = set()
            for c, o in sorted((p for p, k in best.items() if k == by_old[p[1]]), key=lambda p: (p[1], p[0])):
                if o not in taken:
                    taken.add(o)
                    match.setdefault(c, o)
            last = {m: match.get(c, c) for m, c in new.items()}
            out += [(g[key].iloc[0], w, m, x) for m, x in last.items()]
        return pd.DataFrame(out, columns=[key, window, member, "label"])

    f = df.schema
    schema = ", ".join(f"{c} {f[c].dataType.simpleString()}" for c in (key, window, member)) + ", label long"
    return df.select(key, window, member, cluster).groupBy(key).applyInPandas(run, schema)
