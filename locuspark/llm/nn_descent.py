"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Equal vectors are one node. So that the inner product orders like a distance, a component is appended that gives all nodes
the same norm (queries have 0 there). The graph starts from neighbours within runs of a random-projection order.
A round joins each node with samples of its new and old neighbours, in both directions, brings their vectors together and
compares them with one another: a neighbour's neighbour is likely a neighbour. Pairs better than a node's worst neighbour are
merged into its list. Rounds end when few neighbours are new, however many that takes: lists only get better, and a neighbour
that was compared is new no longer. A query starts at a node and keeps its best nodes so far; each hop joins those not yet
expanded with the graph, until no query has any. Queries near each other form a cell: a node that any of them reaches comes
to the cell once, for all of its queries, and a node expanded for one is expanded for all.

Every list has a fixed bound (samples, neighbours, beam), kept on rows sorted by their node; all tables between rounds are
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuspark.llm.common import Scratch, mix

NEIGHBOURS, SAMPLE, STARTS, RUN = 56, 24, 3, 4096
BEAM, EXPAND = 160, 32
#: Queries that share the vectors that any of them reaches.
CELL = 256


def _top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def _segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of a partition that is sorted by key, in tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _vectors(column: pa.ChunkedArray, dim: int, exact: bool = True) -> np.ndarray:
    """The vectors of a binary column without nulls, read from its buffers; in double precision, or unless exact as they are stored."""
    kind, parts = np.float64 if dim < 0 else np.float32, []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    out = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, kind)
    return out.reshape(-1, abs(dim)).astype(np.float64 if exact else kind, copy=False)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among consecutive rows of equal keys, from 0."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new))))


def _luck(u: np.ndarray, v: np.ndarray, turn: int) -> np.ndarray:
    return mix(mix(u.astype(np.uint64) + np.uint64(turn << 48)) ^ v.astype(np.uint64))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's sizes and its values one after the other."""
    lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    return np.diff(ends), lists.values.to_numpy()[ends[0] : ends[-1]]


def _lists(u: np.ndarray, sizes: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Rows u, v, sim, where u[i] has the next sizes[i] of v and sim."""
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(u), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (v, sim))], ["u", "v", "sim"])


#: A graph's row: u, the nodes v that it links with, as 4 * v + 2 * old + pick, and their products sim, the best first.
GRAPH = "u long, v array<long>, sim array<double>"


def _best(df: DataFrame, k: int, sample: int, turn: int) -> DataFrame:
    """The graph of the k best of each u in rows of its kind, which may repeat; pick marks the next round's sample of new and of old ones.

    What was old or picked in a row is old; a pair that is old in any row is.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "u"):
            (sizes, v), (_, sim) = _flat(t["v"]), _flat(t["sim"])
            u, old, v = np.repeat(t["u"].to_numpy(), sizes), (v & 3) > 0, v >> 2
            by = np.lexsort((sim, v, u))
            u, v, sim, old = u[by], v[by], sim[by], old[by]
            last = np.flatnonzero(np.append((u[1:] != u[:-1]) | (v[1:] != v[:-1]), True))
            old = np.logical_or.reduceat(old, np.append(0, last[:-1] + 1))
            u, v, sim = u[last], v[last], sim[last]
            by = np.lexsort((v, -sim, u))
            by = by[_ranks(u[by]) < k]
            u, v, sim, old = u[by], v[by], sim[by], old[by]
            by = np.lexsort((_luck(u, v, turn), old, u))
            pick = np.zeros(len(u), bool)
            pick[by[_ranks(u[by], old[by]) < sample]] = True
            ids, sizes = np.unique(u, return_counts=True)
            yield _lists(ids, sizes, v << 2 | old << 1 | pick, sim)

    return df.repartition("u").sortWithinPartitions("u").mapInArrow(keep, GRAPH)


def valid_vectors(table: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vec of the rows that take part: id and components not null, finite, not all zero, of the commonest length."""
    rows = table.select(F.col(id).alias("vec_id"), F.col(vector).alias("vec")).where("vec_id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (size["d"] if size else -1))


def nodes_of(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, vec as bytes, with the component that evens norms), members (node, vec_id) and the bytes' layout.

    members has every row's node, so queries find theirs. Equal vectors are one node; nodes are numbered in the order of their
    smallest ids, whatever the ids' type. Of rows that repeat an id the one with the smallest vector counts. No rows give no nodes.
    """
    wide = "double" in rows.schema["vec"].dataType.simpleString()
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    first = rows.groupBy("vec").agg(F.min("vec_id").alias("id")).orderBy("id")
    first = scratch.write(first.select(F.monotonically_increasing_id().alias("node"), "vec"), "distinct")
    members = scratch.write(rows.join(first, "vec").select("node", "vec_id"), "members")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = first.agg(F.max(square)).first()[0] or 0.0
    row = first.select(F.size("vec")).first()
    dim = (row[0] + 1) if row else 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            even = np.sqrt(np.maximum(0, most - (x * x).sum(1)))
            x = np.column_stack([x, even]).astype(np.float64 if wide else np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "vec"])

    return scratch.write(first.select("node", "vec").mapInArrow(packed, "node long, vec binary"), "nodes"), members, -dim if wide else dim


def _placed(rows: DataFrame, dim: int, turns: int = 1) -> DataFrame:
    """Rows (node, vec) sorted by random-projection orders, one after the other."""
    planes = [np.random.default_rng(turn).normal(size=(abs(dim), 15)) for turn in range(turns)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(pa.chunked_array([batch.column(1)]), dim)
            for turn, plane in enumerate(planes):
                h = x @ plane
                code = ((h[:, :14] > 0) << np.arange(14)).sum(1)
                columns = [pa.array(np.full(len(x), turn, np.int32)), pa.array(code, pa.int64()), pa.array(h[:, 14]), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, ["turn", "code", "at", "node", "vec"])

    placed = rows.select("node", "vec").mapInArrow(place, "turn int, code long, at double, node long, vec binary")
    return placed.repartitionByRange("turn", "code", "at", "node").sortWithinPartitions("turn", "code", "at", "node")


def _start(nodes: DataFrame, dim: int, k: int, turns: int) -> DataFrame:
    """The graphs of the best within runs of random-projection orders."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = batch.column("turn").to_numpy()
            ends = np.searchsorted(turn, np.arange(turns + 1)).tolist()
            for i, stop in ((i, stop) for start, stop in zip(ends, ends[1:]) for i in range(start, stop, RUN)):
                run = pa.Table.from_batches([batch.slice(i, min(RUN, stop - i))])
                ids, x = run["node"].to_numpy(), _vectors(run["vec"], dim)
                m = min(k, len(ids) - 1)
                if m < 1:
                    continue
                for j in range(0, len(ids), 512):
                    sim = x[j : j + 512] @ x.T
                    sim[np.arange(len(sim)), np.arange(j, j + len(sim))] = -np.inf
                    at = np.argpartition(sim, len(ids) - m, axis=1)[:, len(ids) - m :]
                    yield _lists(ids[j : j + 512], np.full(len(sim), m), ids[at].ravel() << 2, np.take_along_axis(sim, at, 1).ravel())

    return _placed(nodes, dim, turns).mapInArrow(best, GRAPH)


def _round(graph: DataFrame, nodes: DataFrame, dim: int, k: int, sample: int, turn: int) -> DataFrame:
    """One round: the graph after comparing neighbours of each node with one another."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, v = _flat(pa.chunked_array([batch.column(1)]))
            pick = (v & 1) > 0
            u, v = np.repeat(batch.column(0).to_numpy(), sizes)[pick], v[pick]
            old, v = (v & 2) > 0, v >> 2
            columns = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(old, 2), np.arange(2 * len(u)) >= len(u)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["x", "y", "old", "back"])

    both = graph.select("u", "v").mapInArrow(links, "x long, y long, old boolean, back boolean")
    bound = _top(both.repartition("x"), ["x", "old", "back"], [F.xxhash64("x", "y", F.lit(turn)), "y"], sample)  # u's own are no more than that
    lists = bound.groupBy("x", "y").agg(F.min("old").alias("old"))  # met both ways: once, and as new if it is new either way
    worst = graph.select(F.col("u").alias("y"), F.when(F.size("sim") >= k, F.element_at("sim", -1)).alias("worst"))
    known = nodes.withColumnRenamed("node", "y").join(worst, "y", "left").select("y", "vec", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "x"):
            x, y, old, worst, vec = t["x"].to_numpy(), t["y"].to_numpy(), t["old"].to_numpy(), t["worst"].to_numpy(), _vectors(t["vec"], dim)
            cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            n, b, s = [], [], []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                sim = vec[i:j] @ vec[i:j].T
                np.fill_diagonal(sim, -np.inf)
                better = sim > worst[i:j, None]
                better &= ~(old[i:j, None] & old[None, i:j])  # two old ones have met
                n.append(better.sum(1))
                b.append(y[i + np.nonzero(better)[1]])
                s.append(sim[better])
            n = np.concatenate(n)
            yield _lists(y[n > 0], n[n > 0], np.concatenate(b) << 2, np.concatenate(s))

    met = lists.join(known, "y").repartition("x").sortWithinPartitions("x").select("x", "y", "old", "worst", "vec")
    return _best(graph.unionByName(met.mapInArrow(compare, GRAPH)), k, sample, turn + 1)


def build_graph(nodes: DataFrame, dim: int, scratch: Scratch, k: int = NEIGHBOURS, sample: int = SAMPLE) -> DataFrame:
    """node, near: each node's neighbours, best first; a node without any is not in it, and no nodes give none."""
    graph = scratch.write(_best(_start(nodes, dim, k, STARTS), k, sample, 0), "graph")
    for turn in count():
        after = scratch.write(_round(graph, nodes, dim, k, sample, turn), "graph")
        scratch.drop(graph)
        scratch.release()
        graph = after
        edges, fresh = graph.agg(F.sum(F.size("v")), F.sum(F.size(F.filter("v", lambda v: v.bitwiseAND(2) == 0)))).first()
        if not fresh or fresh <= 0.01 * edges:
            break
    return scratch.write(graph.select(F.col("u").alias("node"), F.transform("v", lambda v: F.shiftright(v, 2)).alias("near")), "near")


def _cells(queries: DataFrame, dim: int, size: int, scratch: Scratch) -> DataFrame:
    """cell, q, vec: queries (q, vec) dealt evenly into cells of up to ``size`` neighbours of a random-projection order, across partitions."""

    row = F.monotonically_increasing_id()  # the partition, then the row's place in it
    placed = _placed(queries.select(F.col("q").alias("node"), "vec"), dim).select(F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at"), F.col("node").alias("q"), "vec")
    placed = scratch.write(placed, "placed")
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # a row for each partition
    before = np.append(0, np.cumsum([n for _, n in sizes])).tolist()
    first, total = dict(zip([p for p, _ in sizes], before)), before[-1]
    cells = -(-total // size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray([first[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at * cells // total), batch.column(2), batch.column(3)], ["cell", "q", "vec"])

    return scratch.write(placed.mapInArrow(deal, "cell long, q long, vec binary"), "cells")


def search(graph: DataFrame, nodes: DataFrame, dim: int, queries: DataFrame, scratch: Scratch, beam: int = BEAM, expand: int = EXPAND, cell: int = CELL) -> DataFrame:
    """q, node, sim: up to ``beam`` nodes found for each query (q: its node, where it starts; vec in the nodes' layout with 0 last).

    Greedy: a hop expands the best ``expand`` nodes of a beam that have not been, all of them when nothing new came into the
    beam; a query ends when none is left. What the queries of a cell reach comes to the cell once and is compared with all of
    them. No queries give none.
    """
    own = _cells(queries, dim, cell, scratch)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "cell"):
            cells, kind, q, node, sim, done = (t[c].to_numpy() for c in ("cell", "kind", "q", "node", "sim", "done"))
            vec, out = t["vec"].combine_chunks(), []
            cuts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                a, b = (i + np.searchsorted(kind[i:j], [1, 2])).tolist()  # queries, their beams, then what is new
                asked, fresh = (_vectors(pa.chunked_array([vec[lo:hi]]), dim, False) for lo, hi in ((i, a), (b, j)))
                by = a + np.argsort(q[a:b], kind="stable")
                at = np.searchsorted(q[by], q[i:a], "left"), np.searchsorted(q[by], q[i:a], "right")
                gone = np.unique(np.concatenate([q[i:a], node[a:b][done[a:b]]]))  # expanded for a query, so for all of the cell
                rows = []
                for n, (lo, hi) in enumerate(zip(*at)):
                    if n % 16 == 0:  # the best by rough products, for some queries at a time
                        near, top = asked[n : n + 16] @ fresh.T, np.broadcast_to(np.arange(len(fresh)), (16, len(fresh)))
                        if len(fresh) > beam:
                            top = np.argpartition(near, len(fresh) - beam, axis=1)[:, len(fresh) - beam :]
                    new = top[n % 16]
                    held = by[lo:hi]
                    # summed by row, so that equal products stay equal wherever a row lies
                    s = np.concatenate([sim[held], (fresh[new].astype(np.float64) * asked[n]).sum(1)])
                    who = np.concatenate([node[held], node[b + new]])
                    best = np.lexsort((who, -s))[:beam]
                    s, who = s[best], who[best]
                    seen = gone[np.minimum(np.searchsorted(gone, who), len(gone) - 1)] == who
                    todo = ~seen & (np.cumsum(~seen) <= (expand if (best >= hi - lo).any() else beam))
                    rows.append((np.full(len(s), cells[i]), np.full(len(s), q[i + n]), who, s, seen, todo))
                *rows, todo = [np.concatenate(x) for x in zip(*rows)]
                ask, todo = np.zeros(len(todo), bool), np.flatnonzero(todo)
                ask[todo[np.unique(rows[2][todo], return_index=True)[1]]] = True  # once for the cell
                out.append([*rows, ask])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["cell", "q", "node", "sim", "done", "ask"])

    def near_of(kind: int):
        return F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("near"))))

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        return df.select("cell", F.lit(kind).alias("kind"), *[columns.get(c, F.lit(0).cast(t)).alias(c) for c, t in (("q", "long"), ("node", "long"), ("sim", "double"), ("done", "boolean"))], columns.get("vec", F.lit(None).cast("binary")).alias("vec"))

    mine = rows(own, 0, q=F.col("q"), vec=F.col("vec"))
    held, seen, ask, new = None, None, own.select("cell", F.col("q").alias("node")), own.select("cell", F.lit(1).alias("kind"), F.array("q").alias("near"))
    while not ask.isEmpty():
        near = ask.join(graph, "node").select("cell", F.lit(1).alias("kind"), "near")
        near = near.unionByName(new if seen is None else seen.select("cell", F.lit(0).alias("kind"), "near"))
        near = near.groupBy("cell").agg(near_of(0).alias("had"), near_of(1).alias("near"))  # what the cell has had, neighbours of what it expands
        fresh = scratch.write(near.select("cell", F.array_except("near", "had").alias("near")).where("size(near) > 0"), "fresh")  # a row for each cell
        seen = fresh if seen is None else seen.unionByName(fresh)  # a written table for each hop
        reached = fresh.select("cell", F.explode("near").alias("node")).join(nodes, "node")
        parts = mine.unionByName(rows(reached, 2, node=F.col("node"), vec=F.col("vec")))
        if held is not None:
            parts = parts.unionByName(rows(held, 1, q=F.col("q"), node=F.col("node"), sim=F.col("sim"), done=F.col("done") | F.col("ask")))
        parts = parts.repartition("cell").sortWithinPartitions("cell", "kind")
        beams = scratch.write(parts.mapInArrow(merge, "cell long, q long, node long, sim double, done boolean, ask boolean"), "beam")
        if held is not None:
            scratch.drop(held)
        held, ask = beams, beams.where("ask").select("cell", "node")
        scratch.release()
    return own.select("q", F.col("q").alias("node"), F.lit(0.0).alias("sim")) if held is None else held.select("q", "node", "sim")


def nearest(table: DataFrame, query: str, k: int = 20, id: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the SQL condition ``query``, the k nearest other rows found.

    Nearest is the largest inner product in double precision, ties to the smaller id. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part, nor do null ids; of rows that repeat an
    id the one with the smallest vector takes part. With fewer than k other rows all that are found are returned. Other columns take no part. An empty
    table gives none.
    """
    scratch = Scratch(table.sparkSession)
    rows = valid_vectors(table, id, vector)
    nodes, members, dim = nodes_of(rows, scratch)
    graph = build_graph(nodes, dim, scratch, neighbours)
    asked = scratch.write(members.where(query.replace(id, "vec_id")).select(F.col("vec_id").alias("query_id"), "node"), "asked")
    zero = np.zeros(1, np.float64 if dim < 0 else np.float32).tobytes()
    starts = asked.select("node").distinct().join(nodes, "node")
    queries = starts.select(F.col("node").alias("q"), F.concat(F.expr(f"substring(vec, 1, octet_length(vec) - {len(zero)})"), F.lit(zero)).alias("vec"))
    found = search(graph, nodes, dim, scratch.write(queries, "queries"), scratch, beam)
    best = _top(found, ["q"], [F.desc("sim"), "node"], k + 1)
    answers = _top(members, ["node"], ["vec_id"], k + 1)
    options = best.join(answers, "node").select("q", "vec_id", "sim")
    options = scratch.write(_top(options, ["q"], [F.desc("sim"), "vec_id"], k + 1), "options")
    out = asked.join(options, asked["node"] == options["q"]).where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("sim").alias("score"))
