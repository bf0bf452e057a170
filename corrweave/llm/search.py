"""Exact top-k by inner product with two cover trees.

Data lie in cells about pivots, queries in groups about fewer of them. A query's kth score within its own part of a
cell is a floor for its kth score over all; a group meets a cell only where the bound of centres and radii reaches the
lowest floor of its queries. Data are written once in order of their cells and stay there: queries go past them in
passes of bounded size, as a broadcast. A task builds the cover tree of each block of a cell once a pass and walks it
together with the tree of each group that the cell meets: a data node is left out for a whole query node when no vector
in its covering radius can reach the worst kth score of that node's queries, best scores being carried from block to
block. What the tasks found and the floors let through is merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: Points of a data leaf, and queries of a query leaf: all of a query leaf share one bound, so it has to be narrow.
LEAF, QUERY_LEAF = 32, 8
#: Points scored at once when leaves are reached.
BATCH = 256
#: Vectors whose distances to all pivots are held at once.
DEALT = 512
#: Numbers of the queries, and pieces of their groups, that one pass takes past the data: what a broadcast holds.
PASS_NUMBERS, PASS_PIECES = 1 << 22, 256
LOWEST = -(1 << 63)


class CoverTree:
    """Nodes by number, parents first: a centre among the points, its covering radius, children or (leaf) points.

    A node of scale s splits into children whose centres are more than s / 2 apart and whose points lie within s / 2.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.members: list[np.ndarray | None] = []
        if len(points):
            self._add(np.arange(len(points)))
        self.radii = np.array(self.radius)
        self.centres = points[self.centre] if len(points) else points
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    def _add(self, members: np.ndarray) -> int:
        todo: list[tuple[np.ndarray, np.ndarray, int, list]] = []

        def open_node(mine: np.ndarray, distance: np.ndarray) -> int:
            node = len(self.centre)
            self.centre.append(int(mine[0]))
            self.radius.append(float(distance.max()))
            self.children.append(None)
            self.members.append(mine)
            if len(mine) > self.leaf and distance.max() > 0:
                todo.append((mine, distance, node, []))
            return node

        root = open_node(members, self._distance(members, members[0]))
        while todo:
            mine, distance, node, kids = todo.pop()
            scale = distance.max() / 2
            while len(mine):
                near = distance <= scale
                near[0] = True
                kids.append(open_node(mine[near], distance[near]))
                mine = mine[~near]
                if len(mine):
                    distance = self._distance(mine, mine[0])
            self.children[node], self.members[node] = np.array(kids), None
        return root

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1))


class _Best:
    """The k best of each query so far, by score and then smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.match = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object:
            self.score = self.score.astype(object)
            scores = np.clip(scores, -(1 << 63), (1 << 63) - 1)
        scores = np.where(self.ids[rows][:, None] == ids[None, :], -np.inf, scores)
        all_scores = np.concatenate((self.score[rows], scores), axis=1)
        all_ids = np.concatenate((self.match[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.match[rows] = np.take_along_axis(all_ids, order, axis=1)


def _reach(dots, norms, radii, query_norm, query_radius) -> np.ndarray:
    """No inner product of a vector within one ball and one within another is larger; held to a long, as scores are."""
    most = dots + radii * (query_norm + query_radius) + query_radius * norms
    slack = 1e-9 * (norms + radii) * (query_norm + query_radius) + 1e-6
    return np.clip(most + slack, -(2.0**63), 2.0**63)


def dual_tree_top_k(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int,
    floor: np.ndarray | None = None, best: _Best | None = None, q: CoverTree | None = None, c: CoverTree | None = None,
) -> _Best:
    """queries and points of doubles, or of Python's integers: then trees and bounds are of doubles with room for their error, and scores exact.

    floor: of each query, a score that its k best over all data are known to reach; what is below may be left out.
    best: what was found among other points; q, c: the trees, where they are there already.
    """
    floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(np.float64)
    best = best or _Best(query_ids, k)
    q, c = q or CoverTree(queries.astype(np.float64), QUERY_LEAF), c or CoverTree(points.astype(np.float64))
    if not len(queries) or not len(points):
        return best

    def worst(rows: np.ndarray) -> float:
        return float(np.maximum(best.score[rows, -1].astype(np.float64), floor[rows]).min())

    def bounds(node: int, against: np.ndarray) -> np.ndarray:
        return _reach(c.centres[against] @ q.centres[node], c.norms[against], c.radii[against], q.norms[node], q.radii[node])

    rows_of: dict[int, np.ndarray] = {}
    for node in reversed(range(len(q.centre))):  # children come after their parents
        kids = q.children[node]
        rows_of[node] = q.members[node] if kids is None else np.concatenate([rows_of[x] for x in kids])

    leaf = np.array([x is None for x in c.children])
    sizes = np.array([0 if x is None else len(x) for x in c.members])
    stack = [(0, np.array([0]))]
    while stack:
        node, against = stack.pop()
        rows = rows_of[node]
        reach = bounds(node, against)
        keep = reach >= worst(rows)
        against, reach = against[keep], reach[keep]
        if not len(against):
            continue
        wide = ~leaf[against] & ((c.radii[against] > q.radii[node]) | (q.children[node] is None))
        if wide.any():
            opened = [c.children[x] for x in against[wide]]
            stack.append((node, np.concatenate([against[~wide], *opened])))
        elif q.children[node] is not None:
            stack += [(x, against) for x in q.children[node]]
        else:
            order = np.argsort(-reach, kind="stable")
            against, reach = against[order], reach[order]
            begin = 0
            while begin < len(against) and reach[begin] >= worst(rows):  # the most promising leaves first, a batch at a time
                upto = begin + max(1, int(np.searchsorted(np.cumsum(sizes[against[begin:]]), BATCH)))
                mine = np.concatenate([c.members[x] for x in against[begin:upto]])
                best.offer(rows, queries[rows] @ points[mine].T, ids[mine])
                begin = upto
    return best


def _vectors(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = t.column("id").to_numpy()
    v = flat.reshape(len(ids), -1)
    return ids, v


def _numbers(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as doubles while no sum of products passes 2^53, so that they are exact; else as Python's own integers."""
    q, p = (float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (queries, points))
    kind = np.float64 if q * p * max(1, queries.shape[1]) < 2.0**53 else object
    return queries.astype(kind), points.astype(kind)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(dim, cell, rows) of the runs of rows with one dim and cell, about `most` rows at once."""
    held, key, size = [], None, 0
    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("dim", "cell")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for begin, end in ((at, min(at + most, e)) for s, e in zip(cuts, cuts[1:]) for at in range(s, e, most)):
            mine = (int(keys[begin, 0]), int(keys[begin, 1]))
            if held and (mine != key or size + end - begin > most):
                yield *key, pa.Table.from_batches(held)
                held, size = [], 0
            held.append(b.slice(begin, end - begin))
            key, size = mine, size + end - begin
    if held:
        yield *key, pa.Table.from_batches(held)


def _seed(k: int, every: int, most: int):
    """The queries among the rows, each with the kth score within its own block as `floor`: the lowest long where that holds fewer.

    A floor only says whom a query need not meet; its rows come from the trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _blocks(batches, most):
            ids, points = _vectors(rows, "v")
            asked = np.flatnonzero(ids % every == 0)
            if not len(asked):
                continue
            queries, points = _numbers(points[asked], points)
            floors = np.full(len(asked), LOWEST)
            for at in range(0, len(asked) if len(ids) > k else 0, DEALT):  # one of these is the query itself
                scores = queries[at : at + DEALT] @ points.T
                scores = np.clip(scores, LOWEST, -LOWEST - 1) if scores.dtype == object else scores
                others = np.where(ids[asked[at : at + DEALT], None] == ids, LOWEST, scores)
                floors[at : at + DEALT] = np.sort(others, axis=1)[:, -k] if others.dtype == object else np.partition(others, -k, axis=1)[:, -k]
            kept = rows.take(pa.array(asked)).select(["id", "v", "dim", "grp"])
            yield from kept.append_column("floor", pa.array(floors, pa.int64())).combine_chunks().to_batches()

    return run


class _Asked:
    """The queries of a pass in pieces of groups, and the pieces that each cell meets. Trees of pieces are built once a worker."""

    def __init__(self, queries: pa.Table, met: pa.Table):
        keys = np.stack([queries.column(c).to_numpy() for c in ("dim", "grp", "gpart")], axis=1)
        self.pieces, self.meets, of = [], {}, {}
        for i, key in enumerate(np.unique(keys, axis=0)):
            mine = queries.filter(pa.array((keys == key).all(axis=1)))
            self.pieces.append((*_vectors(mine, "v"), mine.column("floor").to_numpy()))
            of.setdefault((int(key[0]), int(key[1])), []).append(i)
        for dim, grp, cell in zip(*(met.column(c).to_pylist() for c in ("dim", "grp", "cell"))):
            self.meets.setdefault((dim, cell), []).extend(of.get((dim, grp), []))
        self.trees: dict[int, CoverTree] = {}

    def tree(self, i: int) -> CoverTree:
        if i not in self.trees:
            self.trees[i] = CoverTree(self.pieces[i][1].astype(np.float64), QUERY_LEAF)
        return self.trees[i]


def _walk(k: int, most: int, asked: Broadcast):
    """Of each query of the pass, the k best rows of the task that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, found = asked.value, {}
        for dim, cell, rows in _blocks(batches, most):
            meets = a.meets.get((dim, cell), ())
            if not meets:
                continue
            ids, v = _vectors(rows, "v")
            tree = CoverTree(v.astype(np.float64))
            for i in meets:
                query_ids, asks, floor = a.pieces[i]
                queries, points = _numbers(asks, v)
                found[i] = dual_tree_top_k(query_ids, queries, ids, points, k, floor, found.get(i), a.tree(i), tree)
        for i, best in found.items():
            score = best.score.astype(np.float64)
            real = (best.match != np.iinfo(np.int64).max) & (score != -np.inf) & (score >= a.pieces[i][2].astype(np.float64)[:, None])
            columns = [np.repeat(best.ids, real.sum(axis=1)), best.match[real], best.score[real].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


def _passes(groups: list, query_block: int) -> list[tuple[int, int, int, int, int]]:
    """(dim, grp, gparts, gpart, pass) for each piece of each group, passes rising.

    A piece has about `query_block` queries at most, and no more numbers than a pass.
    """
    out, held, pieces, now = [], 0, 0, 0
    for r in groups:
        parts = ceil(r["n"] / max(1, min(query_block, PASS_NUMBERS // r["dim"])))
        numbers = ceil(r["n"] / parts) * r["dim"]
        for part in range(parts):
            if pieces and (held + numbers > PASS_NUMBERS or pieces == PASS_PIECES):
                held, pieces, now = 0, 0, now + 1
            out.append((r["dim"], r["grp"], parts, part, now))
            held, pieces = held + numbers, pieces + 1
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector, the number of a nearest centre and the distance to it."""
    norms, near = (centres**2).sum(axis=1), []
    for at in range(0, len(x), DEALT):
        near.append(np.argmin(norms - 2 * (x[at : at + DEALT] @ centres.T), axis=1))
    near = np.concatenate(near)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


class _Pivots:
    """Centres of each length of vector; a length that no pivot has gets the zero vector."""

    def __init__(self, by_dim: dict[int, np.ndarray]):
        self.by_dim = by_dim

    def of(self, dim: int) -> np.ndarray:
        return self.by_dim.get(dim, np.zeros((1, dim)))

    def first(self, share: float) -> _Pivots:
        return _Pivots({dim: c[: max(1, ceil(len(c) * share))] for dim, c in self.by_dim.items()})


def _deal(cells: _Pivots, groups: _Pivots):
    """Adds dim, the cell and the group of each vector, and its distances to their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                mine = b.filter(pa.array(dims == dim))
                x = mine.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                (cell, away), (grp, grp_away) = _nearest(x, cells.of(dim)), _nearest(x, groups.of(dim))
                more = [pa.array(np.full(len(x), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(away), pa.array(grp, pa.int32()), pa.array(grp_away)]
                yield pa.RecordBatch.from_arrays([*mine.columns, *more], ["id", "v", "dim", "cell", "away", "grp", "grp_away"])

    return run


def _meeting(cells: _Pivots, groups: _Pivots):
    """Keeps the pairs of a group and a cell whose bound reaches the group's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell, grp, r, gr, floor = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "grp", "radius", "grp_radius", "floor"))
            keep = np.zeros(len(dims), bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c, g = cells.of(dim)[cell[at]], groups.of(dim)[grp[at]]
                norms, grp_norms = np.sqrt((c**2).sum(axis=1)), np.sqrt((g**2).sum(axis=1))
                keep[at] = _reach((c * g).sum(axis=1), norms, r[at], grp_norms, gr[at]) >= floor[at].astype(np.float64)
            yield b.filter(pa.array(keep))

    return run


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, query_block: int = 2048, block: int = 2048, most_pivots: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each row whose vec_id is divisible by `every`.

    Components become floor(scale * x). Every other row is a candidate; ties go to the smaller vec_id. Rows with a null
    vec_id or vector, or with null or non-finite components, take no part. Of rows with one vec_id, the one with the
    smallest vector counts. Components and scores beyond a long are the nearest long, and tie there. Vectors meet only those of their own length. Other columns are ignored, an empty table
    gives an empty one.

    Pivots are a sample of one row in `block`, `most_pivots` at most: they pass through the driver and decide only who
    meets whom. Cells and groups with more rows than `block` and `query_block` are split by a hash of the id. Of the queries,
    PASS_NUMBERS numbers at once pass through the driver, on their way to all tasks; data are shuffled twice in all, however
    many groups and passes there are.
    """
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("bigint").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint")).alias("v")).where(F.size("v") > 0)
    size = embeddings.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    n_pivots = min(most_pivots, max(1, ceil(size["n"] / block)))
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect():
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    cells = _Pivots({dim: np.array(v, np.float64) for dim, v in by_dim.items()})
    groups = cells.first(ceil(size["q"] / query_block) / n_pivots)

    spark = embeddings.sparkSession
    placed = stored(rows.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_deal(cells, groups), "id bigint, v array<bigint>, dim int, cell int, away double, grp int, grp_away double"), "vectors")
    cell_sizes = stored(placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "cells")
    group_sizes = stored(placed.where(F.col("id") % every == 0).groupBy("dim", "grp").agg(F.count("*").alias("n"), F.max("grp_away").alias("grp_radius")), "groups")
    # Sizes are a row for each pivot: Spark sees that the table is small, and checks it.
    numbers = cell_sizes.select("dim", "cell", F.ceil(F.col("n") / block).alias("parts"))
    parted = placed.select("id", "v", "dim", "cell", "grp").join(numbers, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    data = stored(parted.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part").select("id", "v", "dim", "cell", "grp"), "data")

    pieces = _passes(group_sizes.orderBy("dim", "grp").collect(), query_block)
    if not pieces:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    table = spark.createDataFrame(pieces, "dim int, grp int, gparts bigint, gpart bigint, pass int")
    seeded = data.mapInArrow(_seed(k, every, block), "id bigint, v array<bigint>, dim int, grp int, floor bigint")
    seeded = seeded.join(table.select("dim", "grp", "gparts").distinct(), ["dim", "grp"]).withColumn("gpart", F.pmod(F.xxhash64("id"), "gparts")).drop("gparts")
    queries = stored(seeded.join(table.drop("gparts"), ["dim", "grp", "gpart"]), "queries")
    floors = queries.groupBy("dim", "grp").agg(F.min("floor").alias("floor"))
    bounds = group_sizes.join(floors, ["dim", "grp"]).select("dim", "grp", "grp_radius", "floor")
    bounds = bounds.join(cell_sizes.select("dim", "cell", "radius"), "dim")
    meetings = stored(bounds.mapInArrow(_meeting(cells, groups), bounds.schema).select("dim", "grp", "cell"), "meetings")

    path = fresh_path(spark, "found")
    for number in range(pieces[-1][-1] + 1):
        now = sorted({(dim, grp) for dim, grp, _, _, n in pieces if n == number})
        met = meetings.join(spark.createDataFrame(now, "dim int, grp int"), ["dim", "grp"], "left_semi")
        asked = spark.sparkContext.broadcast(_Asked(queries.where(F.col("pass") == number).toArrow(), met.toArrow()))
        data.select("id", "v", "dim", "cell").mapInArrow(_walk(k, block, asked), "query_id bigint, vec_id bigint, score bigint").write.parquet(f"{path}/pass={number}")
        asked.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("query_id bigint, vec_id bigint, score bigint, pass int").parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
