"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x).  Data are dealt into blocks and queries into groups; each
(group, block) tile builds a cover tree over either side and descends both together.  A pair of
nodes with centres q, p and covering radii rq, rp can reach at most
q.p + |q| rp + |p| rq + rq rp; it is pruned if that is below the worst k-th score that any query of
the query node has so far.  Leaves are multiplied outright, so all scores are exact integers.  The k
best of each tile then meet in a window over (query, score).

Every row is in one data block and every query meets every block: a stated query set against all
rows, in blocks.  Blocks have a fixed number of rows, so a task's memory does not grow with the data.

Defined cases: vectors that are null, hold null or non-finite components, or differ in length from
the query take no part; a query is never its own neighbour (rows that repeat an id are one row with
it); ties go to the smaller id; fewer than k others give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
GROUP_ROWS = 4_096
LEAF = 256


class CoverTree:
    """Nodes by level: each node's points lie within `radius` of its centre, and halving radii cover them below."""

    __slots__ = ("center", "children", "norm", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray) -> None:
        self.center = x[points[0]]
        self.norm = float(np.sqrt(self.center @ self.center))
        distance = np.sqrt(((x[points] - self.center) ** 2).sum(axis=1))
        self.radius = float(distance.max())
        self.points, self.children = points, []
        if len(points) <= LEAF or self.radius == 0:
            return
        # Centres are chosen farthest first until all points lie within half the radius or there are enough of them.
        near, owner = distance.copy(), np.zeros(len(points), dtype=np.int64)
        for c in range(1, 16):
            far = int(near.argmax())
            if near[far] <= self.radius / 2:
                break
            d = np.sqrt(((x[points] - x[points[far]]) ** 2).sum(axis=1))
            owner[d < near] = c
            near = np.minimum(near, d)
        for c in range(owner.max() + 1):
            mine = points[owner == c]
            if len(mine):
                # the point nearest the mean leads, which tightens the covering radius
                lead = int(((x[mine] - x[mine].mean(axis=0)) ** 2).sum(axis=1).argmin())
                mine[[0, lead]] = mine[[lead, 0]]
                self.children.append(CoverTree(x, mine))


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of each query, by dual descent."""
    scores = np.full((len(queries), k), -np.inf)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def reach(a: CoverTree, b: CoverTree) -> float:
        return float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + 1e-6

    def leaves(a: CoverTree, b: CoverTree) -> None:
        s = queries[a.points] @ data[b.points].T
        s[query_ids[a.points][:, None] == data_ids[b.points][None, :]] = -np.inf
        # only queries that gain something are sorted again
        gains = np.flatnonzero(s.max(axis=1) >= scores[a.points, -1])
        if not len(gains):
            return
        rows, s = a.points[gains], s[gains]
        both = np.concatenate([scores[rows], s], axis=1)
        names = np.concatenate([ids[rows], np.broadcast_to(data_ids[b.points], s.shape)], axis=1)
        best = np.lexsort((names, -both), axis=1)[:, :k]
        scores[rows] = np.take_along_axis(both, best, axis=1)
        ids[rows] = np.take_along_axis(names, best, axis=1)

    qtree, dtree = CoverTree(queries, np.arange(len(queries))), CoverTree(data, np.arange(len(data)))
    n = 0
    heap = [(-reach(qtree, dtree), n, qtree, dtree)]
    while heap:
        bound, _, a, b = heapq.heappop(heap)
        if -bound < scores[a.points, -1].min():
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        if not a.children and not b.children:
            leaves(a, b)
            continue
        for x, y in ((c, b) for c in a.children) if split_a else ((a, c) for c in b.children):
            most = reach(x, y)
            if most >= scores[x.points, -1].min():
                n += 1
                heapq.heappush(heap, (-most, n, x, y))
    got = np.isfinite(scores)
    return list(zip(np.repeat(query_ids, got.sum(axis=1)).tolist(), ids[got].tolist(), scores[got].astype(np.int64).tolist(), strict=True))


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v array<double> of whole numbers; only vectors of finite components."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return rows.filter(sound & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on the column `id`."""
    vectors = integer_vectors(rows, key, vector, scale).dropDuplicates(["id"])
    n, m = vectors.select(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // group_rows))
    data = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = vectors.filter(is_query).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def tile(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for width in set(q["v"].map(len)) & set(d["v"].map(len)):
            a, b = q[q["v"].map(len) == width], d[d["v"].map(len) == width]
            found += search(np.stack(a["v"].tolist()), a["id"].to_numpy(), np.stack(b["v"].tolist()), b["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    tiles = asked.groupBy("group", "block").cogroup(data.groupBy("group", "block")).applyInPandas(tile, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
