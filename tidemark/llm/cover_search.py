"""Operator 5: exact top-k by integer inner product, with a dual-tree search over cover trees.

Rows and queries are dealt to cells (row block x query block) of bounded size. Each cell builds one cover tree over its
rows and one over its queries: a node's children are centres more than half its scale apart, every point lies within the
scale of its centre, and each node keeps the radius that covers its points. The search descends both trees together. A pair
of nodes is pruned when its bound <q, r> + R_q |r| + |q| R_r + R_q R_r is below the worst kth score among the node's
queries. A cell returns at most k rows for each query, and the cells' results are merged by rank.

Scores are exact: doubles hold the integers while products stay below 2**53, beyond that Python integers are used (a
score outside 64 bits is clipped to their range).

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do null ids. Repeated ids:
one row per id takes part, the one with the smallest vector. Vectors of different lengths are compared only with their
own length. Fewer than k candidates: all of them. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components in a block of rows and in a block of queries: 4,096 and 2,048 vectors of 64 dimensions.
ROW_BLOCK, QUERY_BLOCK = 1 << 18, 1 << 17
LEAF = 48


class CoverTree:
    """Nodes as arrays; the points of a node are a range of ``order``."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.norm = np.sqrt((points**2).sum(1))
        far = self._distances(0, self.order)
        self._grow(0, len(points), 0, far, float(far.max()))
        self.centres = points[self.centre]
        self.centre_norm = self.norm[self.centre]
        self.radii = np.array(self.radius)

    def _distances(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(1))

    def _node(self, start: int, stop: int, centre: int, radius: float) -> int:
        for column, value in zip((self.centre, self.start, self.stop, self.radius, self.children),
                                 (centre, start, stop, radius, np.zeros(0, int)), strict=True):
            column.append(value)
        return len(self.centre) - 1

    def _grow(self, start: int, stop: int, centre: int, far: np.ndarray, scale: float) -> int:
        """``far`` are the distances of the range's points from the centre, none above ``scale``."""
        todo = [(self._node(start, stop, centre, float(far.max())), far, scale)]
        root = todo[0][0]
        while todo:
            node, far, scale = todo.pop()
            a, b, centre = self.start[node], self.stop[node], self.centre[node]
            if b - a <= LEAF or self.radius[node] == 0:
                continue
            half = min(scale, self.radius[node]) / 2
            members, left, parts = self.order[a:b], np.arange(b - a), []
            near, dist = centre, far
            while len(left):
                inside = dist <= half
                parts.append((near, left[inside], dist[inside]))
                left = left[~inside]
                if len(left):
                    near = int(members[left[0]])
                    dist = self._distances(near, members[left])
            # Points alone in their ball stay together in one leaf-like child around the parent's centre.
            lone = [p for p in parts if len(p[1]) == 1]
            kept = [p for p in parts if len(p[1]) > 1]
            children, at, moved = [], a, []
            for near, part, dist in kept:
                moved.append(members[part])
                child = self._node(at, at + len(part), near, float(dist.max()))
                children.append(child)
                at += len(part)
                todo.append((child, dist, half))
            for k in range(0, len(lone), LEAF):
                part = np.concatenate([p[1] for p in lone[k:k + LEAF]])
                moved.append(members[part])
                children.append(self._node(at, at + len(part), centre, float(far[part].max())))
                at += len(part)
            self.order[a:b] = np.concatenate(moved)
            self.children[node] = np.array(children)
        return root

    def members(self, node: int) -> np.ndarray:
        return self.order[self.start[node]:self.stop[node]]


class Best:
    """The k best scores and ids of every query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, kind: type) -> None:
        self.score = np.full((queries, k), -np.inf if kind is float else -(1 << 200), kind)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        worth = (scores >= self.score[queries, -1:]).any(1)
        queries, scores = queries[worth], scores[worth]
        if not len(queries):
            return
        score = np.concatenate([self.score[queries], scores], 1)
        where = np.concatenate([self.id[queries], np.broadcast_to(ids, scores.shape)], 1)
        rank = np.lexsort((where, -score), axis=1)[:, :k]
        self.score[queries] = np.take_along_axis(score, rank, 1)
        self.id[queries] = np.take_along_axis(where, rank, 1)


def _clipped(score: int) -> int:
    return min(max(score, -(2**63)), 2**63 - 1)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Best:
    """Dual-tree search in one cell; a row with the query's own id is no candidate."""
    rows_tree, query_tree = CoverTree(rows), CoverTree(queries)
    exact = rows_tree.norm.max(initial=0) * query_tree.norm.max(initial=0) < 2.0**52
    best = Best(len(queries), k, float if exact else object)
    wide = None if exact else ([[int(x) for x in v] for v in queries.tolist()], [[int(x) for x in v] for v in rows.tolist()])
    slack = 1e-9 * rows_tree.norm.max(initial=0) * query_tree.norm.max(initial=0)

    def compare(q: np.ndarray, r: np.ndarray) -> None:
        if wide is None:
            scores = queries[q] @ rows[r].T
            scores[query_ids[q][:, None] == row_ids[r][None, :]] = -np.inf
        else:
            scores = np.array([[-(1 << 200) if query_ids[i] == row_ids[j] else _clipped(sum(x * y for x, y in zip(wide[0][i], wide[1][j], strict=True)))
                                for j in r] for i in q], object)
        best.offer(q, scores, row_ids[r])

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        t = rows_tree
        dot = t.centres[nodes] @ query_tree.centres[q]
        rq, rr = query_tree.radii[q], t.radii[nodes]
        return np.maximum(dot + rq * t.centre_norm[nodes] + query_tree.centre_norm[q] * rr + rq * rr + slack, -(2.0**63))

    todo = [(np.inf, 0, 0)]
    while todo:
        bound, q, r = todo.pop()
        members = query_tree.members(q)
        worst = float(best.score[members, -1].min()) if len(members) else np.inf
        if bound < worst:
            continue
        q_parts, r_parts = query_tree.children[q], rows_tree.children[r]
        if not len(q_parts) and not len(r_parts):
            compare(members, rows_tree.members(r))
        elif len(r_parts) and (not len(q_parts) or rows_tree.radii[r] >= query_tree.radii[q]):
            ends = bounds(q, r_parts)
            some = np.flatnonzero(ends >= worst)
            todo += [(ends[i], q, int(r_parts[i])) for i in some[np.argsort(ends[some])]]  # the most promising comes first
        else:
            todo += [(bounds(int(c), np.array([r]))[0], int(c), r) for c in q_parts]
    return best


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score; queries are the rows whose id is divisible by ``every``."""
    vectors = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
               .where("vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
               .groupBy("vec_id").agg(F.min("x").alias("x")))
    # floor as a double: its integer may be wider than 64 bits.
    vectors = vectors.select("vec_id", F.expr("transform(x, c -> case when abs(c) < 4e15 then double(floor(1024 * c)) else 1024 * c end)").alias("x"),
                             F.size("x").alias("size"))
    is_query = F.col("vec_id") % every == 0
    sizes = (vectors.groupBy("size").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m"))
             .select("size", F.ceil(F.col("n") * F.greatest("size", F.lit(1)) / ROW_BLOCK).cast("int").alias("row_blocks"),
                     F.ceil(F.col("m") * F.greatest("size", F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")))
    dealt = vectors.join(sizes, "size").where("query_blocks > 0")
    own = F.xxhash64("vec_id")
    rows = dealt.select("size", F.pmod(own, "row_blocks").alias("row_block"),
                        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "vec_id", "x", F.lit(False).alias("asks"))
    asks = dealt.where(is_query).select(
        "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_blocks").cast("bigint") - 1)).alias("row_block"),
        F.pmod(own, "query_blocks").cast("int").alias("query_block"), "vec_id", "x", F.lit(True).alias("asks"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = np.asarray(table.column("asks"))
        ids = np.asarray(table.column("vec_id"), np.int64)
        flat = np.asarray(table.column("x").combine_chunks().flatten(), float)
        flat = flat.reshape(len(ids), len(flat) // max(1, len(ids)))
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.any() and not asked.all():
            best = search(flat[asked], ids[asked], flat[~asked], ids[~asked], k)
            real = (best.score > -np.inf) if best.score.dtype == float else (best.score > -(1 << 199))
            i, j = np.nonzero(real)
            out = {"query_id": ids[asked][i], "vec_id": best.id[i, j],
                   "score": np.array([int(s) for s in best.score[i, j]], np.int64)}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = rows.unionByName(asks).groupBy("size", "row_block", "query_block").applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
