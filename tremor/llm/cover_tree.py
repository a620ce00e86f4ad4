"""Exact top-k by inner product with dual cover trees.

Vectors become integers (floor of a scale times each component).  Queries and
candidates are dealt into blocks; a task gets one block of each, builds a
cover tree over both and walks pairs of nodes.  A node is a centre point and a
covering radius; its children's centres are a farthest-first net of its
points, so they lie at least the net's radius apart and cover everything
within it.  For centres a, b and radii r, s no inner product exceeds
``a.b + r|b| + s|a| + rs``: a pair is pruned once that is below the k-th score
of every query under it (or equal, with only larger ids to offer).  Leaves are
multiplied as matrices, in integers exact in double precision.

A window ranks each query's few best of every block.  Blocks have
``BLOCK_ROWS`` rows whatever the table's size, dealt by hash of the row, so
equal vectors do not meet in one task; a query meets every block of
candidates.  Every candidate is in the index; nothing is sampled.

Defined results: vectors that are null, or hold a null or a non-finite
component, take no part; vectors of different lengths never meet; ties go to
the smaller id, then to the row first read; only a query's own row is left
out, a repeated row with the same id is a candidate (and a query of its own);
an empty table, or a query without candidates, gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.session import materialize

BLOCK_ROWS = 16384
LEAF = 256
NET = 16
COLUMNS = 4096
NONE = np.iinfo(np.int64).min + 1  # its negative is a number too
LAST = np.iinfo(np.int64).max


@dataclass
class Node:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    norm: float
    low_id: int
    children: list[int]


class CoverTree:
    """Points in tree order: every node is a range of them."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.nodes: list[Node] = []
        order = np.arange(len(points))
        work = [(0, len(points), int(0), -1)]
        while work:
            start, end, centre, parent = work.pop()
            own = order[start:end]
            c = points[own[centre]]
            d = self._distance(points[own], c)
            node = Node(start, end, c, float(d.max()), float(np.sqrt(c @ c)), int(ids[own].min()), [])
            self.nodes.append(node)
            if parent >= 0:
                self.nodes[parent].children.append(len(self.nodes) - 1)
            if end - start <= LEAF or node.radius == 0:
                order[start:end] = own[np.lexsort((rows[own], ids[own]))]  # ties then go to the first column
                continue
            net, nearest = [centre], np.zeros(end - start, dtype=np.int64)
            while len(net) < NET and d.max() > 0:
                far = int(d.argmax())
                e = self._distance(points[own], points[own[far]])
                closer = e < d
                nearest[closer], d[closer] = len(net), e[closer]
                net.append(far)
            groups = [np.flatnonzero(nearest == i) for i in range(len(net))]
            if max(map(len, groups)) > 0.8 * len(own):  # a dense core: its outer half becomes a node of its own
                i = int(np.argmax([len(g) for g in groups]))
                g = groups[i][np.argsort(d[groups[i]], kind="stable")]
                groups[i:i + 1] = [g[:len(g) // 2], g[len(g) // 2:]]
                net[i:i + 1] = [net[i], int(g[len(g) // 2])]
            order[start:end] = own[np.concatenate(groups)]
            at, here = start, len(self.nodes) - 1
            for g, c0 in zip(groups, net):
                work.append((at, at + len(g), int(np.flatnonzero(g == c0)[0]), here))
                at += len(g)
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    @staticmethod
    def _distance(points: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = points - c
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _bound(a: Node, b: Node) -> float:
    x = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return x + 1e-9 * abs(x) + 1e-6  # above any rounding


class _Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE, dtype=np.int64)
        self.id = np.full((n, k), LAST, dtype=np.int64)

    def useless(self, start: int, end: int, bound: float, low_id: int) -> bool:
        kth, last = self.score[start:end, -1], self.id[start:end, -1]
        top = int(np.floor(bound)) if bound < 2**62 else LAST
        return bool(((top < kth) | ((top == kth) & (low_id > last))).all())

    def merge(self, start: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascend, so a stable order by score breaks ties by id."""
        live = np.flatnonzero(scores.max(axis=1) >= self.score[start:start + len(scores), -1])
        if not len(live):
            return
        s = scores[live]
        top = np.argsort(-s, axis=1, kind="stable")[:, :self.k]
        s = np.concatenate([self.score[start + live], np.take_along_axis(s, top, axis=1)], axis=1)
        i = np.concatenate([self.id[start + live], ids[top]], axis=1)
        by_id = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, by_id, axis=1), np.take_along_axis(i, by_id, axis=1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :self.k]
        self.score[start + live] = np.take_along_axis(s, best, axis=1)
        self.id[start + live] = np.take_along_axis(i, best, axis=1)


def dual_search(queries: CoverTree, data: CoverTree, k: int) -> _Best:
    best = _Best(len(queries.points), k)
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * max(1, queries.points.shape[1]) < 2**53
    stack = [(0, 0, _bound(queries.nodes[0], data.nodes[0]))]
    while stack:
        qi, xi, bound = stack.pop()
        q, x = queries.nodes[qi], data.nodes[xi]
        if best.useless(q.start, q.end, bound, x.low_id):
            continue
        if not q.children and not x.children:
            a = queries.points[q.start:q.end]
            for s in range(x.start, x.end, COLUMNS):
                e = min(x.end, s + COLUMNS)
                b = data.points[s:e]
                scores = (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T
                scores[queries.rows[q.start:q.end, None] == data.rows[None, s:e]] = NONE
                best.merge(q.start, scores, data.ids[s:e])
        elif x.children and (not q.children or x.radius >= q.radius):
            pairs = [(qi, c, _bound(q, data.nodes[c])) for c in x.children]
            stack += sorted(pairs, key=lambda p: p[2])  # the most promising is on top
        else:
            stack += [(c, xi, _bound(queries.nodes[c], x)) for c in q.children]
    return best


_RESULT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _block_search(k: int):
    def points(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = t["vector"].combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        return x, t["vec_id"].to_numpy(), t["row"].to_numpy()

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return _RESULT.empty_table()
        q = CoverTree(*points(queries))
        best = dual_search(q, CoverTree(*points(data)), k)
        i, j = np.nonzero(best.score != NONE)
        return pa.table([q.rows[i], q.ids[i], best.id[i, j], best.score[i, j]], schema=_RESULT)

    return run


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, row) of the vectors that take part: valid ones of rows
    with an id.  A row without one can be neither named nor told from the
    query's own (the SQL twin's ``a.vec_id <> b.vec_id`` leaves it out too)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return (vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("vector"), F.monotonically_increasing_id().alias("row")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is
    divisible by ``every``, candidates all other rows."""
    data = materialize(quantised(vectors, scale, id_col, vector_col), "vectors")  # row numbers are fixed from here on
    queries = data.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n_data, n_queries = data.count(), queries.count()
    shards, blocks = max(1, -(-n_data // block_rows)), max(1, -(-n_queries // block_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    dim = F.size("vector").alias("dim")
    left = queries.select("*", dim, own(blocks).alias("block"), spread(shards).alias("shard"))
    right = data.select("*", dim, own(shards).alias("shard"), spread(blocks).alias("block"))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _block_search(k), "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
