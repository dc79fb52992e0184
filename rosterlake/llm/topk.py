"""Exact top-k inner products: a ball tree for each shard, branch and bound for each block of queries.

At most PIVOTS rows, those of the smallest hash, are pivots, and each vector belongs to the cell of the nearest one. A cell is
cut by a hash of the rows into shards of a bounded number of rows, and each shard becomes one row with a ball tree: rows
ordered by leaf, and for each node its centre and radius. Queries are packed into blocks, each of one cell. A block first
meets the shards of its own cell, which gives a kth score; then the shards of those cells alone whose bound q.p + |q| r (p the
pivot, r the cell's radius) reaches the kth score of one of its queries. It meets shards one after the other in one stream and
keeps its best so far, so the kth score is shared by all nodes and shards that follow. A node's bound is q.c + |q| r; nodes
are opened in order of their bound, and closed when it lies below the kth score of every query of the block. Ties go to the
smaller id, so equal bounds are still opened.

The work is queries times rows at worst, as no bound closes cells of scattered vectors; it is spread over the blocks,
whose number grows with the queries. Components are integers, floor(scale * x) of the given ones, and scores exact;
components of 2**22 or more raise an error.

Vectors that are null, or hold a null or non-finite component, take no part; so do rows with a null id. A query's own row is
no candidate; other rows of its id are. Vectors of other lengths than the query's are no candidates. Other columns are not
read, whatever their names. An empty table gives no rows, and a query with fewer candidates than k gets all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, BLOCK_QUERIES, LEAF, PIVOTS = 4096, 512, 64, 256
#: Scores of up to 512 components below this are exact in doubles.
LARGEST = 1 << 22


class BallTree:
    """Rows of x in the order of their leaves; children of node i are 2i+1 and 2i+2."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order, cuts = np.arange(len(ids)), [np.array([0, len(ids)])]
        for _ in range(self.depth):
            edge = cuts[-1]
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > 1:
                    part = x[order[a:b]].astype(np.float64)
                    far = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                    other = part[((part - far) ** 2).sum(axis=1).argmax()]
                    order[a:b] = order[a:b][np.argsort(part @ (other - far), kind="stable")]
            cuts.append(np.sort(np.concatenate([edge, (edge[:-1] + edge[1:]) // 2])))
        self.ids, self.x = ids[order], x[order]
        spans = np.array([(a, b) for edge in cuts for a, b in zip(edge[:-1], edge[1:])])
        self.begin, self.end = spans[:, 0], spans[:, 1]
        self.centre = np.array([self.x[a:b].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in spans])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) if b > a else -np.inf for (a, b), c in zip(spans, self.centre)])


class Best:
    """The k + 1 best (score, smaller id first) of each query of a block, its own row among them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.own, self.k = queries.astype(np.float64), ids, k + 1
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.scores = np.full((len(ids), self.k), -np.inf)
        self.ids = np.full((len(ids), self.k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.scores[who], scores], axis=1)
        i = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of k others: without the row of the query's own id and score, or the last if that is not among them."""
        own = (self.ids == self.own[:, None]) & (self.scores == (self.q**2).sum(axis=1)[:, None])
        gone = np.where(own.any(axis=1), own.argmax(axis=1), self.k - 1)
        keep = np.arange(self.k)[None, :] != gone[:, None]
        return self.ids[keep].reshape(-1, self.k - 1), self.scores[keep].reshape(-1, self.k - 1)

    def reached(self, bound: np.ndarray) -> np.ndarray:
        """Which columns of bound may improve a query; the slack covers rounding."""
        return (bound + 1e-6 * (1 + np.abs(bound)) >= self.scores[:, -1:]).any(axis=0)

    def search(self, tree: BallTree) -> None:
        """Opens nodes in order of their largest bound; the slack covers rounding of centres and radii."""
        bound = self.q @ tree.centre.T + self.norm[:, None] * tree.radius[None, :]
        bound += 1e-6 * (1 + np.abs(bound))
        first_leaf, heap = 2**tree.depth - 1, [(-np.inf, 0)]
        while heap:
            heap.sort(reverse=True)
            _, node = heap.pop()
            who = np.flatnonzero((bound[:, node] >= self.scores[:, -1]) & (tree.end[node] > tree.begin[node]))
            if not len(who):
                continue
            if node >= first_leaf:
                a, b = tree.begin[node], tree.end[node]
                scores = self.q[who] @ tree.x[a:b].T.astype(np.float64)
                some = (scores >= self.scores[who, -1:]).any(axis=1)
                if some.any():
                    self.offer(who[some], scores[some], tree.ids[a:b])
            else:
                heap += [(-bound[who, child].max(), child) for child in (2 * node + 1, 2 * node + 2)]


Pivots = dict[int, np.ndarray]  # by vector length


def celled(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """vec_id, x, dim, cell (number of the nearest pivot), apart (distance from it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, dims = batch.column("x").to_pylist(), batch.column("dim").to_numpy()
            cell, apart = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in pivots:
                    x = np.array([xs[k] for k in at], np.float64)
                    far = np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ pivots[dim].T + (pivots[dim] ** 2).sum(axis=1)[None, :])
                    cell[at], apart[at] = far.argmin(axis=1), np.sqrt(far.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], ["vec_id", "x", "dim", "cell", "apart"])

    return vectors.select("vec_id", "x", F.size("x").alias("dim")).mapInArrow(run, "vec_id long, x array<long>, dim int, cell int, apart double")


def packed(rows: DataFrame, size: int, tree: bool) -> DataFrame:
    """dim, cell, part, data (pickled): one row for each part of about `size` rows of a cell."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, xs = t.column("vec_id").to_numpy(), np.array(t.column("x").to_pylist(), np.int64)
        if np.abs(xs).max(initial=0) >= LARGEST:
            raise ValueError(f"a component is {LARGEST} or more after scaling; sums would not be exact")
        order = np.argsort(ids, kind="stable")
        ids, xs = ids[order], xs[order].astype(np.int16 if np.abs(xs).max(initial=0) < 2**15 else np.int32)
        data = pickle.dumps(BallTree(ids, xs) if tree else (ids, xs), protocol=5)
        return pa.table([*(pa.array([k.as_py()], t) for k, t in zip(key, (pa.int32(), pa.int32(), pa.int64()))), pa.array([data], pa.binary())], names=["dim", "cell", "part", "data"])

    # A row for each cell. Rows are dealt by content, so a task that runs again deals alike.
    parts = rows.groupBy(F.col("dim").alias("d"), F.col("cell").alias("c")).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    dealt = rows.join(F.broadcast(parts), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts").cast("long"))
    return dealt.select("vec_id", "x", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(run, "dim int, cell int, part long, data binary")


def integer_vectors(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (floor(scale * component) as integers), of usable rows only."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def searched(blocks: DataFrame, trees: DataFrame, final: bool, k: int, pivots: Pivots, radii: dict) -> DataFrame:
    """Lets blocks (block, dim, cell, data) meet trees dealt to them (block, dim, cell, data).

    Returns the blocks with their best so far and the cells that may hold better ones, or in the end the results.
    """
    rows = blocks.select("block", "dim", "cell", F.lit(0).alias("at"), "data").unionByName(trees.select("block", "dim", "cell", F.lit(1).alias("at"), "data"))
    rows = rows.repartition("block").sortWithinPartitions("block", "at", "cell")
    schema = "query_id long, rank int, vec_id long, score long" if final else "block long, dim int, cell int, data binary, cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        where: tuple = ()

        def out() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            if final:
                ids, scores = best.result()
                q, r = np.nonzero(np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(best.own[q]), pa.array((r + 1).astype(np.int32)), pa.array(ids[q, r]), pa.array(scores[q, r].astype(np.int64))], ["query_id", "rank", "vec_id", "score"])
                return
            block, dim, cell = where
            open_cells = []
            if dim in pivots:
                bound = best.q @ pivots[dim].T + best.norm[:, None] * np.array([radii.get((dim, c), 0.0) for c in range(len(pivots[dim]))])[None, :]
                open_cells = [c for c in np.flatnonzero(best.reached(bound)).tolist() if c != cell and (dim, c) in radii]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([pickle.dumps(best, protocol=5)], pa.binary()), pa.array([open_cells], pa.list_(pa.int32()))], ["block", "dim", "cell", "data", "cells"])

        for batch in batches:
            for i in range(len(batch)):
                block, dim, cell, at = (batch.column(c)[i].as_py() for c in ("block", "dim", "cell", "at"))
                data = pickle.loads(batch.column("data")[i].as_py())
                if at == 0:
                    yield from out()
                    where, best = (block, dim, cell), data if isinstance(data, Best) else Best(data[1], data[0], k)
                elif best is not None and where[0] == block:
                    best.search(data)
        yield from out()

    return rows.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """vectors and queries (vec_id, x) -> query_id, rank, vec_id, score: for each query row the k best other rows."""
    n = vectors.count()
    some = vectors.select("x").orderBy(F.xxhash64("vec_id", "x"), "x").limit(max(1, min(PIVOTS, n // shard_rows))).collect()  # at most PIVOTS rows
    pivots = {dim: np.unique(np.array([r.x for r in some if len(r.x) == dim], np.float64), axis=0) for dim in {len(r.x) for r in some}}
    rows = common.written(celled(vectors, pivots), "cells", "none")
    trees = common.written(packed(rows, shard_rows, True), "ball-trees", "none")
    radii = {(r.dim, r.cell): r.r for r in rows.groupBy("dim", "cell").agg(F.max("apart").alias("r")).collect()}  # a row for each cell
    heads = packed(celled(queries, pivots), block_queries, False)
    heads = common.written(heads.select(F.xxhash64("dim", "cell", "part").alias("block"), "dim", "cell", "data"), "query-blocks", "none")
    # The stated query set meets all rows that may count, in blocks: first those of its own cell.
    near = trees.join(heads.select("block", "dim", "cell"), ["dim", "cell"])
    first = common.written(searched(heads, near, False, k, pivots, radii), "first-scores", "none")
    more = first.select("block", "dim", F.explode("cells").alias("cell"))
    return searched(first, trees.join(more, ["dim", "cell"]), True, k, pivots, radii)
