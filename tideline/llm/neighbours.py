"""Approximate nearest neighbours with a vantage-point tree for each shard.

Shards are cells: each vector belongs to its nearest pivot, and a cell too large for one tree is dealt into
several. Each shard becomes a balanced vantage-point tree. A query first searches the cells nearest to it;
the worst of what it finds bounds all that follows: a cell whose lower bound by the triangle inequality,
from its pivot's distance and its radii or from two pivots, times a factor, is beyond it is never visited,
nor is a child of a tree. The nearer child is visited first. Factor 1 is exact search; a larger factor
prunes more.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import discard, numbered, spill

#: Vectors a pivot should have, the most pivots there are (a task holds them all), and the most vectors of one tree.
CELL_ROWS = 128
MOST_PIVOTS = 2048
SHARD_ROWS = 4096
#: Pivots are fitted on about so many vectors, by hash; every vector is indexed.
SAMPLE_ROWS = 20_000
FIT_ROUNDS = 6
#: Cells that a query searches before any bound, and the most queries that meet a shard at once.
SEEDS = 4
QUERY_ROWS = 4096
#: Vector components that a step of the routing sends at once.
PIECE_NUMBERS = 1 << 20
LEAF = 48
FACTOR = 3.3
K = 10


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None where it is null, empty, zero or not all finite."""
    if vector is None or len(vector) == 0:
        return None
    v = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of q to each row of x, from the differences themselves."""
    out = np.empty((len(q), len(x)))
    for a in range(0, len(q), 64):
        d = q[a : a + 64, None, :] - x[None]
        out[a : a + 64] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


class Tree:
    """Points in leaf order and, for each node, its vantage point, ranges of distances and children.

    Children split the points by rank of distance, so copies of one vector keep the tree balanced.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.nodes: list[list] = []  # start, end, vantage, inner lo, hi, outer lo, hi, inner, outer
        todo = [(0, len(x), -1, 0)]
        vantage = []
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][7 + side] = me
            self.nodes.append([a, b, -1, 0.0, 0.0, 0.0, 0.0, -1, -1])
            if b - a <= leaf:
                continue
            own = order[a:b]
            # the vantage point is the one farthest from the first: it sees the widest spread
            far = own[int(distances(x[own[:1]], x[own])[0].argmax())]
            d = distances(x[far : far + 1], x[own])[0]
            by = np.lexsort((ids[own], d))
            order[a:b], d = own[by], d[by]
            mid = (b - a) // 2
            self.nodes[me][2:7] = [len(vantage), d[0], d[mid - 1], d[mid], d[-1]]
            vantage.append(x[far])
            todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.ids, self.x = ids[order], x[order]
        self.vantage = np.array(vantage) if vantage else np.zeros((0, x.shape[1]))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, vantage=self.vantage, nodes=np.array(self.nodes, np.float64))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            t = Tree.__new__(Tree)
            t.ids, t.x, t.vantage = z["ids"], z["x"], z["vantage"]
            t.nodes = [[int(r[0]), int(r[1]), int(r[2]), *r[3:7], int(r[7]), int(r[8])] for r in z["nodes"].tolist()]
        return t

    def search(self, q: np.ndarray, own: np.ndarray, d: np.ndarray, i: np.ndarray, factor: float) -> int:
        """Improve d and i (queries x k, sorted by distance, then id) in place; the number of distances computed.

        own is what the tree's ids say of the query itself, which it never finds.
        """
        if q.shape[1] != self.x.shape[1]:
            return 0
        k, work = d.shape[1], 0
        todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            at, rows, low = todo.pop()
            if len(rows) and low.any():
                rows = rows[low * factor <= d[rows, -1] + 1e-9]
            if not len(rows):
                continue
            a, b, v, ilo, ihi, olo, ohi, inner, outer = self.nodes[at]
            if v < 0:
                new = distances(q[rows], self.x[a:b])
                work += new.size
                new[own[rows][:, None] == self.ids[None, a:b]] = np.inf
                close = new.min(axis=1) <= d[rows, -1]
                rows, new = rows[close], new[close]
                if len(rows):
                    both = np.concatenate([d[rows], new], axis=1)
                    ids = np.concatenate([i[rows], np.broadcast_to(self.ids[a:b], new.shape)], axis=1)
                    best = np.lexsort((ids, both), axis=1)[:, :k]
                    d[rows], i[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(ids, best, 1)
                continue
            dv = distances(q[rows], self.vantage[v : v + 1])[:, 0]
            work += len(rows)
            lin, lout = np.maximum(0, np.maximum(ilo - dv, dv - ihi)), np.maximum(0, np.maximum(olo - dv, dv - ohi))
            near = lin <= lout
            # last in, first out: each query sees its nearer child first
            todo += [(outer, rows[near], lout[near]), (inner, rows[~near], lin[~near]), (inner, rows[near], lin[near]), (outer, rows[~near], lout[~near])]
        return work


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dim of rows that take part."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("v"), F.size(e).alias("dim"))


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products: fast, and good enough to choose among pivots."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None])


def fit_pivots(x: np.ndarray, n: int, rounds: int = FIT_ROUNDS, seed: int = 1) -> np.ndarray:
    """n pivots of a sample: means of its cells, from a random start; the distinct ones."""
    rng = np.random.default_rng(seed)
    pivots = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([square_distances(x[a : a + 4096], pivots).argmin(axis=1) for a in range(0, len(x), 4096)])
        held = np.bincount(cell, minlength=len(pivots))
        order = np.argsort(cell, kind="stable")
        some = np.flatnonzero(held)
        pivots[some] = np.add.reduceat(x[order], (np.cumsum(held) - held)[some], axis=0) / held[some][:, None]
    return np.unique(pivots, axis=0)


class Index:
    """pivots: of each dimension, its pivots. cells: a written table (dim, cell, low, high, shards), the least and
    greatest distance to the pivot in each cell and how many trees it has; trees: (dim, cell, shard, tree)."""

    def __init__(self, rows: DataFrame, pivots: dict[int, np.ndarray], cells: DataFrame, trees: DataFrame):
        self.rows, self.pivots, self.cells, self.trees = rows, pivots, cells, trees


def _cells_of(pdf: pd.DataFrame, pivots: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row and its exact distance to that cell's pivot."""
    cell, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
    dims = pdf["dim"].to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = np.array(pdf["v"].iloc[at].tolist(), np.float64)
        own = square_distances(x, pivots[int(dim)]).argmin(axis=1)
        cell[at] = own
        d = x - pivots[int(dim)][own]
        far[at] = np.sqrt((d * d).sum(axis=1))
    return cell, far


def build(vectors: DataFrame, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS) -> Index:
    """Every usable vector in the tree of one shard.

    Vectors that are null, empty, zero or not finite take no part, nor do null ids. Rows that share an id
    are rows of their own. Equal vectors share a cell, which is dealt by hash into trees of bounded size.
    """
    rows = numbered(_valid(vectors), "rid", "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim, n in sorted(sizes.items()):
        every = max(1, n // SAMPLE_ROWS)
        some = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(every)) == 0)).select("v").orderBy(F.xxhash64("v")).limit(2 * SAMPLE_ROWS).collect()
        some = some or rows.filter(F.col("dim") == dim).select("v").limit(1).collect()
        pivots[dim] = fit_pivots(np.array([r["v"] for r in some], np.float64), min(MOST_PIVOTS, math.ceil(n / cell_rows)))
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for pdf in (b for b in batches if len(b)):
            cell, far = _cells_of(pdf, sent.value)
            yield pdf[["rid", "vec_id", "v", "dim"]].assign(cell=cell, far=far)

    placed = spill(rows.select("rid", "vec_id", "v", "dim").mapInPandas(place, "rid long, vec_id long, v array<double>, dim int, cell int, far double"), "cells")
    shards = F.ceil(F.count("*") / F.lit(shard_rows)).cast("int")
    cells = spill(placed.groupBy("dim", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), shards.alias("shards")), "radii")

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        t = Tree(np.arange(len(pdf)), np.array(pdf["v"].tolist(), np.float64))
        order = t.ids
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "shard": [key[2]], "tree": [t.dump()], "rids": [pdf["rid"].to_numpy()[order].tolist()], "ids": [pdf["vec_id"].to_numpy()[order].tolist()]})

    dealt = placed.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    trees = spill(dealt.groupBy("dim", "cell", "shard").applyInPandas(tree, "dim int, cell int, shard int, tree binary, rids array<long>, ids array<long>"), "trees")
    discard(placed)
    return Index(rows, pivots, cells, trees)


FOUND = "rid long, query_id long, found long, vec_id long, score double"


def _meet(index: Index, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """rid, query_id, found, vec_id, score: what asked (rid, vec_id, v, dim, cell, limit) finds in the cells it names.

    The queries of a cell go in blocks, so that a task holds one tree and a bounded number of queries.
    """
    blocks = spill(asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks")), "blocks")
    queries = asked.join(blocks, ["dim", "cell"]).join(index.cells.select("dim", "cell", "shards"), ["dim", "cell"])
    queries = queries.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    trees = index.trees.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rid": [], "query_id": [], "found": [], "vec_id": [], "score": []}).astype({"rid": "int64", "query_id": "int64", "found": "int64", "vec_id": "int64", "score": "float64"})
        right = right.sort_values("rid")
        tree, rids, names = Tree.load(left["tree"].iloc[0]), np.asarray(left["rids"].iloc[0]), np.asarray(left["ids"].iloc[0])
        # within the tree a point goes by its rank of (id, row), so that ties fall to smaller ids
        by = np.lexsort((rids, names))
        tree.ids = np.empty(len(by), np.int64)
        tree.ids[by] = np.arange(len(by))
        at = np.searchsorted(rids[order := np.argsort(rids)], right["rid"].to_numpy())
        at = np.minimum(at, len(rids) - 1)
        here = rids[order][at] == right["rid"].to_numpy()
        own = np.where(here, tree.ids[order][at], -1)
        q = np.array(right["v"].tolist(), np.float64)
        d = np.full((len(q), k), np.inf)
        d[:] = right["limit"].to_numpy()[:, None]
        i = np.full((len(q), k), np.iinfo(np.int64).max)
        tree.search(q, own, d, i, factor)
        row, col = np.nonzero((i < np.iinfo(np.int64).max) & np.isfinite(d))
        point = by[i[row, col]]
        return pd.DataFrame({"rid": right["rid"].to_numpy()[row], "query_id": right["vec_id"].to_numpy()[row], "found": rids[point], "vec_id": names[point], "score": d[row, col]})

    key = ["dim", "cell", "shard", "block"]
    right = queries.select("rid", "vec_id", "v", "limit", *[F.col(c).alias(f"{c}_") for c in key])
    left = trees.select(*key, "tree", "rids", "ids")
    return left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_" for c in key])).applyInPandas(run, FOUND)


def _pieces(some: pd.DataFrame, want: np.ndarray):
    """A row for each cell that a query wants, in bounded pieces, as each carries the query's vector: all cells of
    512 queries are half a gigabyte of them at 64 components."""
    row, cell = np.nonzero(want)
    piece = max(1, PIECE_NUMBERS // int(some["dim"].iloc[0]))
    for a in range(0, len(row), piece):
        yield some.iloc[row[a : a + piece]][["rid", "vec_id", "v", "dim", "limit"]].assign(cell=cell[a : a + piece].astype(np.int32))[["rid", "vec_id", "v", "dim", "cell", "limit"]]


def search(index: Index, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, ties to smaller ids.

    queries are rows of index.rows. A query never finds its own row, and meets only vectors of its own length.
    Fewer candidates than k give fewer rows. Every query searches its nearest cells; what it has found there
    is the limit for the cells that the bounds leave.
    """
    spark = index.rows.sparkSession
    radii = {(r["dim"], r["cell"]): (r["low"], r["high"]) for r in index.cells.collect()}  # at most MOST_PIVOTS a dimension
    sent = spark.sparkContext.broadcast((index.pivots, {dim: np.array([radii.get((dim, c), (np.inf, -np.inf)) for c in range(len(p))]) for dim, p in index.pivots.items()}))

    def route(first: bool):
        def run(batches):
            pivots, of = sent.value
            for pdf in (b for b in batches if len(b)):
                for dim, part in pdf.groupby("dim"):
                    p, (low, high) = pivots[int(dim)], of[int(dim)].T
                    for a in range(0, len(part), 512):
                        some = part.iloc[a : a + 512]
                        x = np.array(some["v"].tolist(), np.float64)
                        d = np.sqrt(square_distances(x, p))
                        seeds = np.zeros(d.shape, bool)
                        held = np.where(high >= low, d, np.inf)
                        nearest = np.argsort(held, axis=1, kind="stable")[:, :SEEDS]
                        np.put_along_axis(seeds, nearest, True, axis=1)
                        seeds &= high >= low
                        if first:
                            want = seeds
                        else:
                            home = held.argmin(axis=1)
                            apart = np.sqrt(square_distances(p[home], p))
                            bound = np.maximum(np.maximum(d - high, low - d), 0)
                            # a vector of the other cell is nearer to its pivot than to this query's
                            size = 1 + np.sqrt((x * x).sum(axis=1).max()) + np.sqrt((p * p).sum(axis=1).max())
                            mid = (d * d - held[np.arange(len(x)), home][:, None] ** 2) / (2 * np.maximum(apart, 1e-3 * size))
                            bound = np.maximum(bound, np.where(apart > 1e-3 * size, mid, 0)) - 1e-7 * size  # less what rounding may have added
                            want = (bound * factor <= some["limit"].to_numpy()[:, None]) & ~seeds & (high >= low)
                        yield from _pieces(some, want)

        return run

    schema = "rid long, vec_id long, v array<double>, dim int, cell int, limit double"
    asked = queries.select("rid", "vec_id", "v", "dim", F.lit(float("inf")).alias("limit"))
    near = spill(_meet(index, asked.mapInPandas(route(True), schema), k, factor), "near")
    worst = near.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list("score")), k, 1).alias("s")).select("rid", F.get("s", F.lit(0)).alias("worst"))
    limited = asked.drop("limit").join(worst, "rid", "left").withColumn("limit", F.coalesce("worst", F.lit(float("inf")))).drop("worst")
    far = _meet(index, limited.mapInPandas(route(False), schema), k, factor)
    w = Window.partitionBy("rid").orderBy("score", "vec_id", "found")
    return near.unionByName(far).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = K, factor: float = FACTOR, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """search() over all vectors, with those as queries whose id is divisible by every."""
    index = build(vectors, cell_rows, shard_rows)
    return search(index, index.rows.filter(F.col("vec_id") % every == 0), k, factor)
