"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are lifted so that the largest inner product is the smallest Euclidean
distance, and projected by a Gaussian matrix to a few dimensions.  The squared
projected distance over the squared true distance is chi-square distributed, so
a query's projected neighbours are verified in order, region by region, until no
vector nearer than the k-th best would, with the chosen probability, still lie
further off in the projection.

A kd-tree over the projections deals the vectors into cells, and a smaller one
in each block orders its leaves.  A query searches its nearest cell first, then,
in widening rounds, the next ones that the stopping test leaves open.  A cell with
many vectors - of one value, say - is split into blocks by vector id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, own_columns

DIMENSIONS = 8
#: Probability that a vector within the k-th distance is not missed by the stopping test.
CONFIDENCE = 0.95
#: Vectors in a block at most, on average in a cell, and in a leaf.
BLOCK_ROWS, LEAF_ROWS = 1024, 64
#: Vectors that the cells are fitted on; at least 4 of them fall into a cell.
SAMPLE_ROWS = 20_000
#: A query visits 1 cell, then the next up to this factor more, and so on; each round tightens the stopping test of the next.
WIDENING = 4
SEED = 7
#: Slack of the matrix product against the exact sum of one pair.
SLACK = 1e-9

FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of a chi-square variable with m degrees of freedom, m even."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers by kd-tree leaf: halved at the median of the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        own = points[at]
        if len(at) <= rows or not np.ptp(own, axis=0).any():
            out += np.array_split(at, -(-len(at) // rows)) if len(at) else []
            continue
        order = np.argsort(own[:, int(np.argmax(np.ptp(own, axis=0)))], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


@dataclass
class Index:
    """What is fitted: the lift, the projection, and the splits (axis, value) of a complete kd-tree of cells."""

    size: int
    norm: float
    matrix: np.ndarray
    axis: np.ndarray
    value: np.ndarray
    boxes: dict[int, tuple[np.ndarray, np.ndarray, int]] | None = None

    def project(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.norm**2 - (v**2).sum(axis=1), 0))
        return v @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def project_query(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - len(self.axis)

    def distance2(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared lifted distance of a query of squared norm q2 to a vector of that inner product."""
        return np.maximum(q2 + self.norm**2 - 2 * score, 0)


def _box_distance2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distance of each point to each box."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap**2).sum(axis=2)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>) of the vectors that take part.

    Left out: null, zero or empty vectors, those with a null or non-finite
    component, those without an id, and those whose length is not the commonest.
    """
    rows = own_columns(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    good = "id is not null and v is not null and forall(v, x -> x is not null and x = x and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    rows = rows.where(good)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


def fit(rows: DataFrame) -> Index | None:
    """The index of usable rows; its cells are fitted on SAMPLE_ROWS of them, its lift on all."""
    whole = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n2"), F.max(F.size("v")).alias("d")).first()
    if not whole.n:
        return None
    rng = np.random.default_rng(SEED)
    index = Index(whole.n, math.sqrt(whole.n2), rng.standard_normal((whole.d + 1, DIMENSIONS)), np.empty(0, int), np.empty(0))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    points = index.project(np.array([r.v for r in sample]))
    depth = max(0, min(math.ceil(math.log2(whole.n / BLOCK_ROWS)), int(math.log2(max(1, len(points) // 4)))))
    axis, value = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    parts = {0: points}
    for node in range(2**depth - 1):
        own = parts.pop(node)
        if len(own):
            axis[node] = int(np.argmax(np.ptp(own, axis=0)))
            value[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > value[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    index.axis, index.value = axis, value
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def place(rows: DataFrame, index: Index) -> DataFrame:
    """rows with their cell and projected point; sets the index's boxes (a row per cell)."""

    def batches(it):
        for b in it:
            if b.num_rows:
                p = index.project(_matrix(b.column("v")))
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(index.cell(p)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "v", "cell", "p"])

    placed = checkpointed(rows.mapInArrow(batches, "id long, v array<double>, cell long, p array<double>"))
    ends = [f(F.get("p", F.lit(j))).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max)) for j in range(DIMENSIONS)]
    index.boxes = {
        r.cell: (np.array([r[f"lo{j}"] for j in range(DIMENSIONS)]), np.array([r[f"hi{j}"] for j in range(DIMENSIONS)]), -(-r.n // BLOCK_ROWS))
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()
    }
    return placed


def _block(cell, part):
    return cell * 1_000_000 + part


def _search(index: Index, k: int, limit: float):
    def block(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
        q, qid = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy()
        q2 = (q**2).sum(axis=1)
        p, leaves = np.stack(rows["p"].to_numpy()), None
        leaves = _leaves(p, LEAF_ROWS)
        away = _box_distance2(index.project_query(q), np.stack([p[x].min(axis=0) for x in leaves]), np.stack([p[x].max(axis=0) for x in leaves]))
        order = np.argsort(away, axis=1, kind="stable")
        # the k-th score so far: from an earlier round, or none
        bar = np.where(np.isnan(queries["bar"].to_numpy()), -np.inf, queries["bar"].to_numpy())
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in qid]
        open_ = np.arange(len(qid))
        for step in range(len(leaves)):
            leaf = order[open_, step]
            reach = np.where(np.isneginf(bar[open_]), np.inf, limit * index.distance2(q2[open_], np.where(np.isneginf(bar[open_]), 0, bar[open_])))
            # leaves come in order of distance, so a query that stops here needs none of the rest
            go = ~(away[open_, leaf] > reach)
            open_, leaf = open_[go], leaf[go]
            if not len(open_):
                break
            for x in np.unique(leaf):
                mine, at = open_[leaf == x], leaves[x]
                near = q[mine] @ v[at].T >= (bar[mine] - SLACK)[:, None]
                near &= ids[at][None, :] != qid[mine][:, None]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                exact = np.einsum("ij,ij->i", q[mine[a]], v[at[b]])
                cut = np.searchsorted(a, np.arange(len(mine) + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    s, n = best[mine[i]]
                    s, n = np.concatenate([s, exact[cut[i] : cut[i + 1]]]), np.concatenate([n, ids[at[b[cut[i] : cut[i + 1]]]]])
                    top = np.lexsort((n, -s))[:k]
                    best[mine[i]] = (s[top], n[top])
                    if len(top) == k:
                        bar[mine[i]] = max(bar[mine[i]], s[top[-1]])
        return pd.DataFrame({"query_id": np.repeat(qid, [len(s) for s, _ in best]), "vec_id": np.concatenate([n for _, n in best]), "score": np.concatenate([s for s, _ in best])})

    return block


def search(placed: DataFrame, index: Index, queries: DataFrame, k: int, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product, ties to the smaller id.

    queries has (id long, v array<double>), usable vectors too; a vector of the
    query's own id is no candidate.  Fewer than k candidates: all.
    """
    limit = chi_square_quantile(confidence, DIMENSIONS)
    cells = sorted(index.boxes)
    low, high, blocks = (np.stack([index.boxes[c][j] for c in cells]) for j in range(3))
    
    def routed(begin: int, end: int):
        """Queries dealt to the cells that are the begin-th to end-th nearest in the projection, where the test leaves them open."""

        def batches(it):
            for b in it:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("v"))
                away = _box_distance2(index.project_query(q), low, high)
                order = np.argsort(away, axis=1, kind="stable")[:, begin:end]
                bar = b.column("bar").to_numpy(zero_copy_only=False)
                reach = np.where(np.isnan(bar), np.inf, limit * index.distance2((q**2).sum(axis=1), np.nan_to_num(bar)))
                i, rank = np.nonzero(~(np.take_along_axis(away, order, axis=1) > reach[:, None]))
                c = order[i, rank]
                many = blocks[c]
                i, c = np.repeat(i, many), np.repeat(c, many)
                part = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                rows = b.take(pa.array(i))
                yield pa.record_batch([pa.array(_block(np.array(cells)[c], part), pa.int64()), rows.column("id"), rows.column("v"), pa.array(bar[i])], names=["block", "id", "v", "bar"])

        return batches

    width = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c, int(index.boxes[c][2]))]), F.col("cell"))
    dealt = placed.withColumn("block", _block(F.col("cell"), F.pmod(F.xxhash64("id"), width))).select("block", "id", "v", "p")
    find = _search(index, k, limit)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    best, begin, end = None, 0, 1
    while begin < len(cells):
        if best is None:
            asked = queries.select("id", "v", F.lit(None).cast("double").alias("bar"))
        else:
            bars = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
            asked = queries.join(bars, "id", "left").select("id", "v", "bar")
        route = asked.mapInArrow(routed(begin, end), "block long, id long, v array<double>, bar double")
        found = dealt.groupBy("block").cogroup(route.groupBy("block")).applyInPandas(find, FOUND)
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        best = checkpointed(found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k))
        begin, end = end, end * WIDENING
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each usable vector whose id is divisible by `every`, among all the usable others.

    Repeated rows of one id are one vector (the first in sort order); an empty
    table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    index = fit(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = place(rows, index)
    return search(placed, index, placed.where(F.col("id") % every == 0).select("id", "v"), k)
