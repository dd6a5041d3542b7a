"""Exact top-k inner products by dual-tree search over cover trees.

The first level of the trees is laid over the cluster: centres of cells are a
net of far-apart vectors of a bounded sample, and every vector and query
belongs to the cell of its nearest centre. A query's k-th best score within the
sample bounds its true k-th score from below; a group of queries and a cell
whose radii allow no inner product as high are discarded before anything is
shuffled. The rest meet: a cell's block of vectors is indexed by a cover tree,
the queries that need it by another, and both are searched together; a pair of
nodes is pruned when even the largest inner product that their covering radii
allow stays below the worst k-th score of the query group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded
from loomgraph.session import Stored

#: Vectors and queries that meet in one task, points of a leaf of either tree.
VECTORS, QUERIES, LEAF, QUERY_LEAF = 8192, 65536, 256, 32
#: Children of a node.
FAN = 32
#: Vectors, in the order of a hash of their ids, among which cells' centres are chosen and from which queries get their first k-th scores.
SAMPLE = 1024


@dataclass
class Node:
    """Points lo..hi of the tree's order, all within `radius` of the centre."""

    lo: int
    hi: int
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node]


class CoverTree:
    """Each level is a net: centres further apart than the radius that covers their points, which halves from level to level as far as FAN children allow."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.leaf = leaf
        self.root = self._build(0, len(points))
        self.points = self.points[self.order]

    def _build(self, lo: int, hi: int) -> Node:
        at = self.order[lo:hi].copy()
        points = self.points[at]
        centre = points[0]
        d = np.sqrt(((points - centre) ** 2).sum(axis=1))
        node = Node(lo, hi, centre, float(d.max()), float(np.sqrt((centre**2).sum())), [])
        if hi - lo <= self.leaf or node.radius == 0:
            return node
        near, far, centres = np.zeros(len(at), np.int64), d, 1
        while centres < FAN and far.max() > node.radius / 2:
            d = np.sqrt(((points - points[far.argmax()]) ** 2).sum(axis=1))
            near[d < far] = centres
            far = np.minimum(far, d)
            centres += 1
        # the farthest from all centres so far is the next one: so centres are further apart than what they cover
        by = np.lexsort((far, near))  # a child's first point is its centre
        self.order[lo:hi] = at[by]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(near[by]) > 0]))
        node.children = [self._build(lo + a, lo + b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), hi - lo], strict=True)]
        return node


class Search:
    """Best k of each query so far; ties to the smaller id. scored: pairs whose product was taken."""

    def __init__(self, queries: CoverTree, query_ids: np.ndarray, vectors: CoverTree, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.q, self.v, self.k = queries, vectors, k
        self.query_ids, self.ids = query_ids[queries.order], ids[vectors.order]
        self.score = np.full((len(query_ids), k), -np.inf)
        self.id = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(query_ids), -np.inf) if least is None else least[queries.order]
        self.scored = 0
        most = np.abs(queries.points).max(initial=0) * np.abs(vectors.points).max(initial=0) * max(1, queries.points.shape[1] if queries.points.ndim > 1 else 1)
        if most >= 2**53:
            raise ValueError("scores of 2**53 or more: choose a smaller scale")

    @staticmethod
    def bound(q: Node, v: Node) -> float:
        return float(q.centre @ v.centre) + v.radius * q.norm + q.radius * v.norm + q.radius * v.radius

    def run(self) -> None:
        if len(self.query_ids) and len(self.ids):
            self._pair(self.q.root, self.v.root)

    def _pair(self, q: Node, v: Node) -> None:
        worst = np.maximum(self.score[q.lo : q.hi, -1], self.least[q.lo : q.hi]).min()
        if hopeless(self.bound(q, v), worst):
            return
        if q.children and (not v.children or q.hi - q.lo > v.hi - v.lo):
            for c in q.children:
                self._pair(c, v)
        elif v.children:
            for c in sorted(v.children, key=lambda c: -self.bound(q, c)):
                self._pair(q, c)
        else:
            self._leaf(q, v)

    def _leaf(self, q: Node, v: Node) -> None:
        a, b = self.q.points[q.lo : q.hi], self.v.points[v.lo : v.hi]
        s = a @ b.T
        self.scored += s.size
        ids = self.ids[v.lo : v.hi]
        s[self.query_ids[q.lo : q.hi, None] == ids[None, :]] = -np.inf
        better = np.flatnonzero((s.max(axis=1) >= self.score[q.lo : q.hi, -1]) & (s.max(axis=1) > -np.inf))
        if not len(better):
            return
        rows, s = better + q.lo, s[better]
        if s.shape[1] > 4 * self.k:  # what is below a row's k-th score here is not among its best
            cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            wide = int((s >= cut[:, None]).sum(axis=1).max())
            by = np.argsort(-s, axis=1, kind="stable")[:, :wide]
            s, ids = np.take_along_axis(s, by, axis=1), ids[by]
        else:
            ids = np.broadcast_to(ids, s.shape)
        all_s = np.concatenate([self.score[rows], s], axis=1)
        all_i = np.concatenate([self.id[rows], ids], axis=1)
        best = np.lexsort((all_i, -all_s))[:, : self.k]
        self.score[rows] = np.take_along_axis(all_s, best, axis=1)
        self.id[rows] = np.take_along_axis(all_i, best, axis=1)


def hopeless(bound: float | np.ndarray, worst: float | np.ndarray) -> bool | np.ndarray:
    """Scores are whole numbers, so ties are never pruned; the slack also covers rounding."""
    return bound + 0.5 + 1e-9 * np.abs(bound) < worst


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Positions of up to `most` points, each the farthest from those before it: a level of a cover tree."""
    out, far = [0], np.full(len(points), np.inf)
    while len(out) < min(most, len(points)):
        far = np.minimum(far, ((points - points[out[-1]]) ** 2).sum(axis=1))
        nxt = int(far.argmax())
        if far[nxt] == 0:
            break
        out.append(nxt)
    return np.array(out)


def surviving(centres: np.ndarray, vector_radius: np.ndarray, query_radius: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Which cell of queries (row) must meet which cell of vectors (column). Radii below 0: nothing there."""
    norm = np.sqrt((centres**2).sum(axis=1))
    bound = centres @ centres.T + norm[:, None] * vector_radius[None, :] + query_radius[:, None] * (norm + vector_radius)[None, :]
    return ~hopeless(bound, worst[:, None]) & (query_radius >= 0)[:, None] & (vector_radius >= 0)[None, :]


def _lists(x: pa.Array) -> list[np.ndarray]:
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _place(cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Each vector's cell and distance to its centre; a query's k-th best score within the sample (null: fewer there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, query = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            vectors = _lists(batch.column(1))
            cell, dist, least = np.full(len(ids), -1, np.int32), np.zeros(len(ids)), np.full(len(ids), -np.inf)
            dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for d in set(dims.tolist()) & cells.keys():
                at = np.flatnonzero(dims == d)
                points = np.stack([vectors[i] for i in at.tolist()]).astype(np.float64)
                sample_ids, sample, centres = cells[d]
                apart = (points**2).sum(axis=1)[:, None] - 2 * (points @ sample[centres].T) + (sample[centres] ** 2).sum(axis=1)[None, :]
                cell[at] = apart.argmin(axis=1)
                dist[at] = np.sqrt(((points - sample[centres][cell[at]]) ** 2).sum(axis=1))
                asks = query[at]
                if asks.any() and len(sample) > k:
                    s = points[asks] @ sample.T
                    s[ids[at][asks][:, None] == sample_ids[None, :]] = -np.inf
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    least[at[asks]] = kth - 1e-9 * np.abs(kth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(dist), pa.array(least)], ["vec_id", "v", "query", "dim", "cell", "dist", "least"])

    return run


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([t.column(c).to_numpy() for c in ("dim", "cell", "block", "qb")], axis=1)
        query, ids, least = (t.column(c).to_numpy() for c in ("query", "vec_id", "least"))
        vectors = _lists(t.column("v").combine_chunks() if t.column("v").num_chunks != 1 else t.column("v").chunk(0))
        _, of = np.unique(key, axis=0, return_inverse=True)
        by = np.argsort(of, kind="stable")
        for mine in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
            is_q = query[mine]
            if is_q.all() or not is_q.any():
                continue
            points = np.stack([vectors[i] for i in mine.tolist()])
            s = Search(CoverTree(points[is_q], QUERY_LEAF), ids[mine][is_q], CoverTree(points[~is_q]), ids[mine][~is_q], k, least[mine][is_q])
            s.run()
            some = s.score > -np.inf
            row = np.broadcast_to(s.query_ids[:, None], s.score.shape)[some]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(s.id[some]), pa.array(s.score[some].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def whole_vectors(df: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, query) of the vectors that take part, their components floor(scale * x)."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, whole).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("v is not null").distinct()


def placed(rows: DataFrame, k: int, vectors: int, sample: int) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """The rows with dim, cell, dist and least; for each sampled dimension, which cells of queries meet which cells of vectors; the queries.

    The driver gets the sample, and a row for each cell: both bounded.
    """
    rows = Stored(rows, "vectors").read()
    n = rows.count()
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect():
        by_dim.setdefault(len(r.v), []).append((r.vec_id, r.v))
    cells = {}
    for d, some in by_dim.items():
        points = np.array([v for _, v in some], np.float64)
        cells[d] = (np.array([i for i, _ in some]), points, net(points, -(-n // vectors)))
    table = Stored(rows.mapInArrow(_place(cells, k), "vec_id long, v array<long>, query boolean, dim int, cell int, dist double, least double"), "placed-vectors").read()
    of_query = lambda x: F.when(F.col("query"), F.col(x))
    stats = table.where("cell >= 0").groupBy("dim", "cell").agg(F.max("dist").alias("r"), F.max(of_query("dist")).alias("qr"), F.min(of_query("least")).alias("worst"), F.count_if("query").alias("nq")).collect()
    meet = {}
    for d, (_, points, centres) in cells.items():
        mine = [s for s in stats if s.dim == d]
        r, qr, worst = np.full(len(centres), -1.0), np.full(len(centres), -1.0), np.full(len(centres), -np.inf)
        for s in mine:
            r[s.cell] = s.r
            if s.nq:
                qr[s.cell], worst[s.cell] = s.qr, s.worst
        meet[d] = surviving(points[centres], r * (1 + 1e-9), qr * (1 + 1e-9), worst)
    return table, meet, n


def top_inner_products(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256,
    vectors: int = VECTORS, queries: int = QUERIES, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products.

    Components become floor(scale * x), so scores are whole numbers and exact.
    Every row but the query's own is a candidate (rows that share the query's
    id are its own; rows that repeat both id and vector count once). Fewer
    candidates than k give fewer rows. Vectors that are null, empty, or hold
    null or non-finite components, and null ids, take no part; vectors of
    different lengths never meet. Ties go to the smaller id. Other columns are
    not read; an empty table gives an empty result. Ids are whole numbers.
    Components so large that a score could reach 2**53 raise an error.
    """
    bounded(df.sparkSession)
    spark = df.sparkSession
    table, meet, n = placed(whole_vectors(df, is_query, id_col, vector_col, scale), k, vectors, sample)
    size = table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("query").alias("nq"))
    size = size.select("dim", "cell", F.ceil(F.col("n") / vectors).cast("int").alias("blocks"))
    # a cell that holds too many for one task is cut into blocks by a hash of the id; queries likewise
    total = table.where("query").count()
    qbs = max(1, -(-total // queries))
    pairs = [(int(d), int(q), np.flatnonzero(row).tolist()) for d, m in meet.items() for q, row in enumerate(m) if row.any()]
    pairs = spark.createDataFrame(pairs, "dim int, cell int, meets array<int>")
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = table.join(size, ["dim", "cell"]).select("dim", "cell", hashed(F.col("blocks")).alias("block"), every(F.lit(qbs)).alias("qb"), F.lit(False).alias("query"), "vec_id", "v", F.lit(0.0).alias("least"))
    asks = table.where("query").join(F.broadcast(pairs), ["dim", "cell"], "left").withColumn("meets", F.coalesce("meets", F.array("cell")))
    asks = asks.select("dim", F.explode("meets").alias("cell"), "vec_id", "v", "least").join(size, ["dim", "cell"])
    b = asks.select("dim", "cell", every(F.col("blocks")).alias("block"), hashed(F.lit(qbs)).alias("qb"), F.lit(True).alias("query"), "vec_id", "v", "least")
    # blocks are dealt by their number: a hash would give some tasks several of the few there are
    first = F.coalesce(F.sum("blocks").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row for each cell, at most the sample's
    blocks = size.agg(F.sum("blocks")).first()[0] or 0
    met = a.unionByName(b).join(size.select("dim", "cell", first.alias("first")), ["dim", "cell"])
    number = (F.col("first") + F.col("block")) * qbs + F.col("qb")
    near = met.repartitionById(max(1, blocks * qbs), number.cast("int")).drop("first").mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met_share(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, vectors: int = VECTORS, sample: int = SAMPLE) -> float:
    """The share of query-vector pairs whose cells meet: what is not pruned before the shuffle."""
    table, meet, n = placed(whole_vectors(df, is_query, id_col, vector_col, scale), k, vectors, sample)
    size = {(r.dim, r.cell): (r.n, r.nq) for r in table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("query").alias("nq")).collect()}
    met = sum(size.get((d, q), (0, 0))[1] * size.get((d, v), (0, 0))[0] for d, m in meet.items() for q, v in np.argwhere(m).tolist())
    return met / max(1, n * sum(x[1] for x in size.values()))
