"""Exact top-k search by inner product with ball trees (operator 2).

Equal vectors are folded first: of each vector only the k + 1 smallest ids can be among the best of any query.
Vectors then go to the nearest of a bounded number of pivots, a pivot with too many of them being split by a
hash, and each such shard becomes a ball tree, built once and written. A query asks the shards in rounds: the one
with the largest bound, the next few, then all others that can still reach its k-th score so far, which every
round passes on to the next. In a shard, nodes wait in a heap by the largest inner product they could hold for
the queries of a block; a query drops out of a node that cannot reach its current k-th score, and children are
bounded only when their parent is opened. A node is bounded by its ball (inner product with the centre, plus the
query's length times the radius) and by its cone (angle to the centre less the widest angle in the node). A node
whose bound only ties with the k-th score is opened if it holds a smaller id.

Components are integers, floor(scale * x), and scores are exact: in floats while they stay below 2^53, else in
whole numbers of any size. A component or a returned score beyond 64 bits raises an error. Vectors that are null,
or hold null or non-finite components, take no part; a shorter vector counts as padded with zeros, an empty one
has score 0 with all. Rows that repeat an id are candidates of their own, and a query is excluded only from rows
with its own id; a repeated query id asks with its smallest vector. Null ids take no part. Ties go to the smaller
id. An empty table, or no query, gives no row. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, table, written

LEAF = 32
BLOCK = 64
#: Vectors of a shard, and shards at most (their centres go to every task).
ROWS, SHARDS = 16_384, 4096
EXACT = 1 << 53


def directions(points: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
    """Centre, radius, widest angle to the centre, least and largest length of a node's points."""
    centre = points.mean(axis=0)
    length = np.sqrt((points * points).sum(axis=1))
    radius = math.sqrt(((points - centre) ** 2).sum(axis=1).max())
    size = math.sqrt(centre @ centre)
    angle = math.pi
    if size > 0 and length.min() > 0:
        angle = math.acos(max(-1.0, min(1.0, float((points @ centre / (length * size)).min()))))
    return centre, radius, angle, float(length.min()), float(length.max())


def upper_bounds(dots: np.ndarray, query_length: np.ndarray, size, radius, angle, shortest, longest) -> np.ndarray:
    """Largest possible inner products, from those with the centre and a node's (or nodes') measures."""
    ball = dots + query_length * radius
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.arccos(np.clip(dots / (query_length * size), -1, 1))
    turned = np.cos(np.clip(phi - angle - 1e-7, 0, np.pi))
    cone = query_length * np.where(turned > 0, longest, shortest) * turned
    best = np.where(np.isnan(cone) | (angle >= np.pi), ball, np.minimum(ball, cone))
    return best + 1e-9 * query_length * (size + radius + longest) + 1e-6


class BallTree:
    """A binary tree of balls over integer points; each node is a slice of the reordered points."""

    FIELDS = ("ids", "points", "centre", "size", "radius", "angle", "shortest", "longest", "least", "lo", "hi", "kid")

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        exact = points[order]
        ids, real = ids[order], exact.astype(np.float64)
        perm = np.arange(len(ids))
        nodes, kid = [(0, len(ids))], []
        measures = []
        at = 0
        while at < len(nodes):  # a node's children stand side by side
            lo, hi = nodes[at]
            p = real[perm[lo:hi]]
            measures.append(directions(p))
            kid.append(-1)
            if hi - lo > leaf and measures[-1][1] > 0:
                far = p[((p - measures[-1][0]) ** 2).sum(axis=1).argmax()]
                other = p[((p - far) ** 2).sum(axis=1).argmax()]
                middle = (lo + hi) // 2
                perm[lo:hi] = perm[lo:hi][np.argsort(p @ (other - far), kind="stable")]
                kid[-1] = len(nodes)
                nodes += [(lo, middle), (middle, hi)]
            at += 1
        self.ids, self.points = ids[perm], exact[perm]
        self.lo, self.hi = np.array(nodes).T
        self.kid = np.array(kid)
        self.centre = np.array([m[0] for m in measures])
        self.size = np.sqrt((self.centre**2).sum(axis=1))
        self.radius, self.angle, self.shortest, self.longest = (np.array([m[i] for m in measures]) for i in range(1, 5))
        self.least = np.array([self.ids[a:b].min() for a, b in nodes])
        self._prepare()

    def _prepare(self) -> None:
        self.scored = 0
        self.most = max((abs(int(x)) for x in (self.points.max(initial=0), self.points.min(initial=0))), default=0)
        self.real = self.points.astype(np.float64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as held:
            for f in cls.FIELDS:
                setattr(tree, f, held[f])
        tree._prepare()
        return tree

    def _bounds(self, node: int, queries: np.ndarray, length: np.ndarray) -> np.ndarray:
        return upper_bounds(queries @ self.centre[node], length, self.size[node], self.radius[node], self.angle[node], self.shortest[node], self.longest[node])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: list | None = None) -> list[list[tuple[int, int]]]:
        """For each query (integers) its k best as (score, id), best first; only scores of at least its floor are looked for."""
        width = self.points.shape[1]
        real = queries.astype(np.float64)
        most = max((abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0))), default=0)
        exact = width * self.most * most < EXACT
        length = np.sqrt((real * real).sum(axis=1))
        kth = np.array([-np.inf if f is None else float(f) for f in floor] if floor is not None else [-np.inf] * len(queries))
        if not exact:
            kth -= np.abs(kth) * 1e-9
        kth_id = np.full(len(queries), np.iinfo(np.int64).max)
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        first = self._bounds(0, real, length)
        heap = [(-float(first.max(initial=0)), 0, np.arange(len(queries)), first)]
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            open_ = (bound > kth[who]) | ((bound >= kth[who]) & (self.least[node] < kth_id[who]))
            if not open_.any():
                continue
            who, bound = who[open_], bound[open_]
            if self.kid[node] >= 0:
                for child in (self.kid[node], self.kid[node] + 1):
                    own = np.minimum(self._bounds(child, real[who], length[who]), bound)
                    heapq.heappush(heap, (-float(own.max()), int(child), who, own))
                continue
            lo, hi = self.lo[node], self.hi[node]
            self.scored += (hi - lo) * len(who)
            if exact:
                scores = real[who] @ self.real[lo:hi].T
            else:
                scores = queries[who].astype(object) @ self.points[lo:hi].astype(object).T
            ids = self.ids[lo:hi]
            good = (scores >= kth[who][:, None]).astype(bool) & (ids[None, :] != query_ids[who][:, None])
            for row in np.flatnonzero(good.any(axis=1)).tolist():
                w, pick = who[row], good[row]
                new = [*found[w], *zip(map(int, scores[row][pick]), ids[pick].tolist())]
                new.sort(key=lambda x: (-x[0], x[1]))
                found[w] = new = new[:k]
                if len(new) == k and new[-1][0] >= kth[w]:
                    kth[w], kth_id[w] = new[-1]
                    if not exact:
                        kth[w] -= abs(kth[w]) * 1e-9
                        kth_id[w] = np.iinfo(np.int64).max
        return found


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, array<long>, of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(embedding).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(F.lit(float(scale)) * x) < 2.0**63, F.floor(F.lit(float(scale)) * x)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for n, r in enumerate(rows):
        out[n, : len(r)] = r
    return out


def folded(points: DataFrame, k: int) -> DataFrame:
    """vec_id and point: of equal vectors those with the k + 1 smallest ids."""
    place = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    return points.select("vec_id", "v", place.alias("_place")).where(F.col("_place") <= k + 1).select("vec_id", F.col("v").alias("point"))


def sharded(points: DataFrame, shards: int, width: int) -> DataFrame:
    """points with shard, the place of the nearest of `shards` pivots; pivots with too many points are split by a hash."""
    pivots = matrix([r["point"] for r in points.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(shards).collect()], width).astype(np.float64)
    held = points.sparkSession.sparkContext.broadcast((pivots, (pivots**2).sum(axis=1)))

    def run(batches):
        for batch in batches:
            pivots, squares = held.value
            rows = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((squares - 2 * rows @ pivots.T).argmin(axis=1).astype(np.int64))], ["vec_id", "point", "pivot"])

    placed = written(points.select("vec_id", "point").mapInArrow(run, "vec_id long, point array<long>, pivot long"), "placed")
    counts = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    base, parts, total = [], [], 0
    for pivot in range(len(pivots)):
        base.append(total)
        parts.append(max(1, -(-counts.get(pivot, 0) // (2 * ROWS))))
        total += parts[-1]
    at = lambda values: F.element_at(F.lit(values), F.col("pivot").cast("int") + 1)
    return placed.select("vec_id", "point", (at(base) + F.pmod(F.xxhash64("vec_id", F.lit(4)), at(parts))).cast("int").alias("shard"))


def planted(points: DataFrame, width: int, tasks: int) -> DataFrame:
    """One row for each shard: its number, the measures of its root, and its tree."""

    def build(p: pd.DataFrame) -> pd.DataFrame:
        t = BallTree(p.vec_id.to_numpy(), matrix(list(p.point), width))
        return pd.DataFrame({"shard": [int(p.shard.iloc[0])], "centre": [t.centre[0]], "measures": [[t.size[0], t.radius[0], t.angle[0], t.shortest[0], t.longest[0]]], "tree": [t.dump()]})

    return points.repartition(tasks, "shard").groupBy("shard").applyInPandas(build, "shard int, centre array<double>, measures array<double>, tree binary")


def routed(queries: DataFrame, roots: list, width: int, first: int, last: int) -> DataFrame:
    """shard, query_id, probe, floor: each query at the shards that are first to last in the order of their bounds and reach its floor."""
    roots = sorted(roots, key=lambda r: r["shard"])
    number = np.array([r["shard"] for r in roots])
    held = queries.sparkSession.sparkContext.broadcast((np.array([r["centre"] for r in roots]), np.array([r["measures"] for r in roots])))
    fields = ["shard", "query_id", "probe", "floor"]

    def run(batches):
        for batch in batches:
            centre, measures = held.value
            q = matrix(batch.column(1).to_pylist(), width).astype(np.float64)
            length = np.sqrt((q * q).sum(axis=1))[:, None]
            bound = upper_bounds(q @ centre.T, length, *measures.T)
            order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
            floor = np.array([-np.inf if f is None else float(f) for f in batch.column(2).to_pylist()])
            who, place = np.nonzero(np.take_along_axis(bound, order, axis=1) >= (floor - 1e-9 * np.abs(floor, where=np.isfinite(floor), out=np.zeros_like(floor)))[:, None])
            rows = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(number[order[who, place]].astype(np.int32)), *rows.columns], fields)

    return queries.select("query_id", "probe", "floor").mapInArrow(run, "shard int, query_id long, probe array<long>, floor long")


def answered(trees: DataFrame, asked: DataFrame, k: int, width: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score: each shard's best for the queries sent to it."""

    def run(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(t) and len(q):
            tree = BallTree.load(t.tree.iloc[0])
            q = q.sort_values("query_id")
            for a in range(0, len(q), BLOCK):
                part = q.iloc[a : a + BLOCK]
                floors = [None if pd.isna(f) else int(f) for f in part.floor]
                for one, own in zip(part.query_id, tree.search(part.query_id.to_numpy(), matrix(list(part.probe), width), k, floors)):
                    found += [(one, i, s) for s, i in own]
        if any(not -(1 << 63) <= x[2] < 1 << 63 for x in found):
            raise OverflowError("an inner product is beyond 64 bits")
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    left = trees.select("shard", "tree").repartition(tasks, "shard").groupBy("shard")
    return left.cogroup(asked.repartition(tasks, "shard").groupBy("shard")).applyInPandas(run, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(points: DataFrame, queries: DataFrame, k: int = 5, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries (vec_id, v) against all rows of points (vec_id, v)."""
    spark = points.sparkSession
    points = written(folded(points, k), "points")
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("point")).alias("width")).first()
    q = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("probe"))
    q = written(q.withColumn("floor", F.lit(None).cast("long")), "queries")
    width = max(size["width"] or 1, q.agg(F.max(F.size("probe"))).first()[0] or 1)
    shards = shards or min(max(-(-size["n"] // ROWS), min(partitions(spark), -(-size["n"] // 1024)), 1), SHARDS)
    tasks = 4 * shards if shards <= 256 else shards  # so that few shards share a task
    trees = written(planted(sharded(points, shards, width), width, tasks), "trees")
    roots = trees.select("shard", "centre", "measures").collect()  # bounded by SHARDS and what splitting adds
    found, asking, at = None, q, 0
    for upto in sorted({1, 1 + math.isqrt(len(roots)), max(len(roots), 1)}):
        if roots:
            more = written(answered(trees, routed(asking, roots, width, at, upto), k, width, tasks), "answers")
        else:
            more = spark.createDataFrame([], "query_id long, vec_id long, score long")
        found = more if found is None else found.unionByName(more)
        at = upto
        if upto < len(roots):
            kth = written(best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "floors")
            asking = q.drop("floor").join(kth, "query_id", "left")
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir):
    v = written(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(v, v.where("vec_id % 50 = 0"))


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, p.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(p.v)) + 1), lambda i: q.v[i] * p.v[i]))::bigint as score
      from v q join v p on q.vec_id <> p.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, coalesce(score, 0) as score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
