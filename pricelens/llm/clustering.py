"""Centroid clustering of integer vectors with block-norm screening (operator 13).

Each component x becomes floor(scale * x). A vector is compressed to the norms of its blocks of 8 components. By
Cauchy and Schwarz a block's part of the squared distance to a centroid is at least the square of the difference
of the two norms, so the norms alone give a lower bound for every centroid. Of a vector, the centroid with the
least bound is measured first; a further one is measured only if its bound does not exceed the best distance so
far. Distances and means are exact integers; bounds are lowered by what rounding can add to them.

Vectors and norms are written once; each round reads them, sends only the centroids (their number is a parameter)
and returns sums by task, centroid and component, which Spark adds up.

Vectors of another size, null ones and those with a null or non-finite component take no part; ties go to the
smaller number. Repeated rows are vectors of their own; equal ids share a hash and then order by their components'
bytes. A null id is kept and hashes as an empty text. With fewer vectors than centroids there are as many centroids
as vectors; an empty table gives an empty table. Columns besides id and vector do not matter. Components of 2^26 and
more are carried as text and measured with Python's integers; a distance or sum beyond 64 bits is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 8
#: Components below this size take 64-bit arithmetic: 64 squared differences of them stay below 2^61.
NARROW = 1 << 26
#: Sums of large integers travel in digits of so many bits.
DIGIT = 24


def whole(x: float, scale: int) -> int:
    """floor(scale * x) without overflow."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def compressed(vectors: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id, whole (little-endian 32-bit components), wide (components as text where some are too large), norms of blocks."""
    v = F.col(f"`{vector}`")
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & (F.size(v) == dims) & usable)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(x * scale)
            narrow = (np.abs(scaled) < NARROW).all(1)
            small = np.where(narrow[:, None], scaled, 0).astype("<i4")
            norms = np.sqrt(np.add.reduceat(small.astype(np.int64) ** 2, range(0, dims, BLOCK), 1).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                    pa.array([None if n else ",".join(str(whole(c, scale)) for c in row) for n, row in zip(narrow, x.tolist())], pa.string()),
                    pa.array([r.tobytes() for r in norms.astype("<f8")], pa.binary()),
                ],
                ["vec_id", "whole", "wide", "norms"],
            )

    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("_v")).mapInArrow(run, "vec_id long, whole binary, wide string, norms binary")


def components(whole_bytes: bytes, wide: str | None) -> list[int]:
    return list(map(int, wide.split(","))) if wide else np.frombuffer(whole_bytes, "<i4").tolist()


def least_distances(v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of each vector (its block norms) to each centroid (v: their block norms)."""
    bound = np.zeros((len(norms), len(v)))
    for k in range(norms.shape[1]):
        a, b = norms[:, k, None], v[None, :, k]
        bound += np.maximum(np.abs(a - b) - (a + b) * 2.0**-50, 0) ** 2
    return bound * (1 - 2.0**-40)


def nearest(x: np.ndarray, norms: np.ndarray, centres: np.ndarray, measured: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row of x, ties to the smaller number, and its exact squared distance.

    measured, if given, gets the number of exact distances.
    """
    own = np.sqrt(np.add.reduceat(centres**2, range(0, centres.shape[1], BLOCK), 1).astype(np.float64))
    bound = least_distances(own, norms)
    first = bound.argmin(1)
    best, place, n = ((x - centres[first]) ** 2).sum(1), first.copy(), len(x)
    for c in range(len(centres)):
        open_ = np.flatnonzero((bound[:, c] <= best) & (first != c))
        n += len(open_)
        d = ((x[open_] - centres[c]) ** 2).sum(1)
        better = (d < best[open_]) | ((d == best[open_]) & (c < place[open_]))
        best[open_[better]], place[open_[better]] = d[better], c
    if measured is not None:
        measured.append(n)
    return place, best


def assigned(b: pa.RecordBatch, centres: list[list[int]]) -> tuple[list[int], list[int], np.ndarray | list[list[int]]]:
    """Of a batch of compressed vectors: centre, squared distance, components."""
    wide = b.column("wide")
    if wide.null_count == len(wide) and all(abs(x) < NARROW for c in centres for x in c):
        x = np.frombuffer(b"".join(b.column("whole").to_pylist()), "<i4").reshape(len(wide), -1).astype(np.int64)
        norms = np.frombuffer(b"".join(b.column("norms").to_pylist()), "<f8").reshape(len(wide), -1)
        place, best = nearest(x, norms, np.array(centres, np.int64))
        return place.tolist(), best.tolist(), x
    rows = [components(*r) for r in zip(b.column("whole").to_pylist(), wide.to_pylist())]
    best = [min((sum((p - q) ** 2 for p, q in zip(row, c)), k) for k, c in enumerate(centres)) for row in rows]
    return [k for _, k in best], [d for d, _ in best], rows


def sums(vectors: DataFrame, centres: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """For every centre with vectors: how many there are, and their components' sums."""
    dims = len(centres[0])

    def run(batches):
        total, count = {}, {}
        for b in batches:
            if b.num_rows:
                place, _, rows = assigned(b, centres)
                where = np.array(place)
                for c in set(place):
                    at = np.flatnonzero(where == c)
                    part = rows[at].sum(0).tolist() if isinstance(rows, np.ndarray) else [sum(rows[i][d] for i in at) for d in range(dims)]
                    total[c] = [p + q for p, q in zip(total.get(c, [0] * dims), part)]
                    count[c] = count.get(c, 0) + len(at)
        out = [(c, -1, 0, n) for c, n in count.items()]
        for c, row in total.items():
            for d, x in enumerate(row):
                digit = 0
                while abs(x) >> 62:
                    out.append((c, d, digit, x & ((1 << DIGIT) - 1)))
                    x, digit = x >> DIGIT, digit + 1
                out.append((c, d, digit, x))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["c", "d", "digit", "x"])

    parts = vectors.mapInArrow(run, "c int, d int, digit int, x long").groupBy("c", "d", "digit").agg(F.sum(F.col("x").cast("decimal(30,0)")).alias("x"))
    found: dict[int, list[int]] = {}
    for r in parts.collect():  # centres * (components + 1) * digits rows, whatever the table holds
        row = found.setdefault(r.c, [0] * (dims + 1))
        row[r.d + 1] += int(r.x) << (DIGIT * r.digit)
    return {c: (row[0], row[1:]) for c, row in found.items()}


def clustered(vectors: DataFrame, centroids: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: str = "1:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (components joined by commas) of every usable vector."""
    spark = vectors.sparkSession
    rows = written(compressed(vectors, dims, scale, vec_id, vector), "vectors")
    start = rows.orderBy(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "whole", "wide").limit(centroids)
    centres = [components(r.whole, r.wide) for r in start.select("whole", "wide").collect()]
    if centres:
        for _ in range(rounds):
            for c, (n, total) in sums(rows, centres).items():
                centres[c] = [x // n for x in total]

    def run(batches):
        for b in batches:
            place, best, _ = assigned(b, centres) if b.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(place, pa.int32()), pa.array([d if d < 1 << 63 else None for d in best], pa.int64())], ["vec_id", "cluster", "distance"])

    out = written(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"), F.sum(F.when(F.col("distance").isNull(), 1).otherwise(0)).alias("beyond")).collect()  # a row for each centre
    each = {r.cluster: None if r.beyond else int(r.s) for r in inertia}
    total = None if None in each.values() else sum(each.values())
    made = [(c, None if each.get(c) is None or each[c] >= 1 << 63 else each[c], None if total is None or total >= 1 << 63 else total, ",".join(map(str, row))) for c, row in enumerate(centres)]
    known = spark.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroid_clustering(spark, sf_dir):
    out = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _sql(centroids: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    distance = f"list_sum(list_transform(generate_series(1, {dims}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {centroids})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT k.vec_id, k.v, c.c, CAST({distance} AS BIGINT) AS d, row_number() OVER (PARTITION BY k.vec_id ORDER BY {distance}, c.c) AS place"
            f" FROM kept k CROSS JOIN c{r} c) WHERE place = 1)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, {dims}) t(i) GROUP BY c, i)) GROUP BY c),"
                f" c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"
    )


OP13_SQL = _sql()
