"""Clustering of integer vectors around centroids, exact in every digit.

Squared distances come as |x|² - 2 x·c + |c|² from blocked float64 matrix products. All of these are whole numbers, so a product
is exact whatever its order as long as nothing passes 2**53. That is guarded for each pair of a vector and a centroid, by the
largest magnitudes of the two: 64 (|x| + |c|)² bounds every partial sum. A pair beyond the bound has a distance within a known
error; only pairs that could still be the nearest are worked out again in whole numbers, of 64 bits where those hold them and of
any size else. So one large vector, or one large centroid, costs others nothing.

A round's sums and counts are added up by treeAggregate over the RDD of blocks; the driver gets one sum of each centroid.

Defined cases: vectors that are null, not of ``dim`` components, or hold null or non-finite components (or ones that ``scale``
takes beyond a double) take no part and have no row; repeated rows are vectors each; a null id is hashed last, a null name
for its row; fewer vectors than centroids: each starts one; distances and sums beyond a long are told as the largest long
(assignments are exact all the same); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch

#: Doubles hold all whole numbers up to this; products are checked against it.
EXACT = float(1 << 53)
#: Vectors of a block: its distances to some dozens of centroids stay in the cache.
BLOCK_ROWS = 4096
LONG_MOST = (1 << 63) - 1


@dataclass
class Centroids:
    """Whole numbers of any size, and what the products need of them."""

    exact: np.ndarray  # k x dim, Python ints

    def __post_init__(self):
        self.near = self.exact.astype(np.float64)
        self.largest = np.abs(self.near).max(axis=1, initial=0.0)
        with np.errstate(over="ignore"):
            self.square = (self.near**2).sum(axis=1)


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles without fractions as Python ints."""
    return np.frompyfunc(int, 1, 1)(x)


def nearest(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and its squared distance, as int64 or, where needed, Python ints."""
    largest = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = x.shape[1] * (largest[:, None] + c.largest[None, :]) ** 2
        d = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.near.T) + c.square[None, :]
        fits = bound < EXACT
        if fits.all():
            at = d.argmin(axis=1)
            return at, d[np.arange(len(at)), at].astype(np.int64)
        error = np.where(fits, 0.0, np.where(np.isfinite(bound) & np.isfinite(d), bound * 2.0**-40, np.inf))
        d = np.where(np.isfinite(d), d, 0.0)
        maybe = d - error <= (d + error).min(axis=1)[:, None]
    open_rows = (maybe & ~fits).any(axis=1)
    at = np.where(open_rows, 0, np.where(maybe, d, np.inf).argmin(axis=1))
    out = np.zeros(len(x), object)
    sure = np.flatnonzero(~open_rows)
    out[sure] = d[sure, at[sure]].astype(np.int64)
    rows = np.flatnonzero(open_rows)
    best: list = [None] * len(rows)
    for j in range(len(c.near)):
        some = np.flatnonzero(maybe[rows, j])
        if not len(some):
            continue
        if bound[rows[some], j].max() < 2.0**62:
            own = ((x[rows[some]].astype(np.int64) - c.exact[j].astype(np.int64)) ** 2).sum(axis=1)
        else:
            own = ((whole(x[rows[some]]) - c.exact[j]) ** 2).sum(axis=1)
        for i, dist in zip(some, own):
            if best[i] is None or dist < best[i]:
                best[i], at[rows[i]] = int(dist), j
    out[rows] = best
    return at, out


def block_sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The sums of each centroid's rows, as Python ints."""
    member = np.zeros((k, len(x)))
    member[at, np.arange(len(x))] = 1.0
    if np.abs(x).sum(axis=0).max(initial=0.0) < EXACT:
        return whole(member @ x)
    out = np.zeros((k, x.shape[1]), object)
    for j in np.unique(at):
        out[j] = whole(x[at == j]).sum(axis=0)
    return out


def as_long(x) -> int:
    return min(int(x), LONG_MOST)


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of floor(scale * x), as doubles, and of the ids of their rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            vec, n = part.column("vec"), part.num_rows
            x = np.floor(vec.values.to_numpy(zero_copy_only=False)[vec.offsets[0].as_py() : vec.offsets[n].as_py()].reshape(n, dim) * scale)
            ids = part.column("id")
            yield pa.record_batch(
                [pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()), pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                ["ids", "lacks", "x"],
            )


def totals(rdd, c: Centroids, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each centroid's vectors: the sums of their components, their number and the sum of their distances."""
    k = len(c.near)

    def add(state, blob):
        x = np.frombuffer(blob, np.float64).reshape(-1, dim)
        at, dist = nearest(x, c)
        if dist.dtype != object and int(dist.max(initial=0)) * len(dist) < EXACT:
            inertia = whole(np.bincount(at, weights=dist, minlength=k))
        else:
            inertia = np.zeros(k, object)
            np.add.at(inertia, at, dist.astype(object))
        return state[0] + block_sums(x, at, k), state[1] + np.bincount(at, minlength=k), state[2] + inertia

    zero = np.zeros((k, dim), object), np.zeros(k, np.int64), np.zeros(k, object)
    return rdd.treeAggregate(zero, add, lambda a, b: tuple(p + q for p, q in zip(a, b)))


def digest(row: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    k and dim bound what a task holds besides a block, and all that comes to the driver.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = [r.vec for r in rows.orderBy(hashed.asc_nulls_last(), "vec").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], RESULT)
    c = Centroids(whole(np.floor(np.array(first) * scale)))
    blocks = Scratch(spark, "centroids").save(rows.mapInArrow(lambda it: blocks_of(it, dim, scale), "ids binary, lacks binary, x binary"), "blocks")
    rdd = blocks.select("x").rdd.map(lambda r: r[0])
    for _ in range(rounds):
        sums, counts, _ = totals(rdd, c, dim)
        exact = c.exact.copy()
        for j in np.flatnonzero(counts):
            exact[j] = sums[j] // int(counts[j])
        c = Centroids(exact)
    inertia = totals(rdd, c, dim)[2]
    own, whole_sum, names = np.array([as_long(x) for x in inertia]), as_long(sum(inertia)), np.array([digest(x) for x in c.exact])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, dist = nearest(np.frombuffer(r["x"], np.float64).reshape(-1, dim), c)
                ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["lacks"], bool))
                told = [ids, pa.array(at.astype(np.int32)), pa.array([as_long(x) for x in dist], pa.int64()), pa.array(own[at]), pa.array(np.full(len(at), whole_sum)), pa.array(names[at].tolist(), pa.string())]
                yield pa.record_batch(told, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, RESULT)


def oracle(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """SQL for the same on vectors with ids whose products all fit."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS BIGINT) AS k, e
            FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(ve) AS e, min(d * {k} + k) AS m FROM (
                SELECT v.rid, v.vec_id, v.e AS ve, c.k, CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e) AS BIGINT) AS d
                FROM v, c{i} c) GROUP BY rid)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM (
                    SELECT m % {k} AS k, i, CAST(sum(CAST(e[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT CAST(unnest(range(1, {dim + 1})) AS INTEGER) AS i) GROUP BY 1, 2) GROUP BY k)"""
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, CAST(c.k AS INTEGER) AS cluster, a.m // {k} AS distance, CAST(sum(a.m // {k}) OVER (PARTITION BY c.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m % {k}"""
