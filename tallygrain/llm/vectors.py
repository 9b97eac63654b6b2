"""What the two vector searches share: which rows take part, query sets in bounded blocks, and the final merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, partitions_for

#: The vectors of a block of queries take about this many bytes.
QUERY_BYTES = 8 << 20
BLOCK = "q_dim int, q_ids binary, q_vecs binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id and vec (doubles) of rows with an id whose vector is not null and whose components are all finite."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vec")
    )


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows as a float64 matrix) for each vector length in a batch of id and vec."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    vec = batch.column("vec")
    ends = vec.offsets.to_numpy()
    flat = vec.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield ids[at], flat[(ends[at][:, None] + np.arange(d)).reshape(-1)].reshape(len(at), d)


def pack_rows(batches: Iterator[pa.RecordBatch], most: int, make) -> Iterator[pa.RecordBatch]:
    """``make(dim, ids, matrix)`` for each run of at most ``most`` rows of one vector length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for ids, m in matrices(batch):
            own = held.setdefault(m.shape[1], [])
            own.append((ids, m))
            if sum(len(i) for i, _ in own) >= most:
                ids, m = (np.concatenate(x) for x in zip(*own))
                for a in range(0, len(ids) - len(ids) % most, most):
                    yield make(m.shape[1], ids[a : a + most], m[a : a + most])
                held[m.shape[1]] = [(ids[len(ids) - len(ids) % most :], m[len(ids) - len(ids) % most :])]
    for d, own in held.items():
        ids, m = (np.concatenate(x) for x in zip(*own))
        if len(ids):
            yield make(d, ids, m)


def query_blocks(queries: DataFrame, scratch: Scratch) -> DataFrame:
    """The query set as a table of blocks in the shared folder, each of one vector length; nothing of it comes to the driver.

    Rows that repeat an id count once: the smallest vector in array order stays.
    """
    once = scratch.save(queries.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    total = once.agg(F.coalesce(F.sum(F.size("vec") * 8 + 16), F.lit(0))).first()[0]

    def make(d: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([d], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([m.astype(np.float64).tobytes()], pa.binary())], ["q_dim", "q_ids", "q_vecs"])

    dealt = once.repartition(partitions_for(total, QUERY_BYTES), "id")
    return scratch.save(dealt.mapInArrow(lambda it: pack_rows(it, 1 << 20, make), BLOCK), "blocks")


def block_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's query ids and vectors."""
    ids = np.frombuffer(row["q_ids"], np.int64)
    return ids, np.frombuffer(row["q_vecs"], np.float64).reshape(len(ids), row["q_dim"])


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of a shard and a block, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def nearest_first(found: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of the partial results, ties to the smaller vec_id.

    The rank limit applies before the shuffle too, so each task sends at most k rows of a query.
    """
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(w).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, an id once."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(ids))
    order = at[np.lexsort((ids[at], -scores[at]))]
    _, first = np.unique(ids[order], return_index=True)
    if len(first) < len(order):  # repeated rows: distinct ids only, and enough of them
        if len(first) < k and len(at) < len(ids):
            order = np.lexsort((ids, -scores))
            _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)]
    return order[:k]
