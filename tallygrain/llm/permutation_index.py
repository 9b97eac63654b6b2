"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample. A vector is represented by its nearest pivots in order; every vector is posted
under each of them, with the place the pivot has in its order, in the inverted file of its shard. A query gathers the
postings of its own nearest pivots, ranks what it met by the footrule distance of the two prefix permutations (a pivot
that one side lacks counts as if it stood at the end of the prefix), and the nearest few by footrule, with all that tie
with the last of them, are reranked by the exact inner product on the original vectors.

Shards of postings and blocks of queries are tables in the shared folder; every block meets every shard, and each pair tells the
block's queries their best of the shard. A query reads 48 of a shard's 512 posting lists, 4.5 postings a vector, and reranks a
fourteenth of the shard.

Defined cases: rows with a null id, or a vector that is null, zero, or holds null or non-finite components take no part;
vectors of unequal length are never compared; rows that repeat a vec_id count once; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch
from tallygrain.llm.vectors import best, block_of, each_pair, matrices, nearest_first, pack_rows, query_blocks, usable

SHARD = "dim int, ids binary, vecs binary, starts binary, posted binary, places binary"
SCHEMA = "query_id long, vec_id long, score double"


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300), axis=1, keepdims=True)
    return m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300) / np.maximum(n, 1e-300)


def fit_pivots(rows: DataFrame, pivots: int, sample: int, seed: int) -> dict[int, np.ndarray]:
    """Pivots by vector length, from at most ``sample`` rows with the smallest hash: spread by farthest-first choice.

    The sample's bound is the parameter; every row is indexed all the same.
    """
    table = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    out = {}
    for b in table.combine_chunks().to_batches():
        for _, m in matrices(b):
            u = np.unique(unit(m), axis=0)
            chosen, near = [0], u @ u[0]
            while len(chosen) < min(pivots, len(u)):
                chosen.append(int(np.argmin(near)))
                near = np.maximum(near, u @ u[chosen[-1]])
                near[chosen] = np.inf
            out[m.shape[1]] = u[chosen]
    return out


def order(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each row, nearest first, ties to the smaller pivot number."""
    near = -(unit(m) @ pivots.T)
    prefix = min(prefix, near.shape[1])
    if prefix < near.shape[1]:
        # all that tie with the last one are ranked, the others not
        cut = np.partition(near, prefix - 1, axis=1)[:, prefix - 1 : prefix]
        near = np.where(near <= cut, near, np.inf)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


def build(batches: Iterator[pa.RecordBatch], pivots: dict, prefix: int, shard: int):
    def make(d: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        p = pivots.get(d)
        if p is None:  # no pivot of this length was sampled: one pivot-less list holds all
            flat, places, starts = np.arange(len(ids), dtype=np.int32), np.zeros(len(ids), np.uint8), np.array([0, len(ids)], np.int32)
        else:
            perm = order(rows, p, prefix)
            by = np.argsort(perm.reshape(-1), kind="stable")
            flat = (by // perm.shape[1]).astype(np.int32)
            places = (by % perm.shape[1]).astype(np.uint8)
            starts = np.searchsorted(perm.reshape(-1)[by], np.arange(len(p) + 1)).astype(np.int32)
        blobs = [ids.astype(np.int64), rows.astype(np.float64), starts, flat, places]
        return pa.record_batch([pa.array([d], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["dim", "ids", "vecs", "starts", "posted", "places"])

    return pack_rows(batches, shard, make)


def search(batches: Iterator[pa.RecordBatch], pivots: dict, prefix: int, k: int, share: float, least: int):
    for row in each_pair(batches):
        d = row["dim"]
        if d != row["q_dim"]:
            continue
        qids, queries = block_of(row)
        ids = np.frombuffer(row["ids"], np.int64)
        vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), d)
        starts, posted = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["posted"], np.int32)
        left = prefix - np.frombuffer(row["places"], np.uint8).astype(np.int32)
        count = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
        prefixes = order(queries, pivots[d], prefix) if d in pivots else None
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, (qid, q) in enumerate(zip(qids, queries)):
            if prefixes is None:
                at = np.arange(len(ids))
            else:
                # half of how far the footrule falls below that of sharing no pivot:
                # (2 * prefix - a - b - |a - b|) / 2 for a pivot at places a and b
                lists = [slice(starts[p], starts[p + 1]) for p in prefixes[n]]
                met = np.concatenate([posted[s] for s in lists])
                worth = np.concatenate([np.minimum(left[s], prefix - place) for place, s in enumerate(lists)])
                gain = np.bincount(met, worth, len(ids))
                # all that tie at the cut stay: copies have one gain, and which of them are wanted only their ids tell
                at = np.flatnonzero(gain >= np.partition(gain, len(ids) - count)[len(ids) - count])
            at = at[ids[at] != qid]
            score = (vecs[at] * q).sum(axis=1)
            top = best(ids[at], score, k)
            got.append((np.full(len(top), qid), ids[at][top], score[top]))
        if got:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*got)], ["query_id", "vec_id", "score"])


def ann_topk(
    vectors: DataFrame,
    query_of,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = 512,
    prefix: int = 48,
    sample: int = 4096,
    shard: int = 8192,
    share: float = 0.07,
    least: int = 512,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score (double): for each row whose ``query_of(id)`` holds, its k nearest found by inner product.

    pivots and prefix shape the index; share and least set how many of a shard's vectors are reranked for a query, ties at the cut besides.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    fitted = fit_pivots(rows, pivots, sample, seed)
    scratch = Scratch(spark, "permutation-index")
    index = scratch.save(rows.mapInArrow(lambda it: build(it, fitted, prefix, shard), SHARD), "shards")
    blocks = query_blocks(rows.where(query_of(F.col("id"))), scratch)
    pairs = index.crossJoin(blocks)  # a stated query set, in blocks; lengths are told apart in the task, as most are one
    return nearest_first(pairs.mapInArrow(lambda it: search(it, fitted, prefix, k, share, least), SCHEMA), k)
