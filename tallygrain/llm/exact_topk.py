"""Exact top-k inner-product search by branch and bound over a vertical (dimension-major) layout.

Vectors are written once to the shared folder in shards of whole numbers, dimension by dimension, with the norms that remain
after each block of dimensions; queries in blocks of bounded size beside them. Every block meets every shard, and nothing else
moves. Partial products accumulate one block of dimensions after another, and after each the survivors are compacted to those
whose bound - partial product plus the product of the remaining norms - still reaches the query's k-th best of the shard.

Defined cases: rows with a null id, a null vector or a null or non-finite component take no part; vectors of unequal
length are never compared; rows that repeat a vec_id count once, with their best score; an empty table gives no rows;
other columns are ignored, whatever their names. Vectors whose own square could leave what doubles hold exactly stand in
shards of their own. Where such a vector or query takes part, all its products are worked out in doubles with a bound of their
rounding, and those that may be among the k best - each distinct vector once - in whole integers of any size; a large value
costs nothing elsewhere. Scores beyond the range of a long saturate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch
from tallygrain.llm.vectors import best, block_of, each_pair, nearest_first, pack_rows, query_blocks, usable

SCHEMA = "query_id long, vec_id long, score long"
SHARD = "dim int, ids binary, kind string, columns binary, rests binary"
#: Sums of integers in float64 are exact below this.
EXACT = float(1 << 53)
#: Scores are kept within the range of a long: below this, and not below its negative.
LIMIT = 1 << 63


def whole(x: float, scale: float) -> int:
    """floor(scale * x) as an integer of any size; a double of 2 ** 53 and more is a whole number itself."""
    return math.floor(x * scale) if abs(x) < EXACT else int(x) * int(scale)


def quantised(m: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(m * scale)


class Query:
    """One query's vector, its remaining norms, and the best k of a shard."""

    def __init__(self, qid: int, q: np.ndarray, cuts: list[int], k: int):
        self.id, self.q, self.k = qid, q, k
        self.rest = [float(np.sqrt(np.dot(q[c:], q[c:]))) for c in cuts[1:]]
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.float64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        at = best(ids, scores, self.k)
        self.ids, self.scores = ids[at], scores[at]


def search_block(query: Query, ids: np.ndarray, columns: np.ndarray, rests: np.ndarray, cuts: list[int]) -> None:
    """Branch and bound of one query over one vertical block: columns is dims x vectors, rests the norms left after each cut."""
    alive = np.flatnonzero(ids != query.id)
    part = np.zeros(len(alive))
    whole = len(alive) == len(ids)
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        block = columns[a:b] if whole else columns[a:b, alive]
        part = part + query.q[a:b] @ block
        if j + 2 == len(cuts):
            break
        slack = query.rest[j] * rests[j, alive]
        slack += 1e-9 * (np.abs(part) + slack)  # rounding of the norms
        floor = -np.inf
        if len(part) > query.k:  # what k vectors are sure to reach bounds from below
            low = part - slack
            ids_low = np.argpartition(low, len(low) - query.k)[len(low) - query.k :]
            if len(np.unique(ids[alive[ids_low]])) == query.k:
                floor = max(floor, low[ids_low].min())
        keep = part + slack >= floor
        if not keep.all():
            alive, part, whole = alive[keep], part[keep], False
        if not len(alive):
            return
    query.add(ids[alive], part)


def cuts_of(d: int, dims: int) -> list[int]:
    return [*range(0, d, dims), d] if d else [0, 0]


class Scaled:
    """Vectors as columns of at most one times a power of two each, and the norms of what is left: nothing overflows."""

    def __init__(self, columns: np.ndarray):
        self.power = np.frexp(np.abs(columns).max(axis=0, initial=0))[1]
        self.part = np.ldexp(columns, -self.power)
        self.norm = np.sqrt((self.part * self.part).sum(axis=0))


def near_whole(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) / scale but for rounding, for any finite x."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(m) < EXACT, np.floor(m * scale) / scale, m)


def search_large(qid: int, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, scaled: Scaled, scale: float, raw: bool, k: int):
    """(ids, scores) of one query's k best where sums may be too large for doubles: bounds first, then whole integers.

    columns: whole numbers, or, if raw, components as they came.
    """
    at, own = np.flatnonzero(ids != qid), Scaled(near_whole(q, scale)[:, None])
    if not len(at):
        return ids[at], np.empty(0, np.int64)
    sums = own.part[:, 0] @ scaled.part[:, at]
    slack = (len(q) + 16) * 2.0**-52 * own.norm[0] * scaled.norm[at] + 1e-300
    unit = scale * scale if raw else scale
    with np.errstate(over="ignore"):
        low, high = (np.clip(np.ldexp(x, own.power[0] + scaled.power[at]) * unit, -float(LIMIT), float(LIMIT)) for x in (sums - slack, sums + slack))
    distinct, which = np.unique(ids[at], return_inverse=True)
    if len(distinct) > k:  # what k ids are sure to reach bounds from below
        reach = np.full(len(distinct), -np.inf)
        np.maximum.at(reach, which, low)
        keep = high >= np.partition(reach, len(distinct) - k)[len(distinct) - k]
        at, low, high = at[keep], low[keep], high[keep]
    scores = np.where(low >= LIMIT, LIMIT - 1, -LIMIT).astype(np.int64)
    unsure = np.flatnonzero((low < LIMIT) & (high > -LIMIT))
    different, which = np.unique(columns[:, at[unsure]], axis=1, return_inverse=True)
    numbers = [whole(x, scale) for x in q.tolist()]
    exact = [sum(x * (whole(y, scale) if raw else int(y)) for x, y in zip(numbers, column)) for column in different.T.tolist()]
    scores[unsure] = np.array([min(max(x, -LIMIT), LIMIT - 1) for x in exact], np.int64)[which.reshape(-1)]
    order = np.lexsort((ids[at], ~scores))
    _, first = np.unique(ids[at][order], return_index=True)
    taken = order[np.sort(first)[:k]]
    return ids[at][taken], scores[taken]


def build(batches: Iterator[pa.RecordBatch], scale: float, block: int, dims: int):
    """Shards: columns of whole numbers in the smallest type that holds them, and large vectors apart, as they are."""

    def shard(d: int, ids: np.ndarray, kind: str, columns: np.ndarray, rests: np.ndarray) -> pa.RecordBatch:
        held = np.ascontiguousarray(columns).astype("float64" if kind == "raw" else kind)
        return pa.record_batch([pa.array([d], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([kind]), pa.array([held.tobytes()], pa.binary()), pa.array([rests.tobytes()], pa.binary())], ["dim", "ids", "kind", "columns", "rests"])

    def make(d: int, ids: np.ndarray, m: np.ndarray) -> list[pa.RecordBatch]:
        large = too_large(quantised(m, scale))
        out = [shard(d, ids[large], "raw", m[large].T, np.empty(0))] if large.any() else []
        columns, ids = np.ascontiguousarray(quantised(m[~large], scale).T), ids[~large]
        if len(ids):
            tails = np.cumsum((columns * columns)[::-1], axis=0)[::-1]
            rests = np.sqrt(np.array([tails[c] if c < d else np.zeros(len(ids)) for c in cuts_of(d, dims)[1:]]))
            out.append(shard(d, ids, "int16" if np.abs(columns).max(initial=0) < 1 << 15 else "float64", columns, rests))
        return out

    for made in pack_rows(batches, block, make):
        yield from made


def too_large(numbers: np.ndarray) -> np.ndarray:
    """Which rows could, with one no larger, have a sum that doubles do not hold exactly."""
    with np.errstate(over="ignore"):
        return np.abs(numbers).max(axis=1, initial=0) ** 2 * max(numbers.shape[1], 1) >= EXACT


def search(batches: Iterator[pa.RecordBatch], k: int, scale: float, dims: int):
    """Each query's k best of a shard, by branch and bound where float64 sums are exact, else with whole integers."""
    for row in each_pair(batches):
        d = row["dim"]
        if d != row["q_dim"]:
            continue
        ids = np.frombuffer(row["ids"], np.int64)
        qids, vectors = block_of(row)
        cuts = cuts_of(d, dims)
        raw = row["kind"] == "raw"
        columns = np.frombuffer(row["columns"], np.float64 if raw else row["kind"]).reshape(d, len(ids)).astype(np.float64)
        rests = None if raw else np.frombuffer(row["rests"], np.float64).reshape(len(cuts) - 1, len(ids))
        numbers = quantised(vectors, scale)
        scaled, out = None, []
        for qid, q, v, large in zip(qids.tolist(), numbers, vectors, too_large(numbers)):
            if raw or large:
                scaled = scaled or Scaled(near_whole(columns, scale) if raw else columns)
                out.append((qid, *search_large(qid, v, ids, columns, scaled, scale, raw, k)))
            else:
                query = Query(qid, q, cuts, k)
                search_block(query, ids, columns, rests, cuts)
                out.append((qid, query.ids, query.scores.astype(np.int64)))
        if out:
            yield pa.record_batch(
                [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in out])), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))],
                ["query_id", "vec_id", "score"],
            )


def exact_topk(
    vectors: DataFrame,
    query_of,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 256.0,
    block: int = 8192,
    dims: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row whose ``query_of(id)`` holds, the k other rows of the highest
    inner product of floor(scale * x) components. scale: a whole number."""
    rows = usable(vectors, id_col, vec_col)
    scratch = Scratch(vectors.sparkSession, "exact-topk")
    shards = scratch.save(rows.mapInArrow(lambda it: build(it, scale, block, dims), SHARD), "shards")
    blocks = query_blocks(rows.where(query_of(F.col("id"))), scratch)
    pairs = shards.crossJoin(blocks)  # a stated query set, in blocks; lengths are told apart in the task, as most are one
    return nearest_first(pairs.mapInArrow(lambda it: search(it, k, scale, dims), SCHEMA), k)
