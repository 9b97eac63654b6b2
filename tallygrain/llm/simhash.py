"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles. Equal fingerprints are folded first. Two
fingerprints link when they differ in at most ``radius`` bits. Each bit position i has a vector m(i) of radius + 1 bits;
for each non-zero v the mask of v holds the positions where the scalar product of m(i) and v is odd. At most ``radius``
differing positions span less than the whole space, so some v is orthogonal to all of them, and in that table the two
agree on every masked bit: no pair within the radius is ever missed, and no table needs random luck.

A bucket's fingerprints arrive sorted and are searched in memory, giving edges of a spanning forest only: a fingerprint is
compared with those not reached yet, so a dense group costs about a comparison a member. A bucket that outgrows
``bucket_limit`` is dealt anew: its fingerprints agree on the masked bits, so the covering masks of the bits left free
split it further, and no pair is lost, whatever the radius. Masks take half of the free bits each time, and where 16 are
free a bucket has at most 2 ** 16 distinct fingerprints, so it ends there.

Components: alternating large-star and small-star steps over edges in the shared folder, until nothing changes.

Defined cases: a text without words, or a null, has fingerprint zero and is linked like any other; a row with a null
doc_id gets its fingerprint, links like any other, and has the component of the documents with an id that it reaches, else
a null component; rows that share a doc_id are told apart by their fingerprints; repeated rows give repeated result rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import SEED, Scratch, text_bytes

#: Shingles whose bits are counted at a time.
BATCH = 1 << 15
#: Rows told at a time; and with so many free bits a bucket is small enough, whatever its limit.
TOLD, FREE = 1 << 16, 16


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """Majority bits of the shingles' hashes; fewer words: the whole sequence is the one shingle; none: zero."""
    words = text_bytes(text).lower().split()  # bytes: A-Z only are lowered, and exactly \x09-\x0D and \x20 separate
    if not words:
        return 0
    n, k = len(words), words_in_shingle
    buf = b" ".join(words)
    if n <= k:
        return xxhash.xxh64_intdigest(buf, SEED)
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - k + 1
    for a in range(0, total, BATCH):
        b = min(a + BATCH, total)
        h = np.array([digest(buf[s : e - 1], SEED) for s, e in zip(ends[a:b], ends[a + k : b + k])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words_in_shingle: int) -> DataFrame:
    """id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


@functools.cache
def step_of(space: int, bits: int) -> int:
    """Which vector comes after which, so that every mask has as many of the bits as can be."""

    def least(step: int) -> int:
        vectors = [1 + step * i % (space - 1) for i in range(bits)]
        return min(sum((m & v).bit_count() & 1 for m in vectors) for v in range(1, space))

    return max((s for s in range(1, min(space, 64)) if math.gcd(s, space - 1) == 1), key=lambda s: (least(s), -s))


def masks(radius: int, free: list[int] | None = None) -> list[int]:
    """The covering masks of the free bits (all 64 where not given): 2 ** (radius + 1) - 1 of them, about half of the bits each."""
    space = 1 << (radius + 1)
    bits = range(64) if free is None else free
    step = step_of(space, len(bits))
    vectors = {b: 1 + step * i % (space - 1) for i, b in enumerate(bits)}  # every non-zero vector as often as any other
    out = [sum(1 << b for b, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, space)]
    return [signed(m) for m in out]


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def finer(mask: int, radius: int) -> list[int]:
    """The mask, enlarged by each covering mask of the bits that it leaves free."""
    own = mask & ((1 << 64) - 1)
    return [signed(own | (m & ((1 << 64) - 1))) for m in masks(radius, [b for b in range(64) if not own >> b & 1])]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one bucket's links: breadth-first, each fingerprint against those not reached yet."""
    rest = fps.view(np.uint64)  # signed numbers would count the bits of their magnitude
    a, b = [], []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            own = todo.pop()
            near = np.bitwise_count(rest ^ own) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), own))
                b.append(found)
                todo.extend(found)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def merging(a: np.ndarray, b: np.ndarray, label: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of edges, those that bring labels together which the edges before have not."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(label[x]), find(label[y])
        if x != y:
            keep[i], top[x] = True, y
    return a[keep], b[keep]


def bucket_edges(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Distinct rows (mask, fp) sorted by mask and masked bits: edges (a, b, null) of each bucket; of one with more than
    ``limit`` rows, its rows as (fp, null, mask). Where rows have a label, edges inside a label are left out."""
    bucket, held, size, most = None, [], 0, limit  # the bucket so far: its mask and bits, its rows up to the limit, how many
    told: list[tuple[np.ndarray, np.ndarray | None, int, np.ndarray]] = []

    def out():
        a, b, mask, label = ([x[i] for x in told] for i in range(4))
        grown = np.concatenate([np.full(len(x), y is None) for x, y in zip(a, b)])
        a, b = np.concatenate(a), np.concatenate([x if y is None else y for x, y in zip(a, b)])
        mask, label = np.concatenate([np.full(len(x), m, np.int64) for x, m in zip(label, mask)]), np.concatenate(label)
        told.clear()
        return pa.record_batch([pa.array(a), pa.array(b, mask=grown), pa.array(mask, mask=~grown), pa.array(label)], ["a", "b", "mask", "label"])

    def close():
        if size > 1 and held:
            fps = np.concatenate([f for f, _ in held])
            a, b = forest(fps, radius)
            if labelled and len(a):
                a, b = merging(a, b, dict(zip(fps.tolist(), np.concatenate([x for _, x in held]).tolist())))
            told.append((a, b, 0, a))

    for batch in batches:
        labelled = "label" in batch.schema.names
        m, fp = (batch.column(x).to_numpy() for x in ("mask", "fp"))
        label = batch.column("label").to_numpy() if labelled else fp
        k = fp & m
        starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])))) if len(m) else []
        for s, e in zip(starts, [*starts[1:], len(m)]):
            if (m[s], k[s]) != bucket:
                close()
                bucket, held, size = (m[s], k[s]), [], 0
                few = np.bitwise_count(m[s : s + 1].view(np.uint64))[0] >= 64 - FREE
                most = 1 << FREE if few else limit
            held.append((fp[s:e], label[s:e]))
            size += e - s
            if size > most:
                told += [(f, None, int(m[s]), x) for f, x in held]
                held = []
        if sum(len(x[0]) for x in told) > TOLD:
            yield out()
    close()
    if told:
        yield out()


def split(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of outgrown buckets (mask, fp, label), dealt anew."""
    for batch in batches:
        m, fp, label = (batch.column(x).to_numpy() for x in ("mask", "fp", "label"))
        for own in np.unique(m):
            new, here = np.array(finer(int(own), radius), np.int64), m == own
            yield pa.record_batch([pa.array(np.tile(new, here.sum())), pa.array(np.repeat(fp[here], len(new))), pa.array(np.repeat(label[here], len(new)))], ["mask", "fp", "label"])


def edges_of(posted: DataFrame, parts: int, radius: int, limit: int, scratch: Scratch) -> DataFrame:
    """a, b: edges over all buckets of rows (mask, fp), with a label or without; outgrown buckets are dealt anew by finer masks
    until none is left."""
    edges, plain = None, posted.columns
    for depth in itertools.count():
        key = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = posted.repartition(parts, "mask", key).sortWithinPartitions("mask", key)
        found = scratch.save(dealt.mapInArrow(lambda it: bucket_edges(it, radius, limit), "a long, b long, mask long, label long"), f"found{depth}")
        own = found.where("mask is null").select("a", "b")
        edges = own if edges is None else edges.unionAll(own)
        large = found.where("mask is not null").select("mask", F.col("a").alias("fp"), "label")
        if not large.limit(1).count():
            return edges
        posted = large.mapInArrow(lambda it: split(it, radius), "mask long, fp long, label long").select(plain).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: of every node of an edge, the smallest node it is linked to, by large-star and small-star steps."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.save(edges, "step0")
    for step in itertools.count(1):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = scratch.save(small, f"step{step}")
        same = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if step > 1 and tuple(same) == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(same)
        scratch.drop(f"step{step - 1}")
        edges = new


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_in_shingle: int = 4,
    radius: int = 4,
    bucket_limit: int = 1 << 16,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most ``radius`` bits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(with_fingerprints(docs, id_col, text_col, words_in_shingle), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    n = nodes.count()
    cover = masks(radius)
    posted = nodes.select(F.explode(F.array(*map(F.lit, cover))).alias("mask"), "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(cover) // 2_000_000)
    roots = components(edges_of(posted, parts, radius, bucket_limit, scratch), scratch)
    whole = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = whole.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
