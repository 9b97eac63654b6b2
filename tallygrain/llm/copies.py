"""One document of each group of near copies: SimHash candidates by covering masks, links verified on the shingles.

Two documents link when in one of ``prints`` independent 64-bit SimHash fingerprints of their word shingles they differ in at
most ``radius`` bits and the Jaccard similarity of their sets of shingles is at least ``similarity``. Candidates come from
``simhash``: its covering masks let no pair within the radius slip, and each bucket tells a spanning forest of its pairs, never
all of them. Equal sets are folded to one node first.

Masks are tried in rounds, the first ``FIRST`` of them, then the others. A round's pairs are verified on the sets themselves, and
the next round's buckets know which nodes are in one group by then: they tell only pairs that bring groups together, so a
large group of near copies costs a few pairs a member, not one a mask.

What the radius costs: sets of similarity s have an angle of acos(2 s / (1 + s)), and a fingerprint differs in that share of pi
of its 64 bits on average. Within 6 bits lie about 0.13 of the pairs at 0.8, 0.50 at 0.9 and 0.82 at 0.95; two fingerprints
make that 0.24, 0.75 and 0.97. A bit more in the radius doubles the masks, so 0.8 cannot be covered whole by this method.

Defined cases: a text without words, or a null, has the empty set, equal to itself only; fewer words than a shingle: the
whole sequence is the one shingle; rows that share a doc_id are told apart by their contents, nulls included; rows without one count
like any other; columns of any names and types are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import SEED, Scratch, text_bytes
from tallygrain.llm.simhash import BATCH, components, edges_of, masks

#: Masks of the first round of a fingerprint.
FIRST = 4
#: Keys of up to so many nodes are broadcast (24 bytes each); more are joined by a shuffle.
SENT = 1 << 20


def shingles(text: str | None, words: int) -> np.ndarray:
    """The XXH64 hashes of a text's runs of words, repeats included; words as in ``simhash``."""
    own = text_bytes(text).lower().split()
    if not own:
        return np.empty(0, np.uint64)
    buf, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([digest(buf, SEED)], np.uint64)
    ends = list(itertools.accumulate((len(w) + 1 for w in own), initial=0))
    return np.fromiter((digest(buf[s : e - 1], SEED) for s, e in zip(ends, ends[words:])), np.uint64, len(own) - words + 1)


def other_hash(h: np.ndarray, kind: int) -> np.ndarray:
    """An independent hash of a hash: the finisher of splitmix64, ``kind`` steps on; kind 0 is the hash itself."""
    if not kind:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * kind & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), BATCH):
        ones += np.unpackbits(h[a : a + BATCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def row_key(docs: DataFrame):
    """128 bits of a row's contents, with its nulls told apart from what stands beside them."""
    own = []
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        own.append(F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"}) if kind.startswith(("array", "map", "struct")) else column)
    lacks = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in own])
    return F.struct(F.xxhash64(*own, lacks).alias("a"), F.xxhash64(lacks, *own, F.lit(1)).alias("b"))


def with_prints(docs: DataFrame, words: int, kinds: int) -> DataFrame:
    """Of id, own and text: id, own, node (the set's hash) and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hashes = [shingles(t.as_py(), words) for t in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in hashes], np.uint64).view(np.int64)
            found = [np.array([majority(other_hash(h, k)) for k in range(kinds)], np.uint64).view(np.int64) for h in hashes]
            yield pa.record_batch([batch.column("id"), batch.column("own"), pa.array(nodes), pa.array(found, pa.list_(pa.int64()))], ["id", "own", "node", "prints"])

    return docs.mapInArrow(run, "id long, own struct<a:bigint,b:bigint>, node long, prints array<long>")


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), words)).view(np.int64) for t in batch.column("text")]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, set_a, set_b) that link; a pair at a time, so that no batch of sets is ever held."""
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(both >= similarity * (F.size("set_a") + F.size("set_b") - both) - 1e-9).select("a", "b")


def first_of_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 6, prints: int = 2, bucket_limit: int = 1 << 16
) -> DataFrame:
    """One row of each group of rows that links connect: that of the smallest id, rows without an id last."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    own = row_key(docs)
    mark = "copies_own"
    while mark in docs.columns:
        mark += "_"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), own.alias("own"), F.col(text_col).cast("string").alias("text"))
    marked = scratch.save(with_prints(rows, words, prints), "prints")
    nodes = scratch.save(marked.groupBy("node").agg(F.min("own").alias("own"), F.any_value("prints").alias("prints")), "nodes")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cover = masks(radius)
    links, roots = None, spark.createDataFrame([], "node long, root long")
    done = 0

    def linked(some: DataFrame, name: str) -> DataFrame:
        wanted = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
        wanted = scratch.save(nodes.select("node", "own").join(wanted, "node"), f"{name}-nodes")
        hint = F.broadcast if wanted.count() <= SENT else (lambda df: df)
        texts = rows.join(hint(wanted), "own").dropDuplicates(["node"]).select("node", "text")
        sets = scratch.save(with_sets(texts, words), f"{name}-sets")
        both = some.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        found = scratch.save(similar(both, similarity), f"{name}-links")
        scratch.drop(f"{name}-sets")
        return found

    for k in range(prints):
        mine = nodes.select("node", F.col("prints")[k].alias("fp"))
        first = scratch.save(mine.groupBy("fp").agg(F.min("node").alias("node")), f"first{k}")
        parts = max(least, first.count() * len(cover) // 2_000_000)
        ends = [first.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}")) for x in ("a", "b")]
        for own_masks in (cover[:FIRST], cover[FIRST:]):
            name = f"round{done}"
            label = first.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("label"))
            posted = label.select(F.explode(F.array(*map(F.lit, own_masks))).alias("mask"), "fp", "label")
            edges = edges_of(posted, parts, radius, bucket_limit, Scratch(spark, f"copies-{name}")).distinct()
            near = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            if own_masks[0] == cover[0]:  # other sets with the same fingerprint
                near = near.unionAll(mine.join(first.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b"))
            pairs = scratch.save(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-pairs")
            done += 1
            if pairs.limit(1).count():
                found = linked(pairs, name)
                links = found if links is None else links.unionAll(found)
                roots = components(links, Scratch(spark, f"copies-{name}-roots"))
    groups = marked.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
    kept = groups.agg(F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "own")).alias("x")).select(F.col("x.own").alias(mark))
    return docs.withColumn(mark, own).join(kept, mark, "left_semi").dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
