"""Best-fit packing of token pieces into sequences of a fixed length, by exact-complement hashing.

Tokenising, cutting and counting happen in one pass: a piece is known by its document, its length, its task and its rank
among the task's pieces of that length. The histogram of lengths - at most ``limit`` numbers, whatever the input - is all
that planning needs. An index hashes the sums of available lengths: a sum leads to the lengths and pairs that make it, and a
triple's to a length and the pair that the rest leads to. For each length, longest first, combinations that fill its gap exactly
are looked up and used as often as the counts allow. What is left is packed best-fit, longest first, again by counts. An
exact fill of many small pieces can cost more than it saves, so a fill's largest piece must lie within a window of the largest
that fits; plans with several windows, and with the residuals packed length by length or at the end, are made, and the one
of fewest sequences is taken: with the narrowest window and residuals at once it is best-fit decreasing. The plan says, for an interval of ranks of a length, in which sequences and where its pieces stand; every piece
finds its place by a binary search, so no pieces are shuffled and no group of equal lengths is gathered anywhere.

Defined cases: a null text is empty; an empty document is the end id alone; a null doc_id stays null and is packed
like any other; repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

def ids_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.cache  # only texts that need it pay for its memory
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def load_encoding(path: str):
    """text -> ids as ``tokenizers`` gives them without special tokens added, by the faster of two libraries where they agree.

    A byte-level BPE of the GPT-2 pattern has its own merges run by tiktoken; a text that holds the literal of an added token,
    which tokenizers cuts out first, and any other kind of file are run by tokenizers.
    """
    def plain(text: str) -> list[int]:
        return tokenizer_of(path).encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if not (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"):
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    added = {t["content"] for t in spec.get("added_tokens", [])}
    shown = byte_letters()
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    literal = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")
    return lambda text: plain(text) if literal.search(text) else fast(text)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies show bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.cache  # a Python worker serves many tasks
def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes."""
    encode = load_encoding(path)
    return lambda text: ids_bytes(encode(text))


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``limit``, but the first may be shorter."""
    head = n % limit or limit
    return [(0, min(head, n)), *((a, limit) for a in range(head, n, limit))] if n else []


def pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """One row a piece, with the task and the piece's rank among the task's pieces of its length."""
    ids_of = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    task, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = ids_of(text.as_py() or "") + end
            for piece, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                rows.append((doc_id, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, seen[n]))
                seen[n] += 1
        if rows:
            doc, piece, start, n, crc, tasks, nth = zip(*rows)
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(tasks, pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )


class Sums:
    """Hash index of the sums of available lengths: under a sum, the larger parts of the pairs that make it, largest first.

    Counts go down as lengths are used up; what the index leads to is checked against them.
    """

    def __init__(self, counts: list[int], limit: int):
        self.left = counts
        have = np.flatnonzero(counts)
        a, b = np.nonzero((have[:, None] >= have[None, :]) & (have[:, None] + have[None, :] < limit))
        sums, larger = have[a] + have[b], have[a]
        order = np.lexsort((-larger, sums))
        ends = np.searchsorted(sums[order], np.arange(limit + 1))
        self.pairs = {g: larger[order[ends[g] : ends[g + 1]]].tolist() for g in range(1, limit)}

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in set(lengths))

    def largest(self, gap: int) -> int:
        return next((m for m in range(gap, 0, -1) if self.left[m]), 0)

    def fill(self, n: int, window: int) -> tuple[int, ...] | None:
        """The base length and one, two or three others that fill its gap exactly; the largest of them within the window."""
        gap = len(self.left) - 1 - n
        if self.left[gap] and self.enough((n, gap)):
            return n, gap
        self.left[n] -= 1
        top = self.largest(gap)
        self.left[n] += 1
        for a in self.pairs.get(gap, ()):
            if a < top - window:
                break
            if self.enough((n, a, gap - a)):
                return n, a, gap - a
        for a in range(top, max(top - window - 1, (gap - 1) // 3, 0), -1):
            if self.left[a]:
                for b in self.pairs.get(gap - a, ()):
                    if b <= a and self.enough((n, a, b, gap - a - b)):
                        return n, a, b, gap - a - b
        return None

    def fit(self, n: int) -> tuple[int, ...]:
        """The base length, then again and again the largest that fits."""
        lengths, gap = [n], len(self.left) - 1 - n
        self.left[n] -= 1
        while gap and (m := self.largest(gap)):
            self.left[m] -= 1
            lengths.append(m)
            gap -= m
        for m in lengths:
            self.left[m] += 1
        return tuple(lengths)


#: How far below the largest piece that fits an exact fill's largest may lie, in the plans that are compared.
WINDOWS = (0, 8, 64, 1 << 30)


def one_plan(counts: list[int], limit: int, window: int, at_once: bool) -> list[tuple[tuple[int, ...], int]]:
    sums, made = Sums([*counts], limit), []

    def use(lengths: tuple[int, ...]) -> None:
        times = min(sums.left[n] // lengths.count(n) for n in set(lengths))
        for n in lengths:
            sums.left[n] -= times
        if times:
            made.append((lengths, times))

    use((limit,))
    for n in range(limit - 1, 0, -1):
        while sums.left[n] and ((found := sums.fill(n, window)) or at_once):
            use(found or sums.fit(n))
    for n in range(limit, 0, -1):
        while sums.left[n]:
            use(sums.fit(n))
    return made


def plan(counts: list[int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences): exact fills, then best fit; the fewest sequences of several windows."""
    tries = (one_plan(counts, limit, window, at_once) for at_once in (False, True) for window in WINDOWS)
    return min(tries, key=lambda made: sum(times for _, times in made))


def placing(made: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, ascending (first rank, first sequence, offset): its pieces from that rank on go to that sequence
    and the following ones, each at that offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in made:
        at = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + times
            at += n
        sequence += times
    return out


def place(batches: Iterator[pa.RecordBatch], where: dict) -> Iterator[pa.RecordBatch]:
    tables = {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in where.items()}
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, start, off = tables[int(n)]
            k = np.searchsorted(first, rank[at], "right") - 1
            sequence[at], offset[at] = start[k] + rank[at] - first[k], off[k]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document and its place.

    vocabulary: a tokenizers JSON file that every executor can open.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = scratch.save(rows.mapInArrow(lambda it: pieces(it, vocabulary, limit, end_id), PIECES), "pieces")
    by_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = [0] * (limit + 1)
    for n, c in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``limit`` rows
        counts[n] = c
    where = placing(plan(counts, limit))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lambda it: place(it, where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
