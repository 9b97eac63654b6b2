"""Quality rules: plain counts of a text, and how much likelier its n-grams are in trusted text than in the raw corpus.

Two multinomials over hashed n-grams are counted: one of all documents, one of those that labels call good. Tokens are runs
of letters and digits and runs of other signs; single tokens and pairs of neighbours fall into 2**BITS buckets. A bucket's
weight is the logarithm of its share in trusted text over its share in the raw corpus, where the trusted share is drawn
to the raw one by ``KAPPA`` occurrences, so rare buckets weigh nothing. A document's score is the mean weight of its
n-grams. Weights are whole multiples of 2**-20, so sums do not depend on their order and equal texts score alike.

Every document is held against one threshold. It is read off labelled documents that the counts did not learn from (crc32 of the
id mod 5 is 0) and that pass the base rules: the score, in steps of ``STEP``, that parts good and bad ones best, the
middle of those that do so equally well.

Defined cases: a null or empty text has no words and no n-grams, scores 0 and fails the base rules; labels that are null, or of
documents that do not exist, count for nothing; a document labelled more than once is good if every label says so; with
no good label all scores are 0 and the method keeps everything, as it does without bad or good ones to read the threshold
off; rows that repeat are documents each; a null doc_id stays null and has no label; an empty table gives no rows; other
columns are ignored, whatever their names. A run of more than 2**19 code points without white space is several tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, crc_mod, text_bytes

BITS, KAPPA, STEP = 16, 8.0, 0.005
#: Weights are whole numbers of this unit.
UNIT = 1 << 20
#: Code points that are hashed at a time.
WINDOW = 1 << 19
#: Labels of up to so many documents are broadcast (about 60 MB); more are joined by a shuffle.
SENT = 1 << 20
SYMBOLS = "#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@functools.cache
def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, digit or underscore, 2 any other sign."""
    out = np.fromiter((1 if chr(c).isalnum() or c == 95 else 2 for c in range(0x110000)), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64; two more than a window needs."""
    n = 2 * WINDOW + 2
    steps = np.full((2, n), [[BASE], [np.uint64(pow(int(BASE), -1, 1 << 64))]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each token: a polynomial in its code points."""
    kind = classes()[points]
    edges = np.flatnonzero(np.diff(kind, prepend=3, append=3))
    start, end = edges[:-1], edges[1:]
    some = kind[start] != 0
    start, end = start[some], end[some]
    up, down = powers()
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * down[start])


def packs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, places at which pieces begin, each piece's text) of several texts, or of a part of a long one, cut at white space."""
    held: list[np.ndarray] = []
    whose: list[int] = []
    size = 0
    gap = np.array([10], np.uint32)

    def pack():
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        return np.concatenate([y for x in held for y in (x, gap)]), starts, np.array(whose)

    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while at < len(points):
            end = min(at + WINDOW, len(points))
            if end < len(points):
                blank = np.flatnonzero(classes()[points[at:end]] == 0)
                end = at + int(blank[-1]) + 1 if len(blank) else end
            if held and size + end - at > WINDOW:
                yield pack()
                held, whose, size = [], [], 0
            held.append(points[at:end])
            whose.append(i)
            size += end - at
            at = end
    if held:
        yield pack()


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams, a pack at a time; a pair of tokens may span two packs of one text."""
    last = None
    for points, starts, whose in packs(texts):
        place, h = tokens(points)
        text = whose[np.searchsorted(starts, place, "right") - 1]
        shift = np.uint64(64 - BITS)
        yield text, h >> shift
        if last is not None:
            text, h = np.append(last[0], text), np.append(last[1], h)
        if len(h):
            same = text[1:] == text[:-1]
            yield text[1:][same], mixed(h[:-1] * np.uint64(3) + h[1:])[same] >> shift
            last = text[-1], h[-1]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a text."""
    raw = text_bytes(text)
    own = raw.split()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = len(points) - int(((points == 32) | ((points >= 9) & (points <= 13))).sum())
    symbols = sum(raw.count(s.encode()) for s in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if len(own) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in own])
        n = len(number)
        pairs = ids[:-2] * n + ids[1:-1]
        if n >= 1 << 21:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, at, times = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
        again = times[at] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= again
        repeats = int(covered.sum())
    return len(own), chars, symbols, len(lines) - len(set(lines)), repeats


def corpus_counts(rows: DataFrame) -> DataFrame:
    """bucket, raw, trusted: occurrences in all documents and in trusted ones, summed up in each task first."""

    def run(batches):
        both = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            good = batch.column("trusted").to_numpy(zero_copy_only=False)
            for text, bucket in grams(batch.column("text").to_pylist()):
                both[0] += np.bincount(bucket, minlength=1 << BITS)
                both[1] += np.bincount(bucket[good[text]], minlength=1 << BITS)
        at = np.flatnonzero(both[0])
        yield pa.record_batch([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], ["bucket", "raw", "trusted"])

    found = rows.select("text", "trusted").mapInArrow(run, "bucket long, raw long, trusted long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def weights(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Each bucket's log-likelihood ratio in units of 2**-20; both multinomials sum to one."""
    if not trusted.sum():
        return np.zeros(len(raw), np.int64)
    share = raw / raw.sum()
    lift = (trusted + KAPPA) / (trusted.sum() * share + KAPPA)
    lift /= (share * lift).sum()
    return np.where(raw > 0, np.rint(np.log(lift) * UNIT), 0).astype(np.int64)


def best_cut(bins: list[tuple[int, int, int]]) -> float:
    """The threshold from (step, good documents, bad documents)."""
    bins = sorted(bins)
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return float("-inf")
    kept, gone, scores = good, 0, []
    for i, (step, g, b) in enumerate(bins):
        # a cut just above the step before lets all from here on through
        scores.append((kept * bad + gone * good, step, bins[i - 1][0] + 1 if i else step))
        kept, gone = kept - g, gone + b
    scores.append((kept * bad + gone * good, bins[-1][0] + 1, bins[-1][0] + 1))
    top = max(s for s, _, _ in scores)
    high, low = next((h, lo) for s, h, lo in scores if s == top)
    return (low + high) / 2 * STEP


def judge(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 50,
    most_repeats: int = 50,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of each document.

    least_words: fewer fail the base rules. most_repeats: more than so many words of a hundred in windows of three that
    come again fail them.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg((F.min(F.col(label_col).cast("int")) > 0).alias("good"))
    own = scratch.save(own.withColumn("learnt", crc_mod("label_id", 5) != 0), "labels")
    hint = F.broadcast if own.count() <= SENT else (lambda df: df)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(hint(own), F.col("id") == F.col("label_id"), "left")
    counted = corpus_counts(rows.withColumn("trusted", F.coalesce(F.col("good") & F.col("learnt"), F.lit(False)))).toArrow()
    raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    at = counted.column("bucket").to_numpy()
    raw[at], trusted[at] = counted.column("raw").to_numpy(), counted.column("trusted").to_numpy()
    w = weights(raw, trusted)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for text, bucket in grams(texts):
                total += np.bincount(text, weights=w[bucket], minlength=len(texts))
                n += np.bincount(text, minlength=len(texts))
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeats * counts[:, 0])
            score = total / np.maximum(n, 1) / UNIT
            yield pa.record_batch([batch.column("id"), *map(pa.array, counts.T.copy()), pa.array(failed), pa.array(score), batch.column("mark")], ["doc_id", *COUNTS, "base_failed", "score", "mark"])

    marked = rows.select("id", "text", F.when(~F.col("learnt"), F.col("good")).alias("mark"))
    scored = scratch.save(marked.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, mark boolean"), "scored")
    step = F.floor(F.col("score") / STEP).cast("long")
    bins = scored.where(F.col("mark").isNotNull() & ~F.col("base_failed")).groupBy(step.alias("step")).agg(F.count_if("mark").alias("good"), F.count_if(~F.col("mark")).alias("bad"))
    cut = best_cut([tuple(r) for r in bins.collect()])  # a score lies between two logarithms of shares: some thousands of steps
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept"), "score")
