"""Fuzzy scores of two texts, 0 to 100, and brand verdicts.

The scorer that verdicts are defined by is an external library's weighted ratio. This is an own formula of the same family:
the best of the plain indel ratio, of token-sorted and token-set ratios at 0.95, and, for texts of unequal length, of the
best-window ratio at 0.9 (0.6 from eight times the length on). Verdicts at the thresholds agree on the known cases; single
scores can differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrain import config
from tallygrain.functions.text import fold


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def window_ratio(a: str, b: str) -> float:
    """The shorter text against its best window of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(i, 0) : i + n]) for i in range(-n + 1, len(long)))


def token_ratio(a: str, b: str, score=ratio) -> float:
    """The better of sorted tokens and of common against all tokens."""
    x, y = a.split(), b.split()
    best = score(" ".join(sorted(x)), " ".join(sorted(y)))
    same = sorted({*x} & {*y})
    if same:
        both = " ".join(same)
        rest = [" ".join([both, *sorted({*t} - {*same})]).strip() for t in (x, y)]
        best = max(best, score(both, rest[0]), score(both, rest[1]), score(*rest))
    return best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    uneven = max(len(a), len(b)) / min(len(a), len(b))
    if uneven < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if uneven <= 8 else 0.6
    return max(ratio(a, b), scale * window_ratio(a, b), 0.95 * scale * token_ratio(a, b, window_ratio))


def variants(a: str, b: str) -> list[tuple[str, str]]:
    """The pairs of texts that ``token_ratio`` takes the best of."""
    x, y = a.split(), b.split()
    same = sorted({*x} & {*y})
    told = [(" ".join(sorted(x)), " ".join(sorted(y)))]
    if same:
        both = " ".join(same)
        rest = [" ".join([both, *sorted({*t} - {*same})]) for t in (x, y)]
        told += [(both, rest[0]), (both, rest[1]), (rest[0], rest[1])]
    return told


class Codes:
    """Texts as rows of code points in one array, each text once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.points: list[np.ndarray] = []

    def __getitem__(self, text: str) -> int:
        at = self.number.setdefault(text, len(self.number))
        if at == len(self.points):
            self.points.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        return at

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in self.points], np.int64)
        return np.concatenate([*self.points, np.zeros(1, np.uint32)]), np.cumsum(sizes) - sizes, sizes


WORD = 64  # letters of a row


def letter_masks(points: np.ndarray, short: np.ndarray, size: np.ndarray, long: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each pair's longer text, the places (bits) at which the shorter has it; and where a pair's begin.

    Short and long: where texts begin in points. The last mask is empty.
    """
    begin = np.cumsum(length) - length
    pair = np.repeat(np.arange(len(short)), length)
    letter = points[np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(long, length)]
    masks = np.zeros(len(letter) + 1, np.uint64)
    for k in range(int(size.max(initial=0))):
        hit = (k < size[pair]) & (points[np.minimum(short[pair] + k, len(points) - 1)] == letter)
        masks[:-1] |= hit.astype(np.uint64) << np.uint64(k)
    return masks, begin


def common_lengths(masks: np.ndarray, start: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of runs of masks with their shorter texts: a row of bits for each run, all runs
    one letter on at a time."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    row = np.full(len(start), ~np.uint64(0))
    for k in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -k, "left"))  # runs of more than k letters
        r = row[:n]
        hit = r & masks[start[:n] + k]
        row[:n] = (r + hit) | (r - hit)
    kept = (np.uint64(1) << (size[order] % WORD).astype(np.uint64)) - np.uint64(1)
    kept = np.where(size[order] == WORD, ~np.uint64(0), kept)
    out = np.empty(len(order), np.int64)
    out[order] = np.bitwise_count(~row & kept)
    return out


def ratios(pairs: list[tuple[str, str]], windows: bool) -> np.ndarray:
    """``ratio`` of each pair of texts, or with windows ``window_ratio``, of all pairs at once."""
    out = np.zeros(len(pairs))
    codes, fits = Codes(), []
    for i, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short:
            out[i] = 100.0 if not long and not windows else 0.0
        elif len(short) > WORD:
            out[i] = window_ratio(a, b) if windows else ratio(a, b)
        else:
            fits.append((i, codes[short], codes[long]))
    for begin in range(0, len(fits), 4096):
        at, short, long = (np.array(x, np.int64) for x in zip(*fits[begin : begin + 4096]))
        points, starts, sizes = codes.flat()
        n, m = sizes[short], sizes[long]
        masks, first = letter_masks(points, starts[short], n, starts[long], m)
        if not windows:
            out[at] = 200.0 * common_lengths(masks, first, m, n) / (n + m)
            continue
        # windows of n letters begin from n - 1 before the longer text up to its last letter
        count = n + m - 1
        pair = np.repeat(np.arange(len(n)), count)
        shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) - (n - 1)[pair]
        left, right = np.maximum(shift, 0), np.minimum(shift + n[pair], m[pair])
        # slices from before the first letter end as they would in a text: i + n
        got = 200.0 * common_lengths(masks, first[pair] + left, right - left, n[pair]) / (n[pair] + right - left)
        out[at] = np.maximum.reduceat(got, np.cumsum(count) - count)
    return out


def weighted_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``weighted_ratio`` of many pairs: whole batches of rows of bits in place of a loop for each pair and window."""
    best = np.zeros(len(pairs))
    asked: dict[bool, list[tuple[int, float, tuple[str, str]]]] = {False: [], True: []}
    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        uneven = max(len(a), len(b)) / min(len(a), len(b))
        far = uneven >= 1.5
        scale = 1.0 if not far else 0.9 if uneven <= 8 else 0.6
        asked[False].append((i, 1.0, (a, b)))
        if far:
            asked[True].append((i, scale, (a, b)))
        asked[far] += [(i, 0.95 * scale, p) for p in variants(a, b)]
    for windows, rows in asked.items():
        if rows:
            once = {p: k for k, p in enumerate(dict.fromkeys(p for _, _, p in rows))}
            score = ratios(list(once), windows)
            np.maximum.at(best, [i for i, _, _ in rows], [f * score[once[p]] for _, f, p in rows])
    return best


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is scored once."""
    pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b)]
    once = list(dict.fromkeys(p for p in pairs if p is not None))
    folded = {t: fold(t) for p in once for t in p}
    score = dict(zip(once, weighted_ratios([(folded[x], folded[y]) for x, y in once])))
    return pd.Series([None if p is None else float(score[p]) for p in pairs], dtype=object)


def verdict(x: list[str], y: list[str], score: dict[tuple[str, str], float], same: float, differ: float) -> str:
    if not x or not y:
        return "unknown"
    told = [s for p in x for q in y if p and q for s in (100.0 if p == q else score[p, q],)]
    return "pass" if max(told, default=0) >= same else "unknown" if max(told, default=0) > differ else "fail"


def brands_verdict(a: list[str], b: list[str], same: float = config.FUZZY_SAME, differ: float = config.FUZZY_DIFFER) -> str:
    """pass if any pair is alike, fail if all differ, else unknown; pairs with an empty side count as differing."""
    return brands_verdicts([(a, b)], same, differ)[0]


def brands_verdicts(rows: list[tuple[list[str], list[str]]], same: float = config.FUZZY_SAME, differ: float = config.FUZZY_DIFFER) -> list[str]:
    """``brands_verdict`` of many rows: all their pairs of names are scored together, each once."""
    rows = [([fold(x) for x in a], [fold(y) for y in b]) for a, b in rows]
    open_ = [(a, b) for a, b in rows if not {*a} & {*b} - {""}]
    pairs = list(dict.fromkeys((x, y) for a, b in open_ for x in a for y in b if x and y))
    score = dict(zip(pairs, weighted_ratios(pairs)))
    return ["pass" if {*a} & {*b} - {""} else verdict(a, b, score, same, differ) for a, b in rows]


@F.pandas_udf(T.StringType())
def compare_brands(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = [(() if x is None else tuple(x), () if y is None else tuple(y)) for x, y in zip(a, b)]
    once = list(dict.fromkeys(rows))
    told = dict(zip(once, brands_verdicts(once)))
    return pd.Series([told[r] for r in rows])


def compare_brands_exact_first(a: Column, b: Column) -> Column:
    """``compare_brands``, with equal and empty sides decided in the JVM; of those, Python gets nulls only."""
    low = lambda c: F.transform(c, lambda x: F.trim(F.lower(x)))
    told = F.when((F.size(a) <= 0) | (F.size(b) <= 0) | a.isNull() | b.isNull(), "unknown").when(F.arrays_overlap(F.filter(low(a), lambda x: x != ""), F.filter(low(b), lambda x: x != "")), "pass")
    return F.coalesce(told, compare_brands(F.when(told.isNull(), a), F.when(told.isNull(), b)))


def levenshtein_verdict(a: Column, b: Column, same: float = 0.88, differ: float = 0.40) -> Column:
    """The three states by 1 - distance / longer length: not the weighted ratio, and named so."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    score = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), "unknown").when(score >= same, "pass").when(score <= differ, "fail").otherwise("unknown")
