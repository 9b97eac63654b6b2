"""The pipeline's near-copy stage against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallygrain.llm import copies


def sets(text, k=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def table(rng):
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for g in range(12):
        base = words(rng.randint(60, 300))
        texts.append(base)
        for swaps in (1, 1, 2, 3, 4):  # similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), swaps):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    chain = words(120)
    for _ in range(8):  # each links to the one before it only
        chain = [*chain[9:], *words(9)]
        texts.append(list(chain))
    rows = [(i, " ".join(t), f"s{i % 3}") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    one = rows[0]
    lone = words(80)
    return [*rows, one, (one[0], " ".join(words(90)), "s1"), (None, rows[1][1] + " tail", "s1"), (None, " ".join(lone), "s2"), (None, " ".join(lone + ["end"]), "s2"), (900, "", "s0"), (901, None, "s0"), (902, "one two", "s0"), (903, "One  two", "s0")]


def within(a, b, radius=6, kinds=2):
    h = [copies.shingles(t, 5) for t in (a, b)]
    return any((copies.majority(copies.other_hash(h[0], k)) ^ copies.majority(copies.other_hash(h[1], k))).bit_count() <= radius for k in range(kinds))


def grouped(links, n):
    group = list(range(n))
    for a, b in links:
        if group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def test_near_copies_equal_brute_force(spark):
    rows = table(random.Random(8))
    own = [sets(t) for _, t, _ in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if similarity(own[a], own[b]) >= 0.8]
    links = [(a, b) for a, b in pairs if own[a] == own[b] or within(rows[a][1], rows[b][1])]
    group = grouped(links, len(rows))
    assert sum(own[a] != own[b] for a, b in links) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    where = {r: group[i] for i, r in enumerate(rows)}
    assert Counter(where[r] for r in got) == Counter(set(group))  # one row of each group
    for r in got:
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == where[r] and rows[i][0] is not None]
        assert r[0] == min(ids, default=None)
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize(("near", "least"), [(0.9, 0.65), (0.95, 0.9)])
def test_fingerprints_reach_what_the_angle_says(near, least):
    rng = np.random.default_rng(1)
    n, hits = 400, 0
    own = round(n * (1 - near) / (1 + near))  # of each set; similarity is shared over all
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (n, own, own))
        x, y = np.concatenate((both[own:], a)), np.concatenate((both[own:], b))
        hits += any((copies.majority(copies.other_hash(x, k)) ^ copies.majority(copies.other_hash(y, k))).bit_count() <= 6 for k in range(2))
    assert hits >= least * 300


def test_rows_are_told_apart_by_their_nulls(spark):
    rows = [(1, "only text", None, 5), (1, None, "only text", 5), (2, None, None, 6), (2, None, None, 6), (3, "", None, 7), (3, None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies_own long")
    keys = df.select(copies.row_key(df).alias("k")).distinct().count()
    assert keys == 5
    got = [tuple(r) for r in copies.first_of_copies(df).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[1]], key=repr)  # one text each: "only text", and none
    nested = spark.createDataFrame([(1, [1, None]), (1, [None, 1]), (1, None), (1, [])], "doc_id long, text array<int>")
    assert nested.select(copies.row_key(nested).alias("k")).distinct().count() == 4
