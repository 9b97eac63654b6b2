"""Quality rules, centroid clustering and rolling medians against brute force: nulls, ties, repeated rows, empty tables, clashing columns."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallygrain.llm import centroids, quality, queries, rolling

# ---- quality rules


def base(text):
    """The contract's counts, word by word."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if times[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def slow_tokens(text):
    return [t for t in re.findall(r"(?:[^\W]|_)+|[^\w\x20\x09-\x0D]+", text)]


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b", "a b c a b c", "x x x x", "x\nx\n y\n y\n\n\nx ", "é 汉字 | #*$ &<>%", "a b c d\x0ba b c\x1ca b\x85c a b\xa0c", "w " * 5000])
def test_base_counts(text):
    assert quality.base_counts(text) == base(text)


def test_base_counts_of_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c ", " ", "\n", "a b", "#", "|", "\t", "é", " ", "\x1d"]) for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(text) == base(text), repr(text)


def test_tokens_are_the_patterns_matches():
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice(["a", "Bc", " ", "\n", "_", "7", "!!", "é", "汉", "|"]) for _ in range(rng.randint(0, 40)))
        place, h = quality.tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        want = [(m.start(), m.group()) for m in re.finditer(r"\w+|[^\w\x20\x09-\x0D]+", text)]
        assert place.tolist() == [p for p, _ in want]
        assert len(set(h.tolist())) == len({t for _, t in want})  # equal tokens, equal hashes, wherever they stand


def test_ngrams_do_not_depend_on_windows(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "x!", "ab-cd", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(12)] + [None, "", "  "]
    def told():
        out = defaultdict(Counter)
        for text, bucket in quality.grams(texts):
            for t, b in zip(text.tolist(), bucket.tolist()):
                out[t][b] += 1
        return out
    whole = told()
    monkeypatch.setattr(quality, "WINDOW", 40)
    quality.powers.cache_clear()
    assert told() == whole
    monkeypatch.undo()
    quality.powers.cache_clear()
    for i, t in enumerate(texts):
        n = len(slow_tokens(t or ""))
        assert sum(whole[i].values()) == max(0, 2 * n - 1)


DOCS = "doc_id long, text string, score double, kept boolean, good int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(55, 90)))
    bad = lambda: " | ".join(rng.choice(["home", "login", "cart"]) + str(rng.randint(0, 300)) for _ in range(70))
    rows = [(i, bad() if i % 4 == 3 else good(), 0.5, None, 1) for i in range(240)]
    rows += [rows[0], rows[3], (500, None, None, None, None), (501, "", 1.0, True, 0), (502, "one two", 1.0, True, 0), (None, good(), 0.0, None, None), (503, "a b c " * 40, None, None, None), (504, "x" * 3000 + " y" * 60, None, None, None)]
    labels = [(i, int(i % 4 != 3)) for i in range(200)] + [(7, 0), (11, None), (None, 1), (9000, 1)]
    return rows, labels


def test_judge_against_brute_force(spark, corpus):
    rows, labels = corpus
    got = quality.judge(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    good = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            good[i].append(q)
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 0

    def buckets(text):
        return [b for _, found in quality.grams([text]) for b in found.tolist()]

    raw, trusted = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r[1]))
        if r[0] in good and min(good[r[0]]) > 0 and learnt(r[0]):
            trusted.update(buckets(r[1]))
    nr, nt = sum(raw.values()), sum(trusted.values())
    lift = {b: (trusted[b] + 8) / (nt * raw[b] / nr + 8) for b in raw}
    z = sum(raw[b] / nr * lift[b] for b in raw)
    weight = {b: math.log(lift[b] / z) for b in raw}
    assert abs(sum(raw[b] / nr * math.exp(weight[b]) for b in raw) - 1) < 1e-9
    scores = {}
    for r in rows:
        own = buckets(r[1])
        scores[r[1]] = sum(weight[b] for b in own) / len(own) if own else 0.0
    # the cut by trying every one
    cal = [(math.floor(scores[r[1]] / 0.005), min(good[r[0]]) > 0) for r in rows if r[0] in good and not learnt(r[0])]
    cuts = range(min(s for s, _ in cal) - 2, max(s for s, _ in cal) + 3)
    g, b = sum(x for _, x in cal), sum(not x for _, x in cal)
    value = {c: sum(s >= c for s, x in cal if x) * b + sum(s < c for s, x in cal if not x) * g for c in cuts}
    best = [c for c in cuts if value[c] == max(value.values())]
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got))
    want = sorted((r[0] is None, r[0] or 0, *base(r[1]), base(r[1])[0] < 50 or 100 * base(r[1])[4] > 50 * base(r[1])[0]) for r in rows)
    assert seen == want
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert abs(r.score - scores[texts[r.doc_id]]) < 1e-5
        if r.base_failed or r.score / 0.005 < best[0] - 0.01:
            assert not r.kept
        elif r.score / 0.005 > best[-1] + 1:
            assert r.kept
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[i] == (i % 4 != 3) for i in range(240))


def test_judge_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "w%d " % 3 * 2 + " ".join(map(str, range(60)))), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept, r.score) for r in quality.judge(docs, none).collect()) == [(1, True, 0.0), (2, False, 0.0)]
    assert quality.judge(docs.limit(0), none).collect() == []


def test_cuts():
    assert quality.best_cut([]) == quality.best_cut([(3, 5, 0)]) == float("-inf")
    assert quality.best_cut([(0, 0, 4), (10, 4, 0)]) == pytest.approx(5.5 * quality.STEP)  # the middle of the gap
    assert quality.best_cut([(-4, 1, 9), (2, 9, 1)]) == pytest.approx(-0.5 * quality.STEP)


# ---- centroids


def lloyd(vectors, k, rounds, dim, scale=256, seed=2):
    """Whole numbers of any size, vector by vector."""
    rows = [(i, v) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in rows]
    ints = [[math.floor(scale * x) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda j: key[j])[:k]
    c = [ints[j] for j in order]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _ in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (dist(x, c[j]), j)) for x in ints]
        last = c
        c = [[sum(col) // len(own) for col in zip(*own)] if (own := [x for x, a in zip(ints, at) if a == j]) else c[j] for j in range(len(c))]
    d = [min(dist(x, last[a]), (1 << 63) - 1) for x, a in zip(ints, at)]
    exact = [dist(x, last[a]) for x, a in zip(ints, at)]
    own = [min(sum(e for e, b in zip(exact, at) if b == j), (1 << 63) - 1) for j in range(len(last))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in last]
    return sorted(((i is None, i or 0), a, dd, own[a], min(sum(exact), (1 << 63) - 1), sha[a]) for (i, _), a, dd in zip(rows, at, d))


def clustered(spark, vectors, k, rounds, dim, kind="double"):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors], f"vec_id long, embedding array<{kind}>, x string, cluster int").repartition(3)
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in centroids.cluster(df, k=k, rounds=rounds, dim=dim).collect())


def test_clusters_are_lloyds(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(i % 3, 0.4) for _ in range(5)]) for i in range(120)]
    vectors += [vectors[4], (4, vectors[9][1]), (None, vectors[5][1]), (200, None), (201, [1.0]), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [1.0, float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf")] * 5), (205, []), (206, [0.0] * 5), (207, [0.0] * 5)]
    for k in (1, 7, 40):
        assert clustered(spark, vectors, k, 4, 5) == lloyd(vectors, k, 4, 5)


def test_clusters_of_large_and_few_vectors(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    vectors += [(100 + i, [rng.gauss(0, 1) * 10.0 ** rng.choice([7, 8, 15, 30, 200]) for _ in range(4)]) for i in range(40)]
    for k in (3, 30):
        assert clustered(spark, vectors, k, 3, 4) == lloyd(vectors, k, 3, 4)
    assert clustered(spark, vectors[:5], 40, 2, 4) == lloyd(vectors[:5], 40, 2, 4)
    assert clustered(spark, [], 40, 2, 4) == [] and clustered(spark, [(1, None)], 40, 2, 4) == []


def test_ties_go_to_the_smaller_number_and_no_pair_is_told_wrong():
    rng = np.random.default_rng(3)
    for size in (1, 10, 2.0**20, 2.0**27, 2.0**40, 2.0**70):
        x = np.rint(rng.normal(size=(200, 3)) * size)
        x[::7] = np.rint(rng.normal(size=(29, 3)))
        c = centroids.Centroids(np.array([[int(v) for v in r] for r in np.concatenate([x[:8], x[:2], np.rint(rng.normal(size=(3, 3)) * size / 3)])], object))
        at, d = centroids.nearest(x, c)
        for i, r in enumerate(x):
            want = min((sum((int(a) - b) ** 2 for a, b in zip(r, row)), j) for j, row in enumerate(c.exact))
            assert (int(d[i]), at[i]) == want


# ---- rolling medians


def middle2(x):
    return x[(len(x) - 1) // 2] + x[len(x) // 2]


def windows(clicks, minutes=60):
    one = {}
    for i, ts, kind, value in clicks:
        x = (ts is None, ts, kind is not None, kind or "", value is not None, 0 if value is None else value)
        if i not in one or x < one[i][0]:
            one[i] = x, kind, ts, value
    rows = [(i, ts, kind, None if v is None or not math.isfinite(v) or abs(v) > 2**56 / 100 else math.floor(100 * v + 0.5)) for i, (_, kind, ts, v) in one.items() if ts is not None]
    out = []
    for i, ts, kind, c in rows:
        w = sorted(x for _, t, k, x in rows if k == kind and x is not None and ts - datetime.timedelta(minutes=minutes) < t <= ts)
        if len(w) < 2:
            out.append((i, kind, len(w), None, None, None))
            continue
        m = middle2(w)
        r = middle2(sorted(abs(2 * x - m) for x in w))
        out.append((i, kind, len(w), m, r, None if c is None else 2 * abs(2 * c - m) > 3 * r))
    return sorted(out, key=repr)


def told(spark, clicks, **more):
    df = spark.createDataFrame([(*c, "x", 1) for c in clicks], "click_id long, ts timestamp_ntz, kind string, value double, slot string, n int").repartition(3)
    return sorted(map(tuple, rolling.rolling_medians(df, **more).collect()), key=repr)


def clicks_of(rng, n, span_s, kinds=("a", "b", None, "")):
    start = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        ts = start + datetime.timedelta(microseconds=rng.choice([rng.randint(0, span_s * 10**6), 60 * 10**6 * rng.randint(0, span_s // 60)]))
        value = rng.choice([None, 1.0, 2.0, 5.25, rng.uniform(-50, 50), rng.lognormvariate(3, 2)])
        out.append((i, ts, rng.choice(kinds), value))
    return out


def test_medians_are_brute_forces(spark):
    rng = random.Random(11)
    clicks = clicks_of(rng, 500, 6 * 3600)
    t = datetime.datetime(1969, 12, 31, 23, 50)
    clicks += [(900 + i, t + datetime.timedelta(minutes=4 * i), "old", float(i)) for i in range(12)]
    hour = datetime.datetime(2024, 1, 1, 4)
    clicks += [(1000, hour, "edge", 1.0), (1001, hour + datetime.timedelta(hours=1), "edge", 2.0), (1002, hour + datetime.timedelta(hours=1, microseconds=-1), "edge", 4.0)]
    clicks += [clicks[0], clicks[3], (1, None, "a", 3.0), (2000, None, "a", 1.0), (None, hour, "a", 7.0), (None, hour, "a", 8.0)]
    clicks += [(2100, hour, "broken", float("nan")), (2101, hour, "broken", float("inf")), (2102, hour, "broken", 1e300), (2103, hour, "broken", -3.005), (2104, hour, "broken", 7.2e14)]
    assert told(spark, clicks) == windows(clicks)


def test_dense_slots_are_cut_and_nothing_changes(spark):
    clicks = clicks_of(random.Random(12), 700, 5 * 3600, ("a", "b"))
    want = windows(clicks)
    assert told(spark, clicks, most=120) == want
    assert told(spark, clicks, most=3, slot_s=7200) == want


def test_what_no_task_could_hold_is_bisected_by_rounds(spark):
    rng = random.Random(13)
    start = datetime.datetime(2024, 1, 1)
    clicks = [(i, start + datetime.timedelta(seconds=rng.choice([rng.uniform(0, 9000), 60 * rng.randint(0, 150)])), rng.choice(["a", None]), rng.choice([None, 1.0, 2.0, 0.37, -0.2, rng.uniform(-3, 9)])) for i in range(160)]
    assert told(spark, clicks, most=1, slot_s=3600) == windows(clicks)
    same = [(i, start, "a", 5.0) for i in range(9)] + [(20, start, "a", None), (21, start + datetime.timedelta(hours=2), "a", None)]
    assert told(spark, same, most=1, slot_s=3600) == windows(same)


def test_prefix_counts_over_cells(spark):
    rng = random.Random(14)
    points = [(rng.choice(["x", "y"]), rng.randint(-50, 200), rng.randint(0, 300)) for _ in range(200)]
    asks = [(i, rng.choice(["x", "y", "z"]), rng.randint(-60, 220), rng.randint(0, 301), rng.choice([1, -1])) for i in range(80)]
    got = rolling.counted(spark.createDataFrame(points, "g string, t long, v long"), spark.createDataFrame(asks, "a long, g string, at long, y long, sign long").withColumnRenamed("a", "k"), ["g", "k"], 9, 7).collect()
    want = {i: s * sum(p[0] == g and p[1] <= at and p[2] < y for p in points) for i, g, at, y, s in asks}
    assert {r.k: r.n for r in got} == want


def test_no_clicks(spark):
    assert told(spark, []) == []
    assert told(spark, [(1, None, "a", 1.0)]) == []


def test_a_stretch_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, window, slot = rng.integers(1, 60), int(rng.integers(1, 20)), int(rng.integers(1, 40))
        g, at = np.sort(rng.integers(0, 3, n)), rng.integers(1, window + slot, n)
        order = np.lexsort((at, g))
        g, at = g[order], at[order]
        v, some, own = rng.integers(-20, int(rng.choice([-10, 30, 10**6])), n), rng.random(n) < 0.8, at >= window
        got = rolling.solve(g, at, v, some, own, window, slot + 2 * window)
        for i, *x in zip(np.flatnonzero(own), *got[:3]):
            w = sorted(v[(g == g[i]) & some & (at > at[i] - window) & (at <= at[i])].tolist())
            m = middle2(w) if len(w) > 1 else 0
            assert [int(y) for y in x] == [len(w), m, middle2(sorted(abs(2 * c - m) for c in w)) if len(w) > 1 else 0]


def test_the_queries_have_the_contracts_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "op11_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
        "op12_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        "op13_rolling_median": ["click_id", "kind", "n", "median2", "mad4", "far"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, d).columns == columns
