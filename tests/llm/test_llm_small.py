"""Each operator against a brute-force version on a small table with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallygrain.llm import exact_topk, katz, licenses, mixing, packing, permutation_index, pii, repeats, simhash, toxicity
from tallygrain.llm.common import crc_mod

DOCS = "doc_id long, text string, source string, fp string, id long, score double"


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "in", "st", "ou"]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [" ".join(word(rng) for _ in range(rng.randint(1, 260))) for _ in range(60)]
    texts = [*base, *base[:6], "", None, " \n ", "one", "One  TWO\tthree", "é 汉字 don't <|endoftext|>", "word " * 3000]
    texts += [base[3] + " and some more words at the end", base[3][:200] + base[4][-200:], "x" * 200, "x" * 120]
    out = [(i, t, f"s{i % 4}" if i % 9 else None, "a", 1, 0.5) for i, t in enumerate(texts)]
    return [*out, out[2], (None, base[5], "s1", "b", 2, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_packing(docs, rows, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    voc = path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(voc)
    got = packing.pack_documents(docs, voc).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if len(ids) > 1024 else [(0, (0, len(ids)))]:
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    key = [(None if np.isnan(d) else int(d), *map(int, r)) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert Counter(key) == want
    used = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()
        assert g.length.sum() <= 1024
        used += 1
    assert used <= math.ceil(got.length.sum() / 1024) + 1
    assert packing.pack_documents(none, voc).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    counts = [0] * 65
    for _ in range(rng.randint(0, 400)):
        counts[rng.randint(1, 64)] += 1
    made = packing.plan(counts, 64)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert [used[i] for i in range(65)] == counts
    assert any(sum(x) == 64 for x, _ in made) or sum(counts) < 20
    for n in (10, 30):  # exact complements are found: single, pair, triple
        assert packing.plan([0 if i not in (n, 64 - n) else 3 for i in range(65)], 64) == [((64 - n, n), 3)]


@pytest.mark.parametrize("kind", ["uniform", "gamma", "exponential", "two humps"])
def test_plan_takes_no_more_sequences_than_best_fit(kind):
    rng = np.random.default_rng(3)
    x = {"uniform": rng.integers(1, 1025, 8000), "gamma": rng.gamma(2, 200, 8000), "exponential": rng.exponential(300, 8000), "two humps": np.concatenate((rng.integers(600, 700, 3000), rng.integers(100, 400, 5000)))}[kind]
    counts = np.bincount(np.clip(x.astype(int) + 1, 1, 1024), minlength=1025).tolist()
    left, plain = [*counts], 0
    for n in range(1024, 0, -1):
        while left[n]:
            left[n], gap, plain = left[n] - 1, 1024 - n, plain + 1
            while gap and (m := next((m for m in range(gap, 0, -1) if left[m]), 0)):
                left[m], gap = left[m] - 1, gap - m
    assert sum(times for _, times in packing.plan(counts, 1024)) <= plain


def test_special_literals_are_tokens():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    voc = path("byte_bpe_50k.json")
    rng, tok, fast = random.Random(4), Tokenizer.from_file(voc), packing.load_encoding(voc)
    texts = ["abc <|endoftext|> def", "<|endoftext|>", " <|endoftext|><|endoftext|>  ", "<|endoftext", *("".join(rng.choice(["a", "Be ", "\n", "  ", "9", "é", "汉", "'s", "\t", "<|", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    for t in texts:
        assert fast(t) == tok.encode(t, add_special_tokens=False).ids


def fingerprint(text):
    w = tokens(text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert got == Counter((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("limit", "radius"), [(1, 4), (3, 4), (2048, 4), (3, 3), (2, 5)])
def test_simhash_links_are_whole_at_any_bucket_limit(spark, limit, radius, monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "with_fingerprints", lambda df, *a: df.selectExpr("doc_id AS id", "fp"))
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, radius=radius, bucket_limit=limit).collect()}
    label = list(range(len(signed)))
    for a, b in itertools.combinations(range(len(signed)), 2):
        if ((signed[a] ^ signed[b]) & (1 << 64) - 1).bit_count() <= radius:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert got == {i: min(j for j in range(len(label)) if label[j] == label[i]) for i in range(len(label))}


def test_masks_cover_every_pair_in_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    rng = random.Random(0)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)


def test_katz(docs, rows, none):
    got = katz.score_katz(docs, lambda c: crc_mod(c, 10) == 0, order=2).collect()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    texts = [[*tokens(r[1]), None] for r in rows]
    one, two, start = Counter(), Counter(), Counter()
    for h, w in zip(held, texts):
        if not h:
            one.update(w)
            for pair in zip(w, w[1:]):
                two[pair] += 1
                start[pair[0]] += 1
    n, v = sum(one.values()), len(one)
    want = Counter()
    for r, h, w in zip(rows, held, texts):
        want[(r[0], h, len(w), sum(x in one for x in w), n, round(sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    d1 = katz.discounts(Counter(one.values()), 5)
    d2 = katz.discounts(Counter(two.values()), 5)
    f = lambda d, c: d[min(c, 6)] * c
    mass = sum(f(d1, c) for c in one.values())
    p1 = lambda w: f(d1, one[w]) / n if w in one else 1 - mass / n
    after = defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))

    def p2(a, b):
        if not start[a]:
            return p1(b)
        total, found = start[a], sum(f(d2, c) for _, c in after[a])
        full = found >= total * (1 - 1e-12)
        if (a, b) in two:
            return f(d2, two[a, b]) / (total + full)
        left = 1 / (total + 1) if full else 1 - found / total
        return left / (1 - sum(p1(x) for x, _ in after[a])) * p1(b)

    by_text = {tuple(w): math.log10(p1(w[0])) + sum(math.log10(p2(a, b)) for a, b in zip(w, w[1:])) for w in texts}
    scores = defaultdict(list)
    for r in got:
        scores[r.doc_id].append(r.score)
    for r, w in zip(rows, texts):
        assert any(abs(s - by_text[tuple(w)]) < 1e-6 for s in scores[r[0]])
    for a in [*list(start)[:5]]:  # each context's probabilities sum to one
        assert abs(sum(p2(a, b) for b in one) + p2(a, "<never seen>") - 1) < 1e-9
    assert katz.score_katz(none, lambda c: crc_mod(c, 10) == 0).count() == 0


def test_katz_trigrams_and_spread_contexts(docs, monkeypatch):
    held = lambda c: crc_mod(c, 10) == 0
    plain = {(r.doc_id, r.n_tokens): r.score for r in katz.score_katz(docs, held, order=3).collect()}
    bi = {(r.doc_id, r.n_tokens): r.score for r in katz.score_katz(docs, held, order=2).collect()}
    assert sum(plain.values()) > sum(bi.values())
    monkeypatch.setattr(katz, "PART_ASKS", 50)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(katz, "SPREAD_LEAST", 5)
    spread = {(r.doc_id, r.n_tokens): r.score for r in katz.score_katz(docs, held, order=3).collect()}
    assert spread.keys() == plain.keys() and all(abs(spread[k] - plain[k]) < 1e-6 for k in plain)


def test_repeats(docs, rows, none, monkeypatch):
    for own, spread, merge in ((100, 20_000, 2 << 20), (1, 20_000, 200), (0, 1, 200)):
        monkeypatch.setattr(repeats, "OWN_PLACE", own)
        monkeypatch.setattr(repeats, "SPREAD", spread)
        monkeypatch.setattr(repeats, "MERGE_BYTES", merge)
        monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
        first = {}
        for i, t, *_ in rows:
            b = (t or "").encode()
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
        want = Counter()
        for i, t, *_ in rows:
            b = (t or "").encode()
            gone = np.zeros(len(b) + 1, bool)
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < (math.inf if i is None else i):
                    gone[p : p + 50] = True
            gone = gone[:-1]
            kept = bytes(x for x, g in zip(b, gone) if not g)
            want[(i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
        assert got == want
    assert repeats.remove_repeats(none).count() == 0


def test_license_sql_reads_versions_as_the_query(spark):
    import duckdb
    import pandas as pd

    texts = ["Licensed under the Mozilla Public License, v. 2.0. All rights reserved.", "under license V.  3 here. licensed.", "rev. 2 license. v. x license", "v.\n2 license", None, ""]
    want = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = c.execute(f"SELECT doc_id, sentence_ids, wrapped_ids, licenses, n_known, n_unknown FROM ({licenses.oracle()}) ORDER BY doc_id").fetchall()
    assert got == [tuple(r) for r in want]


def test_toxicity(spark, none):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        w = [word(rng) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "moron", "scum"]))
        texts.append((i, " ".join(w), "zz"))
        labels.append((i, int(toxic), 1))
    extra = [(400, None, "zz"), (401, "", "zz"), (None, "idiot scum", "zz"), (0, texts[0][1], "zz")]
    df = spark.createDataFrame(texts + extra, "doc_id long, text string, label_y string")
    lab = spark.createDataFrame([*labels, (7, None, 0), (None, 1, 0), (9999, 1, 0), (3, 0, 1)], "doc_id long, toxic int, quality int")
    learn = lambda c: crc_mod(c, 5) != 0
    got = toxicity.score_toxicity(df, lab, learn).toPandas()
    assert len(got) == len(texts) + len(extra) and got.score.between(0, 1).all() and got.score.notna().all()
    held = got[got.doc_id.notna() & (got.doc_id < 400)]
    held = held[[zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in held.doc_id]]
    assert (held.predicted == (held.doc_id % 5 == 0).astype(int)).mean() > 0.95
    assert got[got.doc_id.isna()].predicted.tolist() == [1]
    kept = toxicity.score_toxicity(df, lab, learn, keep_clean=True)
    assert kept.columns == df.columns and kept.count() == int((got.predicted == 0).sum())
    assert toxicity.score_toxicity(df, lab.where("toxic = 0"), learn).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score_toxicity(none, lab, learn).count() == 0
    assert toxicity.score_toxicity(df, lab.limit(0), learn).count() == len(texts) + len(extra)


def test_toxicity_covers_long_texts_across_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    text = "abc def " * 50
    whole = set(np.concatenate(list(toxicity.hashed(np.frombuffer((" " + text + " ").encode("utf-32-le"), np.uint32)))).tolist())
    assert set(toxicity.features(text).tolist()) == whole


def test_features_are_runs_of_characters():
    def slow(text):
        """Each run of 3 to 6 characters of the padded text, hashed letter by letter."""
        out, t = set(), f" {text.lower()} "
        for n in toxicity.ORDERS:
            for i in range(len(t) - n + 1):
                h = ord(t[i])
                for c in t[i + 1 : i + n]:
                    h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                x = ((h ^ n) * 0x9E3779B1) & 0xFFFFFFFF
                x ^= x >> 15
                out.add(((x * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
        return out

    for text in ("a", "汉", "汉字", "é", "Ünïcode texts 汉字 and \U0001f600 more", "abc abc", "\n"):
        assert set(toxicity.features(text).tolist()) == slow(text)
    assert len(toxicity.features("汉")) == 1 and len(toxicity.features("")) == len(toxicity.features(None)) == 0


def test_the_classifier_is_logistic_regression_over_scaled_counts():
    """The same steps on a dense table of features."""
    rng = random.Random(6)
    texts = [" ".join(word(rng) for _ in range(rng.randint(4, 25))) + rng.choice(["", " idiot"] if i % 3 else [" idiot", " scum 汉字"]) for i in range(60)]
    y = np.array([int(i % 3 == 0) for i in range(60)])
    model = toxicity.fit(texts, y, (300, 100), 1.0, 1e-4, 80)
    every = sorted(set().union(*(toxicity.features(t).tolist() for t in texts)))
    x = np.array([[f in own for f in every] for own in (set(toxicity.features(t).tolist()) for t in texts)], float)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    count = np.array([x[y == 0].sum(0), x[y == 1].sum(0)])
    a = count + 0.5
    r = np.log(a[1] / (n[1] + 1)) - np.log(a[0] / (n[0] + 1))
    keep = (np.abs(r) / np.sqrt(1 / a[0] + 1 / a[1]) >= 1.0) & (count.sum(0) >= 4)
    assert 10 < keep.sum() < len(every)
    x, r = x[:, keep] * r[keep], r[keep]
    w, b, m, v = np.zeros(len(r)), 0.0, np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    for t in range(1, 81):
        g = share * (1 / (1 + np.exp(-(b + x @ w))) - y)
        grad = np.append(x.T @ g + 1e-4 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    want = x @ w + b + np.log(100.5 / 300.5)
    assert np.allclose([toxicity.log_odds(t, model) for t in texts], want, atol=1e-4)
    assert ((np.array([toxicity.log_odds(t, model) for t in texts]) > 0) == (y == 1)).mean() > 0.8


def test_pii(spark, none):
    phone, mail = "+49 (030) 1234-5678", "jo.doe@mail4.example.com"
    texts = [
        (1, f"call {phone} now, later 030 1234 5678 or {mail} end"),
        (2, "card 4012 8888 8888 1881 and 4012888888881882 and ip 10.0.0.255 and 300.1.1.1"),
        (3, None),
        (4, ""),
        (5, "nothing here 4.0"),
        (5, "nothing here 4.0"),
        (None, "é é " + mail + " " + mail),
    ]
    more = [(100 + i, f"word word call +1 (2{i:02d}) 555-{1000 + i} word, mail a{i}@b{i % 7}.example.org and bare number {9000000000 + i * 37} in text") for i in range(150)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts + more], "doc_id long, text string, spans string, model string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(texts) + len(more)
    by_id = {r.doc_id: r.spans for r in got}
    text = texts[0][1]
    told = [(s.kind, text[s.start : s.end], s.base) for s in by_id[1]]
    assert ("phone", phone, True) in told and ("email", mail, True) in told
    assert ("phone", "030 1234 5678", False) in told  # found by its tie to the number above
    assert [(s.kind, texts[1][1][s.start : s.end]) for s in by_id[2] if s.base] == [("card", "4012 8888 8888 1881"), ("ip", "10.0.0.255")]
    assert by_id[3] == by_id[4] == by_id[5] == []
    assert [s.start for s in by_id[None]] == [4, 29]
    for i, t in more:
        assert [s.kind for s in by_id[i]] == ["phone", "email"], t
    clean = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert clean[1] == "call [PHONE] now, later [PHONE] or [EMAIL] end" and clean[3] is None and pii.redact_pii(df).columns == df.columns
    assert pii.find_pii(none).count() == 0


def test_loopy_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(5, pii.FEATURES)), rng.normal(size=(5, 5)), 1.5)
    feats = rng.normal(size=(4, pii.FEATURES)) * 0.2
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    got = pii.infer(field, feats, np.full(4, -1), chain, skip, rounds=200)
    p = np.zeros((4, 5))
    own = feats @ field.unary.T
    for y in itertools.product(range(5), repeat=4):
        w = math.exp(sum(own[i, y[i]] for i in range(4)) + sum(field.chain[y[a], y[b]] for a, b in chain) + field.skip * (y[0] == y[3]))
        for i in range(4):
            p[i, y[i]] += w
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("repeats", [12, 60, 400])
def test_pii_reaches_every_repeat(spark, repeats):
    phone, bare = "+49 (030) 1234-5678", "030 1234 5678"
    text = f"{bare} then {phone} end. " + f"again {bare} there. " * repeats
    more = [(100 + i, f"word call +1 (2{i:02d}) 555-{1000 + i} word and bare number {9000000000 + i * 37} in text") for i in range(80)]
    df = spark.createDataFrame([(1, text), *more], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert [s.kind for s in spans[1]] == ["phone"] * (repeats + 2)
    assert all([s.kind for s in spans[i]] == ["phone"] for i, _ in more)


def test_pii_training_hides_every_repeat():
    text = "call +49 (030) 1234-5678 " + "or 030 1234 5678 " * 5 + "and 9876 54321 0"
    graph = pii.Graph()
    base = pii.base_spans(text)
    graph.add(0, text, base, pii.candidates(text, base))
    assert graph.gold == [4, -1, -1, -1, -1, -1, 0]


def test_messages_settle_on_a_long_chain():
    field = pii.Field(np.zeros((5, pii.FEATURES)), np.zeros((5, 5)), 8.0)
    n = 120
    skip = np.array([[i, i + 1] for i in range(n - 1)])
    got = pii.infer(field, np.zeros((n, pii.FEATURES)), np.array([4] + [-1] * (n - 1)), np.array([[i, i + 1] for i in range(n - 1)]), skip)
    p = np.array([0, 0, 0, 0, 1.0])
    step = (np.full((5, 5), 1.0) + np.eye(5) * (np.exp(8.0) - 1)) / (np.exp(8.0) + 4)
    for i in range(n):
        assert np.allclose(got[i], p, atol=1e-2)
        p = p @ step


def test_licenses(spark, none):
    mit = "Copyright me\n\n" + "\n\n".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "as-is-warranty"))
    wrapped = mit.replace("free of charge, ", "free of charge,\n").replace("included in all copies", "included in\nall copies")
    texts = [(1, mit), (2, wrapped), (3, "Some text.\nReleased under the MIT License."), (4, "licensed to nobody. Bye."), (5, ""), (6, None), (7, licenses.SENTENCES["mit-notice"][0] + " " + licenses.SENTENCES["mit-grant"][0]), (8, "x. Licensed under CC BY-NC 4.0. All rights reserved."), (None, "All rights reserved."), (8, "x. Licensed under CC BY-NC 4.0. All rights reserved.")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in texts], "doc_id long, text string, lines string, licenses int")
    got = [(r.doc_id, r.licenses) for r in licenses.scan_licenses(df).collect()]
    want = ["MIT", "MIT", "MIT", "", "", "", "", "CC-BY-NC-4.0,Proprietary", "Proprietary", "CC-BY-NC-4.0,Proprietary"]
    assert got == list(zip([i for i, _ in texts], want))
    assert licenses.scan_licenses(none).count() == 0


def test_each_known_sentence_comes_back_as_its_own_identifier(spark):
    told = [(name, s) for name, sentences in licenses.SENTENCES.items() for s in sentences]
    texts = [f"The licence is told here. {s} More text." if s[-1] in ".;:" else f"The licence is told here. {s}" for _, s in told]
    wrapped = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v.\n2.0. If a copy of the MPL was not distributed with this file, you can get one."
    df = spark.createDataFrame([*enumerate(texts), (len(texts), wrapped)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].sentence_ids for i in range(len(texts))] == [name for name, _ in told]
    assert got[len(texts)].wrapped_ids == "mpl-2-subject" and got[len(texts)].licenses == "MPL-2.0"


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs, max_repeats=2.0).toPandas()
    size = Counter()
    for _, t, s, *_ in rows:
        size[s or ""] += len(tokens(t))
    taken = Counter()
    for s, n in zip(got.source.fillna(""), got.mix_tokens):
        taken[s] += n
    big = max(size, key=size.get)
    for s, n in size.items():
        want = n * (size[big] / n) ** (1 - alpha(size, 2.0))
        longest = max(len(tokens(t)) for _, t, x, *_ in rows if (x or "") == s)
        assert taken[s] <= want + 1 and taken[s] > want - 2 * longest and taken[s] >= n
    assert set(got.doc_id.dropna().astype(int)) == {r[0] for r in rows if r[0] is not None}
    again = mixing.mix(docs.repartition(2), max_repeats=2.0).toPandas()
    key = ["doc_id", "source", "mix_epoch", "mix_tokens"]
    assert sorted(map(repr, got[key].itertuples(index=False))) == sorted(map(repr, again[key].itertuples(index=False)))
    assert mixing.mix(none, max_repeats=2.0).count() == 0
    assert mixing.mix(docs, target_entropy=0.1).count() > 0
    some = mixing.mix(docs, max_repeats=3.0, budget=2000).agg(F.sum("mix_tokens")).first()[0]
    assert 0 < some <= 2000


@pytest.mark.parametrize("budget", [1.0, 1.5, 1.8, 2.0])
def test_a_budget_keeps_to_the_limit(spark, budget):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 20 else "small" if i % 40 else "tiny") for i in range(3000)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    whole = int(budget * sum(size.values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repeats=2.0, budget=whole).toPandas()
    times = Counter(zip(got.source, got.doc_id))
    assert max(times.values()) <= 2
    taken = Counter()
    for s, n in zip(got.source, got.mix_tokens):
        taken[s] += n
    assert whole - 8 * len(size) <= sum(taken.values()) <= whole  # each source's cut leaves less than its next document
    # the exponent is the smallest that keeps to it: a smaller one repeats the smallest source more
    a = mixing.bisect_exponent(spark.createDataFrame(list(size.items()), "source string, tokens long"), None, 2.0, whole)
    most = lambda x: max(whole * n**x / sum(v**x for v in size.values()) / n for n in size.values())
    assert most(a) <= 2 + 1e-9 and (a == 0 or most(max(a - 1e-4, 0)) > 2 or most(0) <= 2)
    for s, n in size.items():
        assert abs(taken[s] - whole * n**a / sum(v**a for v in size.values())) <= 9


def test_a_budget_beyond_the_limit_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs, max_repeats=2.0, budget=9)


@pytest.mark.parametrize("seed", [11, 5])
def test_passes_are_permutations_of_blocks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(1, 9), "big" if i % 9 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repeats=2.5, seed=seed).toPandas()
    size = {i: len(t.split()) for i, t, _ in rows}
    own = {i: s for i, _, s in rows}
    orders = {}
    for (s, e), g in got.groupby(["source", "mix_epoch"]):
        order = dict(zip(g.mix_block, g.mix_place))
        assert len({*zip(g.mix_block, g.mix_place)}) == len(order) == len({*order.values()})  # one place a block, one block a place
        assert min(order.values()) >= 0 and max(order.values()) < 1024
        orders[s, e] = order
        if e:
            assert order != {b: p for b, p in orders[s, e - 1].items() if b in order}  # another order each time
    block = dict(zip(got.doc_id, got.mix_block))  # every document comes once at least
    assert block.keys() == size.keys()
    for s in ("big", "small"):
        last = got[(got.source == s) & (got.mix_epoch == got[got.source == s].mix_epoch.max())]
        whole = defaultdict(set)
        for i, b in block.items():
            if own[i] == s:
                whole[b].add(i)
        here = last.groupby("mix_block").doc_id.apply(set).to_dict()
        full = [p for b, p in orders[s, last.mix_epoch.max()].items() if here[b] == whole[b]]
        part = [p for b, p in orders[s, last.mix_epoch.max()].items() if here[b] != whole[b]]
        assert len(part) <= 1 and all(p > max(full) for p in part)  # blocks are taken in order, and one is cut
        if len(here) < len(whole):  # the next in order was not taken whole because it does not fit
            quota = round(got[got.source == s].mix_weight.iloc[0] / got[got.source == "big"].mix_weight.iloc[0] * sum(n for i, n in size.items() if own[i] == "big"))
            assert quota - 30 <= got[got.source == s].mix_tokens.sum() <= quota + 1


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8, 9, "q", 3)], "doc_id long, text string, source string, mix_weight int, h int, n int, mix_source string, epoch int")
    (row,) = mixing.mix(docs, max_repeats=2.0).collect()
    assert (row.h, row.n, row.mix_source, row.epoch, row.mix_tokens, row.mix_weight) == (8, 9, "q", 3, 2, 1.0)


def alpha(size, limit):
    low, high = 0.0, 1.0
    n = [v for v in size.values() if v]
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (min(n) / max(n)) ** (mid - 1) > limit else (low, mid)
    return high


def test_entropy_bisection(spark):
    size = {"a": 1000, "b": 100, "c": 10}
    df = spark.createDataFrame(list(size.items()), "source string, tokens long")
    a = mixing.bisect_exponent(df, 0.9, None)
    w = np.array([v**a for v in size.values()])
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-3


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(700, 16)).astype(np.float32)
    m[50:80] = m[50]  # ties
    out = [(i, [float(x) for x in v], 1, 0.0) for i, v in enumerate(m)]
    out += [(700, None, 1, 0.0), (750, [1.0, None, *[0.0] * 14], 1, 0.0), (800, [float("nan")] * 16, 1, 0.0), (850, [float("inf")] * 16, 1, 0.0), (900, [0.0] * 16, 1, 0.0), (None, [1.0] * 16, 1, 0.0), (1000, [1.0, 2.0], 1, 0.0), out[3]]
    return out


VECTORS = "vec_id long, embedding array<float>, rank int, score double"


def test_exact_topk(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = exact_topk.exact_topk(df, lambda i: i % 50 == 0).toPandas()
    live = {i: np.floor(256 * np.array(v, float)) for i, v, *_ in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(live):
        if q % 50 == 0:
            s = sorted(((-int(live[q] @ live[c]), c) for c in live if c != q and len(live[c]) == len(live[q])))[:5]
            want += [(q, r, c, -x) for r, (x, c) in enumerate(s, 1)]
    assert sorted(got.itertuples(index=False, name=None)) == want
    assert exact_topk.exact_topk(df.limit(0), lambda i: i % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_topk.exact_topk(huge, lambda i: i == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


@pytest.mark.parametrize("sizes", [(1.0, 1e8), (1e-3, 1e5, 1e7, 1e9), (1.0, 1e30, 1e300), (1e306, 1e308), (1e6, 1e6)])
def test_exact_topk_of_large_values(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(i, [rng.uniform(-1, 1) * rng.choice(sizes) for _ in range(5)]) for i in range(240)]
    rows += [(i + 300, rows[i % 7][1]) for i in range(90)] + [(3, rows[9][1]), (20, rows[11][1]), (500, [0.0] * 5), (501, [1e308] * 5), (502, [-1e308] * 5), (503, [1e8] * 5)]
    got = exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), lambda i: i % 20 == 0, block=64, dims=2).toPandas()
    whole = [(i, [exact_topk.whole(x, 256.0) for x in v], v) for i, v in rows]
    asked = {i: min((v, n) for j, n, v in whole if j == i)[1] for i, _, _ in whole if i % 20 == 0}
    want = []
    for q, numbers in sorted(asked.items()):
        found = {}
        for i, n, _ in whole:
            if i != q:
                found[i] = max(found.get(i, -(1 << 63)), min(max(sum(x * y for x, y in zip(numbers, n)), -(1 << 63)), (1 << 63) - 1))
        want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted((-s, c) for c, s in found.items())[:5], 1)]
    assert sorted(got.itertuples(index=False, name=None)) == want


def test_a_large_value_costs_other_vectors_nothing():
    m = np.random.default_rng(2).normal(size=(500, 8))
    m[7, 3] = 1e8
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(m.tolist())], ["id", "vec"])
    shards = [(r["kind"], len(r["ids"]) // 8) for b in exact_topk.build(iter([batch]), 256.0, 8192, 8) for r in b.to_pylist()]
    assert sorted(shards) == [("int16", 499), ("raw", 1)]


def test_permutation_index(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = permutation_index.ann_topk(df, lambda i: i % 20 == 0).toPandas()
    live = {i: np.array(v, float) for i, v, *_ in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in (q for q in live if q % 20 == 0):
        mine = got[got.query_id == q].sort_values("rank")
        s = sorted(((-(live[q] * live[c]).sum(), c) for c in live if c != q and len(live[c]) == len(live[q])))[:20]
        assert len(mine) == len(s) and mine["rank"].tolist() == list(range(1, len(s) + 1)) and mine.vec_id.is_unique
        assert all(abs(x - (live[q] * live[c]).sum()) < 1e-9 for x, c in zip(mine.score, mine.vec_id))
        hits += len(set(mine.vec_id) & {c for _, c in s})
        total += len(s)
    assert hits / total >= 0.9
    assert permutation_index.ann_topk(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_permutation_index_finds_the_smallest_ids_of_a_group_of_copies(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(6000, 16))
    m[rng.permutation(6000)[:2000]] = m[0]  # larger than the share of a shard that is reranked
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").coalesce(1)
    group = np.flatnonzero((m == m[0]).all(axis=1))
    asked = group[:: len(group) // 20].tolist()
    got = permutation_index.ann_topk(df, lambda i: i.isin(asked)).toPandas()
    for q in asked:
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i in group if i != q][:20]


def test_base_spans_are_the_patterns_matches():
    # The base patterns as they are given.
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(8)
    for letters in ("a1.@-", "ab.@ %+", "12.", "0123456789. ", "25.@a1 .."):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            want = [(m.start(), m.end(), 0) for m in email.finditer(text)]
            want += [(m.start(), m.end(), 1) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
            assert [s for s in pii.base_spans(text) if s[2] < 2] == sorted(want, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("part", ["a", "1", "a.", "1.", "a@", "1 ", "+1", "(", "x-", "a1", "(at)"])
def test_long_unbroken_texts_take_linear_time(part):
    import time

    text, start = part * (1_000_000 // len(part)), time.perf_counter()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.perf_counter() - start < 20


def test_beliefs_do_not_depend_on_neighbouring_documents():
    rng = np.random.default_rng(6)
    field = pii.Field(rng.normal(size=(5, pii.FEATURES)), rng.normal(size=(5, 5)), 3.0)
    graphs = []
    for n in (3, 40, 7):
        chain = np.array([(i, i + 1) for i in range(n - 1)])
        skip = np.array([(i, j) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.2]).reshape(-1, 2)
        graphs.append((rng.normal(size=(n, pii.FEATURES)), np.where(rng.random(n) < 0.2, 1, -1), chain, skip))
    alone = [pii.infer(field, *g) for g in graphs]
    first = np.cumsum([0, 3, 40])
    both = pii.infer(field, np.concatenate([g[0] for g in graphs]), np.concatenate([g[1] for g in graphs]), np.concatenate([g[2] + f for g, f in zip(graphs, first)]), np.concatenate([g[3] + f for g, f in zip(graphs, first)]))
    assert np.array_equal(np.concatenate(alone), both)


def test_components_near_the_end_of_doubles(spark):
    df = spark.createDataFrame([(0, [1.7e308, -1.0]), (1, [9e307, 0.5]), (2, [-1e306, 3.0]), (50, [0.0, 0.01]), (51, [5e-324, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk.exact_topk(df, lambda i: i % 50 == 0).collect()}
    assert got[0, 1] == (1, (1 << 63) - 1) and got[0, 4] == (2, -(1 << 63))
    assert got[50, 1] == (2, 2 * 768) and got[50, 2] == (51, 2 * 512) and got[50, 4] == (0, -2 * 256)
