"""The registered queries and the pipeline's stages on small tables: columns, digests and what each stage keeps."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallygrain.llm import pii, queries


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(160):
        text = words(rng, rng.randint(30, 160))
        if i % 4 == 0:
            text += " you idiot moron scum"
        if i % 10 == 3:
            text += f" mail a{i}@b.example.org or call +1 (212) 555-{1000 + i} from 10.0.{i}.1, later 1212555{1000 + i}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200 + i, rows[i][1], "en", "s1", rows[i][4]) for i in (1, 2, 3)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (None, words(rng, 40), "en", "s0", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)], i % 3) for i in range(300)]
    spark.createDataFrame([*vectors, (301, None, 0), (302, [0.0] * 8, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, rows


COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_temperature_mixing": ["doc_id", "source", "mix_epoch", "mix_block", "mix_place", "mix_tokens", "mix_weight"],
    "op5_katz_backoff": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_skip_chain_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_suffix_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_license_rules": None,
    "op9_permutation_index": ["query_id", "rank", "vec_id", "score"],
    "op10_exact_topk": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, tables, name):
    d, rows = tables
    out = queries.queries()[name](spark, d)
    assert COLUMNS[name] is None or out.columns == COLUMNS[name]
    got = out.collect()
    if name in ("op2_toxicity", "op3_simhash", "op5_katz_backoff", "op6_skip_chain_pii", "op7_suffix_repeats", "op8_license_rules"):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    if name == "op2_toxicity":
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
        assert all(r.predicted == int(r.score >= 0.5) for r in got)
    if name == "op9_permutation_index":
        assert len(got) == 15 * 20 and all(r.query_id != r.vec_id for r in got)


def test_personal_data_digest(spark, tables):
    d, rows = tables
    texts = {r[0]: r[1] or "" for r in rows}
    for r in queries.op6_skip_chain_pii(spark, d).collect():
        base = pii.base_spans(texts[r.doc_id])
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for *_, k in base) for i in range(4)]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {*told} <= {*r.spans.split(",")} or not told
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))


def test_each_stage_of_the_pipeline(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, d)
    rejected = {r.doc_id for r in queries.op2_toxicity(spark, d).collect() if r.predicted == 1}
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in rejected)
    assert len(rejected & {*range(0, 160, 4)}) >= 38 and len(rejected & {i for i in range(160) if i % 4}) <= 12  # of 128 labels

    once = stages["near_duplicates"](spark, clean, d)
    assert once.columns == docs.columns
    gone = {r.doc_id for r in clean.collect()} - {r.doc_id for r in once.collect()}
    assert gone == {201, 202, 203, 301} - rejected  # the copies, and of the two empty texts the later

    bare = stages["pii"](spark, once, d)
    assert bare.columns == docs.columns and bare.count() == once.count()
    assert not any(pii.base_spans(r.text or "") for r in bare.collect())
    before = {r.doc_id: r for r in once.collect()}
    assert all(r == before[r.doc_id] for r in bare.collect() if "[EMAIL]" not in (r.text or ""))
    assert sum("[EMAIL]" in (r.text or "") for r in bare.collect()) == sum("@" in (r.text or "") for r in before.values())

    mixed = stages["mixing"](spark, bare, d)
    assert mixed.columns == docs.columns
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count.keys() == before.keys() and set(count.values()) <= {1, 2}

    packed = stages["packing"](spark, mixed, d).toPandas()
    assert packed.groupby("doc_id", dropna=False).size().sum() >= sum(count.values())
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all() and g.length.sum() <= 1024

    whole = corpus_pipeline.run(spark, d).toPandas()
    assert sorted(whole.length) == sorted(packed.length) and set(whole.doc_id.dropna()) == set(packed.doc_id.dropna())
