"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm import centroids, licenses, rolling
from tallygrain.llm.common import crc_mod
from tallygrain.llm.exact_topk import exact_topk
from tallygrain.llm.katz import score_katz
from tallygrain.llm.mixing import mix
from tallygrain.llm.packing import pack_documents
from tallygrain.llm.permutation_index import ann_topk
from tallygrain.llm.pii import KINDS, find_pii
from tallygrain.llm.quality import judge
from tallygrain.llm.repeats import remove_repeats
from tallygrain.llm.simhash import near_duplicates
from tallygrain.llm.toxicity import score_toxicity
from tallygrain.session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_documents(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), lambda c: crc_mod(c, 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), max_repeats=2.0)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place", "mix_tokens", "mix_weight")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(read(spark, sf_dir, "documents"), lambda c: crc_mod(c, 10) == 0)


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_topk(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_medians(read(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_toxicity, op3_simhash, op4_temperature_mixing, op5_katz_backoff, op6_skip_chain_pii, op7_suffix_repeats, op8_license_rules, op9_permutation_index, op10_exact_topk, op11_quality_rules, op12_centroid_clustering, op13_rolling_median)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_license_rules": licenses.oracle(),
        "op12_centroid_clustering": centroids.oracle(),
        "op13_rolling_median": rolling.ORACLE,
        "op10_exact_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                       CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
    }
