"""The corpus pipeline: toxicity filter, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrain.llm.common import Scratch, crc_mod
from tallygrain.llm.copies import first_of_copies
from tallygrain.llm.mixing import mix
from tallygrain.llm.packing import pack_documents
from tallygrain.llm.pii import redact_pii
from tallygrain.llm.toxicity import score_toxicity
from tallygrain.session import ship

#: Trained models and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the columns stay as they are."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, lambda c: crc_mod(c, 5) != 0, keep_clean=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of five-word shingles within the radius, and a similarity of
    0.8 or more. That of the smallest doc_id stays, one without an id where no other is in the group."""
    return first_of_copies(docs, words=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, by temperature."""
    return mix(docs, max_repeats=2.0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and their places in sequences of 1024."""
    from public_tokenizers import path

    return pack_documents(docs, path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written to the shared folder and read again."""
    docs, scratch = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline", frees=True)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
