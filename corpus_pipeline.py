"""The training corpus as stages: language, near-duplicates, benchmark, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. Documents keep their columns throughout; the last stage adds the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsieve.llm import decontaminate, langid, mixing, near_dup, secrets
from fieldsieve.llm.common import materialize, release, scratch, shared_dir, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no learned language is found: without a letter, or much farther from their
    nearest profile than the texts it was learned from. Where none was learned, those without a letter.
    Documents that stay and have no lang get the one that was found."""
    small_batches(spark)
    profiles = langid.learn(docs.select("lang", "text"))
    if not profiles:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    row = docs.select(F.struct(*docs.columns).alias("row"), "lang", "text")  # the documents' own columns, whatever their names
    scored = materialize(langid.predict(row, profiles).drop("text"))
    kept = langid.far(scored).filter(~F.col("far"))
    found = F.coalesce("row.lang", "lang_pred").alias("lang")
    return kept.select(*[found if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first document of each near-duplicate class."""
    small_batches(spark)
    return near_dup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document goes."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and all other columns, and size, source_size, target, taken and copies."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secret_spans),
    ("mixing", mixture),
]
ORACLE_SQL = None  # profiles, samples and fingerprints have no SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages. What a stage leaves is deleted when the next one's is written; the last stays, as it is the result."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        release(before)
        docs = before = spark.read.parquet(f"{folder}/{i}")
        before.kept_at = f"{folder}/{i}"
    return docs
