"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm._work import discard, scratch, stash
from quillon.llm.stages import language_id, secret_redaction, sequence_packing, simhash_dedup, source_mix

STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

# Language models, fingerprints, Newton steps and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way goes when its result is written, and that when the next one is."""
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            done = stash(stage(spark, docs, sf_dir), name, kept=True)
        if docs is not first:
            discard(docs)
        docs = done
    return docs
