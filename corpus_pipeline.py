"""The corpus pipeline: each stage reads what its predecessor kept and wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, exact_dedup, language_id, minhash_dedup, mixing, packing

STAGES = [
    ("language", language_id.language_stage),
    ("exact_dedup", exact_dedup.exact_dedup_stage),
    ("near_dedup", minhash_dedup.near_dedup_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

#: The language stage's network has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
