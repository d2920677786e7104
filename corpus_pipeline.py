"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import stages
from lodestone.llm.common import checkpoint

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("simhash", stages.keep_one_of_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("packing", stages.pack),
]
#: The first stage's model, the components and the token ids are beyond SQL. Tests hold line dedup, near-duplicates and
#: decontamination to brute force, the first stage to its operator's predictions, and the last to its contract.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
