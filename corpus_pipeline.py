"""The corpus pipeline: toxicity, language, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; after mixing, a document has a row for each copy
that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import language, mixing, pieces, simhash, toxicity
from tidewire.llm.shared import cut, table

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("language", language.keep_known),
    ("near_duplicates", simhash.keep_one),
    ("mixing", mixing.mixed),
    ("pieces", pieces.encoded),
]

#: Trained models, fingerprints and permuted draws can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
