"""A cleaning pipeline over documents: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder and
reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import language, minhash, packing, suffix
from tessella.llm.util import materialize, table
from tessella.shipping import ship


def _stage(f):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [
    ("language identification", _stage(language.stage)),
    ("near-duplicates", _stage(minhash.stage)),
    ("repeated strings", _stage(suffix.stage)),
    ("packing", _stage(packing.stage)),
]

#: A language model, bottom-k sketches and byte strings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
