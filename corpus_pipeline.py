"""From documents to packed sequences: quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``docs``. ``run`` writes the result of each stage as Parquet to the cluster's checkpoint folder and reads
it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namesieve.llm import near_copies, nnls_packing, quality_rules, temperature_mix
from namesieve.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs, size_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return temperature_mix.mix(docs, result=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
#: No SQL: fingerprints (XXH64), tokenizer ids and the fitted packing are tested against brute force.
ORACLE_SQL = None
