"""Extraction rules for identity documents, one JSON file per country or country and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve import schemas


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """``country_code, document_type, extraction_patterns`` of ``*_rules.json`` files.

    Country and type come from the file name (``us_id_card_rules.json``, ``us_rules.json``), which
    is what decides where a rule applies; a file for a whole country has an empty type.
    """
    raw = (
        spark.read.schema(schemas.EXTRACTION_RULE)
        .option("multiLine", True)
        .option("pathGlobFilter", "*_rules.json")
        .json(path)
    )
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)_rules\.json$", 1)
    return raw.select(
        F.substring_index(stem, "_", 1).alias("country_code"),
        F.when(F.instr(stem, "_") > 0, F.substr(stem, F.instr(stem, "_") + 1)).otherwise("").alias("document_type"),
        "extraction_patterns",
    )
