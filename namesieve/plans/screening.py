"""Screening: a batch of people against the list, with audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.operators.aml import assess
from namesieve.operators.audit import aml_events


def screen_batch(requests: DataFrame, watchlist: DataFrame, **options) -> DataFrame:
    """``request_id`` with flags, score, level, factors and details."""
    return assess(requests, watchlist, **options)


def screening_events(assessed: DataFrame, timestamp: Column) -> DataFrame:
    """One audit event per screened request, its payload included."""
    payload = F.struct("full_name", "dob", "nationality")
    return aml_events(assessed.withColumn("payload", payload), timestamp, "payload")
