"""Audit events: building, cleaning, checking, storing and expiring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from namesieve import schemas
from namesieve.functions.text import fill, strip
from namesieve.sources.lines import file_order

# Size limits of logged payloads and the days audit data is kept.
MAX_TEXT, MAX_ITEMS, RETENTION_DAYS = 1000, 10, 30


def _is_image(name: str) -> bool:
    return name.endswith("_base64") or name.endswith("_image") or name == "image"


def image_marker(value: Column) -> Column:
    size = F.length(value.cast("string")).cast("string")
    return F.when(fill(value.cast("string")) != "", F.concat(F.lit("<base64_image_data: "), size, F.lit(" bytes>")))


def shorten(text: Column) -> Column:
    return F.when(
        F.length(text) > MAX_TEXT, F.concat(F.substring(text, 1, MAX_TEXT), F.lit("... (truncated)"))
    ).otherwise(text)


def sanitize(value: Column, kind: DataType, name: str = "") -> Column:
    """A loggable version of a column, walking its type.

    Image fields become a size marker, long strings are cut and marked, lists keep ten items and a
    note on the rest. Items of lists that hold structs become JSON text, since the note is text.
    """
    if name and _is_image(name):
        return image_marker(value)
    if isinstance(kind, StringType):
        return shorten(value)
    if isinstance(kind, StructType):
        fields = [sanitize(value[f.name], f.dataType, f.name).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        image = lambda k: k.endswith("_base64") | k.endswith("_image") | (k == "image")
        return F.transform_values(value, lambda k, v: F.when(image(k), image_marker(v)).otherwise(shorten(v)))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        nested = isinstance(inner, (StructType, MapType, ArrayType))
        plain = (lambda x: F.to_json(x)) if nested else (lambda x: x.cast("string"))
        clean = (lambda x: F.to_json(sanitize(x, inner))) if isinstance(inner, StructType) else plain
        more = F.concat(F.lit("... ("), (F.size(value) - MAX_ITEMS).cast("string"), F.lit(" more items)"))
        cut = F.concat(F.transform(F.slice(value, 1, MAX_ITEMS), plain), F.array(more))
        return F.when(F.size(value) > MAX_ITEMS, cut).otherwise(F.transform(value, clean))
    return value


def sanitized(df: DataFrame, column: str) -> Column:
    return sanitize(F.col(column), df.schema[column].dataType)


def build_events(
    df: DataFrame,
    event_type: str,
    timestamp: Column,
    data: list[str],
    payload: str | None = None,
    metadata: list[str] | None = None,
) -> DataFrame:
    """Events of one type: ``event_type, timestamp``, the data columns, metadata, payload as JSON."""
    columns = [F.lit(event_type).alias("event_type"), timestamp.alias("timestamp"), *data, *(metadata or [])]
    if payload:
        columns.append(F.to_json(sanitized(df, payload)).alias("request_payload"))
    return df.select(*columns)


def aml_events(assessed: DataFrame, timestamp: Column, payload: str | None = None) -> DataFrame:
    df = assessed.withColumn("status", F.lit("success"))
    data = "request_id status sanctions_match pep_match risk_score risk_level match_count".split()
    return build_events(df, "aml_screening", timestamp, data, payload)


def kyc_events(verified: DataFrame, timestamp: Column, payload: str | None = None) -> DataFrame:
    df = verified.withColumns(
        {
            "status": F.lit("completed"),
            "document_verified": F.coalesce("document_valid", F.lit(False)),
            "face_match": F.coalesce("face_matched", F.lit(False)),
        }
    )
    data = "request_id status risk_score risk_level document_verified face_match".split()
    return build_events(df, "kyc_verification", timestamp, data, payload)


def combined_events(combined: DataFrame, timestamp: Column, payload: str | None = None) -> DataFrame:
    df = combined.withColumns({"status": F.lit("success"), "risk_factors_count": F.size("risk_factors")})
    data = (
        "request_id status combined_risk_score combined_risk_level aml_risk_score aml_risk_level "
        "kyc_risk_score kyc_risk_level risk_factors_count"
    ).split()
    return build_events(df, "combined_risk_assessment", timestamp, data, payload)


def error_events(df: DataFrame, event_type: str, timestamp: Column, error: Column) -> DataFrame:
    """Events with status ``error`` for the rows whose ``error`` is not null."""
    failed = df.withColumns({"status": F.lit("error"), "error": error}).where(F.col("error").isNotNull())
    return build_events(failed, event_type, timestamp, ["request_id", "status", "error"])


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of JSON-lines files with its place and, if it holds no event, why: one scan for both outputs.

    ``ord, line, event, reason``; ``reason`` is null for an event, else ``blank``, ``cut off`` (it opens an object that
    is not closed) or ``no JSON object``. See :func:`events_of` and :func:`rejects_of`; persist the lines to use both.
    """
    schema = f"{schemas.AUDIT_EVENT}, _corrupt_record string"
    lines = spark.read.text(path).select(file_order().alias("ord"), F.col("value").alias("line"))
    parsed = lines.withColumn("event", F.from_json("line", schema))
    text = strip("line")
    bad = F.col("event").isNull() | F.col("event._corrupt_record").isNotNull()
    reason = (
        F.when(text == "", F.lit("blank"))
        .when(bad & text.startswith("{") & ~text.endswith("}"), F.lit("cut off"))
        .when(bad, F.lit("no JSON object"))
    )
    return parsed.withColumn("reason", reason)


def events_of(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("reason").isNull()).select("event.*").drop("_corrupt_record")


def rejects_of(lines: DataFrame, whole_log: bool = False) -> DataFrame:
    """``file, split, number, reason, line``: the number counts from 1 where the file begins.

    With ``whole_log`` it counts on from file to file, in the order of their paths. Only a row per split is ordered, so no
    line is sorted and no file passes through one task.
    """
    place = [F.col("ord.file").alias("file"), F.col("ord.split").alias("split")]
    splits = lines.groupBy(*place).agg(F.min("ord.row").alias("first"), F.count("*").alias("lines"))
    earlier = Window.orderBy("file", "split") if whole_log else Window.partitionBy("file").orderBy("split")
    so_far = F.coalesce(F.sum("lines").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (so_far - F.col("first") + 1).alias("_offset"))
    bad = lines.where(F.col("reason").isNotNull()).select(*place, F.col("ord.row").alias("row"), "reason", "line")
    counted = bad.join(starts, ["file", "split"])
    return counted.select("file", "split", (F.col("row") + F.col("_offset")).alias("number"), "reason", "line")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines events; blank and unreadable lines are left out."""
    return events_of(scan_lines(spark, path))


def write_events(events: DataFrame, path: str) -> None:
    """Append events as JSON, partitioned by type and day."""
    dated = events.withColumn("event_date", F.to_date(F.try_to_timestamp("timestamp")))
    dated.write.mode("append").partitionBy("event_type", "event_date").json(path)


def within_retention(events: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Events of the last ``days`` days; prunes partitions on ``event_date``."""
    return events.where(F.col("event_date") >= F.date_sub(as_of, days))


def drop_expired(spark: SparkSession, table: str, as_of: str, days: int = RETENTION_DAYS) -> list[str]:
    """Drop the day partitions of a catalog table that are older than ``days``; their dates."""
    cutoff = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string")).first()[0]
    dates = {p.partition.split("event_date=")[1].split("/")[0] for p in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    expired = sorted(d for d in dates if d < cutoff)
    for day in expired:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_date='{day}')")
    return expired


def completeness(events: DataFrame) -> DataFrame:
    """Add ``missing_fields, has_payload, complete, valid_timestamp`` to events.

    Every event needs a timestamp, a type and ``risk_score``; a match summary depends on the type.
    Combined events carry ``combined_risk_score`` instead and therefore count as lacking a score.
    """
    kind = fill("event_type")
    present = lambda *names: F.greatest(*[F.col(n).isNotNull() for n in names])
    summary = (
        F.when(kind == "kyc_verification", present("verification_result", "document_verified"))
        .when(kind == "aml_screening", present("sanctions_match", "match_count"))
        .when(kind == "combined_risk_assessment", F.col("combined_risk_score").isNotNull())
        .otherwise(False)
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("timestamp").isNull(), F.lit("Timestamp (timestamp)")),
            F.when(F.col("event_type").isNull(), F.lit("Event type (event_type)")),
            F.when(F.col("risk_score").isNull(), F.lit("Risk score (in data or top level) (risk_score)")),
            F.when(~summary, F.lit("Match summary")),
        )
    )
    return events.withColumns(
        {
            "missing_fields": missing,
            "has_payload": F.col("request_payload").isNotNull(),
            "valid_timestamp": F.try_to_timestamp(F.col("timestamp").cast("string")).isNotNull(),
        }
    ).withColumn("complete", F.size("missing_fields") == 0)


def coverage(events: DataFrame) -> DataFrame:
    """Totals with and without payload."""
    has = F.col("request_payload").isNotNull()
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(has).alias("with_payload"),
        F.count_if(~has).alias("without_payload"),
    )


def last_events(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most recent events."""
    return events.orderBy(F.desc("timestamp"), F.desc("request_id")).limit(n)


def _order(columns) -> Column:
    """By time; of events of one time the last in the order of their contents."""
    return F.struct("timestamp", F.to_json(F.struct(*columns)))


def latest_event(events: DataFrame, request_id: str, event_type: str | None = None) -> DataFrame:
    """The latest event of a request, optionally of one type; no row when there is none."""
    hits = events.where(F.col("request_id") == request_id)
    if event_type:
        hits = hits.where(F.col("event_type") == event_type)
    latest = hits.agg(F.max_by(F.struct(*events.columns), _order(events.columns)).alias("e"))
    return latest.where(F.col("e").isNotNull()).select("e.*")


def latest_events(events: DataFrame) -> DataFrame:
    """The latest event of every request and type."""
    rest = [c for c in events.columns if c not in ("request_id", "event_type")]
    latest = F.max_by(F.struct(*rest), _order(rest)).alias("e")
    return events.groupBy("request_id", "event_type").agg(latest).select("request_id", "event_type", "e.*")
