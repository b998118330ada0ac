"""Queries on the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.inputs import REQUESTS_SQL, requests, table
from namesieve.operators import audit
from namesieve.session import shared_folder
from namesieve.streaming.screening import audit_stream

KINDS = {"view": "aml_screening", "signup": "kyc_verification", "purchase": "combined_risk_assessment"}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the audit layout; a fifth of them lack this or that."""
    kind = F.col("event_type")
    n = F.get_json_object("props", "$.k").cast("int")
    mapped = F.when(kind == "error", F.lit(None).cast("string")).otherwise(kind)
    for own, name in KINDS.items():
        mapped = F.when(kind == own, name).otherwise(mapped)
    present = lambda test, value: F.when(test, value)
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.when(n % 10 != 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        mapped.alias("event_type"),
        present(n % 5 != 0, F.col("value")).alias("risk_score"),
        present(n % 4 != 0, F.col("props")).alias("request_payload"),
        F.lit(None).cast("string").alias("verification_result"),
        present(n % 6 != 0, n > 50).alias("document_verified"),
        present(n % 6 != 0, n > 20).alias("sanctions_match"),
        F.lit(None).cast("bigint").alias("match_count"),
        present(n % 6 != 0, F.col("value")).alias("combined_risk_score"),
        F.col("user_id"),
    )


def audit_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts as request payloads: long text, an image, a long list and a short one."""
    words = F.split("text", " ")
    payload = F.struct(
        F.col("text").alias("note"),
        F.col("source").alias("selfie_image"),
        words.alias("words"),
        F.struct(F.upper("lang").alias("language"), F.slice(words, 1, 3).alias("head")).alias("nested"),
    )
    docs = table(spark, folder, "documents").withColumn("payload", payload)
    clean = docs.select("doc_id", audit.sanitized(docs, "payload").alias("p"))
    return clean.select(
        "doc_id",
        "p.note",
        "p.selfie_image",
        F.array_join("p.words", " ").alias("words"),
        F.col("p.nested.language").alias("language"),
        F.array_join("p.nested.head", " ").alias("head"),
    )


def audit_completeness(spark: SparkSession, folder: str) -> DataFrame:
    checked = audit.completeness(_events(spark, folder))
    return checked.select(
        "request_id",
        F.array_join("missing_fields", "; ").alias("missing_fields"),
        "has_payload",
        "valid_timestamp",
        "complete",
    )


def audit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return audit.coverage(_events(spark, folder))


def last_events(spark: SparkSession, folder: str) -> DataFrame:
    return audit.last_events(_events(spark, folder)).select("request_id", "timestamp", "event_type")


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of every user and type."""
    per_user = _events(spark, folder).withColumn("request_id", F.col("user_id").cast("string"))
    return audit.latest_events(per_user).select("request_id", "event_type", "timestamp")


def retained_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last ten days before a fixed day."""
    dated = table(spark, folder, "events").withColumn("event_date", F.to_date("ts"))
    kept = audit.within_retention(dated, F.lit("2024-01-30").cast("date"), 10)
    return kept.groupBy("event_type").agg(F.count("*").alias("events"))


def error_events(spark: SparkSession, folder: str) -> DataFrame:
    """An error event for every request without a date of birth."""
    reason = F.when(F.col("dob") == "", F.lit("dob is required"))
    stamp = F.lit("2024-02-01T00:00:00")
    return audit.error_events(requests(spark, folder), "aml_screening", stamp, reason)


def built_events(spark: SparkSession, folder: str) -> DataFrame:
    """Screening events of all requests with their payload as JSON."""
    people = requests(spark, folder)
    shaped = people.withColumns(
        {
            "payload": F.struct("full_name", "dob", "nationality"),
            "sanctions_match": F.lit(False),
            "pep_match": F.lit(False),
            "risk_score": F.lit(0),
            "risk_level": F.lit("low"),
            "match_count": F.lit(0).cast("bigint"),
        }
    )
    built = audit.aml_events(shaped, F.lit("2024-02-01T00:00:00"), "payload")
    return built.select("event_type", "timestamp", "request_id", "status", "risk_score", "request_payload")


def _stream_rows() -> dict[str, Column]:
    return {
        "request_id": F.col("user_id").cast("string"),
        "event_type": F.col("event_type"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }


def audit_stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Events arriving in several batches and out of order, stored once per user and type, as (user, type)."""
    base = shared_folder(spark, "audit")
    cells = [c.alias(n) for n, c in _stream_rows().items()]
    table(spark, folder, "events").select(*cells).repartition(4, "timestamp").write.parquet(
        f"{base}/events"
    )
    reader = spark.readStream.schema("request_id string, event_type string, timestamp string")
    stream = reader.option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    audit_stream(stream, f"{base}/out", f"{base}/state").awaitTermination()
    stored = spark.read.schema("request_id string, event_type string").json(f"{base}/out")
    return stored.select("request_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        audit_sanitize,
        audit_completeness,
        audit_coverage,
        last_events,
        latest_events,
        retained_events,
        error_events,
        built_events,
        audit_stream_once,
    )
}

_EVENTS = """
e AS (SELECT event_id, user_id, ts, value, props, json_extract_string(props, '$.k')::INT AS n,
  CASE event_type WHEN 'view' THEN 'aml_screening' WHEN 'signup' THEN 'kyc_verification' WHEN 'purchase' THEN 'combined_risk_assessment'
    WHEN 'error' THEN NULL ELSE event_type END AS kind FROM events),
a AS (SELECT event_id::VARCHAR AS request_id, user_id, kind AS event_type,
  CASE WHEN n % 10 <> 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, n % 5 <> 0 AS has_score, n % 4 <> 0 AS has_payload,
  n % 6 <> 0 AND kind IN ('aml_screening', 'kyc_verification', 'combined_risk_assessment') AS has_summary FROM e)
"""

ORACLES = {
    "audit_sanitize": """SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... (truncated)' ELSE text END AS note,
'<base64_image_data: ' || length(source) || ' bytes>' AS selfie_image,
CASE WHEN len(string_split(text, ' ')) > 10 THEN array_to_string(string_split(text, ' ')[1:10], ' ') || ' ... (' || (len(string_split(text, ' ')) - 10)
  || ' more items)' ELSE text END AS words, upper(lang) AS language, array_to_string(string_split(text, ' ')[1:3], ' ') AS head FROM documents""",
    "audit_completeness": f"""WITH {_EVENTS}, m AS (SELECT *, list_filter([CASE WHEN timestamp IS NULL THEN 'Timestamp (timestamp)' END,
CASE WHEN event_type IS NULL THEN 'Event type (event_type)' END, CASE WHEN NOT has_score THEN 'Risk score (in data or top level) (risk_score)' END,
CASE WHEN has_summary IS NOT TRUE THEN 'Match summary' END], lambda z: z IS NOT NULL) AS miss FROM a)
SELECT request_id, array_to_string(miss, '; ') AS missing_fields, has_payload, timestamp IS NOT NULL AS valid_timestamp, len(miss) = 0 AS complete FROM m""",
    "audit_coverage": f"""WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (has_payload) AS with_payload,
count(*) FILTER (NOT has_payload) AS without_payload FROM a""",
    "last_events": f"""WITH {_EVENTS} SELECT request_id, timestamp, event_type FROM a ORDER BY timestamp DESC NULLS LAST, request_id DESC LIMIT 10""",
    "latest_events": f"""WITH {_EVENTS} SELECT user_id::VARCHAR AS request_id, event_type, max(timestamp) AS timestamp FROM a
GROUP BY ALL""",
    "retained_events": """SELECT event_type, count(*) AS events FROM events WHERE ts::DATE >= DATE '2024-01-20' GROUP BY event_type""",
    "error_events": f"""SELECT 'aml_screening' AS event_type, '2024-02-01T00:00:00' AS timestamp, request_id, 'error' AS status, 'dob is required' AS error
FROM ({REQUESTS_SQL}) WHERE dob = ''""",
    "built_events": f"""SELECT 'aml_screening' AS event_type, '2024-02-01T00:00:00' AS timestamp, request_id, 'success' AS status, 0::INTEGER AS risk_score,
'{{"full_name":"' || full_name || '","dob":"' || dob || '","nationality":"' || nationality || '"}}' AS request_payload FROM ({REQUESTS_SQL})""",
    "audit_stream_once": """SELECT DISTINCT user_id::VARCHAR AS request_id, event_type FROM events""",
}
