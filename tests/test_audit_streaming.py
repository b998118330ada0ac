import json

from pyspark.sql import functions as F

from namesieve.operators import audit, aml
from namesieve.plans.screening import screening_events
from namesieve.streaming import screening as stream

EVENTS = [
    {"event_type": "aml_screening", "timestamp": "2024-01-01T10:00:00", "request_id": "1", "risk_score": 10, "sanctions_match": True, "request_payload": "{}"},
    {"event_type": "kyc_verification", "timestamp": "2024-01-02T10:00:00", "request_id": "1", "risk_score": 5, "document_verified": False},
    {"event_type": "combined_risk_assessment", "timestamp": "later", "request_id": "2", "combined_risk_score": 7, "request_payload": "{}"},
    {"event_type": "aml_screening", "timestamp": "2024-01-03T10:00:00", "request_id": "1", "risk_score": 11},
]


def write_log(tmp_path):
    lines = [json.dumps(e) for e in EVENTS]
    (tmp_path / "audit.jsonl").write_text("\n".join([lines[0], "not json", "", *lines[1:]]))
    return str(tmp_path / "audit.jsonl")


def test_read_check_and_count(spark, tmp_path):
    events = audit.read_events(spark, write_log(tmp_path))
    assert events.count() == 4
    checked = audit.completeness(events).orderBy("timestamp").collect()
    assert [r.complete for r in checked] == [True, True, False, False]
    assert checked[2].missing_fields == ["Match summary"]
    assert checked[3].missing_fields == ["Risk score (in data or top level) (risk_score)"]
    assert [r.valid_timestamp for r in checked] == [True, True, True, False]
    assert tuple(audit.coverage(events).first()) == (4, 2, 2)
    assert [r.timestamp for r in audit.last_events(events, 2).collect()] == ["later", "2024-01-03T10:00:00"]
    assert audit.latest_event(events, "1").first().risk_score == 11
    assert audit.latest_event(events, "1", "kyc_verification").first().risk_score == 5
    assert audit.latest_event(events, "9").count() == 0


def test_sanitize(spark):
    schema = (
        "id int, p struct<note:string, doc_image:string, face_base64:string, n:int, tags:array<string>, "
        "items:array<struct<image:string, k:string>>, meta:map<string,string>>"
    )
    rows = [
        (1, ("x" * 1001, "abc", "", 5, [str(i) for i in range(12)], [("zz", "y" * 1001)], {"image": "q", "k": "v" * 1001})),
        (2, ("ok", None, None, None, ["a"], [("zz", "k")] * 11, None)),
        (3, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r.p for r in df.select("id", audit.sanitized(df, "p").alias("p")).collect()}
    a, b = got[1], got[2]
    assert a.note == "x" * 1000 + "... (truncated)"
    assert (a.doc_image, a.face_base64, a.n) == ("<base64_image_data: 3 bytes>", None, 5)
    assert a["tags"] == [str(i) for i in range(10)] + ["... (2 more items)"]
    assert json.loads(a["items"][0]) == {"image": "<base64_image_data: 2 bytes>", "k": "y" * 1000 + "... (truncated)"}
    assert a.meta == {"image": "<base64_image_data: 1 bytes>", "k": "v" * 1000 + "... (truncated)"}
    assert len(b["items"]) == 11 and json.loads(b["items"][0]) == {"image": "zz", "k": "k"} and b["items"][10] == "... (1 more items)"
    assert got[3] is None


def test_write_and_retain(spark, tmp_path):
    events = audit.read_events(spark, write_log(tmp_path)).where("timestamp <> 'later'")
    audit.write_events(events, str(tmp_path / "out"))
    audit.write_events(events.limit(1), str(tmp_path / "out"))
    stored = spark.read.json(str(tmp_path / "out"))
    assert stored.count() == 4 and (tmp_path / "out" / "event_type=aml_screening").exists()
    kept = audit.within_retention(stored, F.lit("2024-01-12").cast("date"), 10)
    assert {str(r.event_date) for r in kept.select("event_date").distinct().collect()} == {"2024-01-02", "2024-01-03"}


def test_drop_expired(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS audit_days")
    df = spark.range(3).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") + 1).cast("string")).alias("event_date"))
    df.write.partitionBy("event_date").option("path", str(tmp_path / "t")).saveAsTable("audit_days")
    assert audit.drop_expired(spark, "audit_days", "2024-02-02", 30) == ["2024-01-01", "2024-01-02"]
    assert [r.id for r in spark.table("audit_days").collect()] == [2]
    spark.sql("DROP TABLE audit_days")


REQUESTS = [("a", "Eric Badege", "1971-01-01", "QA"), ("b", "John Smith", "1980-01-01", "US"), ("c", "Erik Badege", "", "")]
SCHEMA = "request_id string, full_name string, dob string, nationality string"


def watchlist(spark):
    return spark.createDataFrame([("1", "UN", "ERIC BADEGE")], "dataid string, source string, name string")


def test_events_of_a_batch(spark):
    people = spark.createDataFrame(REQUESTS, SCHEMA)
    events = screening_events(aml.assess(people, watchlist(spark)), F.lit("2024-01-01T00:00:00"))
    rows = {r.request_id: r for r in events.collect()}
    assert rows["a"].status == "success" and rows["a"].sanctions_match and rows["a"].risk_score == 80
    assert json.loads(rows["c"].request_payload)["full_name"] == "Erik Badege"
    failed = audit.error_events(people, "aml_screening", F.lit("t"), F.when(F.col("dob") == "", F.lit("no dob")))
    assert [tuple(r) for r in failed.collect()] == [("aml_screening", "t", "c", "error", "no dob")]


def test_stream_equals_batch(spark, tmp_path):
    people = spark.createDataFrame(REQUESTS, SCHEMA)
    for name, *_ in REQUESTS:
        people.where(F.col("request_id") == name).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    requests = stream.request_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    loads = []

    def load():
        loads.append(1)
        return watchlist(spark)

    query = stream.screen_stream(requests, load, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    pick = ["request_id", "risk_score", "risk_level", "match_count", "details"]
    streamed = spark.read.parquet(str(tmp_path / "out"))
    want = aml.assess(stream.request_batch(spark, str(tmp_path / "in")), watchlist(spark))
    assert sorted(streamed.select(*pick).collect()) == sorted(want.select(*pick).collect())
    assert len(loads) == streamed.select("batch_id").distinct().count() > 1


def test_audit_stream_keeps_one_event(spark, tmp_path):
    events = [("a", "aml_screening", "2024-01-01T10:00:00"), ("a", "aml_screening", "2024-01-01T10:00:01"), ("a", "kyc", "2024-01-01T10:00:02")]
    schema = "request_id string, event_type string, timestamp string"
    spark.createDataFrame(events, schema).repartition(3, "timestamp").write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream.audit_stream(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.request_id, r.event_type) for r in stored.collect()) == [("a", "aml_screening"), ("a", "kyc")]
