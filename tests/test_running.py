"""Published lists, the bounded audit stream, the list that is reloaded, and log lines with their rejects."""

import os

import pytest
from pyspark.sql import functions as F

from namesieve.operators import aml, audit, combine, match, reports, snapshots
from namesieve.streaming import screening as stream

SCHEMA = "request_id string, event_type string, timestamp string, received timestamp"


def lists(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, name string")


def test_publications_are_whole_and_numbered(spark, tmp_path):
    target = str(tmp_path / "lists")
    assert snapshots.newest_version(spark, target) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read_current(spark, target)
    first = snapshots.publish(lists(spark, ("UN", "a"), ("UK", "b"), ("EU", "c")), target, "2024-01-01")
    second = snapshots.publish(lists(spark, ("UN", "d")), target, "2024-01-08", carry=["UK"])
    assert first < second == snapshots.newest_version(spark, target)
    read = lambda name=None: sorted(map(tuple, snapshots.read_current(spark, target, name).select("source", "name").collect()))
    assert read() == [("UK", "b"), ("UN", "d")]
    assert read(first) == [("EU", "c"), ("UK", "b"), ("UN", "a")]
    rows = {r.source: (r.records, r.version) for r in snapshots.manifest(spark, target).collect()}
    assert rows == {"UN": (1, "2024-01-08"), "UK": (1, "2024-01-01")}
    # A publication that ends before its manifest leaves no trace for readers.
    lists(spark, ("UN", "half")).write.partitionBy("source").parquet(f"{target}/data/broken")
    assert read() == [("UK", "b"), ("UN", "d")]
    third = snapshots.publish(lists(spark, ("UN", "e"), ("UK", "f")), target, "2024-01-15")
    assert snapshots.drop_older(spark, target, keep=1) and read() == [("UK", "f"), ("UN", "e")]
    assert [f for f in os.listdir(tmp_path / "lists" / "manifests") if not f.startswith(".")] == [third]


def test_read_latest_scans_only_the_newest_partitions(spark, tmp_path, capsys):
    path = str(tmp_path / "snap")
    rows = lists(spark, ("U N+1%", "old"), ("EU", "only"), (None, "none"))
    combine.write_snapshot(rows, path, "2024-01-01")
    combine.write_snapshot(rows.where("source <> 'EU'").withColumn("name", F.lit("new")), path, "2024-01-02")
    latest = combine.read_latest(spark, path)
    assert sorted(map(tuple, latest.select("source", "name").collect()), key=str) == [("EU", "only"), ("U N+1%", "new"), (None, "none")]
    latest.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [((" in plan and "Join" not in plan
    assert len(latest.inputFiles()) == len(spark.read.parquet(path).inputFiles())  # pruned when planned, not when listed


def test_late_and_repeated_events(spark, tmp_path):
    batches = [
        [("a", "x", "2024-01-01T10:00:00", "2024-01-01 10:00:01"), ("a", "x", "2024-01-01T10:00:00", "2024-01-01 10:00:02"), ("n", "x", None, "2024-01-01 11:00:00")],
        [(f"r{i}", "x", "2024-01-05T10:00:00", "2024-01-05 10:00:00") for i in range(20)],
        [("s", "x", "2024-01-12T10:00:00", "2024-01-12 10:00:00")],
        [("a", "x", "2024-01-01T10:00:00", "2024-01-20 10:00:00"), ("late", "x", "2024-01-01T12:00:00", "2024-01-20 10:00:00"),
         ("n", "x", None, "2024-01-20 10:00:01"), ("t", "x", "2024-01-20T10:00:00", "2024-01-20 10:00:02")],
        [("late", "x", "2024-01-01T12:00:00", "2024-01-30 10:00:00"), ("r3", "x", "2024-01-05T10:00:00", "2024-01-30 10:00:00")],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "request_id string, event_type string, timestamp string, received string")
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.audit_stream(source, str(tmp_path / "out"), str(tmp_path / "state"), within="1 day", arrived="received")
    query.awaitTermination()
    stored = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.request_id for r in stored.collect()) == sorted(["a", "n", "s", "late", "t", *[f"r{i}" for i in range(20)]])
    state = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    held = [s.numRowsTotal for s in state]
    assert max(held) >= 20 and held[-1] < 10  # keys go when they are too old
    assert any("rocksdb" in k for s in state for k in s.customMetrics)


def test_list_is_read_again_only_when_published(spark, tmp_path):
    target = str(tmp_path / "lists")
    needed = {c: F.lit("") for c in ("aliases", "dataid", "record_type", "last_updated", "processing_date")}
    rows = lists(spark, ("UN", "Ann")).withColumns(needed)
    rows = rows.withColumns({c: F.lit("") for c in combine.schemas.REQUIRED if c not in rows.columns})
    snapshots.publish(rows, target, "1")
    newest = stream.NewestList(spark, target)
    before = newest()
    assert newest() is before and before.count() == 1
    snapshots.publish(rows.union(rows), target, "2")
    assert newest().count() == 2 and newest() is not before
    newest().unpersist()


def test_lines_and_rejects(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"request_id":"a","event_type":"x"}\n\n{"request_id":"b","ev\nnoise\n[1]\n{"request_id":"c"}\n')
    lines = audit.scan_lines(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r.request_id for r in audit.events_of(lines).collect()) == ["a", "c"]
    rejects = {r.number: (r.reason, r.line) for r in audit.rejects_of(lines).collect()}
    assert rejects == {2: ("blank", ""), 3: ("cut off", '{"request_id":"b","ev'), 4: ("no JSON object", "noise"), 5: ("no JSON object", "[1]")}


def test_summary_joins_names_and_values_in_both_modes(spark):
    listed = spark.createDataFrame(
        [("1", "Ann Berg", "1970-01-01", "FR", "sanctions", "1970-01-01; 1971-02-02", "1980", "France")] * 3
        + [("2", "Ann Berg", "1970-01-02", "DE", "pep", "", "", "Germany"), ("3", "Other Person", "", "", None, "", "", "")],
        "dataid string, name string, dob string, country string, list_class string, dob_dates string, dob_years string, nationalities string",
    )
    people = spark.createDataFrame(
        [("a", "Berg Ann", "1970-01-01", "de"), ("b", "Ann Berg", "1980-05-05", ""), ("c", "Ann Berg", "", "fr"), ("d", None, "1970-01-01", "fr"), ("e", "Nobody", None, None)],
        "request_id string, full_name string, dob string, nationality string",
    )
    codes = spark.createDataFrame([("FR", "FRA", "France"), ("DE", "DEU", "Germany")], "alpha2 string, alpha3 string, name string")
    for mode in ("compat", "fixed"):
        summary = match.screen_summary(people, listed, mode=mode, countries=codes)
        assert set(people.columns) < set(summary.columns) and "nationality_name" not in summary.columns
        rolled = {r.request_id: r for r in match.match_rollup(match.screen_matches(people, listed, mode=mode, countries=codes)).collect()}
        for r in summary.collect():
            want = rolled.get(r.request_id)
            got = (r.match_count, r.high_count, r.any_dob, r.any_country)
            assert got == ((want.match_count, want.high_count, want.any_dob, want.any_country) if want else (0, 0, False, False))
        assert rolled["b"].any_dob == (mode == "fixed")


def test_response_parts_hold_every_match_once(spark):
    matches = spark.range(2500).select(F.lit("a").alias("request_id"), F.col("id").cast("string").alias("m"))
    matches = matches.union(spark.createDataFrame([("b", "x"), ("b", "x")], "request_id string, m string"))
    parts = aml.response_parts(matches, 500).collect()
    assert {r.parts for r in parts if r.request_id == "a"} == {5} and max(len(r.matches) for r in parts) < 700
    assert sorted(m.m for r in parts for m in r.matches if r.request_id == "a") == sorted(str(i) for i in range(2500))
    assert [[m.m for m in r.matches] for r in parts if r.request_id == "b"] == [["x", "x"]]


def test_figures_of_a_job_come_from_what_was_written(spark, tmp_path):
    figures = reports.measured(spark.range(1000), lambda df: df.write.parquet(str(tmp_path / "out")))
    assert figures["records"] == 1000 and figures["records_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
