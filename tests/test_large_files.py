"""Queries whose files are large enough for several splits or tasks."""

import glob
import os

from pyspark.sql import functions as F

from namesieve.catalog import files, running
from namesieve.operators import audit
from namesieve.sources import lines, ofac

FOLDER = "/root/testdata/sf0.001"


def _with_splits(spark, size, run):
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        return run()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_rejects_of_all_splits_are_found(spark):
    rows = _with_splits(spark, 8000, lambda: running.audit_rejects(spark, FOLDER).collect())
    ids = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id").collect())
    why = {3: "cut off", 5: "blank", 7: "no JSON object"}
    wanted = [(n, why[i % 10]) for n, i in enumerate(ids, 1) if i % 10 in why]
    assert sorted((r.number, r.reason) for r in rows) == wanted


def test_numbers_count_from_where_the_file_begins(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"request_id":"{i}"}}\nbad {i}\n' for i in range(500)))

    def numbers(**kw):
        return sorted(r.number for r in audit.rejects_of(audit.scan_lines(spark, str(tmp_path)), **kw).collect())

    assert _with_splits(spark, 1000, numbers) == sorted([2 * i + 2 for i in range(500)] * 2)
    assert _with_splits(spark, 1000, lambda: numbers(whole_log=True)) == [2 * i + 2 for i in range(1000)]


def test_log_is_written_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = running._log(spark, FOLDER).removeprefix("file:")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(glob.glob(f"{path}/part-*")) > 1


def test_un_file_holds_a_bounded_number_of_entries(spark):
    path = files._un_file(spark, FOLDER, entries=40)
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    read = spark.read.format("xml").option("rowTag", "INDIVIDUAL").load(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r[1] for r in read) == customers and max(r[1] for r in read) <= 40


def test_eu_rejects_writes_as_many_files_as_it_has_tasks(spark, monkeypatch):
    seen = []
    rejected_eu = running.eu.rejected_eu
    monkeypatch.setattr(running.eu, "rejected_eu", lambda s, path: seen.append(path) or rejected_eu(s, path))
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    got = running.eu_rejects(spark, FOLDER)
    wanted = lines.where("l_orderkey % 7 = 0").groupBy(F.col("l_orderkey").cast("string")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    parts = glob.glob(f"{seen[0].removeprefix('file:')}/part-*")
    heads = {open(p).readline().split(";")[0] for p in parts if os.path.getsize(p)}
    assert heads == {"fileGenerationDate"} and len(parts) < 8


def test_late_events_of_several_files_a_batch_are_stored_once(spark, monkeypatch):
    monkeypatch.setattr(running, "LATE_ROWS", 100, raising=False)
    wanted = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("event_id").cast("string"), "event_type")
    got = running.audit_stream_late(spark, FOLDER).select("request_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_aliases_and_addresses_are_shuffled_once(spark):
    from namesieve.sources import ofac

    order = "struct('f' AS file, 0L AS split, id AS row) AS ord"
    rows = spark.range(9).selectExpr(order, "string(id % 2) AS ent_num", "concat('a', id % 3) AS alt_reg_date", "'x' AS address", "'y' AS city_state_zip", "'z' AS country")
    for rolled in (ofac.alias_rollup(rows), ofac.address_rollup(rows)):
        plan = rolled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    assert {r.ent_num: (r.aliases, r.alias_text) for r in ofac.alias_rollup(rows).collect()}["1"] == ("A0; A1; A2", "A1 A0 A2 A1")


def test_whole_files_are_not_read_a_second_time(spark, tmp_path):
    import gzip

    text = "".join(f"{i},a b\n c{i}\n" for i in range(300))
    for name, body in (("a", text), ("b", "no start\n" + text)):
        with gzip.open(tmp_path / f"{name}.txt.gz", "wt") as out:
            out.write(body)
    rows = _with_splits(spark, 1000, lambda: lines.repaired_records(spark, str(tmp_path)).orderBy("ord").collect())
    assert [r.record for r in rows] == [f"{i},a b c{i}" for i in range(300)] + ["no start"] + [f"{i},a b c{i}" for i in range(300)]
    read = spark.read.text(str(tmp_path)).select("_metadata.file_block_length", "_metadata.file_size").distinct().collect()
    assert all(r.file_block_length == r.file_size for r in read)


def test_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "alt.csv").write_text('1,-0- ,x,"b, c",\n2,a,x,b,c,too,many\n')
    alt = ofac.scan_alt(spark, str(tmp_path)).where("alt_reg_date <> ''")
    assert [(r.ent_num, r.alt_type, r.alt_reg_date) for r in alt.collect()] == [("1", "", "b, c")]
    plan = alt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1
