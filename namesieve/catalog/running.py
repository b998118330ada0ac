"""Queries on what runs for long: streams, published lists, logs read back, and files and days that grow old."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve import schemas
from namesieve.catalog import files, lists
from namesieve.catalog import inputs as I
from namesieve.operators import audit, combine, reports, snapshots
from namesieve.plans.refresh import refresh_to
from namesieve.session import shared_folder
from namesieve.sources import eu
from namesieve.streaming.screening import NewestList, audit_stream, request_stream, screen_stream


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id, event_type, timestamp, received``: on time or twelve days late, and again after one or ten days."""
    rows = I.table(spark, folder, "events").selectExpr(
        "event_id", "CAST(event_id AS STRING) AS request_id", "event_type", "ts",
        """filter(array(CASE WHEN event_id % 13 = 0 THEN 12 ELSE 0 END, CASE WHEN event_id % 7 = 0 THEN 1 END,
                        CASE WHEN event_id % 11 = 0 THEN 10 END), d -> d IS NOT NULL) AS days""",
    )
    each = rows.select("*", F.explode("days").alias("day"))
    return each.select(
        "request_id",
        "event_type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        (F.col("ts") + F.expr("make_dt_interval(day)")).alias("received"),
    )


#: Rows of one file of late events.
LATE_ROWS = 250_000


def audit_stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Events in several batches of five days of arrival, keys kept for two days: each event is stored once.

    Some arrive ten or twelve days after they happened, for the first time or again.
    """
    base = shared_folder(spark, "late")
    rows = _delivered(spark, folder).withColumn("batch", F.floor(F.datediff("received", F.lit("2024-01-01")) / 5))
    rows = rows.persist()
    counts = {r[0]: r[1] for r in rows.groupBy("batch").count().collect()}
    # All batches have as many files, so a trigger of that many files is one batch; batches that are too small for it are one with others.
    each = -(-max(counts.values()) // LATE_ROWS)
    for n in sorted(counts):
        rows.where(F.col("batch") == n).drop("batch").repartition(each).write.mode("append").json(f"{base}/in")
    rows.unpersist()
    schema = "request_id string, event_type string, timestamp string, received timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).json(f"{base}/in")
    audit_stream(stream, f"{base}/out", f"{base}/state", within="2 days", arrived="received").awaitTermination()
    stored = spark.read.schema("request_id string, event_type string, timestamp string, event_date date").json(f"{base}/out")
    return stored.select("request_id", "event_type", "timestamp", F.col("event_date").cast("string").alias("event_date"))


def list_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Requests in two batches; a new list is published in between, and each batch is screened with its own."""
    base = shared_folder(spark, "reload")
    people = I.requests(spark, folder)
    odd = F.col("request_id").cast("long") % 2 == 1
    for part in (people.where(~odd), people.where(odd)):
        part.coalesce(1).write.mode("append").json(f"{base}/requests")
    whole = I.watchlist(spark, folder).withColumn("last_updated", F.lit("")).withColumn("processing_date", F.lit(""))
    whole = whole.withColumns({c: F.lit("") for c in schemas.REQUIRED if c not in whole.columns})
    snapshots.publish(whole.where(F.col("dataid").cast("long") % 3 > 0), f"{base}/lists", "2024-01-01")
    newest = NewestList(spark, f"{base}/lists")
    loads = []

    class Loader:
        """Publishes the whole list once the first batch has been screened."""

        @property
        def version(self):
            return snapshots.manifest(spark, f"{base}/lists", newest.version).first().version

        def __call__(self) -> DataFrame:
            if len(loads) == 1:
                snapshots.publish(whole, f"{base}/lists", "2024-01-08")
            loads.append(1)
            return newest()

    stream = request_stream(spark, f"{base}/requests", maxFilesPerTrigger=1)
    screen_stream(stream, Loader(), f"{base}/out", f"{base}/state").awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select("request_id", F.col("list_version").cast("string").alias("list_version"), "match_count")


def refresh_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The published list after three refreshes: whole; a critical source missing; a source that is not critical missing."""
    paths = {"UN": files._un_file(spark, folder), "OFAC": files._ofac_files(spark, folder), "UK": files._uk_file(spark, folder)}
    missing = f"{paths['UK']}-missing"
    target = shared_folder(spark, "published")
    seen = []
    for step, given in enumerate((paths, {**paths, "OFAC": dict.fromkeys(paths["OFAC"], missing)}, {**paths, "UK": missing})):
        refresh_to(spark, given, target, f"2024-01-0{step + 1}")
        entries = snapshots.read_current(spark, target).groupBy("source").agg(F.count("*").alias("entries"))
        seen.append(entries.withColumn("step", F.lit(step)))
    return seen[0].union(seen[1]).union(seen[2]).select("step", "source", "entries")


def latest_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of several snapshots per source; each source was last written on another day."""
    path = shared_folder(spark, "snapshots")
    rows = I.watchlist(spark, folder).select("source", "dataid", "name")
    for day, sources in (("2024-01-01", ["UN", "EU", "OFAC"]), ("2024-01-08", ["UN", "EU"]), ("2024-01-15", ["EU"])):
        dated = rows.where(F.col("source").isin(sources)).withColumn("name", F.concat("name", F.lit(f" {day}")))
        combine.write_snapshot(dated, path, day)
    return combine.read_latest(spark, path).select("source", "dataid", "name")


def _log(spark: SparkSession, folder: str) -> str:
    """Events as JSON lines, in files that follow one another; some are cut off, blank or no JSON."""
    path = shared_folder(spark, "log")
    rows = I.table(spark, folder, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), "event_type", F.col("value").alias("risk_score"))).alias("j")
    )
    k = F.col("event_id")
    line = F.when(k % 10 == 3, F.substring("j", 1, 20)).when(k % 10 == 5, F.lit("  ")).when(k % 10 == 7, F.lit("at line 7: no event"))
    rows.sort("event_id").select(line.otherwise(F.col("j")).alias("value")).write.text(path)
    return path


def audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a log that holds other lines too."""
    read = audit.read_events(spark, _log(spark, folder))
    return read.select("request_id", "event_type", F.round("risk_score", 6).alias("risk_score"))


def audit_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The other lines, with place and reason."""
    rejects = audit.rejects_of(audit.scan_lines(spark, _log(spark, folder)), whole_log=True)
    return rejects.select("number", "reason", F.trim("line").alias("line"))


def eu_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the EU layout with too many cells: every seventh entity's."""
    path = shared_folder(spark, "eu-rejects")
    raw = lists._raw_eu(spark, folder).drop("ord")
    line = F.concat_ws(";", *[F.coalesce(F.translate(c, ';"\n', "   "), F.lit("")) for c in raw.columns])
    entity = F.col("Entity_LogicalId").cast("long")
    # Every file starts with the header: it is the name of the only column.
    value = F.when(entity % 7 == 0, F.concat(line, F.lit(";one;more"))).otherwise(line)
    as_is = {"sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.select(value.alias(";".join(raw.columns))).write.csv(path, header=True, **as_is)
    rejected = eu.rejected_eu(spark, path).groupBy("Entity_LogicalId").agg(F.count("*").alias("rejected"))
    return rejected.select(F.col("Entity_LogicalId").alias("entity"), "rejected")


def eu_dates(spark: SparkSession, folder: str) -> DataFrame:
    """First and last designation of every entity of the EU layout, as dates."""
    dated = eu.with_dates(lists._raw_eu(spark, folder))
    day = F.col("Entity_DesignationDate")
    found = dated.groupBy(F.col("Entity_LogicalId").alias("entity")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return found.select("entity", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


def list_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of one source of a list that is found below a root only, read as screening reads it."""
    root = shared_folder(spark, "root")
    rows = I.watchlist(spark, folder)
    rows = rows.withColumns({c: F.lit("") for c in schemas.REQUIRED if c not in rows.columns})
    name = f"lists-{uuid.uuid4().hex}"  # no folder of this name where the query runs
    rows.write.parquet(f"{root}/{name}/combined")
    loaded = combine.load_search_list(spark, f"{name}/combined", root=root, format="parquet")
    return reports.rows_of_source(loaded, "EU").select("dataid", "search_name")


def newest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Of three lists written one after another the newest by time, its age eight days later, and its entries."""
    base = shared_folder(spark, "by-time")
    rows = I.watchlist(spark, folder).select("source", "dataid", "name")
    for n, day in enumerate(("20240115", "20240101", "20240108")):
        part = rows.where(F.col("dataid").cast("long") % 4 != n)
        part.write.mode("append").csv(f"{base}/combined_sanctions_{day}.csv", header=True)
    found = combine.file_table(spark, base, "part-*.csv").select("path", "modified")
    newest = combine.newest_file(spark, base)
    later = found.agg(F.max("modified") + F.expr("INTERVAL 8 DAYS")).first()[0]
    aged = combine.freshness(found, F.lit(later))
    entries = spark.read.csv(newest.rsplit("/", 1)[0], header=True).groupBy("source").agg(F.count("*").alias("entries"))
    picked = entries.select(F.regexp_extract(F.lit(newest), r"combined_sanctions_(\d+)", 1).alias("list"), "source", "entries")
    return picked.crossJoin(F.broadcast(aged.select("age_days", "needs_update")))  # one row


def expired_days(spark: SparkSession, folder: str) -> DataFrame:
    """A table of days whose partitions older than ten days are dropped; only names of partitions are read for it."""
    name, path = f"audit_{uuid.uuid4().hex[:12]}", shared_folder(spark, "days")
    dated = I.table(spark, folder, "events").select("event_id", "event_type", F.to_date("ts").cast("string").alias("event_date"))
    dated.write.partitionBy("event_date").option("path", path).saveAsTable(name)
    dropped = audit.drop_expired(spark, name, "2024-01-30", 10)
    kept = spark.table(name).groupBy("event_date").agg(F.count("*").alias("events")).withColumn("dropped_days", F.lit(len(dropped)))
    return kept


QUERIES = {
    f.__name__: f
    for f in (
        audit_stream_late,
        list_reload,
        refresh_failures,
        latest_partitions,
        audit_lines,
        audit_rejects,
        eu_rejects,
        eu_dates,
        list_fallback,
        newest_files,
        expired_days,
    )
}

ORACLES = {
    "audit_stream_late": """SELECT event_id::VARCHAR AS request_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
ts::DATE::VARCHAR AS event_date FROM events""",
    "list_reload": f"""WITH {I.SCREEN_SQL},
m AS (SELECT request_id, count(*) AS n FROM hits WHERE request_id::BIGINT % 2 = 1 OR dataid::BIGINT % 3 > 0 GROUP BY request_id)
SELECT request_id, CASE WHEN request_id::BIGINT % 2 = 1 THEN '2024-01-08' ELSE '2024-01-01' END AS list_version,
coalesce(n, 0)::BIGINT AS match_count FROM q LEFT JOIN m USING (request_id)""",
    "refresh_failures": """WITH c AS (SELECT (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM orders) AS entries)
SELECT step::INTEGER AS step, source, entries::BIGINT AS entries FROM (
SELECT unnest([0, 1, 2]) AS step, 'UN' AS source, people AS entries FROM c UNION ALL
SELECT unnest([0, 1, 2]), 'OFAC', entries FROM c UNION ALL SELECT unnest([0, 1]), 'UK', people FROM c)""",
    "latest_partitions": f"""SELECT source, dataid, name || CASE source WHEN 'EU' THEN ' 2024-01-15' WHEN 'UN' THEN ' 2024-01-08' ELSE ' 2024-01-01' END AS name
FROM ({I.WATCHLIST_SQL})""",
    "audit_lines": """SELECT event_id::VARCHAR AS request_id, event_type, round(value, 6) AS risk_score FROM events
WHERE event_id % 10 NOT IN (3, 5, 7)""",
    "audit_rejects": """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS number,
substr('{"request_id":"' || event_id || '","event_type":"' || event_type || '","risk_score":', 1, 20) AS cut FROM events)
SELECT number, CASE event_id % 10 WHEN 3 THEN 'cut off' WHEN 5 THEN 'blank' ELSE 'no JSON object' END AS reason,
CASE event_id % 10 WHEN 3 THEN cut WHEN 5 THEN '' ELSE 'at line 7: no event' END AS line FROM n WHERE event_id % 10 IN (3, 5, 7)""",
    "eu_rejects": """SELECT l_orderkey::VARCHAR AS entity, count(*) AS rejected FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1""",
    "eu_dates": """SELECT l_orderkey::VARCHAR AS entity, min(l_shipdate)::DATE::VARCHAR AS first, max(l_shipdate)::DATE::VARCHAR AS last
FROM lineitem GROUP BY 1""",
    "list_fallback": f"""SELECT dataid, upper(name) AS search_name FROM ({I.WATCHLIST_SQL}) WHERE source = 'EU'""",
    "newest_files": f"""SELECT '20240108' AS list, source, count(*) AS entries, 8.0::DOUBLE AS age_days, true AS needs_update
FROM ({I.WATCHLIST_SQL}) WHERE dataid::BIGINT % 4 <> 2 GROUP BY source""",
    "expired_days": """SELECT ts::DATE::VARCHAR AS event_date, count(*) AS events,
(SELECT count(DISTINCT ts::DATE) FROM events WHERE ts::DATE < DATE '2024-01-20')::INTEGER AS dropped_days
FROM events WHERE ts::DATE >= DATE '2024-01-20' GROUP BY 1""",
}
