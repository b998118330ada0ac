"""Screening of a stream of requests against the newest list, and the audit stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from namesieve import schemas
from namesieve.operators.combine import search_list
from namesieve.operators.snapshots import newest_version, read_current
from namesieve.plans.screening import screen_batch


def request_stream(spark: SparkSession, path: str, schema: str = schemas.AML_REQUEST, **options) -> DataFrame:
    """Requests arriving as JSON files."""
    return spark.readStream.schema(schema).options(**options).json(path)


def request_batch(spark: SparkSession, path: str, schema: str = schemas.AML_REQUEST) -> DataFrame:
    return spark.read.schema(schema).json(path)


def screen_stream(
    requests: DataFrame,
    load_list: Callable[[], DataFrame],
    output: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Screen every micro-batch against the list as it is when the batch starts.

    A request is complete within its batch, so no state is kept. Each batch is written to its own
    ``batch_id`` partition and replaces it, so a batch repeated after a failure leaves no
    duplicates. A loader with a ``version`` (:class:`NewestList`) has it written as ``list_version``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read more than once while it is screened
        try:
            assessed = screen_batch(batch, load_list(), **options).withColumn("batch_id", F.lit(batch_id))
            if hasattr(load_list, "version"):
                assessed = assessed.withColumn("list_version", F.lit(load_list.version))
            writer = assessed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch_id").parquet(output)
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class NewestList:
    """Loader for :func:`screen_stream`: the newest published list, read anew only when another one was published."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target
        self.version: str | None = None
        self._rows: DataFrame | None = None

    def __call__(self) -> DataFrame:
        newest = newest_version(self.spark, self.target)
        if self._rows is None or newest != self.version:
            if self._rows is not None:
                self._rows.unpersist()
            self._rows = search_list(read_current(self.spark, self.target, newest)).persist()
            self.version = newest
        return self._rows


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ["request_id", "event_type"]


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, not in the executors' heaps."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def audit_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    within: str | None = None,
    arrived: str | None = None,
) -> StreamingQuery:
    """Append events as JSON by type and day, each (request, type) once. No event is lost, however late it comes.

    By default the state holds a key per request and type for ever. ``within`` (such as ``2 days``) bounds it: keys are
    kept that long after an event's *arrival* (the column ``arrived``, or the time of the batch), which never lies
    behind the watermark, so the state drops no event for being late. It does not know events that came before; an
    event older than ``within`` on arrival may be a repeat of such a one, and is compared with what is stored for its
    own day. Requests of one id are taken to be of one day then, as repeats of an event are.
    """
    spark = events.sparkSession
    timed = events.withColumn("event_time", F.try_to_timestamp(F.col("timestamp").cast("string")))
    dated = timed.withColumn("event_date", F.to_date("event_time"))
    trigger = trigger or {"availableNow": True}
    if within is None:
        once = dated.drop("event_time").dropDuplicates(_EVENT)
        writer = once.writeStream.format("json").partitionBy("event_type", "event_date").option("path", path)
    else:
        seen = F.col(arrived).cast("timestamp") if arrived else F.current_timestamp()
        recent = dated.withColumn("_arrived", seen).withWatermark("_arrived", within).dropDuplicatesWithinWatermark(_EVENT)
        writer = recent.writeStream.foreachBatch(_merged_into(path, within))
    with _state_on_disk(spark):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _merged_into(path: str, within: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's events; the late ones only if their day has none of the same key from another batch.

    A batch replaces its own partition, so it may be repeated.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            old = F.col("event_time") < F.col("_arrived") - F.expr(f"INTERVAL {within}")
            late = batch.where(F.coalesce(old, F.lit(True)))
            days = [r[0] for r in late.select("event_date").distinct().collect()]
            fresh = batch
            known = _stored(batch.sparkSession, path) if days else None
            if known is not None:
                of_days = F.col("event_date").isin([d for d in days if d]) | (F.col("event_date").isNull() & F.lit(None in days))
                before = known.where(of_days & (F.col("batch_id") != batch_id)).select(*_EVENT)
                repeated = late.select(*_EVENT).join(before, _EVENT, "left_semi")
                fresh = batch.join(repeated, _EVENT, "left_anti")
            writer = fresh.drop("event_time", "_arrived").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            writer = writer.option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("event_date", "batch_id", "event_type").json(path)
        finally:
            batch.unpersist()

    return store


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    schema = "request_id string, event_date date, batch_id long, event_type string"
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
