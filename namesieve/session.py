"""Session set-up and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "namesieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Anything a cluster sets itself (master, memory, shuffle partitions) is left alone unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoint files go once nothing refers to them, which matters for long-running streams.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors the package, once per session's context.

    Functions that tasks run are pickled by name. Spark copies the archive to every executor, so it need not be in
    a shared folder. Clusters that install the package, or name it in ``spark.submit.pyFiles``, need no call.
    """
    context = spark.sparkContext
    if getattr(context, "_namesieve_shipped", False):
        return
    package = Path(__file__).resolve().parent
    # The driver serves the archive from here as long as it runs.
    archive = Path(tempfile.mkdtemp(prefix="spark-")).resolve() / "namesieve.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(f for f in package.rglob("*") if f.suffix in (".py", ".csv")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._namesieve_shipped = True


def _use_shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir``; only a local session may lack one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that driver and executors share; nothing is created yet."""
    return f"{_use_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store, wherever it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later steps read only the columns they use."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own name, such as a configuration, in whatever store the path is in."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back.

    Used where a later step needs the very same rows and row order twice.
    """
    _use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
