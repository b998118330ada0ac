"""Tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namesieve.session import materialize, remove
from namesieve.session import shared_folder as new_folder

__all__ = ["Scratch", "materialize", "new_folder", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its columns can be read one by one."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Scratch:
    """Named tables of one job in the shared folder, which can be deleted once they have been read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)
        self.count = 0
        self.named: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        self.named.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; without names, all."""
        for name in names or list(self.named):
            for path in self.named.pop(name, []):
                remove(self.spark, path)
        if not names:
            remove(self.spark, self.folder)
