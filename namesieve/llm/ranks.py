"""Positions of rows within ordered groups, without a window over a whole group.

Rows are put in range partitions by group and order, written, and numbered within each partition; a table with one
row per (partition, group) carries what lies before. So a group that holds a third of all rows is numbered by as many
tasks as its rows fill, and only one row per partition ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namesieve.llm.shared import written

_ROW = (1 << 33) - 1


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, ``of``, ``group_no`` and ``base``.

    ``at`` is the row's position in its group, from 0; ``of`` the group's size; ``group_no`` the group's position
    among all groups (nulls first, strings bytewise); ``base`` the number of rows of all groups before it. Rows equal
    in ``order`` are numbered in any order, once and for all.
    """
    keys = [group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftright("row", 33)).withColumn("row", F.col("row").bitwiseAND(F.lit(_ROW)))
    pieces = placed.groupBy("part", group).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    pieces = written(pieces, f"{name}-pieces")
    # One row per partition.
    parts = pieces.groupBy("part").agg(F.sum("n").alias("rows"))
    parts = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("rows_before"))
    pieces = pieces.join(parts, "part").withColumn("place", F.col("rows_before") + F.col("first"))
    # At most one row per partition and group.
    of_group = Window.partitionBy(group)
    pieces = pieces.select(
        "part", group, "first",
        (F.sum("n").over(of_group.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(of_group).alias("of"),
        F.min("place").over(of_group).alias("base"),
    )
    starts = pieces.where("before = 0")
    news = starts.groupBy("part").agg(F.count("*").alias("news"))
    news = news.select("part", (F.sum("news").over(Window.orderBy("part")) - F.col("news")).alias("groups_before"))
    numbers = starts.join(news, "part").select(
        F.col(group).alias("_group"),
        (F.col("groups_before") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("group_no"),
    )
    pieces = pieces.join(numbers, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    pieces = pieces.select(F.col("part").alias("_part"), F.col(group).alias("_group"), "first", "before", "of", "base", "group_no")
    same = (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    at = F.col("before") + F.col("row") - F.col("first")
    return placed.join(pieces, same).select(*rows.columns, at.alias("at"), "of", "group_no", "base")
