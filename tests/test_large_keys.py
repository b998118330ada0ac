"""Queries on keys that only larger tables have."""

from namesieve.catalog import lists


def test_order_lines_are_in_order_whatever_their_keys(spark):
    rows = [(n, part, supplier, quantity) for n in (1, 2) for part in (3, 1_150_000, 40_000_000) for supplier in (5, 900_000) for quantity in (1.0, 50.0)]
    lines = spark.createDataFrame(rows, "l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    ordered = lines.withColumn("ord", lists._order()).orderBy("ord").drop("ord")
    assert [tuple(r) for r in ordered.collect()] == sorted(rows)
