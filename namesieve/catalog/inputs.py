"""Lists and requests derived from the given tables, as DataFrames and as the same SQL.

Every part is a list entry and every customer a request; a third of the requests carry an entry's
name with its words turned round and a letter missing, a third the exact name, and the others an alias or a name that is not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _case(key: str, *values: str) -> str:
    whens = " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {whens} END"


WATCHLIST_COLUMNS = {
    "dataid": "CAST(p_partkey AS STRING)",
    "source": _case("p_partkey", "'UN'", "'EU'", "'OFAC'"),
    "record_type": _case("p_partkey", "'individual'", "'entity'"),
    "name": "CONCAT(p_name, ' ', p_brand)",
    "aliases": "CONCAT(p_type, ' ', p_name, '; ', p_name)",
    "dob": "CONCAT(CAST(1940 + p_size AS STRING), '-01-01')",
    "country": "p_type",
    "list_class": "CASE p_brand WHEN 'Brand#7' THEN 'pep' WHEN 'Brand#8' THEN 'watchlist' ELSE 'sanctions' END",
}
REQUEST_COLUMNS = {
    "request_id": "CAST(c_custkey AS STRING)",
    "full_name": _case(
        "c_custkey",
        "CONCAT(p_brand, ' ', SUBSTR(p_name, 1, LENGTH(p_name) - 1))",
        "CONCAT(p_name, ' ', p_brand)",
        "CASE WHEN c_nationkey % 2 = 0 THEN p_name ELSE CONCAT(c_mktsegment, ' ', c_name) END",
    ),
    "dob": "CASE WHEN c_nationkey < 12 THEN CONCAT(CAST(1940 + p_size AS STRING), '-01-01') ELSE '' END",
    "nationality": "CASE WHEN c_nationkey % 2 = 0 THEN LOWER(p_type) ELSE c_mktsegment END",
}


def _sql(columns: dict[str, str], source: str) -> str:
    cells = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {cells.replace('AS STRING', 'AS VARCHAR')} FROM {source}"


def watchlist(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.selectExpr(*[f"{e} AS {n}" for n, e in WATCHLIST_COLUMNS.items()])


def requests(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "part"), F.col("c_custkey") == F.col("p_partkey")
    )
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in REQUEST_COLUMNS.items()])


WATCHLIST_SQL = _sql(WATCHLIST_COLUMNS, "part")
REQUESTS_SQL = _sql(REQUEST_COLUMNS, "customer JOIN part ON c_custkey = p_partkey")


def sql_key(name: str) -> str:
    """DuckDB: lower case, tokens sorted."""
    tokens = rf"string_split_regex(lower(trim({name})), '\s+')"
    return f"array_to_string(list_sort(list_filter({tokens}, lambda w: w <> '')), ' ')"


def sql_lcs(x: str, y: str) -> str:
    """DuckDB: LCS length by the bit-parallel recurrence; ``x`` has at most 62 characters."""
    full = f"((1::BIGINT << length({x})) - 1)"
    position = f"list_transform(range(length({x})), lambda i: CASE WHEN {x}[i + 1] = c THEN 1::BIGINT << i ELSE 0 END)"
    masks = f"list_transform(string_split({y}, ''), lambda c: list_sum({position})::BIGINT)"
    fold = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v & ~m)) & {full}, {full})"
    return f"bit_count(xor({fold}, {full}))"


def sql_score(x: str, y: str) -> str:
    return f"200.0::DOUBLE * {sql_lcs(x, y)} / (length({x}) + length({y}))"


SCREEN_SQL = f"""
l AS (SELECT *, {sql_key('name')} AS rk FROM ({WATCHLIST_SQL})),
q AS (SELECT *, {sql_key('full_name')} AS lk FROM ({REQUESTS_SQL})),
lk AS (SELECT DISTINCT lk FROM q), rk AS (SELECT DISTINCT rk FROM l),
scored AS (SELECT lk, rk, {sql_score('lk', 'rk')} AS similarity FROM lk, rk
           WHERE 200 * least(length(lk), length(rk)) >= 85 * (length(lk) + length(rk))),
pairs AS (SELECT * FROM scored WHERE similarity >= 85),
hits AS (SELECT request_id, dataid, source, name, list_class, similarity,
                CASE WHEN similarity >= 95 THEN 'high' WHEN similarity >= 85 THEN 'medium' ELSE 'low' END AS confidence,
                CASE WHEN q.dob <> '' THEN q.dob = l.dob END AS dob_match,
                CASE WHEN nationality <> '' THEN upper(nationality) = upper(country) END AS country_match
         FROM q JOIN pairs USING (lk) JOIN l USING (rk))
"""
