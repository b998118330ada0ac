"""Queries on list building: sources, roll-ups, union, ids, snapshots and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve import schemas
from namesieve.catalog.expected_names import OFAC_SEARCHED, UK_SEARCHED
from namesieve.catalog.inputs import WATCHLIST_SQL, table, watchlist
from namesieve.functions import countries, dates
from namesieve.operators import combine, reports
from namesieve.sources import eu, ofac, uk, un

AS_OF = "2024-02-01"
CODES = "QA FR US DE IR GB KP CD CI BO CZ TR VA VE HK FM LC KN BA ST TW AE PH ZA XK".split()


def _order() -> Column:
    """A file-order struct for order lines, which come from a table instead of a file.

    By line, part, supplier and quantity, as in the SQL. Two numbers hold two keys each, with room for keys of twelve digits.
    """
    split = F.expr("l_linenumber * 1000000000000L + l_partkey")
    row = F.expr("l_suppkey * 1000000L + CAST(l_quantity AS BIGINT)")
    return F.struct(F.lit("").alias("file"), split.alias("split"), row.alias("row"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def _code(key: str) -> Column:
    return F.get(F.lit(CODES), F.col(key).cast("int") % len(CODES))


def _raw_eu(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines in the raw EU layout: an entity per order, a row per line."""
    cells = {
        "fileGenerationDate": F.lit("21/11/2025"),
        "Entity_LogicalId": F.col("l_orderkey").cast("string"),
        "Entity_SubjectType": F.when(F.col("l_linenumber") % 2 == 0, "person").otherwise("P"),
        "Entity_EU_ReferenceNumber": F.concat(F.lit("EU."), F.col("l_orderkey").cast("string")),
        "Entity_DesignationDate": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "NameAlias_WholeName": F.when(F.col("l_linenumber") != 3, F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))),
        "NameAlias_FirstName": F.substring_index("p_name", " ", 1),
        "NameAlias_LastName": F.when(F.col("l_linenumber") % 2 == 1, F.col("p_brand")),
        "BirthDate_Year": (F.lit(1940) + F.col("p_size")).cast("string"),
        "BirthDate_City": F.initcap("p_type"),
        "BirthDate_CountryIso2Code": F.lower(_code("l_suppkey")),
        "Address_Street": F.concat(F.col("l_linenumber").cast("string"), F.lit(" Street")),
        "Address_CountryDescription": F.when(F.col("l_returnflag") == "A", F.lit("Qatar")),
        "Identification_Number": F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")),
        "Identification_TypeDescription": F.lit("Passport"),
        "Identification_CountryIso2Code": _code("l_suppkey"),
    }
    none = F.lit(None).cast("string")
    raw = _lines(spark, folder).withColumn("ord", _order())
    return raw.select("ord", *[cells.get(c, none).alias(c) for c in schemas.EU_COLUMNS])


def _shown_eu(out: DataFrame) -> DataFrame:
    kept = (
        "record_type dataid name first_name second_name third_name aliases nationalities pob_cities pob_countries "
        "dob_dates dob_years listed_on last_updated addresses id_numbers"
    ).split()
    return out.select(*kept)


def eu_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_eu(eu.normalize_eu(_raw_eu(spark, folder)))


def _alt_and_add(spark: SparkSession, folder: str) -> DataFrame:
    """An alias and an address per order line."""
    return _lines(spark, folder).select(
        _order().alias("ord"),
        F.col("l_orderkey").cast("string").alias("ent_num"),
        F.concat("p_name", F.lit(" of "), _code("l_suppkey"), F.lit(" origin")).alias("alt_reg_date"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" High  Street")).alias("address"),
        F.when(F.col("l_returnflag") != "N", F.col("p_type")).alias("city_state_zip"),
        F.when(F.col("l_returnflag") == "R", F.lit("Russia")).alias("country"),
    )


def _alt(spark: SparkSession, folder: str) -> DataFrame:
    return _alt_and_add(spark, folder).select("ord", "ent_num", "alt_reg_date")


def _add(spark: SparkSession, folder: str) -> DataFrame:
    return _alt_and_add(spark, folder).select("ord", "ent_num", "address", "city_state_zip", "country")


def alias_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ofac.alias_rollup(_alt(spark, folder))


def address_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ofac.address_rollup(_add(spark, folder)).select("ent_num", "addresses")


def _sdn(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("ent_num"),
        F.concat(
            F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, ", ").otherwise(" "),
            F.col("o_orderpriority"), F.lit(" x y"),
        ).alias("sdn_name"),
        F.when(F.col("o_orderkey") % 3 == 0, "individual").otherwise("").alias("sdn_type"),
        F.col("o_orderpriority").alias("program"),
        F.lit(None).cast("string").alias("remarks"),
    )


def ofac_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_ofac(ofac.normalize_ofac(_sdn(spark, folder), _alt(spark, folder), _add(spark, folder), AS_OF))


def _shown_ofac(out: DataFrame) -> DataFrame:
    kept = "record_type dataid name first_name middle_name last_name aliases nationalities addresses program last_updated"
    return out.select(*kept.split())


def _raw_uk(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("Unique ID"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")).alias("OFSI Group ID"),
        F.concat(F.lit("Dr. "), F.col("c_mktsegment"), F.lit("-"), F.col("c_name"), F.lit(", JR")).alias("Name"),
        F.when(F.col("c_nationkey") < 8, "Individual").when(F.col("c_nationkey") < 16, "Ship").otherwise("X").alias("Type"),
        F.concat(F.lit("The "), _code("c_nationkey"), F.lit(" and Russia regime")).alias("Regime Name"),
        F.lit("Asset  freeze").alias("Sanctions Imposed"),
        F.when(F.col("c_nationkey") % 2 == 0, "UK").otherwise("UN").alias("Designation Source"),
    )

def _shown_uk(out: DataFrame) -> DataFrame:
    kept = "dataid reference_number record_type name first_name middle_name last_name nationalities program comments"
    return out.select(*kept.split())


def uk_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_uk(uk.normalize_uk(_raw_uk(spark, folder), AS_OF))


def _raw_un(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the raw UN layout, with nested aliases, births and addresses."""
    text = lambda e: F.expr(e)
    return table(spark, folder, "customer").select(
        text("CAST(c_custkey AS STRING)").alias("DATAID"),
        text("CONCAT('R', c_nationkey)").alias("REFERENCE_NUMBER"),
        text("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END").alias("FIRST_NAME"),
        text("CASE WHEN c_custkey % 5 <> 0 THEN c_name END").alias("SECOND_NAME"),
        text("CAST(NULL AS STRING)").alias("THIRD_NAME"),
        text("CAST(NULL AS STRING)").alias("FOURTH_NAME"),
        text("CONCAT('the ', c_name)").alias("TITLE"),
        text("'Male'").alias("GENDER"),
        text("'DRC'").alias("UN_LIST_TYPE"),
        text("'2012-1-5'").alias("LISTED_ON"),
        *[text(f"CASE WHEN c_custkey % {i} = 0 THEN 'note {i}' END").alias(f"COMMENTS{i}") for i in range(1, 6)],
        text("struct(array('Congo', c_mktsegment) AS VALUE)").alias("NATIONALITY"),
        text("struct(array('UN List') AS VALUE)").alias("LIST_TYPE"),
        text("struct(array('2016-10-13', 'bad', CONCAT('2020-02-', LPAD(CAST(1 + c_nationkey AS STRING), 2, '0'))) AS VALUE)").alias(
            "LAST_DAY_UPDATED"
        ),
        text(
            "array(struct(c_name AS ALIAS_NAME, 'Good' AS QUALITY), struct('hidden' AS ALIAS_NAME, 'Low' AS QUALITY), struct(CONCAT('a  ', c_mktsegment) AS ALIAS_NAME, '' AS QUALITY))"
        ).alias("INDIVIDUAL_ALIAS"),
        text(
            "array(struct('1971-1-2' AS DATE, '1970' AS YEAR), struct('' AS DATE, CAST(1950 + c_nationkey AS STRING) AS YEAR), struct('' AS DATE, 'about 1960' AS YEAR))"
        ).alias("INDIVIDUAL_DATE_OF_BIRTH"),
        text("array(struct('Goma' AS CITY, '' AS COUNTRY), struct('' AS CITY, 'Congo' AS COUNTRY))").alias("INDIVIDUAL_PLACE_OF_BIRTH"),
        text(
            "array(struct('Main st' AS STREET, c_mktsegment AS CITY, '' AS STATE_PROVINCE, 'ab1' AS ZIP_CODE, 'Congo' AS COUNTRY, 'old' AS NOTE))"
        ).alias("INDIVIDUAL_ADDRESS"),
        text(
            "array(struct('Passport' AS TYPE_OF_DOCUMENT, LOWER(c_name) AS NUMBER, 'Congo' AS ISSUING_COUNTRY), struct('Id' AS TYPE_OF_DOCUMENT, '' AS NUMBER, '' AS ISSUING_COUNTRY))"
        ).alias("INDIVIDUAL_DOCUMENT"),
    )

def _shown_un(out: DataFrame) -> DataFrame:
    kept = (
        "dataid name first_name last_name aliases nationalities pob_cities pob_countries dob_dates dob_years addresses "
        "id_numbers comments listed_on last_updated"
    )
    return out.select(*kept.split())


def un_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_un(un.normalize_un(_raw_un(spark, folder), AS_OF))


def ofac_nationalities(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("_text", countries.ofac_search_text("text"))
    found = countries.ofac_nationalities(F.col("_text"))
    return docs.select("doc_id", F.array_join(found, "; ").alias("nationalities"))


def uk_nationalities(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("_text", countries.uk_search_text("text"))
    found = countries.uk_nationalities(F.col("_text"))
    return docs.select("doc_id", F.array_join(found, "; ").alias("nationalities"))


def eu_country_names(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    code = F.when(F.col("s_suppkey") % 7 == 0, F.lit(" qq ")).otherwise(F.lower(_code("s_nationkey")))
    return suppliers.select("s_suppkey", countries.eu_country_name(code).alias("country"))


def code_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Three-letter codes of every customer's country; every seventh customer has an unknown code."""
    code = F.when(F.col("c_custkey") % 7 == 0, F.lit("ZZ")).otherwise(F.lower(_code("c_nationkey")))
    named = countries.lookup_country(table(spark, folder, "customer").withColumn("code", code), "code")
    return named.select("c_custkey", "alpha2", "alpha3")


LAYOUTS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy", "yyyy/MM/dd", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d"]


def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in eight layouts and read back."""
    written = F.lit("no date")
    for i, layout in enumerate(LAYOUTS):
        written = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", layout)).otherwise(written)
    return table(spark, folder, "orders").select("o_orderkey", dates.parse_date(written).alias("parsed"))


def _two_lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    customers = table(spark, folder, "customer").select(
        F.lit("A").alias("source"),
        F.col("c_custkey").cast("string").alias("dataid"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("program"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("B").alias("source"),
        F.col("s_suppkey").cast("string").alias("dataid"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("country"),
    )
    return [customers, suppliers]


def combine_union(spark: SparkSession, folder: str) -> DataFrame:
    return combine.union_lists(_two_lists(spark, folder))


def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    return combine.combine_lists(_two_lists(spark, folder)).select("source", "dataid", "id")


def without_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return combine.without_duplicates(rows)[0]


def _list_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """A list in which every tenth entry lacks a name."""
    return watchlist(spark, folder).withColumns(
        {
            "name": F.when(F.col("dataid").cast("int") % 10 != 0, F.concat(F.lit("  "), F.col("name"))).otherwise(""),
            "last_updated": F.when(F.col("source") == "UN", F.lit("2023-01-01")),
            "processing_date": F.lit("2023-01-02"),
        }
    )


def search_list(spark: SparkSession, folder: str) -> DataFrame:
    """The search form of a list with gaps."""
    return _shown_search(combine.search_list(_list_with_gaps(spark, folder), correct_updated_at=True))


def _shown_search(out: DataFrame) -> DataFrame:
    return out.select("dataid", "search_name", "search_aliases", "updated_at", "gender")


def counts_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return reports.counts_by(watchlist(spark, folder), ["source", "record_type"])


def top_values(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_values(_lines(spark, folder).withColumnRenamed("p_name", "nationalities"), "nationalities")


def listing_range(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    return reports.listing_range(table(spark, folder, "orders").withColumn("listed_on", listed))


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest day of every event type."""
    events = table(spark, folder, "events").withColumn("snapshot_date", F.to_date("ts"))
    newest = combine.latest_snapshot(events, ["event_type"])
    return newest.select("event_id", "event_type", F.col("snapshot_date").cast("string").alias("snapshot_date"))


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("event_type") == "error", F.expr("ts - INTERVAL 10 DAYS")).otherwise(F.col("ts"))
    versions = table(spark, folder, "events").withColumn("modified", shifted)
    aged = combine.freshness(
        versions, F.lit("2024-02-01 00:00:00").cast("timestamp"), ["event_type"], 3
    )
    return aged.select("event_type", F.round("age_days", 6).alias("age_days"), "needs_update")


QUERIES = {
    f.__name__: f
    for f in (
        eu_normalize,
        alias_rollup,
        address_rollup,
        ofac_normalize,
        uk_normalize,
        un_normalize,
        ofac_nationalities,
        uk_nationalities,
        eu_country_names,
        code_lookup,
        date_parse,
        combine_union,
        row_ids,
        without_duplicates,
        search_list,
        counts_by_source,
        top_values,
        listing_range,
        latest_snapshot,
        freshness,
    )
}

_ORDERED = "l_linenumber, l_partkey, l_suppkey, l_quantity"
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
# Names and three-letter codes of the 25 codes used above.
_ALPHA3 = dict(
    zip(
        CODES,
        "QAT FRA USA DEU IRN GBR PRK COD CIV BOL CZE TUR VAT VEN HKG FSM LCA KNA BIH STP TWN ARE PHL ZAF -".split(),
        strict=True,
    )
)
_EU_NAME = {
    "QA": "Qatar",
    "FR": "France",
    "US": "United States of America",
    "DE": "Germany",
    "IR": "Iran",
    "GB": "United Kingdom of Great Britain and Northern Ireland",
    "KP": "Korea (Democratic People''s Republic of)",
    "CD": "Democratic Republic of the Congo",
    "CI": "Côte d''Ivoire",
    "BO": "Bolivia",
    "CZ": "Czech Republic",
    "TR": "Türkiye",
    "VA": "Holy See",
    "VE": "Venezuela (Bolivarian Republic of)",
    "HK": "Hong Kong",
    "FM": "Micronesia (Federated States of)",
    "LC": "Saint Lucia",
    "KN": "Saint Kitts and Nevis",
    "BA": "Bosnia and Herzegovina",
    "ST": "Sao Tome and Principe",
    "TW": "Taiwan, Province of China",
    "AE": "United Arab Emirates",
    "PH": "Philippines",
    "ZA": "South Africa",
    "XK": "Kosovo",
}
_EU_NAMES = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _EU_NAME.items()) + ") n(code, country)"


def _sql_code(key: str) -> str:
    return f"{_CODE_LIST}[({key} % {len(CODES)}) + 1]"


_OFAC_CODE_NAME = {
    **{c: n.upper() for c, n in _EU_NAME.items() if c not in ("HK",)},
    "US": "UNITED STATES",
    "GB": "UNITED KINGDOM",
    "KP": "KOREA, DEMOCRATIC PEOPLE''S REPUBLIC OF",
    "CD": "CONGO, THE DEMOCRATIC REPUBLIC OF THE",
    "CI": "COTE D''IVOIRE",
    "IR": "IRAN, ISLAMIC REPUBLIC OF",
    "TR": "TURKEY",
    "VA": "HOLY SEE (VATICAN CITY STATE)",
    "VE": "VENEZUELA, BOLIVARIAN REPUBLIC OF",
    "FM": "MICRONESIA, FEDERATED STATES OF",
}
_OFAC_NAMES = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _OFAC_CODE_NAME.items()) + ") n(code, country)"


_EU_SQL = f"""
WITH rows AS (
  SELECT l_orderkey AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) AS i, l_linenumber, l_shipdate,
         CASE WHEN l_linenumber <> 3 THEN p_name ELSE '' END AS whole, split_part(p_name, ' ', 1) AS f,
         CASE WHEN l_linenumber % 2 = 1 THEN p_brand ELSE '' END AS la, 1940 + p_size AS y,
         upper(p_type[1]) || lower(p_type[2:]) AS city, country AS c, l_linenumber || ' Street'
         || CASE WHEN l_returnflag = 'A' THEN ', Qatar' ELSE '' END AS addr, l_returnflag,
         CASE WHEN l_linestatus = 'F' THEN 'Passport: ' || l_partkey || ' (' || country || ')' END AS doc
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN {_EU_NAMES} ON n.code = {_sql_code('l_suppkey')}),
first AS (
  SELECT e, l_linenumber, l_shipdate, y, f, la, CASE WHEN whole <> '' THEN whole ELSE trim(f || ' ' || la) END AS name FROM rows WHERE i = 1),
named AS (
  SELECT *, CASE WHEN la = '' AND contains(name, ' ') THEN substr(name, instr(name, ' ') + 1) ELSE la END AS fam FROM first),
sets AS (
  SELECT rows.e,
         list(DISTINCT whole) FILTER (whole <> '' AND whole <> name) AS w,
         list(DISTINCT rows.f) FILTER (rows.f <> '' AND rows.f <> named.f AND rows.f <> fam) AS fs,
         list(DISTINCT rows.la) FILTER (rows.la <> '' AND rows.la <> named.f AND rows.la <> fam) AS ls,
         list(DISTINCT addr) AS a, list(DISTINCT doc) FILTER (doc IS NOT NULL) AS d, list(DISTINCT city) AS ci,
         list(DISTINCT c) AS co, list(DISTINCT 'Qatar') FILTER (l_returnflag = 'A') AS q
  FROM rows JOIN named USING (e) GROUP BY rows.e)
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'individual' ELSE 'entity' END AS record_type, 'EU.' || e AS dataid, name,
       f AS first_name, '' AS second_name, CASE WHEN fam <> f THEN fam ELSE '' END AS third_name,
       array_to_string(list_sort(list_distinct(list_concat(list_concat(coalesce(w, []), coalesce(fs, [])), coalesce(ls, [])))), '; ') AS aliases,
       array_to_string(list_sort(list_distinct(list_concat(co, coalesce(q, [])))), '; ') AS nationalities,
       array_to_string(list_sort(ci), '; ') AS pob_cities, array_to_string(list_sort(co), '; ') AS pob_countries,
       y || '-01-01' AS dob_dates, y::VARCHAR AS dob_years, strftime(l_shipdate, '%Y-%m-%d') AS listed_on, '2025-11-21' AS last_updated,
       array_to_string(list_sort(a), '; ') AS addresses, array_to_string(list_sort(coalesce(d, [])), '; ') AS id_numbers
FROM named JOIN sets USING (e)"""

_ALT_CTE = f"""alt AS (SELECT l_orderkey::VARCHAR AS ent_num, upper(p_name || ' of ' || {_sql_code('l_suppkey')} || ' origin') AS a,
  {_sql_code('l_suppkey')} AS code, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) AS i
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_ADD_CTE = f"""adr AS (SELECT l_orderkey::VARCHAR AS ent_num, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) AS i,
  trim(l_linenumber || ' High ST, ' || CASE WHEN l_returnflag <> 'N' THEN p_type ELSE '' END || ', '
  || CASE WHEN l_returnflag = 'R' THEN 'Russia' ELSE '' END, ' ,') AS a
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_ALIAS = "SELECT ent_num, string_agg(DISTINCT a, '; ' ORDER BY a) AS aliases, string_agg(a, ' ' ORDER BY i) AS alias_text FROM alt GROUP BY ent_num"

ORACLES = {
    "eu_normalize": _EU_SQL,
    "alias_rollup": f"WITH {_ALT_CTE} {_ALIAS}",
    "address_rollup": f"WITH {_ADD_CTE} SELECT ent_num, string_agg(a, '; ' ORDER BY i) AS addresses FROM adr GROUP BY ent_num",
    "ofac_normalize": f"""WITH {_ALT_CTE}, {_ADD_CTE},
al AS ({_ALIAS}),
ad AS (SELECT ent_num, string_agg(a, '; ' ORDER BY i) AS addresses FROM adr GROUP BY ent_num),
hit AS (SELECT ent_num, country FROM alt JOIN {_OFAC_NAMES} ON n.code = alt.code
        UNION SELECT ent_num, unnest(['RUSSIAN FEDERATION', 'UNITED STATES']) FROM adr WHERE l_returnflag = 'R'
        UNION SELECT ent_num, 'SAO TOME AND PRINCIPE' FROM adr WHERE a LIKE '% ST'
        UNION SELECT ent_num, 'UNITED STATES' FROM alt WHERE contains(a, 'US')
        UNION SELECT ent_num, 'UNITED STATES' FROM adr WHERE contains(upper(a), 'US')),
na AS (SELECT ent_num, string_agg(DISTINCT country, '; ' ORDER BY country) AS nationalities FROM hit GROUP BY ent_num),
s AS (SELECT o_orderkey::VARCHAR AS dataid, o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, string_split(o_orderpriority || ' X Y', ' ') AS w FROM orders)
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'individual' ELSE 'entity' END AS record_type, dataid,
  st || CASE WHEN o_orderkey % 2 = 0 THEN ', ' ELSE ' ' END || pr || ' X Y' AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN w[1] ELSE st END AS first_name, CASE WHEN o_orderkey % 2 = 0 THEN st ELSE w[1] END AS middle_name,
  w[2] AS last_name, coalesce(aliases, '') AS aliases, coalesce(nationalities, '') AS nationalities, coalesce(addresses, '') AS addresses,
  pr AS program, '{AS_OF}' AS last_updated
FROM s LEFT JOIN al ON al.ent_num = dataid LEFT JOIN ad ON ad.ent_num = dataid LEFT JOIN na ON na.ent_num = dataid""",
    "uk_normalize": f"""WITH b AS (SELECT *, {_sql_code('c_nationkey')} AS code, upper(c_name) AS n FROM customer)
SELECT c_custkey::VARCHAR AS dataid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_nationkey END::VARCHAR AS reference_number,
  CASE WHEN c_nationkey < 8 THEN 'individual' WHEN c_nationkey < 16 THEN 'vessel' ELSE 'other' END AS record_type,
  c_mktsegment || ' ' || n AS name, c_mktsegment AS first_name, '' AS middle_name, n AS last_name,
  'RUSSIA; RUSSIAN FEDERATION' || CASE WHEN c_nationkey % 2 = 0 THEN '; UK; UNITED KINGDOM' ELSE '' END AS nationalities,
  'The ' || code || ' and Russia regime' AS program, 'Asset freeze' AS comments FROM b""",
    "un_normalize": """SELECT c_custkey::VARCHAR AS dataid,
  CASE WHEN c_custkey % 5 <> 0 THEN upper(c_mktsegment || ' ' || c_name) ELSE upper('the ' || c_name) END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN upper(c_mktsegment) ELSE '' END AS first_name,
  CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) ELSE '' END AS last_name,
  upper(c_name || '; a ' || c_mktsegment) AS aliases, upper('Congo; ' || c_mktsegment) AS nationalities, 'GOMA' AS pob_cities,
  'CONGO' AS pob_countries, '1971-01-02' AS dob_dates, (1950 + c_nationkey)::VARCHAR AS dob_years,
  'MAIN ST, ' || upper(c_mktsegment) || ', ab1, CONGO, (OLD)' AS addresses, 'PASSPORT: ' || upper(c_name) || ' (CONGO)' AS id_numbers,
  array_to_string(list_filter([CASE WHEN c_custkey % i = 0 THEN 'note ' || i END FOR i IN [1, 2, 3, 4, 5]], lambda x: x IS NOT NULL), ' ') AS comments,
  '2012-01-05' AS listed_on, '2020-02-' || lpad((1 + c_nationkey)::VARCHAR, 2, '0') AS last_updated FROM customer""",
    "eu_country_names": f"""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'QQ' ELSE country END AS country
FROM supplier JOIN {_EU_NAMES} ON n.code = {_sql_code('s_nationkey')}""",
    "code_lookup": f"""WITH a(code, alpha3) AS (VALUES {", ".join(f"('{c}', '{a}')" for c, a in _ALPHA3.items() if a != '-')})
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN a.code END AS alpha2, CASE WHEN c_custkey % 7 <> 0 THEN alpha3 END AS alpha3
FROM customer LEFT JOIN a ON a.code = {_sql_code('c_nationkey')}""",
    "date_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
    "combine_union": """SELECT 'A' AS source, c_custkey::VARCHAR AS dataid, c_name AS name, c_mktsegment AS program, '' AS country FROM customer
UNION ALL SELECT 'B', s_suppkey::VARCHAR, s_name, '', s_nationkey::VARCHAR FROM supplier""",
    "row_ids": """WITH u AS (SELECT 'A' AS source, c_custkey::VARCHAR AS dataid FROM customer UNION ALL SELECT 'B', s_suppkey::VARCHAR FROM supplier)
SELECT source, dataid, row_number() OVER (ORDER BY source, dataid) AS id FROM u""",
    "without_duplicates": "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
    "search_list": f"""SELECT dataid, upper(name) AS search_name, upper(aliases) AS search_aliases,
CASE WHEN source = 'UN' THEN '2023-01-01' ELSE '2023-01-02' END AS updated_at, '' AS gender FROM ({WATCHLIST_SQL}) WHERE dataid::INT % 10 <> 0""",
    "counts_by_source": f"""WITH w AS ({WATCHLIST_SQL}) SELECT 'source' AS dimension, source AS value, count(*) AS records FROM w GROUP BY source
UNION ALL SELECT 'record_type', record_type, count(*) FROM w GROUP BY record_type""",
    "top_values": """SELECT p_name AS nationalities, count(*) AS records FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY records DESC, p_name LIMIT 10""",
    "listing_range": """SELECT min(strftime(o_orderdate, '%Y-%m-%d')) AS first_listed, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_listed
FROM orders WHERE o_orderstatus <> 'P'""",
    "latest_snapshot": """WITH d AS (SELECT event_id, event_type, ts::DATE AS d FROM events)
SELECT event_id, event_type, d::VARCHAR AS snapshot_date FROM d WHERE (event_type, d) IN (SELECT (event_type, max(d)) FROM d GROUP BY event_type)""",
    "freshness": """WITH a AS (SELECT event_type, (epoch_us(TIMESTAMP '2024-02-01')
- epoch_us(max(CASE WHEN event_type = 'error' THEN ts - INTERVAL 10 DAY ELSE ts END))) / 86400000000.0 AS age
FROM events GROUP BY event_type)
SELECT event_type, round(age, 6) AS age_days, age >= 3 AS needs_update FROM a""",
}


def _values(rows: list[tuple[str, str]]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)

_UPPER_TEXT = "upper(replace(text, 'ß', 'SS'))"
_FOUND = "SELECT doc_id, coalesce(string_agg(DISTINCT o, '; ' ORDER BY o), '') AS nationalities FROM t LEFT JOIN r ON"
ORACLES |= {
    "ofac_nationalities": f"""WITH r(p, o) AS (VALUES {_values(OFAC_SEARCHED)}),
t AS (SELECT doc_id, ' ' || {_UPPER_TEXT} || ' ' AS s FROM documents)
{_FOUND} contains(s, p) GROUP BY doc_id""",
    "uk_nationalities": f"""WITH r(p, o) AS (VALUES {_values(UK_SEARCHED)}),
t AS (SELECT doc_id, regexp_replace(regexp_replace({_UPPER_TEXT}, '\\s+', ' ', 'g'), '[^\\x00-\\x7F]', 'a', 'g') AS s FROM documents)
{_FOUND} contains(s, p) AND regexp_matches(s, '\\b\\Q' || p || '\\E\\b') GROUP BY doc_id""",
}
