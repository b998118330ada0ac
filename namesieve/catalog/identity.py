"""Queries on identity checks: validation, documents, faces, scores."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.inputs import table
from namesieve.functions import documents as D
from namesieve.functions import risk, validation
from namesieve.functions.countries import country_codes, country_reference
from namesieve.operators import audit, faces, kyc
from namesieve.session import shared_folder, write_text
from namesieve.sources.rules import scan_rules

AS_OF = "2024-02-01"


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


SUBMITTED = {
    "request_id": "CAST(c_custkey AS STRING)",
    "full_name": "CASE c_custkey % 6 WHEN 0 THEN 'J' WHEN 1 THEN 'Solo' WHEN 2 THEN '' WHEN 3 THEN c_name ELSE CONCAT(INITCAP(c_mktsegment), ' O''Neil') END",
    "dob": "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '2031-01-01' WHEN 2 THEN '1899-12-31' WHEN 3 THEN '2020-02-30' "
    "WHEN 4 THEN '01/02/1990' WHEN 5 THEN CONCAT(CAST(2000 + c_nationkey AS STRING), '-03-04') ELSE ' 1901-05-06 ' END",
    "nationality": "CASE c_custkey % 5 WHEN 0 THEN 'qa' WHEN 1 THEN 'ZZ' WHEN 2 THEN 'USA' WHEN 3 THEN '' ELSE ' us ' END",
    "document_type": "CASE c_custkey % 4 WHEN 0 THEN 'Passport' WHEN 1 THEN 'visa' WHEN 2 THEN '' ELSE ' id_card ' END",
    "document_number": "CASE c_custkey % 5 WHEN 0 THEN 'A1' WHEN 1 THEN 'AB 12-3_4' WHEN 2 THEN 'A#12' WHEN 3 THEN '' ELSE REPEAT('A', 51) END",
}


def validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").selectExpr(*[f"{e} AS {n}" for n, e in SUBMITTED.items()])
    fields = [c for c in SUBMITTED if c != "request_id"]
    checked = people.withColumn("v", validation.validate_fields(*fields, _as_of(), country_codes(spark)))
    return checked.select(
        "request_id",
        "v.is_valid",
        F.array_join("v.missing_fields", "; ").alias("missing_fields"),
        F.array_join("v.validation_errors", "; ").alias("validation_errors"),
        F.array_join("v.data_quality_issues", "; ").alias("data_quality_issues"),
    )


def image_check(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts as base64 payloads, some with a data-URL prefix, some damaged or tiny."""
    encoded = F.base64(F.encode("text", "utf-8"))
    encoded = F.regexp_replace(encoded, r"\s", "")
    payload = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("data:image/png;base64,"), encoded))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("!"), encoded))
        .when(F.col("doc_id") % 5 == 2, F.lit("QUJD"))
        .when(F.col("doc_id") % 5 == 3, F.lit(""))
        .otherwise(encoded)
    )
    docs = table(spark, folder, "documents").withColumn("payload", payload)
    return docs.select(
        "doc_id",
        F.length(validation.image_bytes("payload")).cast("bigint").alias("n_bytes"),
        validation.image_error("payload").alias("error"),
    )


def _number() -> Column:
    """Document numbers without the digit 1, runs of which are taken for fillers."""
    return F.lpad(F.translate(F.col("c_custkey").cast("string"), "1", "K"), 9, "0")


def _passport_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Two zone lines per customer; every third has a wrong number check digit."""
    number = _number()
    birth = F.concat(F.lpad((F.col("c_nationkey") + 60).cast("string"), 2, "0"), F.lit("0312"))
    expiry = F.concat(F.lpad((F.col("c_nationkey") + 10).cast("string"), 2, "0"), F.lit("0201"))
    digit = lambda c: D.check_digit(c).cast("string")
    nd = F.when(F.col("c_custkey") % 3 == 0, F.lit("X")).otherwise(digit(number))
    first = F.rpad(F.concat(F.lit("PUTO"), F.col("c_mktsegment"), F.lit("<<ANNA<MARIA")), 43, "<")
    optional = F.lit("Z" * 14)
    body = F.concat(number, nd, birth, digit(birth), expiry, digit(expiry), optional, digit(optional))
    second = F.concat(
        number, nd, F.lit("UTO"), birth, digit(birth), F.lit("F"), expiry, digit(expiry), optional, digit(optional), digit(body)
    )
    spaced = F.concat(F.substring(first, 1, 10), F.lit(" "), F.lower(F.substring(first, 11, 40)))
    boxes = F.array(
        F.struct(spaced.alias("text"), F.lit(0.9).alias("confidence")),
        F.struct(F.translate(second, "<", ">").alias("text"), F.lit(0.8).alias("confidence")),
    )
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.lit("passport").alias("document_type"),
        F.lit("QA").alias("country"),
        boxes.alias("boxes"),
    )


def check_digits(spark: SparkSession, folder: str) -> DataFrame:
    text = F.upper(F.concat(F.substring("c_mktsegment", 1, 3), F.lpad(F.col("c_custkey").cast("string"), 6, "<")))
    return table(spark, folder, "customer").select("c_custkey", D.check_digit(text).alias("digit"))


def mrz_repair(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.concat(
        F.lit("P-UTO"), F.upper("c_mktsegment"), F.lit(">>LIL1"), F.translate(F.upper("c_name"), "1", "7"), F.lit("||//x<L<L1L|"), F.lit("LL")
    )
    return table(spark, folder, "customer").select("c_custkey", D.repair_fillers(noisy).alias("mrz"))


def passports(spark: SparkSession, folder: str) -> DataFrame:
    read = kyc.read_documents(_passport_lines(spark, folder), _as_of())
    return read.select(
        "request_id",
        "document_valid",
        F.col("document_fields.surname").alias("surname"),
        F.col("document_fields.given_names").alias("given_names"),
        F.col("document_fields.document_number").alias("document_number"),
        F.col("document_fields.valid_composite").alias("checks"),
        "expiry.is_expired",
        "expiry.expiry_date_formatted",
        F.col("expiry.days_until_expiry").cast("bigint").alias("days_until"),
        F.col("expiry.days_expired").cast("bigint").alias("days_expired"),
        F.element_at("document_details", -1).alias("last_detail"),
    )


def _identity(spark: SparkSession, folder: str) -> DataFrame:
    number = _number()
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.concat(F.when(F.col("c_nationkey") % 2 == 0, "Maria").otherwise("Peter"), F.lit(" "), F.initcap("c_mktsegment")).alias("full_name"),
        F.when(F.col("c_nationkey") < 5, F.lit("2060-03-12")).otherwise("1960-03-12").alias("dob"),
        F.when(F.col("c_custkey") % 4 == 0, "UTO").when(F.col("c_custkey") % 4 == 1, "QA").otherwise("").alias("nationality"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.substring(number, 1, 8), F.lit("Z")))
        .when(F.col("c_custkey") % 5 == 1, F.lit("XYZ"))
        .otherwise(number)
        .alias("document_number"),
        F.lit("2030-02-01").alias("expiry_date"),
        F.lit("UTO").alias("issuing_country"),
    )


def _faces(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding as a selfie, the one before it as the document's face."""
    vectors = table(spark, folder, "embeddings")
    request = F.col("vec_id").cast("string")
    selfie = vectors.select(request.alias("request_id"), F.lit("selfie").alias("side"), F.lit(0).alias("face_index"), "embedding")
    document = vectors.select(
        (F.col("vec_id") + 1).cast("string").alias("request_id"),
        F.lit("document").alias("side"),
        F.lit(0).alias("face_index"),
        "embedding",
    )
    second = vectors.where("label = 3").select(
        request.alias("request_id"), F.lit("selfie").alias("side"), F.lit(1).alias("face_index"), "embedding"
    )
    return selfie.unionByName(document).unionByName(second)


def face_similarity(spark: SparkSession, folder: str) -> DataFrame:
    matched = faces.match_faces(_faces(spark, folder), threshold=0.1)
    return matched.select(
        "request_id",
        F.round("face_score", 5).alias("face_score"),
        "document_face_count",
        "selfie_face_count",
        "face_error",
        "several_faces",
    )


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    documents = kyc.read_documents(_passport_lines(spark, folder), _as_of())
    return kyc.verify(_identity(spark, folder), documents, faces.match_faces(_faces(spark, folder), 0.0))


def _flat(df: DataFrame) -> DataFrame:
    factor = lambda f: F.concat_ws("|", f["type"], f["severity"], f["description"])
    return df.withColumn("risk_factors", F.array_join(F.transform("risk_factors", factor), "; "))


def mrz_compare(spark: SparkSession, folder: str) -> DataFrame:
    compared = _verified(spark, folder).select("request_id", "comparison.*")
    return compared.select(
        "request_id",
        F.array_join("matches", ",").alias("matches"),
        F.array_join(F.transform("mismatches", lambda m: m["field"]), ",").alias("mismatches"),
        F.array_join("warnings", ",").alias("warnings"),
        "all_match",
    )


def kyc_risk(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_verified(spark, folder)).select("request_id", "risk_score", "risk_level", "risk_factors")


def kyc_engine_risk(spark: SparkSession, folder: str) -> DataFrame:
    """The library form of the score on values taken from orders."""
    key = F.col("o_orderkey")
    face = F.when(key % 4 != 0, (key % 101) / 100.0)
    missing = F.slice(F.array(F.lit("dob"), F.lit("nationality"), F.lit("full_name")), F.lit(1), (key % 4).cast("int"))
    issues = F.when(key % 3 == 0, F.array(F.lit("age")))
    score, found = risk.kyc_engine_score(
        F.col("o_orderstatus") != "P",
        face,
        F.when(key % 5 == 0, face > 0.3),
        F.when(key % 7 != 0, F.round((key % 11) / 10.0, 1)),
        F.col("o_orderdate") < "1994-01-01",
        F.col("o_orderdate") < "1996-01-01",
        missing,
        issues,
    )
    scored = table(spark, folder, "orders").select("o_orderkey", score.alias("risk_score"), found.alias("risk_factors"))
    return _flat(scored).withColumn("risk_level", risk.risk_level(F.col("risk_score")))


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast(f"array<{risk.FACTOR}>")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority"
    )
    half = lambda step: F.struct((F.col("k") * step % 21 * 5).cast("int").alias("risk_score"))
    factor = F.array(risk.factor("kind", "low", F.concat(F.lit("factor "), F.col("request_id"))))
    build = lambda df, step, f: df.select(
        "request_id",
        half(step)["risk_score"].alias("risk_score"),
        risk.risk_level(half(step)["risk_score"]).alias("risk_level"),
        f.alias("risk_factors"),
    )
    screened, verified = orders.where("o_orderstatus <> 'P'"), orders.where("o_orderpriority <> '1-URGENT'")
    return build(screened, 3, none), build(verified, 8, factor)


def combined_risk(spark: SparkSession, folder: str) -> DataFrame:
    combined = kyc.combine_scores(*_halves(spark, folder))
    return combined.select(
        "request_id",
        "combined_risk_score",
        "combined_risk_level",
        F.size("risk_factors").cast("bigint").alias("factors"),
        F.array_join("details", "; ").alias("details"),
    )


def combined_events(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events of the combined assessments."""
    combined = kyc.combine_scores(*_halves(spark, folder))
    return audit.combined_events(combined, F.lit("2024-02-01T00:00:00"))


def combined_engine_risk(spark: SparkSession, folder: str) -> DataFrame:
    combined = kyc.combine_scores_engine(*_halves(spark, folder))
    return combined.select(
        "request_id", "risk_score", "risk_level", F.size("risk_factors").cast("bigint").alias("factors")
    )


def _text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's whole text as one text box; languages stand in for countries."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.lit("id_card").alias("document_type"),
        F.col("lang").alias("country"),
        F.array(F.struct("text", F.lit(0.5).alias("confidence")), F.struct(F.lit("end").alias("text"), F.lit(0.7).alias("confidence"))).alias("boxes"),
    )


def field_extract(spark: SparkSession, folder: str) -> DataFrame:
    read = kyc.read_documents(_text_documents(spark, folder), _as_of())
    return read.select(
        "request_id",
        "document_valid",
        F.col("document_fields.document_number").alias("document_number"),
        F.col("extracted_birth").alias("date_of_birth"),
        F.col("extracted_name").alias("name"),
        F.round("ocr_confidence", 6).alias("ocr_confidence"),
    )


#: Country, document type (or none), and the patterns of number, name, birth and expiry.
RULES = [
    ("en", "id_card", r'token = "([0-9a-f]+)"', r"([A-Z][a-z]+) the", r"(\d{3}-\d{4})", r"mail(\d+)\."),
    *[(c, "", r"@mail(\d+)", r"([a-z]+)\.\d+@", r"(\d+\.\d+\.\d+\.\d+)", r"nothing (here)") for c in ("en", "de", "fr", "es")],
]


def _rule_files(spark: SparkSession) -> str:
    """The rules as JSON files of several lines, named by country and type."""
    path = shared_folder(spark, "rules")
    names = ("document_number", "name", "date_of_birth", "expiry_date")
    for country, kind, *patterns in RULES:
        stem = f"{country}_{kind}" if kind else country
        rule = {"country_code": "as the name says", "document_type": kind, "extraction_patterns": dict(zip(names, patterns))}
        write_text(spark, f"{path}/{stem}_rules.json", json.dumps(rule, indent=2))
    write_text(spark, f"{path}/notes.json", "{}")
    return path


def rule_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction by rules read from files: for English a rule of the type goes before the country's own."""
    rules = scan_rules(spark, _rule_files(spark))
    read = kyc.read_documents(_text_documents(spark, folder), _as_of(), rules)
    return read.select(
        "request_id",
        "document_valid",
        F.col("document_fields.document_number").alias("document_number"),
        F.col("document_fields.nationality").alias("nationality"),
        F.col("extracted_birth").alias("date_of_birth"),
        F.col("extracted_name").alias("name"),
    )


def _damaged_zones(spark: SparkSession, folder: str) -> DataFrame:
    """A sound zone per customer, damaged in one of ten ways; all its check digits are worked out after that but one."""
    k = F.col("c_custkey") % 10
    number = _number()
    birth = F.when(k == 1, F.lit("850230")).otherwise("850228")
    expiry = F.when(k == 2, F.lit("301301")).otherwise("301201")
    nation = F.when(k == 3, F.lit("U1O")).when(k == 4, F.lit("QQQ")).otherwise("DEU")
    sex = F.when(k == 5, F.lit("A")).otherwise("F")
    kind = F.when(k == 6, F.lit("X<")).otherwise("P<")
    names = F.when(k == 7, F.rpad(F.lit(""), 39, "<")).otherwise(F.rpad(F.lit("BERG<<ANNA"), 39, "<"))
    digit = lambda c: D.check_digit(c).cast("string")
    wrong = lambda c, when: F.when(when, ((c.cast("int") + 1) % 10).cast("string")).otherwise(c)
    nd, bd, ed, optional = wrong(digit(number), k == 8), digit(birth), digit(expiry), F.lit("<" * 14)
    body = F.concat(number, nd, birth, bd, expiry, ed, optional, F.lit("0"))
    last = wrong(digit(body), k == 9)
    zone = F.concat(kind, F.lit("DEU"), names, number, nd, nation, birth, bd, sex, expiry, ed, optional, F.lit("0"), last)
    return table(spark, folder, "customer").select("c_custkey", zone.alias("zone"))


def passport_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with passports that are damaged in different ways; the country codes are those of the reference."""
    codes = [r.alpha3 for r in country_reference(spark).select("alpha3").collect()]  # a table of fixed size
    zones = _damaged_zones(spark, folder)
    return zones.select(
        "c_custkey",
        F.array_join(D.mrz_faults(F.col("zone"), codes), ",").alias("faults"),
        D.mrz_fields(F.col("zone"), codes)["valid_composite"].alias("valid"),
    )


def number_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted numbers that are the document's own, have a character more, or are another one."""
    k = F.col("request_id").cast("long") % 3
    own = F.lpad(F.replace("request_id", F.lit("1"), F.lit("K")), 9, "0")
    number = F.when(k == 0, own).when(k == 1, F.concat(own, F.lit("X"))).otherwise("QQQQQQ")
    documents = kyc.read_documents(_passport_lines(spark, folder), _as_of())
    people = _identity(spark, folder).withColumn("document_number", number)
    compared = kyc.verify(people, documents, faces.match_faces(_faces(spark, folder), 0.0)).select("request_id", "comparison.*")
    same = F.array_contains("matches", "document_number")
    return compared.select("request_id", F.array_join("warnings", ",").alias("warnings"), same.alias("number_matches"))


def kyc_events(spark: SparkSession, folder: str) -> DataFrame:
    """An audit event for every identity check."""
    verified = _verified(spark, folder)
    built = audit.kyc_events(verified.withColumns({"risk_score": F.lit(0), "risk_level": F.lit("low")}), F.lit("2024-02-01T00:00:00"))
    return built.select("event_type", "timestamp", "request_id", "status", "document_verified")


QUERIES = {
    f.__name__: f
    for f in (
        validate_requests,
        image_check,
        check_digits,
        mrz_repair,
        passports,
        face_similarity,
        mrz_compare,
        kyc_risk,
        kyc_engine_risk,
        combined_risk,
        combined_events,
        combined_engine_risk,
        field_extract,
        rule_extract,
        passport_faults,
        kyc_events,
        number_warnings,
    )
}


def _submitted_sql() -> str:
    cells = ", ".join(f"{e} AS {n}" for n, e in SUBMITTED.items())
    cells = cells.replace("AS STRING", "AS VARCHAR").replace(
        "INITCAP(c_mktsegment)", "(c_mktsegment[1] || lower(c_mktsegment[2:]))"
    )
    return f"SELECT {cells} FROM customer"


def _digit(text: str) -> str:
    value = (
        f"CASE WHEN {text}[i + 1] = '<' THEN 0 ELSE instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {text}[i + 1]) - 1 END"
    )
    weight = "CASE i % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END"
    return f"(list_sum(list_transform(range(length({text})), lambda i: ({value}) * {weight})) % 10)"


_PASSPORT_SQL = f"""
p AS (SELECT c_custkey, c_mktsegment, c_nationkey, lpad(replace(c_custkey::VARCHAR, '1', 'K'), 9, '0') AS number,
             make_date(2010 + c_nationkey, 2, 1) AS expiry, c_custkey % 3 <> 0 AS checks FROM customer),
v AS (SELECT *, expiry <= DATE '{AS_OF}' AS gone FROM p)
"""
_FACE_SQL = """
face AS (SELECT a.vec_id::VARCHAR AS request_id, d.vec_id IS NOT NULL AS has_document, a.label = 3 AS several,
  list_cosine_similarity(a.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS sim
  FROM embeddings a LEFT JOIN embeddings d ON d.vec_id + 1 = a.vec_id)
"""
# Faces of documents without a selfie of their own: the last embedding's successor.
_FACE_ALL = """
faces AS (SELECT request_id, has_document, several, sim, 1 AS selfies FROM face
  UNION ALL SELECT (max(vec_id) + 1)::VARCHAR, true, false, NULL, 0 FROM embeddings)
"""


_COMPARE_SQL = f"""
{_PASSPORT_SQL.strip()},
w AS (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN 'MARIA' ELSE 'PETER' END AS first,
  CASE WHEN c_custkey % 5 = 0 THEN substr(number, 1, 8) || 'Z' WHEN c_custkey % 5 = 1 THEN 'XYZ' ELSE number END AS asked,
  CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN right(number, 1) = 'Z' THEN 1.0 ELSE 16.0 / 18.0 END
       WHEN c_custkey % 5 = 1 THEN 0.0 ELSE 1.0 END AS ns FROM v),
c AS (SELECT c_custkey::VARCHAR AS request_id, *,
  [CASE WHEN ns >= 0.9 THEN 'document_number' END, 'last_name', CASE WHEN first = 'MARIA' THEN 'first_name' END,
   CASE WHEN c_nationkey < 5 AND c_nationkey = 0 THEN 'date_of_birth' END, CASE WHEN c_custkey % 4 = 0 THEN 'nationality' END,
   CASE WHEN c_nationkey = 20 THEN 'expiry_date' END, 'issuing_country'] AS m,
  [CASE WHEN ns < 0.9 THEN 'document_number' END, CASE WHEN first <> 'MARIA' THEN 'first_name' END,
   CASE WHEN NOT (c_nationkey = 0) THEN 'date_of_birth' END, CASE WHEN c_custkey % 4 = 1 THEN 'nationality' END,
   CASE WHEN c_nationkey <> 20 THEN 'expiry_date' END] AS x FROM w)
"""
_NONNULL = "lambda z: z IS NOT NULL"

_VALIDATE_SQL = f"""
WITH s AS ({_submitted_sql()}),
e AS (SELECT *, CASE WHEN request_id::INT % 7 = 5 THEN date_diff('day', trim(dob)::DATE, DATE '{AS_OF}') // 365
                     WHEN request_id::INT % 7 = 6 THEN date_diff('day', DATE '1901-05-06', DATE '{AS_OF}') // 365 END AS age,
  CASE request_id::INT % 6 WHEN 0 THEN 'full_name: Full name is too short (minimum 2 characters)'
    WHEN 1 THEN 'full_name: Full name should include first and last name' WHEN 3 THEN 'full_name: Full name contains invalid characters' END AS e1,
  CASE request_id::INT % 7 WHEN 1 THEN 'dob: Date of birth is in the future' WHEN 2 THEN 'dob: Date of birth is too far in the past (before 1900)'
    WHEN 3 THEN 'dob: Date of birth is invalid: day is out of range for month' WHEN 4 THEN 'dob: Date of birth must be in YYYY-MM-DD format'
    WHEN 5 THEN CASE WHEN trim(dob)::DATE > DATE '{AS_OF}' THEN 'dob: Date of birth is in the future' END END AS e2,
  CASE request_id::INT % 5 WHEN 1 THEN 'nationality: Nationality must be a valid 2 or 3-letter ISO country code (e.g., US, GBR, QA, ARE)'
    WHEN 2 THEN 'nationality: Nationality must be a 2-letter ISO country code (e.g., QA, PH, US)' END AS e3,
  CASE request_id::INT % 4 WHEN 1 THEN 'document_type: Invalid document type. Must be one of: driving_license, id_card, national_id, passport, residence_permit' END AS e4,
  CASE request_id::INT % 5 WHEN 0 THEN 'document_number: Document number is too short (minimum 3 characters)'
    WHEN 2 THEN 'document_number: Document number contains invalid characters' WHEN 4 THEN 'document_number: Document number is too long (maximum 50 characters)' END AS e5
  FROM s),
l AS (SELECT *, list_filter([CASE WHEN full_name = '' THEN 'full_name' END, CASE WHEN dob = '' THEN 'dob' END, CASE WHEN nationality = '' THEN 'nationality' END,
  CASE WHEN document_type = '' THEN 'document_type' END, CASE WHEN document_number = '' THEN 'document_number' END], {_NONNULL}) AS miss,
  list_filter([e1, e2, e3, e4, e5], {_NONNULL}) AS errs,
  list_filter([CASE WHEN age < 16 AND e2 IS NULL THEN 'Date of birth indicates age ' || age || ' (minimum 16 expected)' END,
               CASE WHEN age > 120 AND e2 IS NULL THEN 'Date of birth indicates age ' || age || ' (unusually old)' END], {_NONNULL}) AS q FROM e)
SELECT request_id, len(miss) = 0 AND len(errs) = 0 AS is_valid, array_to_string(miss, '; ') AS missing_fields,
  array_to_string(errs, '; ') AS validation_errors, array_to_string(q, '; ') AS data_quality_issues FROM l"""

# Letters beyond ASCII count as word characters but match no pattern: a lower-case letter stands in.
_WORDS = r"regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\x00-\x7F]', 'a', 'g')"
_FIRST = lambda col, p: f"CASE WHEN regexp_matches({col}, '{p}') THEN trim(regexp_extract({col}, '{p}', 1), E' \\n\\t\\r') END"

ORACLES = {
    "validate_requests": _VALIDATE_SQL,
    "image_check": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN strlen(text) WHEN 2 THEN 3 WHEN 4 THEN strlen(text) END::BIGINT AS n_bytes,
CASE doc_id % 5 WHEN 1 THEN 'Invalid base64 encoding' WHEN 2 THEN 'Decoded image data is too small or empty'
  WHEN 3 THEN 'Image data must be a non-empty string' ELSE CASE WHEN strlen(text) < 10 THEN 'Decoded image data is too small or empty' END END AS error
FROM documents""",
    "check_digits": f"""WITH t AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 3) || lpad(c_custkey::VARCHAR, 6, '<')) AS s FROM customer)
SELECT c_custkey, {_digit('s')}::INTEGER AS digit FROM t""",
    "mrz_repair": """SELECT c_custkey, rpad('P<UTO' || upper(c_mktsegment) || '<<<<<<' || replace(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), '1', '7')
  || '<<<<' || '<<<<<<<<<', 88, '<') AS mrz FROM customer""",
    "passports": f"""WITH {_PASSPORT_SQL} SELECT c_custkey::VARCHAR AS request_id, checks AND NOT gone AS document_valid, c_mktsegment AS surname,
'ANNA MARIA' AS given_names, number AS document_number, checks, gone AS is_expired, strftime(expiry, '%Y-%m-%d') AS expiry_date_formatted,
CASE WHEN NOT gone THEN date_diff('day', DATE '{AS_OF}', expiry) - 1 END AS days_until, CASE WHEN gone THEN date_diff('day', expiry, DATE '{AS_OF}') END AS days_expired,
CASE WHEN gone THEN 'Document expired: ' ELSE 'Document expiry date valid: ' END || strftime(expiry, '%Y-%m-%d') AS last_detail FROM v""",
    "face_similarity": f"""WITH {_FACE_SQL}, {_FACE_ALL}
SELECT request_id, round(CASE WHEN has_document AND selfies > 0 THEN sim ELSE 0.0 END, 5) AS face_score, has_document::INT AS document_face_count,
selfies + several::INT AS selfie_face_count, CASE WHEN NOT has_document THEN 'No face detected in the document image'
WHEN selfies = 0 THEN 'No face detected in the selfie' END AS face_error, several AS several_faces FROM faces""",
    "mrz_compare": f"""WITH {_COMPARE_SQL} SELECT request_id, array_to_string(list_filter(m, {_NONNULL}), ',') AS matches,
array_to_string(list_filter(x, {_NONNULL}), ',') AS mismatches,
'' AS warnings, len(list_filter(x, {_NONNULL})) = 0 AS all_match FROM c""",
    "kyc_risk": f"""WITH {_COMPARE_SQL}, {_FACE_SQL},
j AS (SELECT c.*, coalesce(has_document AND sim >= 0, false) AS face FROM c LEFT JOIN face USING (request_id)),
s AS (SELECT *, least(100, CASE WHEN gone THEN 30 ELSE 0 END + CASE WHEN checks AND NOT gone THEN 0 ELSE 50 END
  + 10 * len(list_filter(x, {_NONNULL})) + CASE WHEN face THEN 0 ELSE 50 END) AS score,
  strftime(expiry, '%Y-%m-%d') AS ex, 'data_mismatch|' AS dm,
  '20' || (c_nationkey + 60) || '-03-12' AS mb FROM j)
SELECT request_id, score::INTEGER AS risk_score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS risk_level,
array_to_string(list_filter([
 CASE WHEN gone THEN 'document_expired|high|Document expired on ' || ex END,
 CASE WHEN NOT (checks AND NOT gone) THEN 'document_validation|high|Document validation failed' END,
 CASE WHEN ns < 0.9 THEN dm || CASE WHEN ns > 0.7 THEN 'medium' ELSE 'high' END || '|MRZ data mismatch: document_number (MRZ: ' || number || ', Request: ' || asked || ')' END,
 CASE WHEN first <> 'MARIA' THEN dm || 'high|MRZ data mismatch: first_name (MRZ: ANNA MARIA, Request: Peter)' END,
 CASE WHEN c_nationkey <> 0 THEN dm || 'high|MRZ data mismatch: date_of_birth (MRZ: ' || CASE WHEN c_nationkey + 60 < 100 THEN mb END || ', Request: ' || CASE WHEN c_nationkey < 5 THEN '2060-03-12' ELSE '1960-03-12' END || ')' END,
 CASE WHEN c_custkey % 4 = 1 THEN dm || 'high|MRZ data mismatch: nationality (MRZ: UTO, Request: QA)' END,
 CASE WHEN c_nationkey <> 20 THEN dm || 'high|MRZ data mismatch: expiry_date (MRZ: ' || ex || ', Request: 2030-02-01)' END,
 CASE WHEN len(list_filter(x, {_NONNULL})) = 0 THEN 'data_verification|low|All MRZ data matches request data' END,
 CASE WHEN NOT face THEN 'face_match|high|Face match failed' END,
 CASE WHEN checks AND NOT gone THEN 'document_validation|low|Document validation passed' END,
 CASE WHEN face THEN 'face_match|low|Face match passed' END], {_NONNULL}), '; ') AS risk_factors FROM s""",
    "kyc_engine_risk": f"""
WITH a AS (SELECT o_orderkey, o_orderkey AS k, o_orderstatus <> 'P' AS ok, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE END AS face,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS ocr, o_orderdate < '1994-01-01' AS gone, o_orderdate < '1996-01-01' AS soon FROM orders),
b AS (SELECT *, coalesce(k % 5 = 0 AND NOT (face > 0.3), false) AS mis, array_slice(['dob', 'nationality', 'full_name'], 1, (k % 4)::INT) AS miss, k % 3 = 0 AS iss FROM a),
c AS (SELECT *, [CASE WHEN NOT ok THEN {{'p': 40, 'f': 'kyc_document|high|Invalid document format'}} END,
 CASE WHEN mis THEN {{'p': 35, 'f': 'kyc_face_match|high|Face mismatch between document and selfie'}}
      WHEN face < 0.7 THEN {{'p': 20, 'f': 'kyc_face_match|medium|Low face match confidence (' || printf('%.2f', face * 100) || '%)'}}
      WHEN face < 0.85 THEN {{'p': 10, 'f': 'kyc_face_match|low|Moderate face match confidence (' || printf('%.2f', face * 100) || '%)'}} END,
 CASE WHEN ocr < 0.5 THEN {{'p': 25, 'f': 'kyc_ocr|high|Poor OCR extraction quality'}}
      WHEN ocr < 0.7 THEN {{'p': 15, 'f': 'kyc_ocr|medium|Moderate OCR extraction quality'}} END,
 CASE WHEN gone THEN {{'p': 30, 'f': 'kyc_expiry|high|Document has expired'}}
      WHEN soon THEN {{'p': 10, 'f': 'kyc_expiry|low|Document expiring soon (within 30 days)'}} END,
 CASE WHEN len(miss) > 0 THEN {{'p': least(20, 5 * len(miss))::INT, 'f': 'kyc_validation|' || CASE WHEN len(miss) >= 2 THEN 'medium' ELSE 'low' END
      || '|Missing required fields: ' || array_to_string(miss, ', ')}} END,
 CASE WHEN iss THEN {{'p': 3, 'f': 'general_data_quality|low|Data quality issues: age'}} END] AS l FROM b),
d AS (SELECT o_orderkey, list_filter(l, {_NONNULL}) AS l FROM c),
e AS (SELECT o_orderkey, least(100, coalesce(list_sum(list_transform(l, lambda z: z.p)), 0))::INTEGER AS risk_score,
  array_to_string(list_transform(l, lambda z: z.f), '; ') AS risk_factors FROM d)
SELECT *, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM e""",
    "combined_risk": """WITH s AS (SELECT o_orderkey::VARCHAR AS request_id, o_orderkey AS k, (o_orderkey * 3 % 21 * 5)::INT AS a, (o_orderkey * 8 % 21 * 5)::INT AS y
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'),
c AS (SELECT *, round(a * 0.6::DOUBLE + y * 0.4::DOUBLE, 2) AS score FROM s)
SELECT request_id, score AS combined_risk_score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS combined_risk_level,
1::BIGINT AS factors, 'AML screening completed with risk score: ' || a || '; KYC verification completed with status: completed' AS details FROM c""",
    "combined_events": """WITH s AS (SELECT o_orderkey::VARCHAR AS request_id, (o_orderkey * 3 % 21 * 5)::INT AS a, (o_orderkey * 8 % 21 * 5)::INT AS y
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'),
c AS (SELECT *, round(a * 0.6::DOUBLE + y * 0.4::DOUBLE, 2) AS score FROM s)
SELECT 'combined_risk_assessment' AS event_type, '2024-02-01T00:00:00' AS timestamp, request_id, 'success' AS status, score AS combined_risk_score,
CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS combined_risk_level,
a AS aml_risk_score, CASE WHEN a >= 70 THEN 'high' WHEN a >= 40 THEN 'medium' ELSE 'low' END AS aml_risk_level,
y AS kyc_risk_score, CASE WHEN y >= 70 THEN 'high' WHEN y >= 40 THEN 'medium' ELSE 'low' END AS kyc_risk_level,
1::INTEGER AS risk_factors_count FROM c""",
    "combined_engine_risk": """WITH s AS (SELECT o_orderkey::VARCHAR AS request_id, o_orderkey AS k,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey * 3 % 21 * 5)::INT END AS a, CASE WHEN o_orderpriority <> '1-URGENT' THEN (o_orderkey * 8 % 21 * 5)::INT END AS y FROM orders),
c AS (SELECT *, least(100, floor(coalesce(a * 0.6::DOUBLE + y * 0.4::DOUBLE, a, y)))::INTEGER AS score FROM s WHERE a IS NOT NULL OR y IS NOT NULL)
SELECT request_id, score AS risk_score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk_level,
(y IS NOT NULL)::BIGINT AS factors FROM c""",
    "field_extract": f"""WITH t AS (SELECT doc_id, {_WORDS} || ' END' AS s FROM documents),
f AS (SELECT doc_id, coalesce({_FIRST('s', r'\b([A-Z0-9]{6,20})\b')}, {_FIRST('s', r'ID[:\s]+([A-Z0-9]{6,20})')}, {_FIRST('s', r'DOC[:\s]+([A-Z0-9]{6,20})')}) AS number,
 coalesce({_FIRST('s', r'\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b')}, {_FIRST('s', r'\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b')}) AS birth,
 {_FIRST('s', r'NAME[:\s]+([A-Z\s]{3,50})')} AS name FROM t)
SELECT doc_id::VARCHAR AS request_id, number IS NOT NULL AS document_valid, number AS document_number, birth AS date_of_birth, name,
0.6::DOUBLE AS ocr_confidence FROM f""",
    "passport_faults": """SELECT c_custkey, ['', 'birth_date', 'expiry_date', 'nationality', 'nationality', 'sex', 'document_type', 'names',
'number_check', 'composite_check'][c_custkey % 10 + 1] AS faults, c_custkey % 10 = 0 AS valid FROM customer""",
    "number_warnings": """SELECT c_custkey::VARCHAR AS request_id, c_custkey % 3 < 2 AS number_matches,
CASE WHEN c_custkey % 3 = 1 THEN 'Document number similar but not exact (similarity: 0.95)' ELSE '' END AS warnings FROM customer""",
    "kyc_events": f"""WITH {_PASSPORT_SQL} SELECT 'kyc_verification' AS event_type, '2024-02-01T00:00:00' AS timestamp,
c_custkey::VARCHAR AS request_id, 'completed' AS status, checks AND NOT gone AS document_verified FROM v""",
    "rule_extract": """WITH t AS (SELECT doc_id, lang, text || ' end' AS s FROM documents),
f AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN regexp_extract(s, 'token = "([0-9a-f]+)"', 1) ELSE regexp_extract(s, '@mail(\\d+)', 1) END AS number,
 CASE lang WHEN 'en' THEN regexp_extract(s, '([A-Z][a-z]+) the', 1) ELSE regexp_extract(s, '([a-z]+)\\.\\d+@', 1) END AS name,
 CASE lang WHEN 'en' THEN regexp_extract(s, '(\\d{3}-\\d{4})', 1) ELSE regexp_extract(s, '(\\d+\\.\\d+\\.\\d+\\.\\d+)', 1) END AS birth FROM t)
SELECT doc_id::VARCHAR AS request_id, number <> '' AS document_valid, nullif(number, '') AS document_number, lang AS nationality,
nullif(birth, '') AS date_of_birth, nullif(name, '') AS name FROM f""",
}
