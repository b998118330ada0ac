"""Identity verification of a table of requests against document text and faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.functions import documents as D
from namesieve.functions.risk import SERVICE_MEDIUM_RISK, combined_engine_score, combined_route_score
from namesieve.functions.risk import kyc_service_score, risk_level
from namesieve.functions.text import blank_null, fill

MRZ_TYPE = (
    "struct<document_type:string,country_code:string,surname:string,given_names:string,"
    "document_number:string,nationality:string,birth_date:string,sex:string,expiry_date:string,"
    "valid_composite:boolean>"
)
EXPIRY_TYPE = (
    "struct<valid:boolean,is_expired:boolean,expiry_date_formatted:string,days_until_expiry:int,"
    "days_expired:int,error:string>"
)


def is_passport(document_type: Column) -> Column:
    kind = F.lower(fill(document_type))
    return (kind == "") | kind.isin("passport", "pass")


def read_passports(documents: DataFrame, as_of: Column) -> DataFrame:
    """Zone fields, expiry check and verdict of passports: ``request_id, boxes`` in."""
    df = documents.withColumn("mrz", D.mrz_text(F.transform("boxes", lambda b: b["text"])))
    df = df.withColumn("fields", F.when(F.col("mrz").isNotNull(), D.mrz_fields(F.col("mrz"))))
    df = df.withColumn("expiry", F.when(F.col("mrz").isNotNull(), D.expiry_check(F.col("fields.expiry_date"), as_of)))
    verdict = D.passport_verdict(F.col("fields"), F.col("expiry"))
    blank = F.struct(
        F.lit(False).alias("valid"),
        F.lit("No text extracted from MRZ").alias("error"),
        F.array(F.lit("OCR could not read MRZ text")).alias("details"),
    )
    df = df.withColumn("verdict", F.when(F.col("mrz").isNotNull(), verdict).otherwise(blank))
    none = F.lit(None)
    return df.select(
        "request_id",
        F.col("verdict.valid").alias("document_valid"),
        F.col("verdict.error").alias("document_error"),
        F.col("verdict.details").alias("document_details"),
        F.col("fields").cast(MRZ_TYPE).alias("document_fields"),
        F.col("expiry").cast(EXPIRY_TYPE).alias("expiry"),
        none.cast("string").alias("extracted_name"),
        none.cast("string").alias("extracted_birth"),
        none.cast("double").alias("ocr_confidence"),
    )


def with_rules(documents: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Add ``patterns``: those for country and document type, else those for the country alone.

    ``rules``: ``country_code, document_type, extraction_patterns``. One row per country and type,
    a configuration table of a few hundred rows at most.
    """
    if rules is None:
        none = "struct<document_number:string,name:string,date_of_birth:string,expiry_date:string>"
        return documents.withColumn("patterns", F.lit(None).cast(none))
    listed = rules.select(
        F.lower("country_code").alias("_country"),
        F.lower(fill("document_type")).alias("_kind"),
        F.col("extraction_patterns").alias("_patterns"),
    )
    exact = listed.where(F.col("_kind") != "").withColumnRenamed("_patterns", "_exact")
    general = listed.where(F.col("_kind") == "").drop("_kind").withColumnRenamed("_patterns", "_general")
    keyed = documents.withColumns({"_country": F.lower("country"), "_kind": F.lower(fill("document_type"))})
    joined = keyed.join(exact, ["_country", "_kind"], "left").join(general, "_country", "left")
    return joined.withColumn("patterns", F.coalesce("_exact", "_general")).drop(
        "_country", "_kind", "_exact", "_general"
    )


def read_id_cards(documents: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Extracted fields and verdict of documents without a machine-readable zone."""
    df = with_rules(documents, rules)
    df = df.withColumn("_text", F.array_join(F.transform("boxes", lambda b: b["text"]), " "))
    by_rule = D.rule_fields("_text", F.col("patterns"), F.col("country"))
    df = df.withColumn(
        "fields", F.when(F.col("patterns").isNotNull(), by_rule).otherwise(D.generic_fields("_text"))
    ).withColumn("verdict", D.id_verdict(F.col("fields"), F.col("boxes")))
    none = F.lit(None).cast("string")
    comparable = F.struct(
        none.alias("document_type"),
        none.alias("country_code"),
        none.alias("surname"),
        none.alias("given_names"),
        F.col("fields.document_number").alias("document_number"),
        F.col("fields.nationality").alias("nationality"),
        none.alias("birth_date"),
        none.alias("sex"),
        F.col("fields.expiry_date").alias("expiry_date"),
        F.lit(None).cast("boolean").alias("valid_composite"),
    )
    return df.select(
        "request_id",
        F.col("verdict.valid").alias("document_valid"),
        F.col("verdict.error").alias("document_error"),
        F.col("verdict.details").alias("document_details"),
        comparable.cast(MRZ_TYPE).alias("document_fields"),
        F.lit(None).cast(EXPIRY_TYPE).alias("expiry"),
        F.col("fields.name").alias("extracted_name"),
        F.col("fields.date_of_birth").alias("extracted_birth"),
        F.col("verdict.ocr_confidence").alias("ocr_confidence"),
    )


def read_documents(documents: DataFrame, as_of: Column, rules: DataFrame | None = None) -> DataFrame:
    """Route by type: passports by their machine-readable zone, all others by their text.

    ``documents``: ``request_id, document_type, country, boxes`` (``array<struct<text,confidence>>``).
    """
    passport = is_passport(F.col("document_type"))
    country = F.coalesce(blank_null("country"), F.lit("US"))
    cards = documents.where(~passport).withColumn("country", country)
    return read_passports(documents.where(passport), as_of).unionByName(read_id_cards(cards, rules))


def verify(requests: DataFrame, documents: DataFrame, faces: DataFrame, compare_expiry: bool = True) -> DataFrame:
    """Identity verification: one scored row per request.

    ``requests``: ``request_id, full_name, dob, nationality, document_number`` and, when
    ``compare_expiry``, ``expiry_date, issuing_country``. ``documents`` and ``faces`` come from
    :func:`read_documents` and :func:`faces.match_faces`; all three are keyed by request.
    """
    df = requests.join(documents, "request_id", "left").join(faces, "request_id", "left")
    first, last = D.request_names(F.col("full_name"))
    request = {
        "document_number": F.col("document_number"),
        "first_name": first,
        "last_name": last,
        "date_of_birth": F.col("dob"),
        "nationality": F.col("nationality"),
    }
    if compare_expiry:
        request |= {"expiry_date": F.col("expiry_date"), "issuing_country": F.col("issuing_country")}
    df = D.with_comparison(df, "document_fields", request, "_compared")
    df = df.withColumn("comparison", F.when(F.col("document_fields").isNotNull(), F.col("_compared")))
    score, found = kyc_service_score(
        F.col("document_valid"),
        F.col("expiry.is_expired"),
        F.col("expiry.expiry_date_formatted"),
        F.col("expiry.days_expired"),
        F.col("comparison.mismatches"),
        F.col("face_matched"),
    )
    df = df.drop("_compared").withColumns({"risk_score": score, "risk_factors": found})
    return df.withColumn("risk_level", risk_level(F.col("risk_score"), SERVICE_MEDIUM_RISK))


def verification_result(verified: DataFrame, timestamp: Column) -> DataFrame:
    """The nested response of a verification."""
    no = F.lit(False)
    result = F.struct(
        F.coalesce("document_valid", no).alias("document_verified"),
        F.coalesce("face_matched", no).alias("face_match"),
        F.struct(
            F.coalesce("document_valid", no).alias("valid"),
            F.col("document_error").alias("error"),
            F.col("document_details").alias("details"),
            F.col("document_fields").alias("mrz_data"),
            F.col("expiry").alias("expiry_validation"),
        ).alias("document_validation"),
        F.col("comparison").alias("data_comparison"),
        F.struct(
            F.coalesce("face_matched", no).alias("matched"),
            F.coalesce("face_score", F.lit(0.0)).alias("score"),
            F.coalesce("document_face_count", F.lit(0)).alias("document_face_count"),
            F.coalesce("selfie_face_count", F.lit(0)).alias("selfie_face_count"),
            F.col("face_error").alias("error"),
            F.col("face_details").alias("details"),
        ).alias("face_match_details"),
    )
    return verified.select(
        "request_id",
        F.lit("completed").alias("status"),
        "risk_score",
        "risk_level",
        "risk_factors",
        timestamp.alias("timestamp"),
        result.alias("verification_result"),
    )


def combine_scores(aml: DataFrame, kyc: DataFrame) -> DataFrame:
    """Combined assessment of both halves: weighted, two decimals, medium from 30.

    Both inputs: ``request_id, risk_score, risk_level, risk_factors``. Only the identity half's
    factors are carried, as the screening response holds none.
    """
    left = aml.select(
        "request_id", F.col("risk_score").alias("aml_risk_score"), F.col("risk_level").alias("aml_risk_level")
    )
    right = kyc.select(
        "request_id",
        F.col("risk_score").alias("kyc_risk_score"),
        F.col("risk_level").alias("kyc_risk_level"),
        "risk_factors",
    )
    joined = left.join(right, "request_id").withColumn(
        "combined_risk_score", combined_route_score(F.col("aml_risk_score"), F.col("kyc_risk_score"))
    )
    details = F.array(
        F.format_string("AML screening completed with risk score: %d", F.col("aml_risk_score")),
        F.lit("KYC verification completed with status: completed"),
    )
    return joined.withColumns(
        {
            "combined_risk_level": risk_level(F.col("combined_risk_score"), SERVICE_MEDIUM_RISK),
            "details": details,
        }
    )


def combine_scores_engine(aml: DataFrame, kyc: DataFrame) -> DataFrame:
    """Combined score that also takes requests with one half only: that half's score counts.

    Truncated to an integer, medium from 40, factors of both halves in order.
    """
    kind = "array<struct<type:string,severity:string,description:string>>"
    shaped = lambda c: F.transform(
        c,
        lambda f: F.struct(
            f["type"].alias("type"), f["severity"].alias("severity"), f["description"].alias("description")
        ),
    )
    left = aml.select(
        "request_id", F.col("risk_score").alias("aml_risk_score"), shaped(F.col("risk_factors")).alias("_aml")
    )
    right = kyc.select(
        "request_id", F.col("risk_score").alias("kyc_risk_score"), shaped(F.col("risk_factors")).alias("_kyc")
    )
    empty = F.array().cast(kind)
    score = combined_engine_score(F.col("aml_risk_score"), F.col("kyc_risk_score"))
    joined = left.join(right, "request_id", "full_outer").withColumn("risk_score", score)
    return joined.withColumns(
        {
            "risk_level": risk_level(F.col("risk_score")),
            "risk_factors": F.concat(F.coalesce("_aml", empty), F.coalesce("_kyc", empty)),
        }
    ).drop("_aml", "_kyc")
