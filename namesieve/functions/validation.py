"""Checks of submitted identity fields. Error columns are null for valid values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesieve.functions.text import _col, fill, strip

# Accepted document types and the limits of the text checks.
DOCUMENT_TYPES = ["driving_license", "id_card", "national_id", "passport", "residence_permit"]
NUMBER_MIN, NUMBER_MAX = 3, 50
NAME_MIN, NAME_MAX = 2, 100
AGE_MIN, AGE_MAX = 16, 120
IMAGE_MIN_BYTES = 10


def _missing(c: Column) -> Column:
    return fill(c) == ""


def valid_date(c, as_of: Column) -> Column:
    """DateType when the text is a real date from 1900 up to ``as_of``; else null."""
    text = strip(_col(c))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when((day >= F.lit("1900-01-01").cast("date")) & (day <= as_of), day)


def date_error(c, as_of: Column, label: str = "date") -> Column:
    raw = _col(c)
    text = strip(raw)
    day = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")
    month, number = F.substring(text, 6, 2), F.substring(text, 9, 2)
    impossible = ~month.between("01", "12") | (number == "00")
    reason = (
        F.when(impossible, F.concat(F.lit("time data '"), text, F.lit("' does not match format '%Y-%m-%d'")))
        .when(number > "31", F.concat(F.lit("unconverted data remains: "), F.substring(text, 10, 1)))
        .otherwise("day is out of range for month")
    )
    return (
        F.when(_missing(raw), f"{label} is required")
        .when(~text.rlike(r"^\d{4}-\d{2}-\d{2}$"), f"{label} must be in YYYY-MM-DD format")
        .when(day.isNull(), F.concat(F.lit(f"{label} is invalid: "), reason))
        .when(day < F.lit("1900-01-01").cast("date"), f"{label} is too far in the past (before 1900)")
        .when(day > as_of, f"{label} is in the future")
    )


def document_type_error(c) -> Column:
    raw = _col(c)
    known = ", ".join(DOCUMENT_TYPES)
    return F.when(_missing(raw), "Document type is required").when(
        ~strip(F.lower(raw)).isin(*DOCUMENT_TYPES), f"Invalid document type. Must be one of: {known}"
    )


def nationality_error(c, codes: Sequence[str]) -> Column:
    """``codes``: the valid two- and three-letter codes."""
    raw = _col(c)
    code = F.upper(strip(raw))
    return (
        F.when(_missing(raw), "Nationality is required")
        .when(~code.rlike(r"^[A-Z]{2}$"), "Nationality must be a 2-letter ISO country code (e.g., QA, PH, US)")
        .when(
            ~code.isin(*codes),
            "Nationality must be a valid 2 or 3-letter ISO country code (e.g., US, GBR, QA, ARE)",
        )
    )


def document_number_error(c) -> Column:
    raw = _col(c)
    text = strip(raw)
    return (
        F.when(_missing(raw), "Document number is required")
        .when(F.length(text) < NUMBER_MIN, f"Document number is too short (minimum {NUMBER_MIN} characters)")
        .when(F.length(text) > NUMBER_MAX, f"Document number is too long (maximum {NUMBER_MAX} characters)")
        .when(~F.upper(text).rlike(r"(?U)^[A-Z0-9\s\-_]+$"), "Document number contains invalid characters")
    )


def full_name_error(c) -> Column:
    raw = _col(c)
    text = strip(raw)
    return (
        F.when(_missing(raw), "Full name is required")
        .when(F.length(text) < NAME_MIN, f"Full name is too short (minimum {NAME_MIN} characters)")
        .when(F.length(text) > NAME_MAX, f"Full name is too long (maximum {NAME_MAX} characters)")
        .when(~text.rlike(r"(?U)^[A-Za-z\s\-'.]+$"), "Full name contains invalid characters")
        .when(~text.contains(" "), "Full name should include first and last name")
    )


def validate_fields(
    full_name, dob, nationality, document_type, document_number, as_of: Column, codes: Sequence[str]
) -> Column:
    """Struct ``is_valid, missing_fields, validation_errors, data_quality_issues``."""
    fields = {
        "full_name": (full_name, full_name_error(full_name)),
        "dob": (dob, date_error(dob, as_of, "Date of birth")),
        "nationality": (nationality, nationality_error(nationality, codes)),
        "document_type": (document_type, document_type_error(document_type)),
        "document_number": (document_number, document_number_error(document_number)),
    }
    missing = F.array_compact(F.array(*[F.when(_missing(_col(c)), F.lit(n)) for n, (c, _) in fields.items()]))
    errors = F.array_compact(
        F.array(
            *[F.when(~_missing(_col(c)), F.concat(F.lit(f"{n}: "), e)) for n, (c, e) in fields.items()]
        )
    )
    age = F.floor(F.datediff(as_of, valid_date(dob, as_of)) / 365)
    issue = lambda note: F.concat(F.lit("Date of birth indicates age "), age.cast("string"), F.lit(note))
    issues = F.array_compact(
        F.array(
            F.when(age < AGE_MIN, issue(f" (minimum {AGE_MIN} expected)")),
            F.when(age > AGE_MAX, issue(" (unusually old)")),
        )
    )
    return F.struct(
        ((F.size(missing) == 0) & (F.size(errors) == 0)).alias("is_valid"),
        missing.alias("missing_fields"),
        errors.alias("validation_errors"),
        issues.alias("data_quality_issues"),
    )


def image_bytes(c) -> Column:
    """Decoded bytes of a base64 payload without its data-URL prefix; null when not strict base64."""
    raw = _col(c)
    body = strip(F.when(F.instr(raw, ",") > 0, F.substr(raw, F.instr(raw, ",") + 1)).otherwise(raw))
    strict = body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0)
    return F.when(strict & (body != ""), F.unbase64(body))


def image_error(c) -> Column:
    raw = _col(c)
    body = strip(F.when(F.instr(raw, ",") > 0, F.substr(raw, F.instr(raw, ",") + 1)).otherwise(raw))
    decoded = image_bytes(c)
    return (
        F.when(_missing(raw), "Image data must be a non-empty string")
        .when(body == "", "Empty base64 image data")
        .when(decoded.isNull(), "Invalid base64 encoding")
        .when(F.length(decoded) < IMAGE_MIN_BYTES, "Decoded image data is too small or empty")
    )
