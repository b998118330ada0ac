"""Machine-readable zones, text field extraction, and comparison with submitted data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesieve.functions.dates import mrz_calendar_date, mrz_date
from namesieve.functions.similarity import name_similarity
from namesieve.functions.text import _col, blank_null, fill, let, strip, words

# Layout of the two 44-character lines, as (start, length) in the joined 88.
LAYOUT = {
    "document_type": (1, 2),
    "country_code": (3, 3),
    "names": (6, 39),
    "document_number": (45, 9),
    "number_check": (54, 1),
    "nationality": (55, 3),
    "birth_date": (58, 6),
    "birth_check": (64, 1),
    "sex": (65, 1),
    "expiry_date": (66, 6),
    "expiry_check": (72, 1),
    "optional": (73, 14),
    "optional_check": (87, 1),
    "composite_check": (88, 1),
}
MRZ_LENGTH = 88
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # position = check value; "<" counts 0

# Generic extraction patterns on upper-case text, tried in order.
NUMBER_PATTERNS = [r"(?U)\b([A-Z0-9]{6,20})\b", r"(?U)ID[:\s]+([A-Z0-9]{6,20})", r"(?U)DOC[:\s]+([A-Z0-9]{6,20})"]
DATE_PATTERNS = [
    r"(?U)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"(?U)\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
    r"(?U)DOB[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(?U)BIRTH[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
]
NAME_PATTERNS = [r"(?U)NAME[:\s]+([A-Z\s]{3,50})", r"(?U)FULL[:\s]+NAME[:\s]+([A-Z\s]{3,50})"]

# Similarity from which differing values still count as the same.
NUMBER_SIMILAR, LAST_NAME_SIMILAR, FIRST_NAME_SIMILAR = 0.9, 0.85, 0.80


def mrz_lines(lines: Column) -> Column:
    """Upper case, spaces and line breaks removed, blank lines dropped."""
    cleaned = F.transform(lines, lambda s: strip(F.translate(F.upper(fill(s)), " \n", "")))
    return F.filter(cleaned, lambda s: s != "")


def align_type(lines: Column) -> Column:
    """``P`` followed by three letters on the first line becomes ``P<`` and the letters."""
    return F.transform(
        lines, lambda s, i: F.when(i == 0, F.regexp_replace(s, r"^(\p{L})(\p{L}{3})", "$1<$2")).otherwise(s)
    )


def _runs(c: Column, chars: str, least: int) -> Column:
    """Every character of a run of at least ``least`` of the given characters becomes ``<``."""
    k = least - 1
    inside = "|".join(f"(?<=[{chars}]{{{i}}})[{chars}](?=[{chars}]{{{k - i}}})" for i in range(k + 1))
    return F.regexp_replace(c, inside, "<")


def repair_fillers(text: Column, length: int | None = MRZ_LENGTH) -> Column:
    """Undo typical misreadings of the filler ``<`` and pad or cut to the full length."""
    text = F.regexp_replace(text, r"[^A-Z0-9<>|/\-]", "")
    text = F.translate(text, "->", "<<")
    text = _runs(text, "LI1", 3)
    text = _runs(text, "|", 2)
    text = _runs(text, "/", 2)
    text = _runs(text, "<LI1|", 3)
    text = F.regexp_replace(text, r"[^A-Z0-9<]", "")
    return text if length is None else F.rpad(text, length, "<")


def mrz_text(lines: Column) -> Column:
    """The 88 characters of a two-line zone from raw text lines; null when there is no text."""
    cleaned = align_type(mrz_lines(lines))
    return F.when(F.size(cleaned) > 0, repair_fillers(F.array_join(cleaned, "")))


def check_digit(text: Column) -> Column:
    """Check digit: values weighted 7, 3, 1 in turn, summed modulo 10."""
    weighted = F.transform(
        F.split(text, ""),
        lambda ch, i: F.when(ch == "", 0).otherwise(
            F.greatest(F.call_function("instr", F.lit(ALPHABET), ch) - 1, F.lit(0))
            * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
        ),
    )
    return F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x) % 10


# Codes of a zone's issuer or holder that are no countries of the reference.
ZONE_CODES = (
    "D", "EUE", "GBD", "GBN", "GBO", "GBP", "GBS", "RKS", "UNA", "UNK", "UNO", "UTO", "XBA", "XCC", "XCE", "XCO", "XEC",
    "XIM", "XMP", "XOM", "XPO", "XXA", "XXB", "XXC", "XXX",
)


def mrz_fields(text: Column, codes: list[str] | None = None) -> Column:
    """Struct of the zone's fields with ``faults`` and ``valid_composite``: no fault was found.

    See :func:`mrz_faults`.
    """
    return let(text, lambda t: _mrz_struct(t, codes))


def mrz_faults(text: Column, codes: list[str] | None = None) -> Column:
    """What is wrong with a two-line zone of 88 characters: an empty array for a sound one, null without a zone.

    Every field is held against what it may consist of, then the five check digits: the kind of document, both country
    codes (letters; with ``codes`` one of these or of ``ZONE_CODES``), a surname, the number, both dates (real days),
    the sex, and that no field holds a character that zones do not have. An empty optional field may carry ``<`` or
    ``0`` as its check digit.
    """
    return let(text, lambda t: _faults(t, codes))


def _parts(text: Column) -> dict[str, Column]:
    return {name: F.substring(text, *span) for name, span in LAYOUT.items()}


def _faults(text: Column, codes: list[str] | None) -> Column:
    part = _parts(text)
    unfilled = lambda c: F.regexp_replace(c, "<+$", "")
    agrees = lambda value, check: check_digit(value).cast("string") == check
    composite = F.concat(F.substring(text, 45, 10), F.substring(text, 58, 7), F.substring(text, 66, 22))
    empty = (F.rtrim(F.translate(part["optional"], "<", " ")) == "") & part["optional_check"].isin("<", "0")

    def country(name: str) -> Column:
        code = unfilled(part[name])
        known = code.rlike("^[A-Z]{1,3}$")
        return known & code.isin(*codes, *ZONE_CODES) if codes else known

    sound = {
        "length": F.length(text) == MRZ_LENGTH,
        "characters": text.rlike("^[A-Z0-9<]*$"),
        "document_type": part["document_type"].startswith("P"),
        "country_code": country("country_code"),
        "names": part["names"].rlike("^[A-Z]"),
        "document_number": unfilled(part["document_number"]) != "",
        "nationality": country("nationality"),
        "birth_date": mrz_calendar_date(part["birth_date"]).isNotNull(),
        "sex": part["sex"].isin("M", "F", "X", "<"),
        "expiry_date": mrz_calendar_date(part["expiry_date"]).isNotNull(),
        "number_check": agrees(part["document_number"], part["number_check"]),
        "birth_check": agrees(part["birth_date"], part["birth_check"]),
        "expiry_check": agrees(part["expiry_date"], part["expiry_check"]),
        "optional_check": agrees(part["optional"], part["optional_check"]) | empty,
        "composite_check": agrees(composite, part["composite_check"]),
    }
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sound.items()])
    return F.when(text.isNotNull(), F.filter(found, lambda f: f.isNotNull()))


def _mrz_struct(text: Column, codes: list[str] | None) -> Column:
    part = _parts(text)
    plain = lambda c: F.trim(F.regexp_replace(F.translate(c, "<", " "), " +", " "))
    surname = F.substring_index(part["names"], "<<", 1)
    given = F.when(
        F.instr(part["names"], "<<") > 0, F.substr(part["names"], F.instr(part["names"], "<<") + 2)
    ).otherwise("")
    unfilled = lambda c: F.regexp_replace(c, "<+$", "")
    return F.struct(
        unfilled(part["document_type"]).alias("document_type"),
        unfilled(part["country_code"]).alias("country_code"),
        plain(surname).alias("surname"),
        plain(given).alias("given_names"),
        unfilled(part["document_number"]).alias("document_number"),
        unfilled(part["nationality"]).alias("nationality"),
        part["birth_date"].alias("birth_date"),
        F.when(part["sex"] == "<", "").otherwise(part["sex"]).alias("sex"),
        part["expiry_date"].alias("expiry_date"),
        (F.size(_faults(text, codes)) == 0).alias("valid_composite"),
    )


def expiry_check(expiry: Column, as_of: Column) -> Column:
    """Struct on a ``YYMMDD`` expiry date. A document that expires on ``as_of`` has expired."""
    day = mrz_calendar_date(expiry)
    gone = day <= as_of
    error = F.when(fill(expiry) == "", "No expiry date found in MRZ").when(
        day.isNull(), F.concat(F.lit("Invalid expiry date format: "), expiry)
    )
    return F.struct(
        F.coalesce(~gone, F.lit(False)).alias("valid"),
        gone.alias("is_expired"),
        F.date_format(day, "yyyy-MM-dd").alias("expiry_date_formatted"),
        F.when(~gone, F.datediff(day, as_of) - 1).alias("days_until_expiry"),
        F.when(gone, F.datediff(as_of, day)).alias("days_expired"),
        error.alias("error"),
    )


def passport_verdict(fields: Column, expiry: Column) -> Column:
    """Struct ``valid, error, details`` for a parsed zone."""
    checks = F.coalesce(fields["valid_composite"], F.lit(False))
    valid = checks & expiry["valid"]
    shown = F.coalesce(expiry["expiry_date_formatted"], F.lit("None"))
    details = F.array(
        F.lit("MRZ extraction successful"),
        F.lit("OCR text extraction successful"),
        F.lit("MRZ parsing successful"),
        F.when(checks, "MRZ checksums validated").otherwise(
            "MRZ checksum validation failed (may be due to OCR errors)"
        ),
        F.when(expiry["valid"], F.concat(F.lit("Document expiry date valid: "), shown)).otherwise(
            F.concat(F.lit("Document expired: "), shown)
        ),
    )
    return F.struct(
        valid.alias("valid"),
        F.when(~valid, "Document validation issues found").alias("error"),
        details.alias("details"),
    )


def request_names(full_name: Column) -> tuple[Column, Column]:
    """First word, and the remaining words (the only word again when there is just one)."""
    parts = words(fill(full_name))
    first = fill(F.get(parts, 0))
    rest = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")
    return first, F.when(F.size(parts) > 1, rest).otherwise(first)


def _bare(name: Column) -> Column:
    return F.translate(F.upper(fill(name)), " <", "")


def with_comparison(df, mrz: str, request: dict[str, Column], out: str = "comparison"):
    """Add the comparison of a document's fields with the submitted ones.

    ``mrz`` names a struct column; ``request`` maps ``document_number, first_name, last_name,
    date_of_birth, nationality, expiry_date, issuing_country`` to columns (left out = not compared).
    A value missing on either side is not compared. The result is a struct of ``matches``,
    ``mismatches`` (``field, mrz_value, request_value, similarity``), ``warnings`` and counts.
    Similarities are computed in one pass before they are used.
    """
    doc = lambda f: F.col(f"{mrz}.{f}")
    given = lambda f: fill(request.get(f, F.lit("")))
    number, wanted = F.upper(strip(F.translate(fill(doc("document_number")), "<", ""))), strip(given("document_number"))
    pairs = {
        "_number": (number, F.upper(wanted)),
        "_last": (_bare(doc("surname")), _bare(given("last_name"))),
        "_first": (_bare(doc("given_names")), _bare(given("first_name"))),
    }
    both = {k: (a != "") & (b != "") for k, (a, b) in pairs.items()}
    df = df.withColumns({k: F.when(both[k], name_similarity(a, b) / 100) for k, (a, b) in pairs.items()})
    same_number = number == F.upper(wanted)
    contained = pairs["_first"][0].contains(pairs["_first"][1]) | pairs["_first"][1].contains(pairs["_first"][0])
    checks: list[tuple[str, Column, Column, Column, Column, Column]] = [
        (
            "document_number",
            both["_number"],
            same_number | (F.col("_number") >= NUMBER_SIMILAR),
            strip(F.translate(fill(doc("document_number")), "<", "")),
            wanted,
            F.col("_number"),
        ),
        (
            "last_name",
            both["_last"],
            F.col("_last") >= LAST_NAME_SIMILAR,
            doc("surname"),
            given("last_name"),
            F.col("_last"),
        ),
        (
            "first_name",
            both["_first"],
            (F.col("_first") >= FIRST_NAME_SIMILAR) | contained,
            doc("given_names"),
            given("first_name"),
            F.col("_first"),
        ),
    ]
    exact = [
        ("date_of_birth", fill(mrz_date(doc("birth_date"))), given("date_of_birth")),
        ("nationality", strip(fill(doc("nationality"))), strip(given("nationality"))),
        ("expiry_date", fill(mrz_date(doc("expiry_date"))), given("expiry_date")),
        ("issuing_country", strip(fill(doc("country_code"))), strip(given("issuing_country"))),
    ]
    none = F.lit(None).cast("double")
    for field, a, b in exact:
        equal = a == b if field in ("date_of_birth", "expiry_date") else F.upper(a) == F.upper(b)
        checks.append((field, (a != "") & (b != ""), equal, a, b, none))
    matches = F.array_compact(F.array(*[F.when(test & ok, F.lit(f)) for f, test, ok, *_ in checks]))
    mismatches = F.array_compact(
        F.array(
            *[
                F.when(
                    test & ~ok,
                    F.struct(
                        F.lit(f).alias("field"), a.alias("mrz_value"), b.alias("request_value"), s.alias("similarity")
                    ),
                )
                for f, test, ok, a, b, s in checks
            ]
        )
    )
    near = both["_number"] & ~same_number & (F.col("_number") >= NUMBER_SIMILAR)
    warning = F.concat(
        F.lit("Document number similar but not exact (similarity: "),
        F.format_string("%.2f", F.col("_number")),
        F.lit(")"),
    )
    df = df.withColumns(
        {
            "_matches": matches,
            "_mismatches": mismatches,
            "_warnings": F.array_compact(F.array(F.when(near, warning))),
        }
    )
    result = F.struct(
        F.col("_matches").alias("matches"),
        F.col("_mismatches").alias("mismatches"),
        F.col("_warnings").alias("warnings"),
        F.size("_matches").alias("match_count"),
        F.size("_mismatches").alias("mismatch_count"),
        (F.size("_mismatches") == 0).alias("all_match"),
    )
    return df.withColumn(out, result).drop(*pairs, "_matches", "_mismatches", "_warnings")


def first_hit(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that is found, trimmed; null when none is."""
    hits = [F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1))) for p in patterns]
    return F.coalesce(*hits)


def generic_fields(text) -> Column:
    """Struct of fields found in plain text by the generic patterns."""
    return let(F.upper(_col(text)), _generic_struct)


def _generic_struct(upper: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        first_hit(upper, NAME_PATTERNS).alias("name"),
        first_hit(upper, NUMBER_PATTERNS).alias("document_number"),
        first_hit(upper, DATE_PATTERNS).alias("date_of_birth"),
        none.alias("expiry_date"),
        none.alias("nationality"),
        upper.alias("raw_text"),
    )


def rule_fields(text, patterns: Column, country: Column) -> Column:
    """Struct of fields found by the patterns of a rule (a struct of regular expressions)."""
    text = _col(text)
    found = lambda f: blank_null(strip(F.call_function("regexp_extract", text, patterns[f], F.lit(1))))
    return F.struct(
        found("name").alias("name"),
        found("document_number").alias("document_number"),
        found("date_of_birth").alias("date_of_birth"),
        found("expiry_date").alias("expiry_date"),
        country.alias("nationality"),
        text.alias("raw_text"),
    )


def id_verdict(fields: Column, boxes: Column) -> Column:
    """Struct ``valid, error, details, ocr_confidence`` for extracted fields."""
    seen = F.coalesce(F.size(boxes), F.lit(0)) > 0
    number = fields["document_number"]
    valid = seen & (fill(number) != "")
    details = F.array_compact(
        F.array(
            F.when(fill(number) == "", F.lit("Document number not found")),
            F.when(fill(fields["name"]) == "", F.lit("Name not found")),
            F.when(fill(fields["date_of_birth"]) == "", F.lit("Date of birth not found")),
            F.when(valid, F.lit("ID OCR extraction successful")),
            F.when(valid, F.concat(F.lit("Extracted document number: "), number)),
        )
    )
    mean = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + b["confidence"]) / F.size(boxes)
    return F.struct(
        valid.alias("valid"),
        F.when(~seen, "Could not extract text from document")
        .when(~valid, "Some required fields could not be extracted")
        .alias("error"),
        F.when(seen, details).otherwise(F.array(F.lit("OCR extraction returned no results"))).alias("details"),
        F.when(seen, mean).otherwise(0.0).alias("ocr_confidence"),
    )
