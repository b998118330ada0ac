import pytest
from pyspark.sql import functions as F

from namesieve.functions import documents as D
from namesieve.functions import risk, validation
from namesieve.functions.countries import country_codes
from namesieve.operators import faces, kyc
from namesieve.plans.assessment import assess_batch
from namesieve import schemas

def as_of():
    return F.lit("2024-02-01").cast("date")


LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"  # the specimen of the public standard


def digit(text):
    values = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return str(sum(max(values.find(c), 0) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10)


# The text repair takes an L, I or 1 next to fillers for a filler: the specimen's own number and last
# filler run would be damaged, so documents that are read as text use others.
OPTIONAL = "ZE284226BABCDE"
NUMBER = "K898902C3" + digit("K898902C3")
CHECKED = NUMBER + "7408122" + "1204159" + OPTIONAL + digit(OPTIONAL)
READ2 = NUMBER + "UTO7408122F1204159" + OPTIONAL + digit(OPTIONAL) + digit(CHECKED)


def mrz(*lines):
    return D.mrz_text(F.array(*[F.lit(x) for x in lines]))


def test_specimen(one):
    got = one(D.mrz_fields(F.lit(LINE1 + LINE2)))
    assert got.asDict() == {
        "document_type": "P",
        "country_code": "UTO",
        "surname": "ERIKSSON",
        "given_names": "ANNA MARIA",
        "document_number": "L898902C3",
        "nationality": "UTO",
        "birth_date": "740812",
        "sex": "F",
        "expiry_date": "120415",
        "valid_composite": True,
    }
    broken = LINE1 + LINE2.replace("L898902C36", "L898902C46")
    assert one(D.mrz_fields(F.lit(broken))).valid_composite is False


def test_text_repair(one):
    assert one(mrz("PUTOERIKSSON>>ANNA-MARIA")) == ("P<UTOERIKSSON<<ANNA<MARIA" + "<" * 88)[:88]
    assert one(mrz(" p<uto ab\n", "", "LLL11||x//|/")) == ("P<UTOAB<<<<<<<X" + "<" * 88)[:88]
    assert one(mrz(LINE1, LINE2)) == LINE1 + "<" + LINE2[1:-2] + "<0"
    assert one(mrz("P<UTOALLI|NE")) == ("P<UTOA" + "<<<<" + "NE" + "<" * 88)[:88]
    assert one(mrz("", "  ")) is None
    assert len(one(mrz("A" * 100))) == 88


def test_expiry(one):
    check = lambda d: one(D.expiry_check(F.lit(d), as_of()))
    assert tuple(check("240201"))[:5] == (False, True, "2024-02-01", None, 0)
    assert tuple(check("240203"))[:5] == (True, False, "2024-02-03", 1, None)
    assert check("241301").error == "Invalid expiry date format: 241301" and check("241301").valid is False
    assert check("").error == "No expiry date found in MRZ"


def boxes(*texts):
    return [(t, 0.5) for t in texts]


DOCS = "request_id string, document_type string, country string, boxes array<struct<text:string,confidence:double>>"


def test_documents_by_type(spark):
    rules = spark.createDataFrame(
        [("qa", "id_card", ("ID ([0-9]+)", "NAME ([A-Z]+)", None, None)), ("us", "", ("No ([0-9]+)", None, None, None))],
        "country_code string, document_type string, extraction_patterns struct<document_number:string,name:string,date_of_birth:string,expiry_date:string>",
    )
    df = spark.createDataFrame(
        [
            ("p", "Passport", "QA", boxes(LINE1, READ2)),
            ("n", None, "QA", boxes(" ")),
            ("q", "ID_CARD", "QA", boxes("ID 77", "NAME ANN")),
            ("u", "id_card", None, boxes("No 55")),
            ("g", "id_card", "FR", boxes("Name: Jean Dupont", "born 01/02/1990", "AB123456")),
            ("e", "id_card", "FR", []),
            ("x", "id_card", "FR", boxes("short")),
        ],
        DOCS,
    )
    got = {r.request_id: r for r in kyc.read_documents(df, as_of(), rules).collect()}
    assert got["p"].document_details[3:] == ["MRZ checksums validated", "Document expired: 2012-04-15"]
    assert (got["p"].document_valid, got["p"].document_error) == (False, "Document validation issues found")
    assert (got["n"].document_error, got["n"].document_fields) == ("No text extracted from MRZ", None)
    assert (got["q"].document_fields.document_number, got["q"].extracted_name, got["q"].document_fields.nationality) == ("77", "ANN", "QA")
    assert (got["u"].document_fields.document_number, got["u"].document_valid) == ("55", True)
    g = got["g"]
    assert (g.document_fields.document_number, g.extracted_birth, g.extracted_name) == ("DUPONT", "01/02/1990", "JEAN DUPONT BORN")
    assert g.ocr_confidence == 0.5 and g.document_details[-1] == "Extracted document number: DUPONT"
    assert (got["e"].document_error, got["e"].ocr_confidence) == ("Could not extract text from document", 0.0)
    assert got["x"].document_details == ["Document number not found", "Name not found", "Date of birth not found"]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("1990-01-01", None),
        (" 1990-01-01 ", None),
        ("", "dob is required"),
        ("1990/01/01", "dob must be in YYYY-MM-DD format"),
        ("1990-13-01", "dob is invalid: time data '1990-13-01' does not match format '%Y-%m-%d'"),
        ("1990-02-30", "dob is invalid: day is out of range for month"),
        ("1990-01-42", "dob is invalid: unconverted data remains: 2"),
        ("1899-12-31", "dob is too far in the past (before 1900)"),
        ("2024-02-02", "dob is in the future"),
    ],
)
def test_dates(one, text, error):
    assert one(validation.date_error("d", as_of(), "dob"), d=text) == error


def test_field_checks(one, spark):
    codes = country_codes(spark)
    assert one(validation.nationality_error("c", codes), c=" qa ") is None
    assert "2-letter" in one(validation.nationality_error("c", codes), c="QAT")
    assert "valid 2 or 3" in one(validation.nationality_error("c", codes), c="ZZ")
    assert one(validation.document_number_error("c"), c="ab-1 2_") is None
    assert "invalid" in one(validation.document_number_error("c"), c="ab#1")
    assert one(validation.full_name_error("c"), c="Anne-Marie O'Neil Jr.") is None
    assert "invalid" in one(validation.full_name_error("c"), c="José Díaz")
    assert one(validation.document_type_error("c"), c=" Passport") is None
    struct = validation.validate_fields("n", "d", "c", "t", "k", as_of(), codes)
    got = one(struct, n="Jo Li", d="2015-01-01", c="QA", t="", k="A12")
    assert tuple(got) == (False, ["document_type"], [], ["Date of birth indicates age 9 (minimum 16 expected)"])


def test_images(one):
    assert one(validation.image_error("i"), i="data:image/png;base64,QUJDREVGR0hJSktM") is None
    assert one(F.length(validation.image_bytes("i")), i="QUJDREVGR0hJSktM") == 12
    assert "too small" in one(validation.image_error("i"), i="QUJD")
    for bad in ("AAA", "QU JD", "QUJ*", "===="):
        assert one(validation.image_error("i"), i=bad) == "Invalid base64 encoding"
    assert one(validation.image_error("i"), i="data:,") == "Empty base64 image data"
    assert one(validation.image_error("i"), i=None) == "Image data must be a non-empty string"


def test_faces(spark):
    rows = [
        ("same", "document", 0, [1.0, 0.0]),
        ("same", "selfie", 0, [2.0, 0.0]),
        ("diff", "document", 0, [1.0, 0.0]),
        ("diff", "document", 1, [0.0, 1.0]),
        ("diff", "selfie", 0, [0.0, 1.0]),
        ("one", "selfie", 0, [0.0, 1.0]),
        ("two", "document", 0, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "request_id string, side string, face_index int, embedding array<float>")
    got = {r.request_id: r for r in faces.match_faces(df).collect()}
    assert (got["same"].face_matched, got["same"].face_score, got["same"].several_faces) == (True, 1.0, False)
    assert (got["diff"].face_matched, got["diff"].face_score, got["diff"].several_faces) == (False, 0.0, True)
    assert got["one"].face_error == "No face detected in the document image" and got["one"].face_score == 0.0
    assert got["two"].face_details == ["Face matching error: No face detected in the selfie"]
    assert got["same"].face_details == ["Face match successful (score: 1.00)"]


REQUESTS = "request_id string, full_name string, dob string, nationality string, document_number string, expiry_date string, issuing_country string"


def verified(spark):
    requests = spark.createDataFrame(
        [
            ("ok", "Anna Eriksson", "2074-08-12", "uto", "k898902c3", "2012-04-15", "UTO"),
            ("near", "Maria Erikson", "1974-08-12", "QA", "K898902C4", "", ""),
            ("none", "Anna Eriksson", "", "", "", "", ""),
        ],
        REQUESTS,
    )
    docs = spark.createDataFrame([(r, "passport", "UTO", boxes(LINE1, READ2)) for r in ("ok", "near")], DOCS)
    same = [(r, s, 0, [1.0]) for r in ("ok", "near") for s in ("document", "selfie")]
    match = faces.match_faces(spark.createDataFrame(same, "request_id string, side string, face_index int, embedding array<float>"))
    return kyc.verify(requests, kyc.read_documents(docs, F.lit("2012-01-01").cast("date")), match)


def test_verification(spark):
    got = {r.request_id: r for r in verified(spark).collect()}
    ok, near, none = got["ok"], got["near"], got["none"]
    fields = ["document_number", "last_name", "first_name", "date_of_birth", "nationality", "expiry_date", "issuing_country"]
    assert ok.comparison.matches == fields and ok.comparison.all_match
    assert (ok.risk_score, ok.risk_level) == (0, "low")
    assert [f.type for f in ok.risk_factors] == ["data_verification", "document_validation", "face_match"]
    assert [m.field for m in near.comparison.mismatches] == ["document_number", "date_of_birth", "nationality"]
    assert near.comparison.mismatches[0].similarity == pytest.approx(16 / 18)
    assert near.comparison.matches == ["last_name", "first_name"]
    assert (near.risk_score, near.risk_level, near.risk_factors[0].severity, near.risk_factors[1].severity) == (30, "medium", "medium", "high")
    assert near.risk_factors[0].description == "MRZ data mismatch: document_number (MRZ: K898902C3, Request: K898902C4)"
    assert (none.risk_score, none.risk_level, none.comparison) == (100, "high", None)
    nested = {r.request_id: r for r in kyc.verification_result(verified(spark), F.lit("2024-01-01T00:00:00")).collect()}
    assert nested["ok"].verification_result.document_validation.mrz_data.surname == "ERIKSSON"
    assert nested["none"].verification_result.face_match_details.score == 0.0


def test_engine_scores(one):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None)
    empty = F.array().cast("array<string>")
    score = lambda *a: one(risk.kyc_engine_score(*a)[0])
    assert score(yes, none, none, none, no, no, empty, empty) == 0
    assert score(no, F.lit(0.5), no, F.lit(0.4), yes, yes, empty, empty) == 100
    assert score(yes, F.lit(0.69), yes, F.lit(0.6), no, yes, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("q"))) == 20 + 15 + 10 + 10 + 3
    found = one(risk.kyc_engine_score(yes, F.lit(0.8), none, none, no, no, F.array(F.lit("a")), none)[1])
    assert [(f.type, f.severity, f.description) for f in found] == [
        ("kyc_face_match", "low", "Moderate face match confidence (80.00%)"),
        ("kyc_validation", "low", "Missing required fields: a"),
    ]


def test_combined_scores(spark):
    half = lambda *rows: spark.createDataFrame([(i, s, "x", []) for i, s in rows], f"request_id string, risk_score int, risk_level string, risk_factors array<{risk.FACTOR}>")
    aml, ident = half(("a", 95), ("b", 50), ("c", 45)), half(("a", 35), ("b", 10), ("d", 80))
    engine = {r.request_id: (r.risk_score, r.risk_level) for r in kyc.combine_scores_engine(aml, ident).collect()}
    assert engine == {"a": (71, "high"), "b": (34, "low"), "c": (45, "medium"), "d": (80, "high")}
    route = {r.request_id: (r.combined_risk_score, r.combined_risk_level) for r in kyc.combine_scores(aml, ident).collect()}
    assert route == {"a": (71.0, "high"), "b": (34.0, "medium")}


def test_whole_assessment(spark):
    doc = ("passport", "K898902C3", "2012-04-15", None, "UTO", "Anna", "Eriksson", "2074-08-12", "UTO", None)
    requests = spark.createDataFrame([("r", ("Anna Eriksson", "1974-08-12", "UT"), (doc, "", "", None))], schemas.COMBINED_REQUEST)
    watchlist = spark.createDataFrame([("1", "UN", "ERIKSSON ANNA")], "dataid string, source string, name string")
    docs = spark.createDataFrame([("r", "passport", "UTO", boxes(LINE1, READ2))], DOCS)
    face = spark.createDataFrame([("r", s, 0, [1.0]) for s in ("document", "selfie")], "request_id string, side string, face_index int, embedding array<float>")
    got = assess_batch(requests, watchlist, docs, face, as_of()).first()
    assert (got.aml_risk_score, got.kyc_risk_score, got.combined_risk_score, got.combined_risk_level) == (80, 80, 80.0, "high")
    assert got.risk_factors[0].description == "Document expired on 2012-04-15" and got.risk_factors[0].days_expired == 4309


def test_names_of_any_length_are_whole(spark):
    from namesieve.functions.documents import request_names
    from namesieve.sources.ofac import name_parts

    long = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(long,)], "n string")
    first, last = df.select(*request_names(F.col("n"))).first()
    assert first == "w0" and last.split() == long.split()[1:]
    fourth = df.select(name_parts(F.col("n"))["fourth"]).first()[0]
    assert fourth.split() == long.split()[3:]
