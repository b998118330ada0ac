"""Combined assessment: screening and identity verification of the same requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.operators.aml import assess
from namesieve.operators.faces import match_faces
from namesieve.operators.kyc import combine_scores, read_documents, verify


def assess_batch(
    requests: DataFrame,
    watchlist: DataFrame,
    documents: DataFrame,
    faces: DataFrame,
    as_of: Column,
    rules: DataFrame | None = None,
    **options,
) -> DataFrame:
    """One combined row per request.

    ``requests``: ``request_id``, ``aml_data`` and ``kyc_data`` as in ``schemas.COMBINED_REQUEST``.
    Expiry date and issuing country are not part of the combined comparison.
    """
    person = requests.select("request_id", "aml_data.*")
    data = "kyc_data.document_data"
    identity = requests.select(
        "request_id",
        F.concat_ws(" ", f"{data}.first_name", f"{data}.last_name").alias("full_name"),
        F.col(f"{data}.date_of_birth").alias("dob"),
        F.col(f"{data}.nationality").alias("nationality"),
        F.col(f"{data}.document_type").alias("document_type"),
        F.col(f"{data}.document_number").alias("document_number"),
    )
    aml = assess(person, watchlist, **options)
    kyc = verify(identity, read_documents(documents, as_of, rules), match_faces(faces), compare_expiry=False)
    return combine_scores(aml, kyc)
