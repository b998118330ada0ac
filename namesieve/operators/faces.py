"""Face similarity of documents and selfies from precomputed embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_THRESHOLD = 0.65  # fixed value


def cosine_similarity(a: Column, b: Column) -> Column:
    """``1 - cosine distance``; null for a zero vector or different lengths."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def match_faces(faces: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One row per request: ``face_matched, face_score``, face counts, error and details.

    ``faces``: ``request_id, side`` (``document`` or ``selfie``), ``face_index, embedding``. Each
    side's first face is compared. No face on a side is an error; more than one is only noted.
    """
    on = lambda side: F.col("side") == side
    first = lambda side: F.min_by(F.when(on(side), F.col("embedding")), F.when(on(side), F.col("face_index")))
    sides = faces.groupBy("request_id").agg(
        F.count_if(on("document")).cast("int").alias("document_face_count"),
        F.count_if(on("selfie")).cast("int").alias("selfie_face_count"),
        first("document").alias("_document"),
        first("selfie").alias("_selfie"),
    )
    similarity = cosine_similarity(F.col("_document"), F.col("_selfie"))
    return face_results(sides.withColumn("_similarity", similarity), threshold).drop("_document", "_selfie")


def face_results(sides: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Error, score, verdict and details from counts and ``_similarity``."""
    error = (
        F.when(F.col("document_face_count") == 0, "No face detected in the document image")
        .when(F.col("selfie_face_count") == 0, "No face detected in the selfie")
        .when(F.col("_similarity").isNull(), "Face verification failed")
    )
    score = F.when(F.col("face_error").isNull(), F.col("_similarity")).otherwise(0.0)
    matched = F.col("face_error").isNull() & (F.col("face_score") >= threshold)
    shown = F.format_string("%.2f", F.col("face_score"))
    details = F.array(
        F.when(F.col("face_error").isNotNull(), F.concat(F.lit("Face matching error: "), F.col("face_error")))
        .when(F.col("face_matched"), F.concat(F.lit("Face match successful (score: "), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("Face match failed (score: "), shown, F.lit(")")))
    )
    several = (F.col("document_face_count") > 1) | (F.col("selfie_face_count") > 1)
    return (
        sides.withColumn("face_error", error)
        .withColumn("face_score", score)
        .withColumn("face_matched", matched)
        .withColumn("face_details", details)
        .withColumn("several_faces", several)
        .drop("_similarity")
    )
