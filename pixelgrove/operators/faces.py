"""Faces and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelgrove.functions.boxes import padded_crop
from pixelgrove.operators.search import top_k

#: The five landmarks in order.
LANDMARKS = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")


def named_landmarks(flat: Column) -> Column:
    """Struct of five points from ten numbers; null for fewer."""
    points = [F.array(F.get(flat, F.lit(2 * i)), F.get(flat, F.lit(2 * i + 1))).alias(name) for i, name in enumerate(LANDMARKS)]
    return F.when(F.size(flat) >= 10, F.struct(*points))


def normalised_landmarks(flat: Column, width: Column, height: Column) -> Column:
    return F.transform(flat, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))


def fan_out(images: DataFrame, image: str = "image_id", faces: str = "faces", embeddings: str = "embeddings") -> DataFrame:
    """One row per face with its embedding, as many as both lists have; a missing box is the whole image."""
    n = F.least(F.size(faces), F.size(embeddings))
    rows = images.select(image, F.posexplode(F.slice(F.arrays_zip(F.col(faces).alias("face"), F.col(embeddings).alias("embedding")), 1, n)).alias("pos", "z"))
    whole = F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])
    return rows.select(image, "pos", F.concat_ws("_", F.col(image).cast("string"), F.lit("face"), F.col("pos").cast("string")).alias("face_id"), F.coalesce("z.face.box", whole).alias("box"), named_landmarks(F.col("z.face.landmarks")).alias("landmarks"), F.col("z.face.confidence").alias("confidence"), F.col("z.embedding").alias("embedding"))


def ingest(faces: DataFrame, person: Column, width: Column, height: Column) -> DataFrame:
    """Adds person_id (given, or one new id for all faces of an image), is_reference (first face of a new person) and the padded crop."""
    new = person.isNull()
    made = F.concat(F.lit("person_"), F.substring(F.sha2(F.col("image_id").cast("string"), 256), 1, 12))
    return faces.withColumns({"person_id": F.coalesce(person, made), "is_reference": new & (F.col("pos") == 0), "crop": padded_crop(F.col("box"), width, height)})


def identify(faces: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6, id_col: str = "face_id", **settings) -> DataFrame:
    """(query_id, n_matches, best_person_id, is_identified): the best match's person, if any reaches the threshold and has one."""
    found = top_k(faces, queries, k, id_col, min_score=threshold, **settings).join(faces.select(F.col(id_col).alias("id"), "person_id"), "id")
    best = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min_by("person_id", "rank").alias("best_person_id"))
    asked = queries.select(F.col(settings.get("query_id", "query_id")).alias("query_id")).distinct()
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "best_person_id", F.col("best_person_id").isNotNull().alias("is_identified"))


def identify_with_faces(faces: DataFrame, queries: DataFrame, threshold: float = 0.7, most: int = 20, id_col: str = "face_id", **settings) -> DataFrame:
    """(query_id, person_id, face_id, place): the person of the best match and up to ``most`` of their faces by confidence.

    A match without a person gives no rows.
    """
    found = top_k(faces, queries, 1, id_col, min_score=threshold, **settings).join(faces.select(F.col(id_col).alias("id"), "person_id"), "id").where("person_id IS NOT NULL")
    rows = found.select("query_id", "person_id").join(faces.select("person_id", F.col(id_col).alias("face_id"), "confidence"), "person_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "face_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("query_id", "person_id", "face_id", "place")


def person_faces(faces: DataFrame, most: int = 1000, reference_first: bool = True) -> DataFrame:
    """Faces of each person with their place: references first, or by confidence alone."""
    keys = [F.desc(F.coalesce("is_reference", F.lit(False)))] if reference_first else []
    order = Window.partitionBy("person_id").orderBy(*keys, F.desc("confidence"), "face_id")
    return faces.where("person_id IS NOT NULL").withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def reassign(faces: DataFrame, face_id: Column, person: Column) -> DataFrame:
    """Moves faces to a person; adds previous_person_id for them."""
    moved = F.coalesce(face_id, F.lit(False))
    return faces.withColumns({"previous_person_id": F.when(moved, F.col("person_id")), "person_id": F.when(moved, person).otherwise(F.col("person_id")), "is_reference": F.when(moved, False).otherwise(F.col("is_reference"))})


def persons(faces: DataFrame, most: int = 100) -> DataFrame:
    """(person_id, n_faces, sample_face_id): most faces first; the sample is a reference if there is one."""
    rows = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"), F.max(F.struct(F.coalesce("is_reference", F.lit(False)).alias("r"), (-F.col("face_id")).alias("f"))).alias("m"))
    return rows.select("person_id", "n_faces", (-F.col("m.f")).alias("sample_face_id")).orderBy(F.desc("n_faces"), "person_id").limit(most)


def parent(index: Column) -> Column:
    """Index of the person a face was found in; null for the whole image."""
    return F.nullif(index, F.lit(-1))
