"""Ingest: content hashes, the exact-duplicate gate, and the whole dataflow of a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def image_id(content: Column) -> Column:
    """Default id of an image: the first 16 hex digits of its content's hash."""
    return F.substring(content_hash(content), 1, 16)


def gate(arrivals: DataFrame, store: DataFrame, content: str = "content", order: str = "image_id") -> DataFrame:
    """Arrivals whose content is neither in the store nor in an earlier arrival, with content_hash.

    The store's hashes are its column content_hash, or made of its content where
    it has no such column. Of the store only the hashes that arrive are shuffled.
    """
    hashed = arrivals.withColumn("content_hash", content_hash(F.col(content)))
    known = store.select("content_hash") if "content_hash" in store.columns else store.select(content_hash(F.col(content)).alias("content_hash"))
    known = known.join(hashed.select("content_hash").distinct(), "content_hash", "left_semi").distinct()
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("__first"))
    return hashed.join(known, "content_hash", "left_anti").join(first, "content_hash").where(F.col(order) == F.col("__first")).drop("__first")


def embed(images: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Hook for model inference: ``function`` maps an iterator of pandas frames of images to frames of ``schema``."""
    return images.mapInPandas(function, schema)


def batch(images: DataFrame, store: DataFrame, content: str = "content", near: float | None = None, centroids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The collections that a batch of analysed images adds, and the batch's counters.

    images: image_id, ``content``, embedding, detections (array of structs with
    class_id and more), texts, and if there are any faces and face_embeddings.
    Hash and size are kept for each new image, so that a later batch, whose
    ``store`` is the collection "global", finds its duplicates. near: threshold of near-duplicate groups; their patches
    against ``store`` with the new images come as "groups". centroids: new
    images get their cluster at once.
    """
    from pixelgrove.operators import clustering, detections, duplicates, faces, ocr

    fresh = gate(images, store, content)
    found = detections.fan_out(fresh)
    rows = fresh.select("image_id", "embedding", "content_hash", F.length(content).cast("long").alias("file_size_bytes"))
    if centroids is not None:
        rows = clustering.backfill(rows, clustering.assign(rows, centroids, "image_id"), "image_id")
    out = {"global": rows, "vehicles": found.where("route = 'vehicle'"), "people": found.where("route = 'person'"), "ocr": ocr.fan_out(fresh)}
    if {"faces", "face_embeddings"} <= set(images.columns):
        out["faces"] = faces.fan_out(fresh, embeddings="face_embeddings")
    if near is not None:
        old = store.select(F.col("image_id").alias("id"), "embedding", (F.col(duplicates.GROUP) if duplicates.GROUP in store.columns else F.lit(None).cast("string")).alias(duplicates.GROUP))
        new = fresh.select(F.col("image_id").alias("id"), "embedding", F.lit(None).cast("string").alias(duplicates.GROUP))
        out["groups"] = duplicates.join_or_create(old.unionByName(new), new, near)
    counts = images.agg(F.count(F.lit(1)).alias("received")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("indexed")))
    counts = counts.crossJoin(found.agg(F.count_if(F.col("route") == "vehicle").alias("vehicles"), F.count_if(F.col("route") == "person").alias("people"), F.count_if(F.col("route") == "other").alias("skipped")))
    out["counters"] = counts.withColumn("duplicates", F.col("received") - F.col("indexed"))
    return out


def collected(out: dict[str, DataFrame]) -> DataFrame:
    """(collection, id) of all rows that ``batch`` adds."""
    keys = {"global": "image_id", "vehicles": "detection_id", "people": "detection_id", "ocr": "ocr_id", "faces": "face_id"}
    parts = [out[name].select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id")) for name, key in keys.items() if name in out]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def nth_vehicle_missing(detections: DataFrame, n: int) -> DataFrame:
    """Images that have no n-th (from 0) vehicle, with how many they have."""
    from pixelgrove.operators.detections import route

    rows = detections.groupBy("image_id").agg(F.count_if(route(F.col("class_id")) == "vehicle").alias("vehicles"))
    return rows.where(F.col("vehicles") <= n)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
