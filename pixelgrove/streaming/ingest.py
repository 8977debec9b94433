"""Streaming ingest and windowed statistics; an extension beyond batch requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelgrove.operators.ingest import gate
from pixelgrove.sources.store import Collection, upsert

FILES_PER_TRIGGER = 64


def read(spark: SparkSession, path: str, schema: str, files: int = FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, key: str = "image_id", content: str = "content", after: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch passes the exact-duplicate gate and is upserted by key, so a batch that runs twice changes nothing.

    Rows of new keys are appended, without reading more of the collection than
    its keys and hashes; only a key that comes again with other content makes it
    be written anew. after: maps (collection with the new rows, the new rows) to
    patched rows, such as duplicate groups; they are upserted too.
    """

    def one(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            if collection.exists():
                old = collection.read()
                # rows of a batch that is repeated are known by key and content; the gate must not see their own former copies
                others = old.select(key, "content_hash").join(batch.select(key), key, "left_anti")
                fresh = gate(batch, others, content, key).persist()
                same = fresh.join(old.select(key, F.col("content_hash").alias("__old")), key)
                changed, known = not same.where(F.col("__old") != F.col("content_hash")).isEmpty(), same.select(key)
                added = fresh.join(known, key, "left_anti")
                if changed or after:
                    new = upsert(old, fresh, key)
                    collection.write(upsert(new, after(new, fresh), key) if after else new)
                elif not added.isEmpty():
                    collection.append(added)
                fresh.unpersist()
            else:
                fresh = gate(batch, batch.limit(0), content, key)
                collection.write(upsert(fresh, after(fresh, fresh), key) if after else fresh)
        batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and means in tumbling or, with ``slide``, sliding windows; rows later than ``late`` are left out of a stream."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a key: rows with less than ``gap`` between them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
