"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelgrove.llm.common import stage

#: Bound of a sample's texts together; texts longer than a sixteenth of it are left out.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, sample_rows: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of labelled ids, one row of each, picked by a hash of the id.

    The sample has at most ``sample_rows`` rows and ``sample_bytes`` bytes of
    whole texts. usable: condition on ``doc_id`` for a label to be used. Of rows
    that repeat an id one is taken, by a hash of its text. Only the ids that are
    picked are broadcast or meet in one task: their bound is sample_rows.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
    order = F.xxhash64("doc_id", F.lit(17))
    picked = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stage(rows.withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "labelled-rows")
    lengths = sample.where(F.col("n") <= sample_bytes // 16).select("doc_id", F.sum("n").over(Window.orderBy(order, "doc_id")).alias("n"))
    kept = lengths.where(F.col("n") <= sample_bytes).select("doc_id")
    return sample.join(F.broadcast(kept), "doc_id", "left_semi").select("doc_id", "text", "label")
