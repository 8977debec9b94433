"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelgrove.sources.scratch import scratch_path, stage

__all__ = ["documents", "join_uneven", "key_filter", "may_contain", "scratch_path", "stage", "unused"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, such that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One-hash Bloom filter of ``keys[key]`` as a table of bitmap rows.

    Fixed size whatever the input: at most ``bits / 32768`` rows of 4 KB, so
    it can be broadcast. Returns (bucket long, bitmap binary).
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    slots = keys.select(slot.alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def may_contain(rows: DataFrame, key: Column, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the filter; a row of another key passes only by a clash of bits."""
    slot, names = F.pmod(F.xxhash64(key), F.lit(bits)), rows.columns
    rows = rows.withColumn("__slot", slot)
    pos = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.shiftright(byte, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), (pos % 8).cast("int"))) != 0
    held = F.broadcast(bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
    return rows.join(held, F.bitmap_bucket_number("__slot") == F.col("__bucket")).where(hit).select(*names)


def join_uneven(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, least: int = 1000, most_hot: int = 10_000, how: str = "left") -> DataFrame:
    """Left or inner join to unique keys of ``right`` whose column ``weight`` tells how many rows of ``left`` they have.

    Keys with more than ``least`` rows, and more than one in ``most_hot`` of all,
    are joined by a broadcast where the rows lie: there are at most ``most_hot``
    of them. So no task of the shuffled rest gets a key with a large share.
    ``right`` is read several times, so it is best a written table.
    """
    keys = [key] if isinstance(key, str) else key
    total, largest = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    bound = max(least, total // most_hot)
    if largest <= bound:
        return left.join(right, keys, how)
    hot = right.where(F.col(weight) > bound)
    spread = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) <= bound), keys, how)
    return spread.unionByName(rest.select(*spread.columns))
