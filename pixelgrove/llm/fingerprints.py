"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is the multiset of its words (lower case, cut at white space); a word
counts with its number of occurrences as its weight. For each of K samples and
each word, gamma-distributed r and c and a uniform b are drawn from hashes of
the word; with t = floor(ln(weight)/r + b), the word with the smallest
c / exp(r (t - b + 1)) gives the sample (word, t). Two texts agree in a sample
with a probability of their generalised Jaccard similarity, sum(min) / sum(max)
of the weights.

Neighbours in the order of ids come from a window over blocks of 256 ids, so
no task sorts the whole table; the first row of each next block is added to a
block as its end. The order of blocks themselves is found in levels of 2^16.

Cases: null text is the empty text; two texts without words are alike (1.0),
one without words is unlike any other (0.0). Rows of one id follow each other
in the order of their texts. A row without an id has no next document: nothing
replaces its last half, and its near_next is null. A single document is its
own next one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelgrove.llm.common import stage

SAMPLES = 32
ID_BITS, LEVEL_BITS = 8, 16


def terms(text: Column) -> Column:
    """Sorted 64-bit hashes of the words of a text, with repeats."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def weighted(hashes: str) -> Column:
    """(term, weight) of each distinct value of a sorted array column."""
    a = F.col(hashes)
    return F.transform(F.col("starts"), lambda p, j: F.struct(F.get(a, p).alias("term"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size(a)) - p).alias("weight")))


def starts(hashes: str) -> Column:
    """Positions at which a new value begins in a sorted array column."""
    a = F.col(hashes)
    return F.array_compact(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)))


def _uniform(bits: Column, n: int) -> Column:
    """Value in (0, 1) from the lowest n bits."""
    return (bits.bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) / F.lit(float(1 << n))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Rank and identity of one term in sample k: the smallest of all terms is the sample.

    31 bits of ln(c / exp(r (t - b + 1))), which lies between -100 and 5, then 32 bits of a hash of (term, t).
    """
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_uniform(x, 32) * _uniform(F.shiftrightunsigned(x, 32), 32))
    c = -F.log(_uniform(y, 21) * _uniform(F.shiftrightunsigned(y, 21), 21))
    b = _uniform(F.shiftrightunsigned(y, 42), 21)
    t = F.floor(log_weight / r + b)
    rank = F.floor((F.log(c) - r * (t - b + 1) + 128) * F.lit(float(1 << 23)))
    return F.shiftleft(rank, 32).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signature(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and ``fingerprint`` array<int> from rows of keys, term, weight; a null term alone gives null samples."""
    rows = rows.withColumn("lw", F.log(F.col("weight").cast("double")))
    least = [F.min(sample(F.col("term"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)]
    low = [(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int") for k in range(samples)]
    return rows.groupBy(*keys).agg(*least).select(*keys, F.array(*low).alias("fingerprint"))


def fingerprint(docs: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of each key's text."""
    rows = docs.select(*keys, terms(F.coalesce(F.col(text_col), F.lit(""))).alias("hashes"))
    rows = rows.select("*", starts("hashes").alias("starts")).select(*keys, F.explode_outer(weighted("hashes")).alias("w"))
    return signature(rows.select(*keys, "w.term", "w.weight"), keys, samples)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are alike."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def as_hex(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.coalesce(F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0"), F.lit("-"))), "")


def successors(keys: DataFrame, levels: int = 2) -> DataFrame:
    """(k, next) for distinct long k; the last is followed by the first.

    A window holds at most 2^16 keys; above the levels, at most 2^24 groups meet for keys of 56 bits, and one for dense keys up to 2^32.
    """
    if not levels:
        order = Window.orderBy("k")
        return keys.select("k", F.coalesce(F.lead("k").over(order), F.first("k").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    keys = keys.withColumn("up", F.shiftright("k", LEVEL_BITS))
    heads = keys.groupBy("up").agg(F.min("k").alias("head"))
    above = successors(heads.select(F.col("up").alias("k")), levels - 1)
    after = above.join(heads.withColumnRenamed("up", "next"), "next").select(F.col("k").alias("up"), F.col("head").alias("next_head"))
    own = keys.withColumn("follows", F.lead("k").over(Window.partitionBy("up").orderBy("k")))
    return own.join(after, "up").select("k", F.coalesce("follows", "next_head").alias("next"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    lone = -F.lit(1 << 60) - F.pmod(F.xxhash64(text), F.lit(1 << 40))
    src = docs.select(F.coalesce(F.shiftright(doc_id, ID_BITS), lone).alias("g"), doc_id.alias("doc_id"), text.alias("text"))
    known = src.where("doc_id IS NOT NULL")
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("doc_id", "text"))).where("n = 1").select(F.col("g").alias("to_g"), "text")
    ends = successors(known.select(F.col("g").alias("k")).distinct()).select(F.col("k").alias("g"), F.col("next").alias("to_g"))
    ends = ends.join(first, "to_g").select("g", F.lit(True).alias("end"), F.lit(None).cast("long").alias("doc_id"), "text", "to_g")
    rows = src.select("g", F.lit(False).alias("end"), "doc_id", "text", F.col("g").alias("to_g")).unionByName(ends)
    order = Window.partitionBy("g").orderBy("end", "doc_id", "text")
    rows = rows.select("*", F.row_number().over(order).alias("n"), F.lead("text").over(order).alias("next_text"), F.lead("to_g").over(order).alias("next_g"), F.lead("end").over(order).alias("wraps")).where("NOT end")

    has_id, n_chars = F.col("doc_id").isNotNull(), F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.when(has_id, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(F.lit("")))
    rows = rows.select("g", "n", "doc_id", n_chars.cast("long").alias("n_chars"), F.when(has_id, F.col("next_g")).alias("next_g"), F.when(F.col("wraps"), 1).otherwise(F.col("n") + 1).alias("next_n"), F.array(F.col("text"), edited).alias("both"))
    keys = ["g", "n", "doc_id", "n_chars", "next_g", "next_n", "edited_sha256", "side"]
    rows = rows.select("*", F.sha2(F.get("both", F.lit(1)), 256).alias("edited_sha256"), F.posexplode("both").alias("side", "text"))
    prints = fingerprint(rows, keys, "text", samples)  # grouped where the window left the rows, without a shuffle
    pairs = prints.groupBy(*keys[:-1]).agg(F.sort_array(F.collect_list(F.struct("side", "fingerprint"))).alias("f"))
    pairs = pairs.select(*keys[:-1], F.get("f", F.lit(0))["fingerprint"].alias("fingerprint"), F.get("f", F.lit(1))["fingerprint"].alias("edited_fingerprint"))
    done = stage(pairs, "fingerprints")
    other = done.select(F.col("g").alias("next_g"), F.col("n").alias("next_n"), F.col("fingerprint").alias("next_fingerprint"))
    out = done.join(other, ["next_g", "next_n"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
