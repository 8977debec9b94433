"""Recognised text: fan-out, search, reading order, filters."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pixelgrove.functions.texts import LEAST_GRAM, MOST_GRAM, grams, tokens

#: Constants of the BM25 weights, and the weight of a phrase match.
K1, B, PHRASE = 1.2, 0.75, 2.0
#: Bytes of words in a segment of the text index; a longer line is a segment of its own.
MOST_SIGNS = 1 << 22


def fan_out(images: DataFrame, image: str = "image_id", texts: str = "texts") -> DataFrame:
    """One row per line that is not blank, with its position in the whole list."""
    rows = images.select(image, F.posexplode(texts).alias("pos", "text")).where(F.trim("text") != "")
    return rows.withColumn("ocr_id", F.concat_ws("_", F.col(image).cast("string"), F.lit("ocr"), F.col("pos").cast("string")))


def full_text(texts: Column) -> Column:
    return F.array_join(texts, " ")


def shown(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def confident(lines: DataFrame, det: float = 0.5, rec: float = 0.8) -> DataFrame:
    return lines.where((F.col("det_score") >= det) & (F.col("rec_score") >= rec))


def of_image(lines: DataFrame, most: int = 1000, image: str = "image_id", id_col: str = "ocr_id") -> DataFrame:
    """Lines of each image with their place by detection score."""
    order = Window.partitionBy(image).orderBy(F.desc("det_score"), id_col)
    return lines.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def exact(lines: DataFrame, text: str, column: str = "text") -> DataFrame:
    return lines.where(F.col(column) == text)


def gram_count(text: Column) -> Column:
    """Number of n-grams of a text, from the lengths of its words."""
    fits = lambda t: sum((F.greatest(F.length(t) - (n - 1), F.lit(0)) for n in range(LEAST_GRAM, MOST_GRAM + 1)), F.lit(0))
    return F.aggregate(tokens(text), F.lit(0), lambda s, t: s + fits(t))


def search(lines: DataFrame, query: str, k: int = 10, min_score: float = 0.0, query_grams: bool = False, id_col: str = "ocr_id", text_col: str = "text") -> DataFrame:
    """(id, score, rank) by BM25 over the n-grams of each line, plus PHRASE times it where the query is part of the line.

    Query terms are whole words, which only match if they are as long as an
    n-gram; with ``query_grams`` their n-grams count instead. A term's
    frequency in a line is its number of overlapping occurrences, as n-grams do
    not leave their word and terms have no separators. So lines are projected
    twice, for the totals and for the scores, and nothing is exploded or joined.
    """
    terms = query_terms(lines.sparkSession, query, query_grams)
    if not terms:
        return lines.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    low = F.lower(F.col(text_col))
    tf = {f"tf{i}": F.when(F.contains(low, F.lit(t)), F.regexp_count(low, F.lit(f"(?={t})"))).otherwise(F.lit(0)) for i, t in enumerate(terms)}
    total = lines.agg(F.count(F.lit(1)).alias("docs"), F.avg(gram_count(F.col(text_col))).alias("mean"), *[F.count_if(F.contains(low, F.lit(t))).alias(f"tf{i}") for i, t in enumerate(terms)]).first()
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    rows = lines.where(hit).select(F.col(id_col).alias("id"), low.alias("low"), gram_count(F.col(text_col)).alias("len"), *[c.alias(n) for n, c in tf.items()])
    weight = F.lit(0.0)
    for n in tf:
        idf = log(1 + (total.docs - total[n] + 0.5) / (total[n] + 0.5))
        weight = weight + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("len") / (total.mean or 1.0)))
    score = weight * F.when(F.contains("low", F.lit(query.lower())), 1 + PHRASE).otherwise(F.lit(1.0))
    out = rows.select("id", score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= min_score))
    return _best(out, k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).cast("long"))


def query_terms(spark: SparkSession, query: str, query_grams: bool = False) -> list[str]:
    """The terms a query is searched by."""
    asked = tokens(F.lit(query))
    asked = F.flatten(F.transform(asked, lambda t: grams(t))) if query_grams else F.filter(asked, lambda t: F.length(t).between(LEAST_GRAM, MOST_GRAM))
    return sorted(set(spark.range(1).select(asked.alias("t")).first().t))  # as many as the query has


def _numbers(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Each run of values, from each start to the next, as bytes: seven bits a byte, the lowest first; the last has no high bit."""
    size = np.ones(len(values), "i8")
    for i in range(1, 5):
        size += values >= 1 << 7 * i
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, "u1")
    for i in range(5):
        more = size > i
        out[(ends - size)[more] + i] = (values[more] >> 7 * i & 127) | (size[more] > i + 1) * 128
    offsets = np.concatenate([(ends - size)[starts], [len(out)]]).astype("i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _values(data: bytes) -> np.ndarray:
    """The values that ``_numbers`` wrote."""
    b = np.frombuffer(data, "u1").astype("i8")
    starts = np.concatenate([[0], np.flatnonzero(b < 128) + 1])[:-1]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 127) << 7 * place, starts)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, n of them."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _fits(length: np.ndarray) -> np.ndarray:
    """Number of n-grams of words of these lengths."""
    return sum(np.maximum(length - (n - 1), 0) for n in range(LEAST_GRAM, MOST_GRAM + 1))


def _word_grams(words: pa.Array, length: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct n-grams in order, the number of each n-gram of each word, where each word's begin)."""
    signs, code = np.unique(np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "u4"), return_inverse=True)
    begins, first = np.cumsum(length) - length, np.cumsum(_fits(length)) - _fits(length)
    held, done = np.zeros((int(_fits(length).sum()), MOST_GRAM), "u4"), first.copy()
    for n in range(LEAST_GRAM, MOST_GRAM + 1):
        here = np.maximum(length - (n - 1), 0)
        at, of = _spread(done, here), _spread(begins, here)
        for i in range(n):
            held[at, i] = code[of + i] + 1
        done += here
    if len(signs) < 1 << 16:
        key = np.zeros(len(held), "u8")
        for i in range(MOST_GRAM):
            key = key << np.uint64(16) | held[:, i].astype("u8")
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        distinct = held[one]
    else:
        distinct, number = np.unique(held, axis=0, return_inverse=True)
    text = np.ascontiguousarray(np.concatenate([[0], signs]).astype("u4")[distinct]).view(f"<U{MOST_GRAM}").ravel()
    return pa.array(text.tolist(), pa.string()), number.ravel(), first


def postings(lines: DataFrame, id_col: str = "ocr_id", text_col: str = "text") -> DataFrame:
    """(segment, term, n, lines, tfs, ids, lens): which lines have an n-gram, and how often; each part in the order of terms.

    A segment is some thousand lines that lie together, so nothing is shuffled.
    Its row with an empty term has their ids and lengths in n-grams, each other
    one a term: the number of lines with it, their places in the segment, as
    steps from one to the next, and the term's frequency in each, as
    ``_numbers``. Stored in this order, a search reads the few pages of its
    terms; a frequent term lies in all parts.
    """
    kind, most = lines.select(id_col).schema[0].dataType.simpleString(), MOST_SIGNS

    def piece(segment: int, ids: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
        count = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        held = words.flatten().dictionary_encode()
        code, length = held.indices.to_numpy().astype("i8"), pc.utf8_length(held.dictionary).to_numpy().astype("i8")
        line, fits = np.repeat(np.arange(len(count)), count), _fits(length)
        lens = np.bincount(line, fits[code], len(count)).astype("i8")
        names = ["segment", "term", "n", "lines", "tfs", "ids", "lens"]
        listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        total = listed(pa.array(lens, mask=words.is_null().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([""]), pa.array([len(ids)]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), listed(ids), total], names)
        if not fits.sum():
            return
        terms, number, first = _word_grams(held.dictionary, length)
        # one value for each n-gram of each word: equal ones follow each other when sorted
        bits = int(len(count)).bit_length()
        key = number[_spread(first[code], fits[code])] << bits | np.repeat(line, fits[code])
        key.sort()
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf, key = np.diff(np.append(begin, len(key))), key[begin]
        term, place = key >> bits, key & (1 << bits) - 1
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        step = np.diff(place, prepend=0)
        step[starts] = place[starts]
        n, nulls = len(starts), lambda a: pa.nulls(len(starts), a.type)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), terms.take(pa.array(term[starts])), pa.array(np.diff(np.append(starts, len(term)))), _numbers(step, starts), _numbers(tf, starts), nulls(listed(ids)), nulls(total)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            # about as many signs of text, in whole lines
            size = np.cumsum(pc.binary_length(batch.column("words").flatten()).to_numpy(zero_copy_only=False).astype("i8"))
            ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            chunk = np.concatenate([[0], size])[ends] // most
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield from piece(segment, batch.column("id").slice(i, j - i), batch.column("words").slice(i, j - i))
                    segment += 1

    # words without n-grams are left behind
    words = F.filter(tokens(F.col(text_col)), lambda t: F.length(t) >= LEAST_GRAM)
    rows = lines.select(F.col(id_col).alias("id"), words.alias("words"))
    return rows.mapInArrow(run, f"segment long, term string, n long, lines binary, tfs binary, ids array<{kind}>, lens array<long>").sortWithinPartitions("term", "segment")


def index_totals(index: DataFrame) -> DataFrame:
    """One row that goes with the postings: docs and mean, the number of lines and their mean length in n-grams."""
    lens = F.filter("lens", lambda v: v.isNotNull())
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda s, v: s + v)
    return index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), (F.sum(total) / F.sum(F.size(lens))).alias("mean"))


def _hits(index: DataFrame, terms: list[str]) -> DataFrame:
    """(id, term, tf, len) of the lines with the terms."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        names, out = ["id", "term", "tf", "len"], []
        rows = group.column("term").to_pylist()
        head = rows.index("")
        ids, lens = group.column("ids")[head].values, group.column("lens")[head].values
        for i, term in enumerate(rows):
            if i != head:
                place, tf = pa.array(np.cumsum(_values(group.column("lines")[i].as_py()))), _values(group.column("tfs")[i].as_py())
                out.append(pa.table([ids.take(place), pa.array([term] * len(tf)), pa.array(tf), lens.take(place)], names))
        return pa.concat_tables(out) if out else pa.table([ids[:0], pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names)

    held = index.where(F.col("term").isin(["", *terms]))
    return held.groupBy("segment").applyInArrow(run, f"id {kind}, term string, tf long, len long")


def search_index(index: DataFrame, totals: DataFrame, lines: DataFrame, query: str, k: int = 10, min_score: float = 0.0, query_grams: bool = False, id_col: str = "ocr_id", text_col: str = "text") -> DataFrame:
    """The result of ``search`` from stored postings; of ``lines`` only the ids of those with the phrase go on."""
    terms, total = query_terms(lines.sparkSession, query, query_grams), totals.first()
    if not terms:
        return lines.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    known = {r.term: r.n for r in index.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(log(1 + (total.docs - known.get(t, 0) + 0.5) / (known.get(t, 0) + 0.5))))])
    weight = F.element_at(idf, F.col("term")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (total.mean or 1.0)))
    scored = _hits(index, terms).groupBy("id").agg(F.sum(weight).alias("score"))
    phrase = lines.where(F.contains(F.lower(F.col(text_col)), F.lit(query.lower()))).select(F.col(id_col).alias("id"), F.lit(1 + PHRASE).alias("more"))
    out = scored.join(phrase, "id", "left").select("id", (F.col("score") * F.coalesce("more", F.lit(1.0))).alias("score")).where((F.col("score") > 0) & (F.col("score") >= min_score))
    return _best(out, k)


def reading_order(boxes: DataFrame, gap: float = 10.0, image: str = "image_id", id_col: str = "box_id") -> DataFrame:
    """Adds line and place: by y, a gap of at least ``gap`` to the box before starts a line; inside a line by x."""
    by_y = Window.partitionBy(image).orderBy("y", id_col)
    rows = boxes.withColumn("__new", F.coalesce((F.col("y") - F.lag("y").over(by_y) >= gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("line", F.sum("__new").over(by_y.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(image).orderBy("line", "x", "y", id_col)).cast("long"))
