import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pixelgrove.llm.common import join_uneven, key_filter, may_contain
from pixelgrove.llm.exact_dedup import DigestIndex, drop_copies, exact_dedup, sha256_digest

SCHEMA = "doc_id long, text string, digest string, n int"  # clashing names
ROWS = [(5, "a", "x", 1), (2, "a", None, 2), (9, "b", "x", 3), (1, None, "x", 4), (7, "", "x", 5), (None, "a", "x", 6), (None, "solo", "x", 7), (3, "c" * 300_000, "x", 8), (4, "c" * 300_000, "x", 9), (4, "c" * 300_000, "x", 9), (6, "A", "x", 1)]


def brute(rows, keep):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        out += [(i, best, len(ids), i == best) for i in ids]
    return sorted(out, key=str)


def run(spark, rows, **settings):
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA), **settings)
    return sorted([(r.id, r.keep_id, r.group_size, r.kept) for r in found.collect()], key=str)


def test_like_brute_force(spark):
    for keep in ("smallest", "largest"):
        assert run(spark, ROWS, keep=keep) == brute(ROWS, keep)


def test_collisions_are_told_apart_by_bytes(spark):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))
    assert run(spark, ROWS, digest=weak) == brute(ROWS, "smallest")


def test_empty_table(spark):
    assert run(spark, []) == []


def test_index_merges_run_after_run(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = DigestIndex(spark, path)
    assert index.compact().count() == 0 and index.rows().count() == 0
    index.flush(spark.createDataFrame([], "digest binary, id long"))
    assert index.runs == []
    want = {}
    for start, part in ((0, ["a", "b"]), (10, ["a", "c"]), (20, ["c"]), (30, ["d"] * 40)):
        rows = spark.createDataFrame([(start + i, t) for i, t in enumerate(part)], "id long, text string").repartition(12)
        index.flush(rows.select(sha256_digest(F.col("text")).alias("digest"), "id"))
        for i, t in enumerate(part):
            want.setdefault(t, []).append(start + i)
        if start != 10:
            index.compact()
        index = DigestIndex(spark, path)  # opened again
    assert len(index.flushed) > 8 and index.fresh == []
    assert sorted((r.smallest, r.largest, r.n) for r in index.compact().collect()) == sorted((min(v), max(v), len(v)) for v in want.values())
    asked = spark.createDataFrame([(t, hashlib.sha256(t.encode()).digest()) for t in "abz"], "t string, digest binary")
    assert sorted((r.t, r.smallest, r.n) for r in index.lookup(asked).collect()) == [("a", 0, 2), ("b", 1, 1)]
    assert {r.t for r in index.maybe(asked, "again").collect()} == {"a"}
    assert index.find([hashlib.sha256(b"a").digest()]).count() == 2 and index.find([hashlib.sha256(b"z").digest()]).count() == 0


def test_two_batches_like_one(spark, tmp_path):
    for keep in ("smallest", "largest"):
        path = f"file://{tmp_path}/{keep}"
        first, second = spark.createDataFrame(ROWS[:5], SCHEMA), spark.createDataFrame(ROWS[5:], SCHEMA)
        assert run(spark, ROWS[:5], keep=keep, path=path) == brute(ROWS[:5], keep)
        assert run(spark, ROWS[5:], keep=keep, path=path, earlier=first) == brute(ROWS, keep)
        assert run(spark, [], keep=keep, path=path, earlier=first.unionByName(second)) == brute(ROWS, keep)
        with pytest.raises(ValueError):
            run(spark, ROWS[:1], path=path)


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", None)], "doc_id string, text string")
    assert sorted([(r.id, r.keep_id, r.kept) for r in exact_dedup(docs).collect()], key=str) == sorted([("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)], key=str)


def test_rows_that_stay(spark):
    rows = [(2, "a", "en", 1), (2, "a", "en", 1), (5, "a", "fr", 2), (7, None, "en", 3), (3, "", None, 4), (None, "z", "en", 5), (None, "z", "en", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest string, __id int")
    out = drop_copies(docs, keep="largest")
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(5, "a"), (7, None), (None, "z")], key=str)
    assert sorted(r.doc_id or 0 for r in drop_copies(docs).collect()) == [0, 2, 3]


def test_uneven_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(400)] + [(None, -1)], "k int, v int")
    right = left.groupBy("k").count().where("k IS NOT NULL").select("k", F.col("count").alias("n"), (F.col("k") * 10).alias("p")).where("k <> 5")
    want = sorted(left.join(right, "k", "left").collect(), key=str)
    for least, hot in ((1000, 10), (50, 1000), (1, 2)):
        assert sorted(join_uneven(left, right, "k", "n", least, hot).collect(), key=str) == want


def test_filters_pass_every_key(spark):
    keys = spark.range(500).select((F.col("id") * 3).alias("k"))
    rows = spark.range(1500).select("id")
    for bits in (1 << 15, 1 << 20):
        found = {r.id for r in may_contain(rows, F.col("id"), key_filter(keys, "k", bits), bits).collect()}
        assert {3 * i for i in range(500)} <= found and (bits < 1 << 20 or len(found) < 510)
    assert may_contain(rows, F.col("id"), key_filter(keys.limit(0), "k", 1 << 15), 1 << 15).count() == 0
