import hashlib
from collections import Counter
from statistics import mean

from pixelgrove.llm.fingerprints import edited_and_next, successors

SCHEMA = "doc_id long, text string, g string, n string, both string"


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def run(spark, rows, **settings):
    return edited_and_next(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3), **settings).collect()


def test_edits_follow_the_order_of_ids_across_blocks(spark):
    ids = [-5, 0, 3, 255, 256, 700, 70_000, 20_000_000, 1 << 40, (1 << 62) + 5]
    texts = ["é1 a b c", "", "one two three four five six", None, "x", "long " * 3000, "one two", "😀😀😀 ok", "z z z", "last words"]
    rows = list(zip(ids, texts, strict=True))
    found = {r.doc_id: r for r in run(spark, rows)}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert found[i].n_chars == len(t)
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[j % 60] for j in range(i % 7, i % 7 + 40 + i % 13) for _ in range(1 + j % 3))) for i in range(200)]
    found = {r.doc_id: r for r in run(spark, rows, samples=64)}
    gaps = [found[i].near_next - jaccard(rows[i][1], rows[(i + 1) % 200][1]) for i in range(200)]
    assert abs(mean(gaps)) < 0.02 and mean(map(abs, gaps)) < 0.07


def test_ties_repeats_nulls_and_single_rows(spark):
    found = run(spark, [(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f"), (None, "e f"), (2, None), (3, "")])
    assert len(found) == 7
    assert {r.fingerprint for r in found if r.doc_id in (2, 3)} == {"-" * 32}
    assert {r.near_next for r in found if r.doc_id == 2} == {1.0}
    assert {r.near_next for r in found if r.doc_id is None} == {None}
    assert len({r.fingerprint for r in found if r.doc_id is None}) == 1
    one = run(spark, [(9, "only one here")])
    assert one[0].near_next == 1.0
    assert run(spark, []) == []


def test_successors_wrap_around(spark):
    keys = [0, 1, 65535, 65536, 1 << 33, 5, -1]
    found = {r.k: r.next for r in successors(spark.createDataFrame([(k,) for k in keys], "k long")).collect()}
    order = sorted(keys)
    assert found == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
