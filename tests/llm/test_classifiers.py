import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelgrove.llm import quality, toxicity
from pixelgrove.llm.training import held_out, labelled_rows

DOCS = "doc_id long, text string, score string, label string, __quality string"


def made(n=600, seed=1):
    """(id, text, quality, toxic): prose; some rows have noisy lines, some a rude word."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(r.randint(4, 20))).capitalize() + "." for _ in range(r.randint(1, 6))]
        good, toxic = int(r.random() < 0.8), int(r.random() < 0.2)
        if toxic:
            k = r.randrange(len(lines))
            lines[k] = lines[k][:-1] + f" {r.choice(['blorg', 'snark'])} {word()}."
        if not good:
            lines += [" | ".join(word().upper() + "!!" for _ in range(12))] * r.randint(1, 4)
        out.append((i, "\n".join(lines), good, toxic))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, *_ in rows], DOCS)
    return docs, spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = made()
    docs, labels = frames(spark, rows)
    out = held_out(F.col("doc_id"), 3, 1)
    for name, col, limit, train, score in (("toxic", 3, 0.7, toxicity.train, toxicity.score), ("quality", 2, 0.3, quality.train, None)):
        model = train(labelled_rows(docs, labels, name, ~out, 10_000))
        scored = score(docs, model) if score else quality.score(docs.select("doc_id", "text"), model)
        found = {r.doc_id: r.score for r in scored.where(out).collect()}
        right = [(found[r[0]] >= limit) == bool(r[col]) for r in rows if r[0] in found]
        assert len(right) > 100 and np.mean(right) > 0.95, (name, np.mean(right))


def test_order_and_labels_of_held_out_rows_do_not_matter(spark):
    rows = made(120)
    docs, labels = frames(spark, rows)
    out = held_out(F.col("doc_id"), 5, 0)
    a = quality.train(labelled_rows(docs, labels, "quality", ~out, 1000))
    b = quality.train(labelled_rows(docs.repartition(5), labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).repartition(2), "quality", ~out, 1000))
    assert a == b


def test_sample_has_one_row_an_id_and_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(7, None)] + [(i, "abcdefgh" * 4) for i in range(100, 150)] + [(99, "x" * 900)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in [7, 7, 99, *range(100, 150)]], "doc_id long, toxic int")
    every = labelled_rows(docs, labels, "toxic", F.lit(True), 1000).collect()
    assert sorted(r.doc_id for r in every) == [7, 99, *range(100, 150)]
    assert every[0].label == 1 and {r.text for r in labelled_rows(docs.repartition(2), labels, "toxic", F.lit(True), 1000).collect()} == {r.text for r in every}
    few = labelled_rows(docs, labels, "toxic", F.lit(True), 1000, sample_bytes=640).collect()
    assert 15 <= len(few) <= 21 and sum(len((r.text or "").encode()) for r in few) <= 640 and 99 not in {r.doc_id for r in few}
    assert set(map(tuple, few)) <= set(map(tuple, every))


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """Weights and bias by the published update, one coordinate after the other."""
    from math import copysign, exp, log, sqrt

    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - copysign(l1, z[i])) / ((beta + sqrt(n[i])) / alpha + l2)
    rate = sum(y for _, y in rows) / len(rows)
    bias, squares = log(rate / (1 - rate)), 1.0
    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + exp(-(bias + sum(w.values())))) - y
            for i in x:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (sqrt(n[i]) - sqrt(before)) / alpha * w[i]
            squares += g * g
            bias -= 0.3 * g / sqrt(squares)
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_like_a_plain_version():
    r = random.Random(5)
    rows = [(sorted(r.sample(range(60), 8)), 0) for _ in range(300)]
    rows = [(x, int(r.random() < (0.9 if 3 in x or 11 in x else 0.1))) for x, _ in rows]
    settings = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": 1.5, "l2": 0.1}
    want, bias = plain_ftrl(rows, **settings)
    numbers, weights, found = toxicity.fit([(np.array(x), y) for x, y in rows], bits=6, **settings)
    assert 2 <= len(want) < 60 and abs(found - bias) < 1e-9
    assert sorted(want) == numbers.tolist() and np.allclose([want[i] for i in numbers.tolist()], weights, atol=1e-5)


def test_sample_is_bounded_and_odd_labels_are_ignored(spark):
    docs, labels = frames(spark, made(100))
    assert labelled_rows(docs, labels, "toxic", F.lit(True), 10).count() == 10
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (999, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.label) for r in labelled_rows(docs, odd, "toxic", F.lit(True), 10).collect()] == [(2, 1)]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_missing_labels_nulls_empty_and_long_texts(spark, labels):
    rows = [(1, "fine words here."), (2, None), (3, ""), (None, "no id"), (4, "word " * 60_000), (4, "again"), (4, "again"), (5, "\n\n")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for found in (toxicity.score(docs, toxicity.train(labelled_rows(docs, given, "toxic", F.lit(True), 10))), quality.score(docs, quality.train(labelled_rows(docs, given, "quality", F.lit(True), 10)))):
        values = [r.score for r in found.collect()]
        assert len(values) == len(rows) and all(0 <= v <= 1 for v in values)
    assert toxicity.score(docs.limit(0), (np.zeros(0, "i8"), np.zeros(0, "f4"), 0.0)).count() == 0
    assert quality.score(docs.limit(0), {"rate": 1.0, "w": None}).count() == 0


def test_weights_are_sparse():
    rows = [(np.unique(toxicity.features(t, toxicity.WordHashes())), x) for _, t, _, x in made()]
    numbers, weights, _ = toxicity.fit(rows)
    seen = np.unique(np.concatenate([f for f, _ in rows]))
    assert 0 < len(numbers) == len(weights) < 0.05 * len(seen)


def test_forward_backward_like_enumeration():
    r = np.random.default_rng(5)
    counts = np.array([1, 4, 3])
    emit, trans = r.normal(size=8), r.normal(size=(2, 2))
    p, pairs = quality.marginals(emit, trans, counts, True)
    want, joint, at = [], np.zeros((2, 2)), 0
    for n in counts:
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(1 << n)]
        weight = np.array([np.exp(sum(emit[at + t] * s[t] for t in range(n)) + sum(trans[s[t], s[t + 1]] for t in range(n - 1))) for s in paths])
        weight /= weight.sum()
        want += [sum(w for w, s in zip(weight, paths, strict=True) if s[t]) for t in range(n)]
        for w, s in zip(weight, paths, strict=True):
            for t in range(n - 1):
                joint[s[t], s[t + 1]] += w
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, joint)


def test_line_tables_count_like_python():
    texts = ["Ab c!\n\nÉé | 12%%", "", "x\nx"]
    own, chars, counts = quality.lines_of(texts)
    assert counts.tolist() == [3, 1, 2] and chars.tolist() == [5, 0, 9, 0, 1, 1] and len(own) == 6
