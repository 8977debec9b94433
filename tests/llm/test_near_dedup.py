import random

from pyspark.sql import functions as F

from pixelgrove.llm.near_dedup import drop_near_copies, near_duplicates

SCHEMA = "doc_id long, text string, node string, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    import re

    import numpy as np

    sets, number = [], {}
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        sets.append([number.setdefault(g, len(number)) for g in grams])
    held = np.zeros((len(rows), max(len(number), 1)), "f4")
    for i, s in enumerate(sets):
        held[i, s] = 1
    common, n = (held @ held.T).astype("i8"), np.array([len(s) for s in sets])
    linked = (common > 0) & (100 * common >= percent * (n[:, None] + n[None] - common))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in np.argwhere(np.tril(linked, -1)).tolist():
        parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted([(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)], key=str)


def corpus(seed=3):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)]
    rows = []
    base = [r.choice(voc) for _ in range(150)]
    for _ in range(120):  # one crowd of near copies, some of them at the threshold
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(150)] = r.choice(voc)
        rows.append(" ".join(w))
    for _ in range(40):  # chains of edits
        w = [r.choice(voc) for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(1, 5)):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(voc)
            rows.append(" ".join(w))
    passage = [r.choice(voc) for _ in range(80)]
    rows += [" ".join([r.choice(voc) for _ in range(60)] + passage) for _ in range(80)]
    rows += ["Two words", "two  WORDS", "two\twords\n", "É é", "é é", "x", "X", "", None, " \t ", "a b c", "a b c", "b c a"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    r.shuffle(rows)
    return rows


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(*row, "x", "y") for row in rows], SCHEMA).repartition(3)
    found = near_duplicates(docs, **settings).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=str)


def test_components_like_brute_force(spark):
    rows = corpus()
    assert run(spark, rows, shingle=3, percent=85) == brute(rows, 3, 85)
    assert run(spark, rows, shingle=5, percent=80) == brute(rows, 5, 80)


def test_large_regions_are_cut_and_still_joined(spark):
    rows = corpus(8)
    assert run(spark, rows, shingle=3, percent=85, region_rows=20) == brute(rows, 3, 85)


def family(seed, size, pairs):
    """Texts of one template just below the threshold of each other, and pairs of them above it."""
    r = random.Random(seed)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(size):
        w = list(base)
        for at in r.sample(range(120), 3):
            w[at] = f"u{i}x{at}"
        rows.append(w)
    for i in range(pairs):
        w = list(rows[i])
        for at in r.sample(range(3, 117), 3):
            w[at] = f"v{i}x{at}"
        rows.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(rows)
    return rows


def test_pairs_in_a_family_just_below_the_threshold(spark):
    rows = family(5, 600, 60)
    want = brute(rows, 3, 85)
    assert sum(doc != of for doc, _, of in want) >= 60 and len({of for _, _, of in want}) > 500
    assert run(spark, rows, shingle=3, percent=85) == want
    assert run(spark, rows, shingle=3, percent=85, region_rows=50) == want


def on_a_passage(seed, pairs, shared, own, changed):
    """Pairs above the threshold whose texts share a passage with all others."""
    r = random.Random(seed)
    passage, rows = [f"p{seed}x{i}" for i in range(shared)], []
    for k in range(pairs):
        w = [f"o{seed}x{k}x{i}" for i in range(own)]
        rows.append(passage + w)
        v = list(w)
        for at in r.sample(range(3, own - 3), changed):
            v[at] = f"c{seed}x{k}x{at}"
        rows.append(passage + v)
    return [" ".join(w) for w in rows]


def test_pairs_on_a_shared_passage(spark):
    cases = ((340, 70, 5), (340, 50, 5), (340, 42, 5), (340, 32, 3))  # of all texts J = 0.70, 0.77, 0.80, 0.84
    rows = [t for i, (shared, own, changed) in enumerate(cases) for t in on_a_passage(i, 120, shared, own, changed)]
    rows = list(enumerate(rows))
    random.Random(1).shuffle(rows)
    want = brute(rows, 3, 85)
    assert sum(doc != of for doc, _, of in want) == 480
    assert run(spark, rows, shingle=3, percent=85) == want


def test_passages_in_all_combinations(spark):
    r = random.Random(12)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(9)]
    rows = []
    for i in range(400):
        w = [x for k in sorted(r.sample(range(9), 6)) for x in passages[k]]
        for at in r.sample(range(len(w)), r.randint(0, 6)):
            w[at] = f"u{i}x{at}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 3, 85)
    assert len({of for _, _, of in want}) > 20
    assert run(spark, rows, shingle=3, percent=85, region_rows=100) == want


def test_very_long_and_repeated_rows(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(60_000))
    rows = [(9, long), (4, long + " end"), (6, "a b c d")] + [(6, "a b c d")] * 300 + [(6, long)] * 20
    assert run(spark, rows, shingle=3, percent=85) == brute(rows, 3, 85)


def test_repeats_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (5, "q r s t"), (7, None), (7, "lone text here")]
    found = run(spark, rows, shingle=3, percent=85)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, 5), (5, 2, 5), (7, 0, 7), (7, 1, 7)], key=str)


def test_empty_table_and_filter(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(2, "a b c d e f", "en"), (1, "a b c d e f", "en"), (3, "g h", None)], "doc_id long, text string, __id string").withColumnRenamed("__id", "__of").withColumn("__id", F.col("__of"))
    assert {(r.doc_id, r["__of"]) for r in drop_near_copies(docs).collect()} == {(1, "en"), (3, None)}
