"""Hand cases and plain versions of the engine's own operators."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelgrove.functions import boxes as bx, texts as tx, vectors as vx
from pixelgrove.functions.jpeg import size_of
from pixelgrove.operators import clustering as cl, detections as dt, duplicates as dp, evaluation as ev, faces as fc, ocr, search as se
from pixelgrove.operators.ingest import batch, gate, nth_vehicle_missing
from pixelgrove.sources.store import Collection, benchmark_results, delete, export_csv, image_files, load_model, mosaic, patch, save_model, upsert


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vectors(spark, n=60, d=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")


# ---- vectors


def test_zero_vectors_and_scales(spark):
    zero, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, vx.unit(zero).alias("z"), vx.unit(a).alias("u"), vx.unit(zero, 1e-10).alias("f"), vx.cosine(zero, a).alias("c"), vx.scaled(F.lit(1.0), "os").alias("o"), vx.scaled(F.lit(-1.0), "cos").alias("s"))
    assert r.z == [0, 0] and r.u == [0.6, 0.8] and r.f == [0, 0] and r.c == 0 and (r.o, r.s) == (1.0, -1.0)
    with pytest.raises(ValueError):
        vx.scaled(F.lit(1.0), "other")


@pytest.mark.parametrize("most", [0, 4096])
def test_top_k_like_numpy_with_ties(spark, most):
    m, docs = vectors(spark)
    docs = docs.unionByName(spark.createDataFrame([(100, [float(x) for x in m[3]]), (101, None), (None, [1.0] * 8)], docs.schema))
    m = np.vstack([m, m[3]]).astype("f4").astype("f8")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([*range(60), 100])
    q = docs.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    for own in (False, True):
        found = se.top_k(docs, q, 4, exclude_self=own, most_broadcast=most).collect()
        for i in range(5):
            cos = np.round(u @ u[i], 12)
            order = [j for j in np.lexsort((ids, -cos)) if not (own and ids[j] == i)][:4]
            assert [r.id for r in sorted(found, key=lambda r: r.rank) if r.query_id == i] == ids[order].tolist()
    assert se.top_k(docs, q.limit(0), 4, most_broadcast=most).count() == 0 and se.top_k(docs.limit(0), q, 4, most_broadcast=most).count() == 0


def test_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    _, docs = vectors(spark, 80)
    want = {(r.a, r.b) for r in se.similar_pairs(docs, 0.3, scale="cos").collect()}
    monkeypatch.setattr(se.blocks, "__defaults__", (9,))
    assert {(r.a, r.b) for r in se.similar_pairs(docs, 0.3, scale="cos").collect()} == want and all(a < b for a, b in want)


def test_post_filter_stays_above_the_rank(spark):
    m, docs = vectors(spark)
    docs = docs.withColumn("k", F.col("id") % 2)
    q = docs.limit(1).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    assert se.filtered_top_k(docs, q, 10, F.col("k") == 1, "post").count() < 10 == se.filtered_top_k(docs, q, 10, F.col("k") == 1, "pre").count()
    assert set(se.with_source(se.top_k(docs, q, 3), docs, ["k"]).columns) == {"id", "query_id", "score", "rank", "k"}


# ---- clusters


def test_training_like_a_plain_version(spark):
    m, docs = vectors(spark, 90)
    cents = cl.train(docs, 5, 4)
    got = np.array([r.centroid for r in cents.orderBy("cluster_id").collect()])
    u = m.astype("f4").astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    seeds = [r.id for r in docs.orderBy(F.xxhash64("id"), "id").limit(5).collect()]
    c = u[sorted(seeds)]
    for _ in range(4):
        best = (u @ c.T).argmax(1)
        c = np.array([u[best == k].mean(0) if (best == k).any() else c[k] for k in range(5)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert np.allclose(got, c)
    with pytest.raises(ValueError):
        cl.train(docs, 10**6)


def test_fit_fills_in_all_rows_and_keeps_those_without_vectors(spark):
    _, docs = vectors(spark, 40)
    docs = docs.unionByName(spark.createDataFrame([(77, None)], docs.schema))
    cents, rows = cl.fit(docs, 1024, rounds=2)
    assert cents.count() == 16 and rows.where("cluster_id IS NULL").collect()[0].id == 77 and rows.count() == 41
    assert cl.centroid(cents, 3).count() == 1


def test_more_centroids_than_are_held_at_once(spark, monkeypatch):
    r = np.random.default_rng(8)
    m = np.concatenate([r.normal(size=(600, 8)), np.zeros((1, 8))])
    docs = spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(5)
    u = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    some = spark.createDataFrame([(100 - i, [float(x) for x in v]) for i, v in enumerate(m[:90])], "cluster_id long, centroid array<double>")
    ip = u @ u[:90].T
    plain = [{r.id: round(r.cluster_id) for r in cl.assign(docs, some).collect()}, sorted((r.cluster_id, *np.round(r.centroid, 9)) for r in cl.train(docs, 70, 2).collect())]
    assert all(abs(ip[i // 3, 100 - c] - ip[i // 3].max()) < 1e-12 for i, c in plain[0].items()) and plain[0][1800] == 11
    monkeypatch.setattr(cl, "MOST_CENTROIDS", 40)
    monkeypatch.setattr(cl, "FEW", 8)  # slices of forty centroids, in cells
    assert {r.id: r.cluster_id for r in cl.assign(docs, some).collect()} == plain[0]
    assert np.allclose(sorted((r.cluster_id, *r.centroid) for r in cl.train(docs, 70, 2).collect()), plain[1], atol=1e-8)
    rows = cl.fit(docs.where("id < 1800"), 16, 600, 0)[1].collect()
    assert len(rows) == 600 and all(r.cluster_id == r.id // 3 and abs(r.cluster_distance) < 1e-9 for r in rows)
    twice = docs.where("id < 300").unionByName(docs.where("id < 300").withColumn("id", F.col("id") + 3000))
    rows = sorted(cl.fit(twice, 16, 200, 0)[1].collect())  # equal rows have a centroid each
    assert [r.cluster_id for r in rows] == list(range(200))


def test_cells_meet_all_that_may_be_nearer():
    r = np.random.default_rng(9)
    base = r.normal(size=(30, 16))
    m = np.repeat(base, 100, 0) + 0.1 * r.normal(size=(3000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = np.concatenate([m[::7], r.normal(size=(200, 16)), np.zeros((2, 16))])
    v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    cells = cl._cells(np.arange(3000), m)
    at, top = cl._nearest(v, cells, np.full(len(v), 1 << 62), np.full(len(v), -np.inf))
    want = v @ m.T
    assert len(cells.pivots) > 40 and np.allclose(top, want.max(1)) and np.allclose(want[np.arange(len(v)), at], want.max(1)) and (at[-2:] == 0).all()


def test_balance_rules_are_strict_and_in_order(spark):
    def reason(sizes, new=0, old=100):
        z = spark.createDataFrame(list(enumerate(sizes)), "cluster_id int, n long")
        return cl.balance(cl.stats(z), F.lit(new), F.lit(old)).first().reason

    assert reason([10, 1]) is None and reason([11, 1]) == "imbalance" and reason([5] * 9 + [0]) is None and reason([5] * 8 + [0, 0]) == "empty"
    assert reason([5, 5], 50) is None and reason([5, 5], 51) == "new_data" and reason([0, 0]) == "empty" and reason([5, 5], 51, 0) is None


def test_model_round_trip(spark, tmp_path):
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id long, centroid array<double>")
    save_model(cents, f"file://{tmp_path}/m", F.lit("2024-01-01").cast("timestamp"), F.lit(7))
    found, meta = load_model(spark, f"file://{tmp_path}/m")
    assert found.count() == 2 and (meta.first().n_clusters, meta.first().n_vectors) == (2, 7)


# ---- duplicates


def test_greedy_groups_like_the_scan(spark):
    r = random.Random(4)
    for _ in range(3):
        edges = {tuple(sorted(r.sample(range(25), 2))) for _ in range(30)}
        near = {i: sorted({a + b - i for a, b in edges if i in (a, b)}) for i in range(25)}
        taken, want = set(), {}
        for i in range(25):
            if i not in taken:
                mine = [j for j in near[i] if j not in taken]
                if mine:
                    taken |= {i, *mine}
                    want |= {j: i for j in [i, *mine]}
        pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a long, b long, score double")
        assert {x.id: x.primary_id for x in dp.greedy_groups(pairs).collect()} == want
    assert dp.greedy_groups(pairs.limit(0)).count() == 0


def test_scan_makes_disjoint_groups_and_keeps_those_there_are(spark):
    angles = [0.0, 0.1, 0.2, 0.3, 2.0, 0.05]
    docs = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], "dup_old" if i == 5 else None, True if i == 5 else None, 1.0 if i == 5 else None) for i, a in enumerate(angles)], f"id long, embedding array<double>, {dp.GROUP} string, {dp.PRIMARY} boolean, {dp.SCORE} double")
    least = (1 + np.cos(0.11)) / 2
    first, third = [f"dup_{hashlib.sha256(i).hexdigest()[:12]}" for i in (b"0", b"2")]
    found = {r.id: (r[dp.GROUP], r[dp.PRIMARY]) for r in dp.scan(docs, least).collect()}
    assert found == {0: (first, True), 1: (first, False), 2: (third, True), 3: (third, False), 4: (None, None), 5: ("dup_old", True)}
    assert sorted((r.id, r[dp.PRIMARY]) for r in dp.own_groups(docs, least).collect()) == [(0, True), (1, False), (1, True), (2, False), (2, True), (3, False)]


def test_merging_needs_two(spark):
    with pytest.raises(ValueError):
        dp.merge(spark.createDataFrame([], "id long, duplicate_group_id string, is_duplicate_primary boolean, duplicate_score double"), ["a"])


# ---- boxes


def test_iou_cases(spark):
    b = lambda *v: bx.box(*[F.lit(float(x)) for x in v])
    r = one(spark, bx.iou(b(0, 0, 1, 1), b(0, 0, 1, 1)).alias("same"), bx.iou(b(0, 0, 1, 1), b(1, 1, 2, 2)).alias("corner"), bx.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("none"), bx.iou(b(0, 0, 2, 2), b(1, 0, 3, 2)).alias("third"))
    assert (r.same, r.corner, r.none) == (1, 0, 0) and abs(r.third - 1 / 3) < 1e-12


def test_rounding_of_letterboxes_is_half_to_even(spark):
    r = one(spark, bx.letterbox(F.lit(1280), F.lit(5)).alias("m")).m
    assert (r.scale, r.pad_y) == (0.5, (640 - 2) / 2)
    assert one(spark, bx.letterbox(F.lit(100), F.lit(50)).alias("m")).m.scale == 1.0


def test_nms_like_a_plain_version(spark):
    r = random.Random(2)
    rows = []
    for image in range(20):
        for det in range(r.randint(0, 15)):
            x, y = r.random(), r.random()
            rows.append((image, det, x, y, x + 0.1 + r.random() / 2, y + 0.1 + r.random() / 2, round(r.random(), 1), r.randint(0, 1)))
    df = spark.createDataFrame(rows, "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double, score double, class_id int")

    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    for aware in (False, True):
        want = set()
        for image in range(20):
            kept = []
            for a in sorted((x for x in rows if x[0] == image), key=lambda x: (-x[6], x[1])):
                if all(iou(a, b) <= 0.4 or (aware and a[7] != b[7]) for b in kept):
                    kept.append(a)
            want |= {(image, a[1]) for a in kept}
        assert {(x.image_id, x.det_id) for x in dt.nms(df, class_aware=aware).collect()} == want


def test_matching_of_empty_sets(spark):
    schema = "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double, score double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.5), (2, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], schema)
    b = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0, 0.4), (3, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], schema)
    found = {r.image_id: r for r in dt.metrics(dt.match(a, b)).collect()}
    assert (found[1].precision, found[1].recall, found[1].f1, found[1].mean_iou) == (1, 1, 1, 1) and abs(found[1].mean_conf_diff - 0.1) < 1e-9
    assert (found[2].n_test, found[2].f1) == (0, 0) and (found[3].n_reference, found[3].recall) == (0, 0)


def test_similarity_transform_of_a_reflection_has_no_negative_scale(spark):
    p = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    m = one(spark, bx.similarity(p([(0, 0), (2, 0), (0, 2)]), p([(1, 1), (1, 5), (-3, 1)])).alias("m")).m
    assert [round(m[k], 9) + 0.0 for k in ("a", "b", "tx", "ty")] == [0.0, 2.0, 1.0, 1.0]


def test_landmarks_and_trimmed_arrays(spark):
    ten, nine = F.array(*[F.lit(float(i)) for i in range(10)]), F.array(*[F.lit(float(i)) for i in range(9)])
    r = one(spark, fc.named_landmarks(ten).alias("a"), fc.named_landmarks(nine).alias("b"), dt.trimmed(ten, F.lit(2)).alias("c"), dt.trimmed(ten, F.lit(0)).alias("d"), bx.face_pixel(F.lit(255.5)).alias("e"))
    assert r.a.nose == [4, 5] and r.b is None and r.c == [0, 1] and r.d == [] and r.e == 1.0


# ---- text


def test_reading_order_gaps(spark):
    rows = [(1, 1, 5.0, 0.0), (1, 2, 1.0, 9.0), (1, 3, 0.0, 19.0), (1, 4, 2.0, 30.0), (2, 1, 0.0, 0.0)]
    found = ocr.reading_order(spark.createDataFrame(rows, "image_id int, box_id int, x double, y double")).where("image_id = 1").orderBy("place").collect()
    assert [(r.box_id, r.line) for r in found] == [(2, 0), (1, 0), (3, 1), (4, 2)]


def test_grams_and_tokens(spark):
    r = one(spark, tx.tokens(F.lit("A-b Çé12")).alias("t"), tx.grams(F.lit("abc")).alias("g"), tx.grams(F.lit("a")).alias("n"), tx.class_list(F.lit("1, 2,x")).alias("c"))
    assert r.t == ["a", "b", "çé12"] and sorted(r.g) == ["ab", "abc", "bc"] and r.n == [] and r.c == [1, 2]


def test_text_search_of_nothing(spark):
    lines = spark.createDataFrame([(1, "hello world"), (2, "help")], "ocr_id long, text string")
    assert [r.id for r in ocr.search(lines, "hel", query_grams=True).collect()] == [2, 1]
    assert ocr.search(lines, "zzz").count() == 0 and ocr.search(lines.limit(0), "hel").count() == 0 and ocr.search(lines, "").count() == 0


def test_postings_hold_every_gram(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÄßж中𝒳9") for _ in range(r.choice([1, 2, 3, 5, 9, 40])))
    texts = [" ".join(word() for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(80)] + ["the MIT", "The mit, the MITten", "-- !", "", None, "ab " * 500]
    lines = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "ocr_id string, text string").repartition(3)
    cut = lines.select("ocr_id", F.explode(tx.tokens(F.col("text"))).alias("w")).select("ocr_id", F.explode(tx.grams(F.col("w"))).alias("g"))
    want = sorted((x.ocr_id, x.g, x["count"]) for x in cut.groupBy("ocr_id", "g").count().collect())
    for most in (1 << 22, 400):
        monkeypatch.setattr(ocr, "MOST_SIGNS", most)
        index = ocr.postings(lines).cache()
        assert ocr.postings(lines)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the rows above
        terms = sorted({g for _, g, _ in want})
        assert sorted((x.id, x.term, x.tf) for x in ocr._hits(index, terms).collect()) == want
        total = ocr.index_totals(index).first()
        assert total.docs == len(texts) and abs(total.mean - lines.agg(F.avg(ocr.gram_count(F.col("text")))).first()[0]) < 1e-9
        for query, parts in (("the MIT", False), ("zzz", False)) if most == 400 else (("aba", True),):
            found = [(x.id, round(x.score, 9), x["rank"]) for x in ocr.search_index(index, ocr.index_totals(index), lines, query, 20, query_grams=parts).collect()]
            assert found == [(x.id, round(x.score, 9), x["rank"]) for x in ocr.search(lines, query, 20, query_grams=parts).collect()]
    empty = ocr.postings(lines.limit(0))
    assert ocr.search_index(empty, ocr.index_totals(empty), lines.limit(0), "the").count() == 0
    n = np.array([0, 127, 128, 16383, 16384, 1 << 21, (1 << 30) + 5, 7])
    coded = ocr._numbers(n, np.array([0, 3, 7]))
    assert [ocr._values(x.as_py()).tolist() for x in coded] == [n[:3].tolist(), n[3:7].tolist(), [7]]
    found, number, first = ocr._word_grams(pa.array(["".join(map(chr, range(0x4E00, 0x9FA0))) + "".join(map(chr, [*range(0xAC00, 0xD7A0), *range(0x20000, 0x2A6D0)])), "abc"]), np.array([0x9FA0 - 0x4E00 + 0xD7A0 - 0xAC00 + 0x2A6D0 - 0x20000, 3]))
    assert [found[int(x)].as_py() for x in number[first[1] :]] == ["ab", "bc", "abc"] and len(found) == len(number)


# ---- faces and evaluation


def test_identify_without_a_person(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0], None, 0.5), (2, [0.0, 1.0], 9, 0.5)], "face_id long, embedding array<double>, person_id int, confidence double")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, query_embedding array<double>")
    found = {r.query_id: r for r in fc.identify(faces, q, 1, 0.9).collect()}
    assert not found[0].is_identified and found[1].best_person_id == 9
    assert [r.query_id for r in fc.identify_with_faces(faces, q, 0.9).collect()] == [1]


def test_ingest_of_faces_and_parents(spark):
    rows = spark.createDataFrame([(1, 0, [0.1, 0.1, 0.5, 0.5]), (1, 1, [0.9, 0.9, 1.0, 1.0])], "image_id long, pos int, box array<double>")
    rows = rows.withColumn("box", bx.box(*[F.get("box", F.lit(i)) for i in range(4)]))
    found = fc.ingest(rows, F.lit(None).cast("string"), F.lit(100), F.lit(100)).orderBy("pos").collect()
    assert found[0].person_id == found[1].person_id and [r.is_reference for r in found] == [True, False]
    assert tuple(found[0].crop) == (6, 6, 54, 54) and found[1].crop.x2 == 100


def test_speedup_without_throughput(spark):
    tracks = spark.createDataFrame([("A", 0.0), ("B", 5.0)], "track string, throughput_rps double")
    assert {r.track: r.speedup for r in ev.speedup(tracks, "A").collect()} == {"A": 0.0, "B": 5.0}


# ---- store, files, streams


def test_store_versions(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}", "faces")
    assert not c.exists()
    c.create("id long, v string")
    c.create("id long, v string")
    assert c.version() == 1 and c.read().count() == 0
    c.write(spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"))
    assert c.get("id", 1, ["v"]).collect()[0].v == "a"
    assert c.scan(["id"], missing="v").collect()[0].id == 2 and c.size_mb() >= 0
    new = upsert(c.read(), spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), "id")
    c.write(patch(new, spark.createDataFrame([(1, None)], "id long, v string"), "id", ["v"]))
    assert sorted((r.id, r.v or "") for r in c.read().collect()) == [(1, ""), (2, "b"), (3, "c")]
    kept, gone = delete(c.read(), F.col("v") == "b")
    assert kept.count() == 2 and gone.first().deleted == 1


def test_files(spark, tmp_path):
    for name in ("b.jpg", "a.PNG", "c.txt"):
        (tmp_path / "img").mkdir(exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x" * 3)
    assert [r.path.rsplit("/")[-1] for r in image_files(spark, f"file://{tmp_path}/img", 5).collect()] == ["a.PNG", "b.jpg"]
    (tmp_path / "bench").mkdir()
    for i, t in enumerate(["A", "A", "B@16"]):
        (tmp_path / "bench" / f"{i}.json").write_text(json.dumps({"track": t, "throughput_rps": i}))
    found = benchmark_results(spark, f"file://{tmp_path}/bench").collect()
    assert [(r.track, r.throughput_rps) for r in found] == [("A", 0)]
    export_csv(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").first().b == "x"
    assert mosaic(spark.createDataFrame([(1, 1)], "g int, id int"), "g", "id").count() == 0


def test_jpeg_headers():
    frame = bytes.fromhex("FFC2001108") + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + bytes(10)
    assert size_of(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff" + frame[1:]) == (640, 480)
    assert size_of(b"\xff\xd8" + frame) == (640, 480)
    assert size_of(b"\x89PNG") == size_of(None) == size_of(b"\xff\xd8\xff") == size_of(b"\xff\xd8\xff\xe0\x00\x04ab") == (None, None)


IMAGES = "image_id long, content string, embedding array<float>, detections array<struct<class_id:int>>, texts array<string>"


def test_batch_ingest_and_missing_vehicles(spark):
    rows = [(1, "x", [1.0], [(0,), (2,), (77,)], ["a", " "]), (2, "x", [1.0], [(2,)], []), (3, "y", [0.5], [], ["b"]), (4, "old", [0.1], [(5,)], [])]
    images = spark.createDataFrame(rows, IMAGES)
    store = spark.createDataFrame([(9, "old", [0.1], [], [])], IMAGES)
    out = batch(images, store)
    c = out["counters"].first()
    assert (c.received, c.indexed, c.duplicates, c.vehicles, c.people, c.skipped) == (4, 2, 2, 1, 1, 1)
    assert [r.ocr_id for r in out["ocr"].orderBy("ocr_id").collect()] == ["1_ocr_0", "3_ocr_0"]
    assert gate(images.limit(0), store).count() == 0
    cents = spark.createDataFrame([(4, [1.0])], "cluster_id long, centroid array<double>")
    out = batch(images, store, near=0.99, centroids=cents)
    assert {r.image_id: r.cluster_id for r in out["global"].collect()} == {1: 4, 3: 4}
    assert {(r.id, r.action) for r in out["groups"].collect()} == {(1, "created_group"), (3, "created_group")}
    d = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "image_id int, class_id int")
    assert {r.image_id: r.vehicles for r in nth_vehicle_missing(d, 1).collect()} == {2: 0}


def test_streaming_ingest_equals_one_batch_and_repeats_change_nothing(spark, tmp_path):
    from pixelgrove.streaming.ingest import ingest, read, windowed

    schema = "image_id long, content string"
    src = f"file://{tmp_path}/src"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema).coalesce(1).write.parquet(src)
    c = Collection(spark, f"file://{tmp_path}", "images")
    for check in ("one", "two"):
        ingest(read(spark, src, schema, 1), c, f"file://{tmp_path}/{check}").awaitTermination()
        assert sorted(r.image_id for r in c.read().collect()) == [1, 2]
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    ingest(read(spark, src, schema, 1), c, f"file://{tmp_path}/two").awaitTermination()
    assert sorted(r.image_id for r in c.read().collect()) == [1, 2, 5]

    events = f"file://{tmp_path}/events"
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 'a' AS event_type, double(id) AS value FROM range(120)").write.parquet(events)
    stream = windowed(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(events), "1 hour")
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 120


# ---- round trips and scale


def test_ids_of_another_type(spark):
    m, docs = vectors(spark)
    named = docs.select(F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id"), "embedding")
    asked = lambda df: df.limit(5).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    for most in (10, 0):
        want = {(r.query_id, r.rank): r.id for r in se.top_k(docs, asked(docs.orderBy("id")), 4, most_broadcast=most, exclude_self=True).collect()}
        got = {(int(r.query_id[2:]), r.rank): int(r.id[2:]) for r in se.top_k(named, asked(named.orderBy("id")), 4, most_broadcast=most, exclude_self=True).collect()}
        assert got == want
    cents = spark.createDataFrame([(0, [1.0] * 8), (1, [-1.0] * 8)], "cluster_id long, centroid array<double>")
    assert {(r.id[2:], r.cluster_id) for r in cl.assign(named, cents).collect()} == {(f"{r.id:03d}", r.cluster_id) for r in cl.assign(docs, cents).collect()}
    assert cl.probe(named, cents, 1).schema["query_id"].dataType.simpleString() == "string"
    assert {(r.a[2:], r.b[2:]) for r in se.similar_pairs(named, 0.8).collect()} == {(f"{r.a:03d}", f"{r.b:03d}") for r in se.similar_pairs(docs, 0.8).collect()}


def test_pairs_of_cells_like_numpy(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 12))
    m = np.concatenate([base, base + 0.05 * r.normal(size=base.shape), np.repeat(base[:1], 150, 0), np.zeros((2, 12))])
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    cos = (m / np.where(n == 0, 1, n)) @ (m / np.where(n == 0, 1, n)).T
    for threshold in (0.99, 0.7, 0.4):
        want = {(int(i), int(j)) for i, j in np.argwhere(np.triu((1 + cos) / 2 >= threshold - 1e-12, 1))}
        found = [(x.a, x.b) for x in se.similar_pairs(docs, threshold, block=20).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert se.similar_pairs(docs.limit(0), 0.9).count() == 0


def test_pruned_search_reads_its_clusters_only(spark, tmp_path):
    m, docs = vectors(spark, 200)
    cents = docs.limit(8).select(F.col("id").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    c = Collection(spark, f"file://{tmp_path}", "global")
    c.write(docs.join(cl.assign(docs, cents).select("id", "cluster_id"), "id"), ["cluster_id"])
    asked = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    probed = cl.probe(asked, cents, 2, "query_id", "query_embedding")
    found = se.pruned_top_k(c.read(), asked, probed, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster_id" in plan.replace("PartitionFilters: [isnotnull(cluster_id", "PartitionFilters: [cluster_id")
    of = {r.id: r.cluster_id for r in cl.assign(docs, cents).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = {}
    for r in probed.collect():
        near.setdefault(r.query_id, set()).add(r.cluster_id)
    got = {(r.query_id, r.rank): r.id for r in found.collect()}
    for q, clusters in near.items():
        ids = sorted((i for i in range(200) if of[i] in clusters), key=lambda i: (-unit[i] @ unit[q], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == ids
    full = se.pruned_top_k(c.read(), asked, cl.probe(asked, cents, 8, "query_id", "query_embedding"), 5)
    assert se.recall(full, se.top_k(docs, asked, 5)).first().recall == 1.0


def test_collections_append_conflict_vacuum_and_drop(spark, tmp_path):
    from pixelgrove.sources.store import ConcurrentWrite

    a, b = (Collection(spark, f"file://{tmp_path}", "x") for _ in range(2))
    a.write(spark.range(3))
    start = a.version()
    assert b.append(spark.range(3, 5)) == 2 and a.read().count() == 5
    with pytest.raises(ConcurrentWrite):
        a.write(spark.range(9), parent=start)
    assert b.read().count() == 5 and a.write(spark.range(7)) == 3
    assert a.vacuum(1) == 3 and a.read().count() == 7 and b.version() == 3
    assert a.drop() and not b.exists() and not b.drop()


def test_second_batch_finds_the_first(spark):
    rows = [(i, f"c{i // 2}", [float(i)], [(2,)], ["t"]) for i in range(6)]
    images = spark.createDataFrame(rows, IMAGES)
    first = batch(images.where("image_id < 4"), images.limit(0))["global"]
    assert {r.image_id for r in first.collect()} == {0, 2}
    assert {r.image_id for r in batch(images, first)["global"].collect()} == {4}


def test_quantiles_and_alerts(spark):
    rows = spark.createDataFrame([("a", float(v % 7)) for v in range(50)] + [("b", 3.0), (None, 1.0), ("c", None)], "track string, latency_ms double")
    want = {k: np.percentile(v, [50, 95, 99]).tolist() for k, v in (("a", [v % 7 for v in range(50)]), ("b", [3.0]), (None, [1.0]))}
    found = {r.track: [r.p50, r.p95, r.p99] for r in ev.latency(rows, "latency_ms", "track").collect()}
    assert found["c"] == [None] * 3 and all(np.allclose(found[k], v) for k, v in want.items())
    timed = rows.where("track = 'a'").withColumn("ts", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    assert ev.latency_alerts(timed, "latency_ms", 5.5, "1 minute").count() == 1 and ev.latency_alerts(timed, "latency_ms", 6.0, "1 minute").count() == 0
    assert dt.confident(spark.createDataFrame([(0.5,)], "score double"), 0.5, True).count() == 1


def test_intermediate_tables_can_be_cleared(spark):
    from pixelgrove.sources.scratch import clear, scratch_path, stage

    assert stage(spark.range(3), "few").count() == 3
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]
    assert clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
