"""Detection sets: routing, fan-out, suppression, matching, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pixelgrove.functions.boxes import SIDES, box, clamp, iou

# Object classes of the detector by route, and their names.
PERSON, VEHICLES = 0, (2, 3, 5, 7, 8)
NAMES = {0: "person", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 8: "boat"}
NMS_IOU, MOST_FACES = 0.4, 128


def route(class_id: Column) -> Column:
    return F.when(class_id == PERSON, "person").when(class_id.isin(*VEHICLES), "vehicle").otherwise("other")


def class_name(class_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, class_id.cast("int")), F.concat(F.lit("class_"), class_id.cast("string")))


def fan_out(images: DataFrame, image: str = "image_id", found: str = "detections") -> DataFrame:
    """One row per detection of an array of structs, with its position, id, route and class name."""
    rows = images.select(image, F.posexplode(found).alias("pos", "d")).select(image, "pos", "d.*")
    return rows.withColumns({"detection_id": F.concat_ws("_", F.col(image).cast("string"), F.lit("box"), F.col("pos").cast("string")), "route": route(F.col("class_id")), "class_name": class_name(F.col("class_id"))})


def route_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy(route(F.col("class_id")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def confident(detections: DataFrame, least: float, inclusive: bool = False, score: str = "score") -> DataFrame:
    """Detections above a score, or with ``inclusive`` at it as well."""
    return detections.where(F.col(score) >= least if inclusive else F.col(score) > least)


def trimmed(boxes: Column, count: Column) -> Column:
    """The first ``count`` entries of a padded array."""
    return F.slice(boxes, 1, F.greatest(count.cast("int"), F.lit(0)))


def valid(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the last pixel of the image; those without area go."""
    cut = {s: clamp(F.col(s), 0.0, (width if s[0] == "x" else height) - 1.0) for s in SIDES}
    return detections.withColumns(cut).where("x2 > x1 AND y2 > y1")


def _sorted_boxes(detections: DataFrame, keys: list[str], score: str, tie: str, extra: list[str]) -> DataFrame:
    item = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("id"), *[F.col(c) for c in (*SIDES, *extra)])
    return detections.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("boxes"))


def nms(detections: DataFrame, threshold: float = NMS_IOU, most: int | None = MOST_FACES, least_score: float | None = None, class_aware: bool = False, image: str = "image_id", tie: str = "det_id", score: str = "score") -> DataFrame:
    """Greedy suppression: by falling score, a box stays unless it overlaps a kept one by more than ``threshold``.

    The boxes of one image are bounded by the detector, so they are folded inside one row.
    """
    rows = detections.where(F.col(score) > least_score) if least_score is not None else detections
    keys = [image, "class_id"] if class_aware else [image]
    packed = _sorted_boxes(rows, keys, score, tie, [] if class_aware else ["class_id"])
    item = dict(packed.dtypes)["boxes"]
    kept = F.aggregate("boxes", F.array().cast(item), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > threshold), acc).otherwise(F.array_append(acc, b)))
    out = packed.select(*keys, F.posexplode(kept).alias("pos", "b")).select(*keys, (F.col("pos") + 1).cast("long").alias("rank"), F.col("b.id").alias(tie), (-F.col("b.s")).alias(score), *[F.col(f"b.{s}").alias(s) for s in SIDES], *([] if class_aware else [F.col("b.class_id").alias("class_id")]))
    if class_aware:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(score), tie)).cast("long"))
    return out if most is None else out.where(F.col("rank") <= most)


def iou_pairs(a: DataFrame, b: DataFrame, least: float, image: str = "image_id", a_id: str = "det_id", b_id: str = "det_id") -> DataFrame:
    """(image, a, b, iou) of all pairs of one image that overlap by at least ``least``."""
    x = a.select(image, F.col(a_id).alias("a"), box(*[F.col(s) for s in SIDES]).alias("box_a"))
    y = b.select(image, F.col(b_id).alias("b"), box(*[F.col(s) for s in SIDES]).alias("box_b"))
    return x.join(y, image).withColumn("iou", iou(F.col("box_a"), F.col("box_b"))).where(F.col("iou") >= least).select(image, "a", "b", "iou")


def match(reference: DataFrame, test: DataFrame, threshold: float = 0.5, image: str = "image_id", tie: str = "det_id", score: str = "score") -> DataFrame:
    """Per image: n_reference, n_test and the matches (ref, test, iou, conf_diff, centre distance).

    Each reference box in order takes the free test box of the largest overlap
    of at least ``threshold``; of equal ones the first. Classes do not matter.
    Only overlapping pairs, in that order, are folded.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(image).alias("__image"), F.struct(F.col(tie).cast("long").alias("id"), F.col(score).alias("s"), *SIDES).alias(name))

    r, t = F.col("r"), F.col("t")
    pairs = side(reference, "r").join(side(test, "t"), "__image").withColumn("o", iou(r, t)).where(F.col("o") >= threshold)
    centre = lambda low, high: (r[low] + r[high] - t[low] - t[high]) / 2
    dx, dy = centre("x1", "x2"), centre("y1", "y2")
    item = F.struct(r["id"].alias("ref"), (-F.col("o")).alias("o"), t["id"].alias("test"), F.abs(r["s"] - t["s"]).alias("conf_diff"), F.sqrt(dx * dx + dy * dy).alias("distance"))
    packed = pairs.groupBy("__image").agg(F.sort_array(F.collect_list(item)).alias("l"))
    kind = dict(packed.dtypes)["l"]
    taken = F.aggregate("l", F.array().cast(kind), lambda acc, p: F.when(F.exists(acc, lambda m: (m["ref"] == p["ref"]) | (m["test"] == p["test"])), acc).otherwise(F.array_append(acc, p)))
    found = packed.select("__image", F.transform(taken, lambda m: F.struct(m["ref"].alias("ref"), m["test"].alias("test"), (-m["o"]).alias("iou"), m["conf_diff"].alias("conf_diff"), m["distance"].alias("distance"))).alias("matches"))
    none = F.array().cast(dict(found.dtypes)["matches"])
    both = reference.select(image, F.lit(1).alias("r"), F.lit(0).alias("t")).unionByName(test.select(image, F.lit(0).alias("r"), F.lit(1).alias("t")))
    counts = both.groupBy(image).agg(F.sum("r").alias("n_reference"), F.sum("t").alias("n_test"))
    out = counts.join(found, F.col(image) == F.col("__image"), "left")
    return out.select(image, "n_reference", "n_test", F.coalesce("matches", none).alias("matches"))


def metrics(matched: DataFrame, image: str = "image_id") -> DataFrame:
    """Per image: counts, precision, recall, f1, and means over the matches; 0 where there is nothing to divide by."""
    n = F.size("matches").cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    mean = lambda f: ratio(F.aggregate("matches", F.lit(0.0), lambda s, m: s + m[f]), n)
    rows = matched.select(image, n.alias("n_matches"), "n_reference", "n_test", ratio(n, F.col("n_test")).alias("precision"), ratio(n, F.col("n_reference")).alias("recall"), mean("iou").alias("mean_iou"), mean("conf_diff").alias("mean_conf_diff"), mean("distance").alias("mean_box_diff"))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_average(measured: DataFrame, *by: str) -> DataFrame:
    """Means of the images' metrics and totals of their counts."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "mean_conf_diff", "mean_box_diff")]
    return measured.groupBy(*by).agg(*means, F.sum("n_matches").alias("total_matches"), F.sum("n_reference").alias("total_reference"), F.sum("n_test").alias("total_test"), F.count(F.lit(1)).alias("n_images"))


def anchors(spark, size: int = 640, strides: tuple[int, ...] = (8, 16, 32), per_cell: int = 2) -> DataFrame:
    """(anchor, stride, cx, cy): centres of the cells of each stride, row by row, each ``per_cell`` times."""
    out, base = None, 0
    for stride in strides:
        n = size // stride
        cell = F.floor(F.col("id") / per_cell)
        rows = spark.range(n * n * per_cell).select((F.col("id") + base).alias("anchor"), F.lit(stride).alias("stride"), ((cell % n + 0.5) * stride).alias("cx"), ((F.floor(cell / n) + 0.5) * stride).alias("cy"))
        out, base = (rows if out is None else out.unionByName(rows)), base + n * n * per_cell
    return out


def decode_distances(rows: DataFrame, width: Column, height: Column, size: int = 640, least_score: float = 0.5) -> DataFrame:
    """Boxes from (score, left, top, right, bottom) in strides from the anchor's centre, scaled by axis to the image; score above the floor, strictly."""
    sx, sy = width / float(size), height / float(size)
    at = lambda c, d, sign, f: (F.col(c) + sign * F.col(d) * F.col("stride")) * f
    return rows.where(F.col("score") > least_score).withColumns({"x1": at("cx", "left", -1, sx), "y1": at("cy", "top", -1, sy), "x2": at("cx", "right", 1, sx), "y2": at("cy", "bottom", 1, sy)})


def decode_landmark(offset: Column, centre: Column, stride: Column, factor: Column) -> Column:
    return (offset * stride + centre) * factor


def decode_centres(rows: DataFrame, pad_x: Column, pad_y: Column, scale: Column, least_score: float = 0.5) -> DataFrame:
    """Boxes from (cx, cy, w, h, objectness, class_confidence) in a letterbox; score is the product, above the floor, strictly."""
    x, y = (lambda c: (c - pad_x) / scale), (lambda c: (c - pad_y) / scale)
    rows = rows.withColumn("score", F.col("objectness") * F.col("class_confidence")).where(F.col("score") > least_score)
    return rows.withColumns({"x1": x(F.col("cx") - F.col("w") / 2), "y1": y(F.col("cy") - F.col("h") / 2), "x2": x(F.col("cx") + F.col("w") / 2), "y2": y(F.col("cy") + F.col("h") / 2)})


def keypoints(flat: Column) -> Column:
    """(x, y) points of a flat array of (x, y, visibility)."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 3 - 1).cast("int")), lambda i: F.struct(F.get(flat, i * 3).alias("x"), F.get(flat, i * 3 + 1).alias("y")))
