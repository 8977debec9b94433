"""Geometry of boxes, landmarks and resize plans as column expressions.

Boxes are (x1, y1, x2, y2) columns or structs with these fields.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIDES = ("x1", "y1", "x2", "y2")
MARGIN, EDGE_FACTOR = 0.02, 0.8


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint boxes and for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    union = area(a) + area(b) - w * h
    return F.when((w * h <= 0) | (union <= 0), F.lit(0.0)).otherwise(w * h / union)


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """(scale, pad_x, pad_y) that fits an image into a square without enlarging it; sizes round half to even."""
    scale = F.least(F.lit(float(size)) / F.greatest(width, height), F.lit(1.0))
    pad = lambda side: (F.lit(size) - F.bround(side * scale)) / 2.0
    return F.struct(scale.alias("scale"), pad(width).alias("pad_x"), pad(height).alias("pad_y"))


def unletterbox(x: Column, pad: Column, scale: Column, side: Column, size: int, pixels: Column) -> Column:
    """A letterbox coordinate, in pixels or as a share of ``size``, as a share of the image's side within 0 and 1."""
    at = F.when(pixels, x).otherwise(x * size)
    return clamp((at - pad) / scale / side, 0.0, 1.0)


def unletterbox_landmark(x: Column, other: Column, width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """A landmark of a letterbox that may enlarge, in pixels of the image."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    return (x - (size - width * scale) / 2) / scale, (other - (size - height * scale) / 2) / scale


def letterbox_to_tensor(x: Column, pad: Column, pad_x: Column, pad_y: Column, scale: Column, width: Column, height: Column, size: int = 640) -> Column:
    """A letterbox pixel in a tensor of (width, height) that holds the original, maybe made smaller.

    The original size is taken from the letterbox itself; both axes' factors are averaged.
    """
    by = (width / ((size - 2 * pad_x) / scale) + height / ((size - 2 * pad_y) / scale)) / 2
    return (x - pad) * (by / scale)


def edge_factor(b: Column, width: Column, height: Column) -> Column:
    def of(low: Column, high: Column, side: Column) -> Column:
        return F.when((low < side * MARGIN) | (high > side * (1 - MARGIN)), F.lit(EDGE_FACTOR)).otherwise(F.lit(1.0))

    return of(b["x1"], b["x2"], width) * of(b["y1"], b["y2"], height)


def size_factor(b: Column, width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) / F.greatest(width * height, F.lit(1)) * 10)


def face_quality(b: Column, width: Column, height: Column, left_eye: Column, right_eye: Column, epsilon: float = 1e-6) -> Column:
    """Size, distance from the edges and level eyes, 0 to 1. Eyes are structs (x, y)."""
    tilt = F.abs(left_eye["y"] - right_eye["y"]) / (right_eye["x"] - left_eye["x"] + epsilon)
    return clamp(size_factor(b, width, height) * edge_factor(b, width, height) * F.greatest(F.lit(0.0), 1 - tilt * 2), 0.0, 1.0)


def box_quality(b: Column, width: Column, height: Column) -> Column:
    """Size, distance from the edges and squareness, 0 to 1."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return clamp(size_factor(b, width, height) * edge_factor(b, width, height) * F.least(w, h) / F.greatest(w, h, F.lit(1.0)), 0.0, 1.0)


def margin_crop(b: Column, width: Column, height: Column, margin: float = 0.4) -> Column:
    """Box widened on each side, cut to the image, made square as far as it goes; whole pixels."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    x1, x2 = F.greatest(F.lit(0.0), b["x1"] - w * margin), F.least(width.cast("double"), b["x2"] + w * margin)
    y1, y2 = F.greatest(F.lit(0.0), b["y1"] - h * margin), F.least(height.cast("double"), b["y2"] + h * margin)
    wide, more_y, more_x = (x2 - x1) > (y2 - y1), ((x2 - x1) - (y2 - y1)) / 2, ((y2 - y1) - (x2 - x1)) / 2
    whole = lambda c: c.cast("int")
    return box(
        whole(F.when(wide, x1).otherwise(F.greatest(F.lit(0.0), x1 - more_x))),
        whole(F.when(wide, F.greatest(F.lit(0.0), y1 - more_y)).otherwise(y1)),
        whole(F.when(wide, x2).otherwise(F.least(width.cast("double"), x2 + more_x))),
        whole(F.when(wide, F.least(height.cast("double"), y2 + more_y)).otherwise(y2)),
    )


def padded_crop(b: Column, width: Column, height: Column, pad: float = 0.1) -> Column:
    """Pixels of a normalised box with some padding, cut to the image."""
    x1, y1, x2, y2 = ((b[s] * (width if s[0] == "x" else height)).cast("int") for s in SIDES)
    dx, dy = ((x2 - x1) * pad).cast("int"), ((y2 - y1) * pad).cast("int")
    return box(F.greatest(F.lit(0), x1 - dx), F.greatest(F.lit(0), y1 - dy), F.least(width.cast("int"), x2 + dx), F.least(height.cast("int"), y2 + dy))


#: Centre and face width in the 112 x 112 reference frame, and how far down the box its centre lies.
REFERENCE_X, REFERENCE_Y, REFERENCE_WIDTH, CENTRE_DOWN = 56.0, 64.0, 78.0, 0.45


def reference_frame(b: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """(step, x0, y0): pixel (i, j) of the reference frame lies at (x0 + step i, y0 + step j) of the image tensor."""
    fx, fy = image_width / width, image_height / height
    step = F.sqrt(fx * fy) * F.greatest(b["x2"] - b["x1"], F.lit(1.0)) / REFERENCE_WIDTH
    cx, cy = (b["x1"] + b["x2"]) / 2 * fx, (b["y1"] + (b["y2"] - b["y1"]) * CENTRE_DOWN) * fy
    return F.struct(step.alias("step"), (cx - step * REFERENCE_X).alias("x0"), (cy - step * REFERENCE_Y).alias("y0"))


def from_crop(x: Column, low: Column, high: Column, size: int = 640) -> Column:
    """A coordinate inside a crop that was resized to ``size``, in the image."""
    return x * ((high - low) / size) + low


def similarity(src: Column, dst: Column) -> Column:
    """(a, b, tx, ty) of the least-squares similarity (x, y) -> (a x - b y + tx, b x + a y + ty) between arrays of (x, y).

    The closed form in the plane. The translation uses the scale once, as a similarity has to.
    """
    n = F.size(src)
    mean = lambda pts, c: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[c]) / n
    total = lambda pairs, f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["s"], p["d"]))
    mx, my, ux, uy = mean(src, "x"), mean(src, "y"), mean(dst, "x"), mean(dst, "y")
    both = F.zip_with(src, dst, lambda s, d: F.struct(s.alias("s"), d.alias("d")))
    dots = total(both, lambda s, d: (s["x"] - mx) * (d["x"] - ux) + (s["y"] - my) * (d["y"] - uy))
    cross = total(both, lambda s, d: (s["x"] - mx) * (d["y"] - uy) - (s["y"] - my) * (d["x"] - ux))
    var = total(both, lambda s, d: (s["x"] - mx) * (s["x"] - mx) + (s["y"] - my) * (s["y"] - my))
    a, b = dots / var, cross / var
    return F.struct(a.alias("a"), b.alias("b"), (ux - (a * mx - b * my)).alias("tx"), (uy - (b * mx + a * my)).alias("ty"))


def clip_crop_plan(width: Column, height: Column, size: int = 256) -> Column:
    """Shortest side to ``size``, cut to whole pixels, then the centre."""
    scale = F.lit(float(size)) / F.least(width, height)
    w, h = (width * scale).cast("int"), (height * scale).cast("int")
    return F.struct(w.alias("new_width"), h.alias("new_height"), F.floor((w - size) / 2).cast("int").alias("left"), F.floor((h - size) / 2).cast("int").alias("top"))


def resize_plan(width: Column, height: Column, most: int = 1024, least: int = 640) -> Column:
    """(new_width, new_height): large images get ``most`` as their longer side, others stay."""
    longer = F.greatest(width, height)
    stays = (longer <= most) | (longer < least)
    other = lambda side, long: (side * (F.lit(float(most)) / long)).cast("int")
    w = F.when(stays, width).when(width > height, F.lit(most)).otherwise(other(width, height))
    h = F.when(stays, height).when(width > height, other(height, width)).otherwise(F.lit(most))
    return F.struct(w.cast("int").alias("new_width"), h.cast("int").alias("new_height"))


def ocr_resize_plan(width: Column, height: Column, limit: int = 960, least: int = 640, step: int = 32) -> Column:
    """Size for text detection: the longer side within bounds, then filled up to a multiple of ``step``."""
    longer = F.greatest(width, height)
    ratio = F.when(longer > limit, F.lit(float(limit)) / longer).when(longer < least, F.lit(float(least)) / longer).otherwise(F.lit(1.0))
    side = lambda s: F.greatest(F.lit(step), (s * ratio).cast("int"))
    fill = lambda s: (s + F.pmod(-s, F.lit(step))).cast("int")
    return F.struct(side(width).alias("resize_width"), side(height).alias("resize_height"), fill(side(width)).alias("padded_width"), fill(side(height)).alias("padded_height"))


def valid_size(width: Column, height: Column, n_bytes: Column, least: int = 16, most: int = 16384, megabytes: int = 50) -> Column:
    """Why an image is refused, or null."""
    return F.when((width > most) | (height > most), F.lit("too_large")).when((width < least) | (height < least), F.lit("too_small")).when(n_bytes > megabytes * 1024 * 1024, F.lit("too_heavy"))


def recogniser_width(width: Column, height: Column, line: int = 48, least: int = 8, most: int = 2048) -> Column:
    return clamp(F.ceil(line * (width / height.cast("double"))).cast("int"), F.lit(least), F.lit(most))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def quad_crop(tl: Column, tr: Column, br: Column, bl: Column) -> Column:
    """(width, height, skipped, rotated) of the crop of a text quad."""
    w, h = F.greatest(distance(tl, tr), distance(bl, br)).cast("int"), F.greatest(distance(tl, bl), distance(tr, br)).cast("int")
    skipped = (w < 3) | (h < 3)
    return F.struct(w.alias("width"), h.alias("height"), skipped.alias("skipped"), (~skipped & (h / F.greatest(w, F.lit(1)) >= 1.5)).alias("rotated"))


def order_quad(points: Column) -> Column:
    """(tl, tr, br, bl) of four (x, y): smallest and largest x + y, smallest and largest y - x; the first of equals wins."""

    def pick(key, most: bool) -> Column:
        better = (lambda p, q: key(p) > key(q)) if most else (lambda p, q: key(p) < key(q))
        return F.aggregate(points, F.get(points, F.lit(0)), lambda best, p: F.when(better(p, best), p).otherwise(best))

    total, gap = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.struct(pick(total, False).alias("tl"), pick(gap, False).alias("tr"), pick(total, True).alias("br"), pick(gap, True).alias("bl"))


def unclip_distance(width: Column, height: Column, ratio: float = 1.5) -> Column:
    """How far a rectangle's sides move out: area times ratio over perimeter."""
    return width * height * ratio / (2 * (width + height))


#: Fixed value: pixels are centred at 127.5 and divided by 128 for face embeddings.
def face_pixel(value: Column) -> Column:
    return (value - 127.5) / 128


