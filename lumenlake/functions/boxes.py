"""Box arithmetic. A box is struct<x, y, w, h> in fractions of the image, from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 0.618033988749895


def sides(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height of what two boxes share; not above 0 where they share nothing."""
    return F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])


def intersection(a: Column, b: Column) -> Column:
    w, h = sides(a, b)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a union. The sides are made once: written out wherever they are used,
    the expression is too large to be compiled."""

    def ratio(t):
        both = F.when((t["w"] > 0) & (t["h"] > 0), t["w"] * t["h"]).otherwise(0.0)
        union = t["areas"] - both
        return F.when(union > 0, both / union).otherwise(0.0)

    w, h = sides(a, b)
    return F.get(F.transform(F.array(F.struct(w.alias("w"), h.alias("h"), (area(a) + area(b)).alias("areas"))), ratio), F.lit(0))


def containment(face: Column, segment: Column) -> Column:
    """How much of the face the segment covers."""
    return F.when(area(face) > 0, intersection(face, segment) / area(face)).otherwise(0.0)


def prominence(area_: Column, confidence: Column) -> Column:
    return F.sqrt(area_) * 0.7 + confidence * 0.3


def roll(landmarks: Column) -> Column:
    """Degrees between the first two landmarks; 0 without them."""
    a, b = F.get(landmarks, F.lit(0)), F.get(landmarks, F.lit(1))
    return F.when(F.size(landmarks) >= 2, F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))).otherwise(0.0)


def parse_landmarks(text: Column) -> Column:
    """x,y,... as points; an odd count, fewer than two numbers or anything that is none: empty."""
    numbers = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
    n = F.size(numbers)
    bad = text.isNull() | (n < 2) | (n % 2 != 0) | F.exists(numbers, lambda x: x.isNull())
    points = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, 2 * i).alias("x"), F.get(numbers, 2 * i + 1).alias("y")))
    return F.when(bad, F.array().cast("array<struct<x:double,y:double>>")).otherwise(points)


def format_landmarks(points: Column) -> Column:
    """Up to five decimals, without trailing zeros."""
    number = lambda x: F.regexp_replace(F.format_string("%.5f", x), r"\.?0+$", "")
    return F.array_join(F.transform(points, lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), ",")


def letterbox_inverse(x: Column, y: Column, w: Column, h: Column, pad_x: Column, pad_y: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box in model pixels back in the image, clipped; null under two pixels."""
    zero = F.lit(0.0)
    left, top = F.greatest(zero, F.least((x - pad_x) / scale, width)), F.greatest(zero, F.least((y - pad_y) / scale, height))
    right, bottom = F.greatest(zero, F.least((x - pad_x + w) / scale, width)), F.greatest(zero, F.least((y - pad_y + h) / scale, height))
    return F.when((right - left >= 2) & (bottom - top >= 2), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def anchor_decode(cls: Column, obj: Column, dx: Column, dy: Column, dw: Column, dh: Column, column: Column, row: Column, stride: Column) -> Column:
    """A detector cell's score and box in pixels: offsets by stride, sizes by exponent."""
    w, h = F.exp(dw) * stride, F.exp(dh) * stride
    return F.struct(F.sqrt(cls * obj).alias("score"), ((column + dx) * stride - w / 2).alias("x"), ((row + dy) * stride - h / 2).alias("y"), w.alias("w"), h.alias("h"))


def crop_square(box: Column, width: Column, height: Column) -> Column:
    """The square around a face, 1.6 of its longer side, moved inside the image; null under 8 pixels."""
    side = F.least(1.6 * F.greatest(box["w"] * width, box["h"] * height), width, height)
    cx, cy = (box["x"] + box["w"] / 2) * width, (box["y"] + box["h"] / 2) * height
    x = F.greatest(F.lit(0.0), F.least(cx - side / 2, width - side))
    y = F.greatest(F.lit(0.0), F.least(cy - side / 2, height - side))
    return F.when(side >= 8, F.struct(x.alias("x"), y.alias("y"), side.alias("side")))


def similarity_fit(points: Column, template: Column) -> Column:
    """Scale-and-rotation a, b and shift tx, ty that bring points nearest to the template, by least
    squares; the identity where the points do not spread."""
    n = F.size(points).cast("double")
    mean = lambda c, k: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[k]) / n
    px, py, qx, qy = mean(points, "x"), mean(points, "y"), mean(template, "x"), mean(template, "y")
    pairs = F.zip_with(points, template, lambda p, q: F.struct((p["x"] - px).alias("x"), (p["y"] - py).alias("y"), (q["x"] - qx).alias("u"), (q["y"] - qy).alias("v")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, r: s + f(r))
    norm = total(lambda r: r["x"] * r["x"] + r["y"] * r["y"])
    a, b = total(lambda r: r["x"] * r["u"] + r["y"] * r["v"]) / norm, total(lambda r: r["x"] * r["v"] - r["y"] * r["u"]) / norm
    fit = F.struct(a.alias("a"), b.alias("b"), (qx - a * px + b * py).alias("tx"), (qy - b * px - a * py).alias("ty"))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    return F.when(norm > 1e-12, fit).otherwise(same)


def label_hue(label: Column) -> Column:
    """A stable hue for a label: FNV-1a over its UTF-16 units, spread by the golden ratio."""
    units = F.regexp_extract_all(F.hex(F.encode(label, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    step = lambda h, u: ((h.bitwiseXOR(F.conv(u, 16, 10).cast("long"))) * 16777619).bitwiseAND(0xFFFFFFFF)
    h = F.aggregate(units, F.lit(2166136261).cast("long"), step)
    return F.floor((h.cast("double") * TAU) % 360).cast("int")


def hsl_to_rgb(hue: Column, saturation: float = 0.85, lightness: float = 0.58) -> Column:
    c = (1 - abs(2 * lightness - 1)) * saturation
    channel = lambda k: F.round((lightness - c / 2 + c * F.least(F.greatest(F.abs((hue / 60 + k) % 6 - 3) - 1, F.lit(0.0)), F.lit(1.0))) * 255).cast("int")
    return F.struct(channel(0).alias("r"), channel(4).alias("g"), channel(2).alias("b"))


def eligible_face(landmarks: Column, box: Column, least: float = 0.035) -> Column:
    """Whether a face is worth a vector: five landmarks and a shorter side that is large enough."""
    return (F.size(landmarks) >= 5) & (F.least(box["w"], box["h"]) >= least)
