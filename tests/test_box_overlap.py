"""The overlap of two boxes is a small expression, with the values of the plain formula."""

import random

from pyspark.sql import functions as F

from lumenlake.functions.boxes import iou


def plain(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w, h = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    both = w * h if w > 0 and h > 0 else 0.0
    union = aw * ah + bw * bh - both
    return both / union if union > 0 else 0.0


def test_sides_are_made_once(spark):
    draw = random.Random(9)
    box = lambda: tuple(draw.choice((0.0, 0.1, 0.2, 0.35, 0.5)) for _ in "xywh")
    boxes = [(i, box(), box()) for i in range(300)]
    kind = "struct<x:double,y:double,w:double,h:double>"
    rows = spark.createDataFrame([*boxes, (300, None, box())], f"id long, a {kind}, b {kind}")
    near = rows.select("id", iou(F.col("a"), F.col("b")).alias("s"))
    got = {r.id: r.s for r in near.collect()}
    assert got == {i: plain(a, b) for i, a, b in boxes} | {300: 0.0}
    text = near.where("s > 0.6")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("least(") <= 4  # two sides, in the filter and in the result
