"""Nearest places where thousands of them share a degree."""

import numpy as np
from pyspark.sql import functions as F

from lumenlake.operators import places


def brute(points, spots):
    lat, lon = np.radians([p[1] for p in spots]), np.radians([p[2] for p in spots])
    out = {}
    for i, a, b in points:
        a, b = np.radians(a), np.radians(b)
        h = np.sin((lat - a) / 2) ** 2 + np.cos(lat) * np.cos(a) * np.sin((lon - b) / 2) ** 2
        out[i] = 2 * places.RADIUS * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0))).min()
    return out


def frames(spark, points, spots):
    return spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(spots, "place_id long, lat double, lon double")


def scene():
    draw = np.random.default_rng(7)
    spots = [(i, 48.0 + y, 2.0 + x) for i, (y, x) in enumerate(draw.normal(0.3, 0.01, size=(2500, 2)).tolist())]
    spots += [(5000 + i, y, x) for i, (y, x) in enumerate(zip(draw.uniform(-90, 90, 60).tolist(), draw.uniform(-180, 180, 60).tolist()))]
    spots += [(9000 + i, 89.999, 10.0 * i - 90) for i in range(20)] + [(7, 48.3, 2.3), (8, 48.3, 2.3)]
    points = [(i, 48.3 + y, 2.3 + x) for i, (y, x) in enumerate(draw.normal(0, 0.02, size=(300, 2)).tolist())]
    points += [(1000 + i, y, x) for i, (y, x) in enumerate(zip(draw.uniform(-90, 90, 150).tolist(), draw.uniform(-180, 180, 150).tolist()))]
    points += [(2000, 90.0, 0.0), (2001, -90.0, 180.0), (2002, 0.0, 180.0), (2003, 0.0, -180.0), (2004, 48.3, 2.3), (2005, 48.9999999, 2.9999999)]
    return points, spots


def test_dense_places_are_exact(spark):
    points, spots = scene()
    p, s = frames(spark, points, spots)
    want = brute(points, spots)
    for most in (64, 8):
        got = {r.id: r for r in places.nearest(p, s, most).collect()}
        assert set(got) == set(want)
        assert all(abs(got[i].km - want[i]) < 1e-6 for i in want)
        assert got[2004].place_id == 7  # of equal places the smallest id


def test_lists_stay_short_and_all_points_have_one(spark):
    """One degree holds 2,500 places; a list is no longer than the limit, wherever its points are."""
    points, spots = scene()
    p, s = frames(spark, points, spots)
    spots = s.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("place_id").alias("place_id"))
    located, candidates, _ = places.lists(p, spots, 64)
    sizes = candidates.groupBy("level", "row", "column").agg(F.count("*").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 64 and sizes.agg(F.max("level")).first()[0] >= 3
    assert located.count() == len(points) and located.join(candidates, ["level", "row", "column"], "left_anti").count() == 0
    assert candidates.count() < 64 * sizes.count() / 2  # half full on average at most


def test_points_off_the_globe(spark):
    rows = [(1, None, 1.0), (2, 91.0, 0.0), (3, float("nan"), 0.0), (4, 10.0, 10.0)]
    p, s = frames(spark, rows, [(1, 10.0, 11.0), (2, None, 3.0)])
    assert {(r.id, r.place_id) for r in places.nearest(p, s).collect()} == {(1, None), (2, None), (3, None), (4, 1)}
