"""Queries see every row of their tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.plans import catalog as queries
from lumenlake.plans import fixtures
from lumenlake.session import table


def test_every_order_is_grouped(spark, sf_dir):
    rows = sorted((r.captured_utc, r.id, int(r.perceptual_hash, 16)) for r in queries.hashes(spark, sf_dir).collect())
    assert len(rows) == table(spark, sf_dir, "orders").count()
    anchors, of = [], {}
    for _, id_, x in rows:
        of[id_] = next((i for i, y in anchors if (x ^ y).bit_count() <= 6), id_)
        if of[id_] == id_:
            anchors.append((id_, x))
    size = {a: list(of.values()).count(a) for a in set(of.values())}
    got = {(r.id, r.anchor_id, r["size"]) for r in queries.QUERIES["near_duplicate_groups"](spark, sf_dir).collect()}
    assert got == {(i, a, size[a]) for i, a in of.items() if size[a] > 1}
    kinds = sorted({f"{x:016x}" for _, _, x in rows})
    near = {(a, b) for a in kinds for b in kinds if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 6}
    assert {(r.a, r.b) for r in queries.QUERIES["hash_pairs"](spark, sf_dir).collect()} == near


def test_operators_see_every_row(spark, sf_dir):
    at = lambda name: queries.QUERIES[name](spark, sf_dir)
    assert at("aspect_ratios").count() == table(spark, sf_dir, "lineitem").count()
    months = at("time_rail").where("kind = 'month'").agg(F.sum("n")).first()[0]
    assert months == table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").count()
    by_photo = {}
    for r in fixtures.table(spark, sf_dir, "segments").collect():
        by_photo.setdefault(r.photo_id, []).append(r)
    want = {(p.id, q.id) for rows in by_photo.values() for p in rows for q in rows if p.id < q.id and overlap(p, q) > 0.2}
    assert {(r.a, r.b) for r in at("iou_pairs").collect()} == want
    units = queries.units(spark, sf_dir).collect()
    by_id = {r.photo_id: r for r in units}
    v = np.array([by_id[i].vector for i in range(len(units))], float)
    label = np.array([by_id[i].label for i in range(len(units))])
    mixed = np.roll(v, -1, axis=0)
    top = np.argsort(-(mixed @ v[:20].T), axis=0, kind="stable")[:5]
    got = {r.weight: r.precision for r in at("blend_precision").collect()}
    assert got[0.0] == pytest.approx((label[top] == label[:20]).mean(), abs=1e-6)


def overlap(p, q):
    w, h = min(p.x + p.w, q.x + q.w) - max(p.x, q.x), min(p.y + p.h, q.y + q.h) - max(p.y, q.y)
    both = w * h if w > 0 and h > 0 else 0.0
    return both / (p.w * p.h + q.w * q.h - both)


def test_rail_of_empty_months(spark):
    shot = [(datetime(2019, 11, 3), 2), (datetime(2020, 6, 9), 0), (datetime(2020, 10, 1), 2), (datetime(2020, 10, 2), 2)]
    rows = queries.rail(spark.createDataFrame(shot, "captured_utc timestamp, state int")).orderBy("position").collect()
    # five empty months before June, three (too few) before October; December 2019 stands alone
    assert [(r.kind, r["first"], r.n, r.months) for r in rows] == [
        ("year", "2020-01-01", 3, 0), ("month", "2020-10-01", 2, 0), ("month", "2020-06-01", 1, 0), ("gap", "2020-01-01", 0, 5),
        ("year", "2019-01-01", 1, 0), ("month", "2019-11-01", 1, 0),
    ]
