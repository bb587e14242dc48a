"""Nearest places, labels and coordinates.

nearest() is exact: each cell of the globe that holds points has a list of the places that can be nearest to some
point in it. With r the distance from the cell's middle to its farthest corner and d that to the place nearest
to the middle, no such place is farther from the middle than d + 2 r. Cells begin as degrees; which cells of places matter
to a cell of points is worked out from the cells alone (64,800 at most), with the same bound widened by their own
radii. A cell whose list is long is cut in four, and its quarters that hold points take what their own, smaller bound
leaves of its list, round by round, so lists are short however dense places are. Lists are rows until the end: no task holds the
places of a cell, and none of them go through the driver. Places of equal coordinates are one, of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.store import kept, released

RADIUS = 6371.0
NEAR_KM, FAR_KM = 20, 150
#: Distances between cells that are worked out at a time; places of a list above which its cell is cut; cuts at most.
BLOCK, LIST, LEVELS = 4_000_000, 64, 24
#: Kilometres that bounds are widened by, for rounding.
SLACK = 1e-6 * RADIUS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)


def label(city: Column, country: Column, km: Column) -> Column:
    full = F.concat(city, F.lit(", "), country)
    return F.when(km <= NEAR_KM, full).when(km <= FAR_KM, F.concat(F.lit("near "), full)).otherwise(country)


def coordinates(lat: Column, lon: Column) -> Column:
    part = lambda x, plus, minus: F.concat(F.format_string("%.3f", F.abs(x)), F.lit("°"), F.when(x < 0, minus).otherwise(plus))
    return F.concat(part(lat, "N", "S"), F.lit(" "), part(lon, "E", "W"))


def cell(lat: Column, lon: Column, level: Column | int = 0) -> tuple[Column, Column]:
    """Row and column of the cell of 1 / 2^level degrees."""
    scale = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return F.least(F.floor((lat + 90) * scale), (180 * scale - 1).cast("long")), F.pmod(F.floor((lon + 180) * scale), (360 * scale).cast("long"))


def axes(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors, a row each."""
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _cells_near(spots: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell of points the cells of places that can hold the nearest place of some point in it."""

    def about(row, column):
        middle = axes(row - 89.5, column - 179.5)
        corners = axes(row[:, None] - 90 + np.array([0, 0, 1, 1]), column[:, None] - 180 + np.array([0, 1, 0, 1]))
        return middle, angle((corners * middle[:, None, :]).sum(axis=2)).max(axis=1)

    there, size = about(*spots)
    for batch in batches if len(size) else ():
        row, column = (np.asarray(c).astype(float) for c in batch.columns)
        middle, radius = about(row, column)
        step = max(1, BLOCK // max(len(size), 1))
        for at in range(0, len(row), step):
            far = angle(middle[at : at + step] @ there.T)
            # a place is in the nearest cell at most its radius beyond its middle, and at least that before it
            reach = (far + size).min(axis=1) + 2 * radius[at : at + step] + 1e-6
            i, j = np.nonzero(far - size <= reach[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (row[at + i], column[at + i], spots[0][j], spots[1][j])], ["row", "column", "prow", "pcolumn"])


def _kept_by_bound(told: DataFrame) -> DataFrame:
    """Of candidates (level, row, column, place_id, plat, plon) those within the bound of their cell, stored."""
    size = F.pow(F.lit(2.0), -F.col("level"))
    south, west = F.col("row") * size - 90, F.col("column") * size - 180
    lat, lon = south + size / 2, west + size / 2
    radius = F.greatest(*[haversine(lat, lon, south + size * a, west + size * b) for a in (0, 1) for b in (0, 1)])
    names = ["level", "row", "column"]
    rows = told.select(*names, "place_id", "plat", "plon", haversine(lat, lon, F.col("plat"), F.col("plon")).alias("far"), radius.alias("radius"))
    rows = kept(rows, "candidates")
    bound = rows.groupBy(*names).agg((F.min("far") + 2 * F.max("radius") + SLACK).alias("reach"))
    out = kept(rows.join(bound, names).where(F.col("far") <= F.col("reach")).select(*names, "place_id", "plat", "plon"), "lists")
    released(rows)
    return out


def lists(points: DataFrame, spots: DataFrame, most: int = LIST) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Points (id, lat, lon) with their cells (level, row, column), candidates of the cells, and the stored tables that both
    are read from. Cells with more than `most` candidates are cut."""
    names = ["level", "row", "column"]
    row, column = cell(F.col("lat"), F.col("lon"))
    open_ = points.select("id", "lat", "lon", F.lit(0).alias("level"), row.alias("row"), column.alias("column"))
    homes = spots.select("place_id", "plat", "plon", *[c.alias(n) for c, n in zip(cell(F.col("plat"), F.col("plon")), ("prow", "pcolumn"))])
    there = homes.select("prow", "pcolumn").distinct().toArrow()  # 64,800 rows at most
    cells = open_.select("row", "column").distinct().repartition(points.sparkSession.sparkContext.defaultParallelism, "row", "column")
    near = cells.mapInArrow(partial(_cells_near, tuple(there.column(c).to_numpy().astype(float) for c in range(2))), "row long, column long, prow long, pcolumn long")
    held = _kept_by_bound(near.join(homes, ["prow", "pcolumn"]).select(F.lit(0).alias("level"), "row", "column", "place_id", "plat", "plon"))
    used, done_points, done_lists = [held], None, None
    for level in range(1, LEVELS + 1):
        large = held.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*names)
        if not large.limit(1).count():
            break
        large = kept(large, "large")
        used.append(large)
        rest = held.join(large, names, "left_anti")
        stay = open_.join(large, names, "left_anti")
        done_points = stay if done_points is None else done_points.unionByName(stay)
        done_lists = rest if done_lists is None else done_lists.unionByName(rest)
        row, column = cell(F.col("lat"), F.col("lon"), level)
        cut = open_.join(large, names, "left_semi").select("id", "lat", "lon", F.lit(level).alias("level"), row.alias("row"), column.alias("column"))
        open_ = kept(cut, "points")
        quarters = open_.select(*names).distinct().select(*names, F.shiftright("row", 1).alias("r"), F.shiftright("column", 1).alias("c"))
        inside = held.join(large, names, "left_semi").select(F.col("row").alias("r"), F.col("column").alias("c"), "place_id", "plat", "plon")
        held = _kept_by_bound(quarters.join(inside, ["r", "c"]).select(*names, "place_id", "plat", "plon"))
        used += [open_, held]
    all_points = open_ if done_points is None else done_points.unionByName(open_)
    return all_points, held if done_lists is None else done_lists.unionByName(held), used


def nearest(points: DataFrame, places: DataFrame, most: int = LIST) -> DataFrame:
    """id, place_id, km of the nearest place to each point (id, lat, lon); ties to the smaller place id;
    points off the globe have none."""
    spots = places.where(valid(F.col("lat"), F.col("lon"))).groupBy(F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon")).agg(F.min(F.col("place_id").cast("long")).alias("place_id"))
    on = F.coalesce(valid(F.col("lat"), F.col("lon")), F.lit(False))
    rows = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    located, candidates, used = lists(rows.where(on), spots, most)
    names = ["level", "row", "column"]
    near = candidates.groupBy(*names).agg(F.collect_list(F.struct("place_id", "plat", "plon")).alias("near"))  # `most` rows or few more
    km = lambda x: haversine(F.col("lat"), F.col("lon"), x["plat"], x["plon"])
    best = F.array_min(F.transform("near", lambda x: F.struct(km(x).alias("km"), x["place_id"].alias("place_id"))))
    found = located.join(near, names, "left").select("id", best.alias("b")).select("id", "b.place_id", "b.km")
    off = rows.where(~on).select("id", F.lit(None).cast("long").alias("place_id"), F.lit(None).cast("double").alias("km"))
    out = kept(found.unionByName(off), "nearest")
    released(*used)
    return out
