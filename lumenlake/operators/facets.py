"""Counts: facets, months, the time rail, coverage and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.schema import PENDING, PROCESSING, UNREADABLE


def facet(df: DataFrame, value: Column, name: str, limit: int | None = None, distinct: str | None = None, by_value: bool = False) -> DataFrame:
    """facet, value, n: commonest first (or by value, last first), ties by value; nulls are left out.
    distinct counts a column's distinct values instead of rows."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    found = df.select(value.alias("value"), *[c for c in [distinct] if c]).where("value IS NOT NULL").groupBy("value").agg(n.alias("n"))
    found = found.orderBy(F.desc("value")) if by_value else found.orderBy(F.desc("n"), "value")
    return (found.limit(limit) if limit else found).select(F.lit(name).alias("facet"), "value", "n")


def folders(photos: DataFrame) -> DataFrame:
    return facet(photos.where("source_folder <> ''"), F.col("source_folder"), "folder")


def cameras(photos: DataFrame) -> DataFrame:
    return facet(photos, F.col("camera_model"), "camera")


def years(photos: DataFrame) -> DataFrame:
    return facet(photos, F.date_format("captured_utc", "yyyy"), "year", by_value=True)


def tag_facet(tags: DataFrame, per_photo: bool = False) -> DataFrame:
    """Rows count, so a photo tagged by file and model counts twice; per_photo counts photos."""
    return facet(tags, F.col("tag"), "tag", 60, "photo_id" if per_photo else None)


def cities(photos: DataFrame) -> DataFrame:
    return facet(photos.where("place_city <> ''"), F.col("place_city"), "city", 40)


def countries(photos: DataFrame) -> DataFrame:
    return facet(photos, F.col("place_country"), "country", 40)


def objects(segments: DataFrame) -> DataFrame:
    return facet(segments, F.coalesce("user_label", "label"), "object", 40, "photo_id")


def _photo_sets() -> list[tuple[str, Column, int | None]]:
    """Facets of the photo table: name, value, most values."""
    return [
        ("folder", F.nullif("source_folder", F.lit("")), None), ("camera", F.col("camera_model"), None), ("year", F.date_format("captured_utc", "yyyy"), None),
        ("city", F.nullif("place_city", F.lit("")), 40), ("country", F.col("place_country"), 40),
    ]


def photo_facets(photos: DataFrame) -> DataFrame:
    """facet, value, n of all facets of photos in one scan: grouping sets, then the first of each set that has a limit,
    which each task finds for its own rows first."""
    sets = _photo_sets()
    names = [n for n, _, _ in sets]
    told = photos.select(*[c.alias(n) for n, c, _ in sets]).groupingSets([[n] for n in names], *names)
    facet_ = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(n)) for n in names])
    counts = told.agg(facet_.alias("facet"), F.count("*").alias("n")).select("facet", F.coalesce(*names).alias("value"), "n").where("value IS NOT NULL")
    limits = {n: most for n, _, most in sets if most}
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    first = counts.where(F.col("facet").isin(*limits)).withColumn("rank", rank).where(F.col("rank") <= max(limits.values()))
    first = first.where(F.coalesce(*[F.when(F.col("facet") == n, F.col("rank") <= most) for n, most in limits.items()])).drop("rank")
    return counts.where(~F.col("facet").isin(*limits)).unionByName(first)


def all_facets(photos: DataFrame, tags: DataFrame, segments: DataFrame) -> DataFrame:
    """facet, value, n: a scan a table. In order of the facets, each commonest first (years last first)."""
    out = photo_facets(photos).unionByName(tag_facet(tags)).unionByName(objects(segments))
    names = F.array(*map(F.lit, ("folder", "camera", "year", "tag", "city", "country", "object")))
    return out.orderBy(F.array_position(names, F.col("facet")), F.when(F.col("facet") == "year", F.col("value")).desc(), F.desc("n"), "value")


def months(photos: DataFrame) -> DataFrame:
    """month (yyyy-MM) and n; empty months are left out."""
    return photos.groupBy(F.date_format("captured_utc", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def time_rail(photos: DataFrame) -> DataFrame:
    """Rows of the rail, newest first by position: a heading for every year of the span, each month that
    has photos with share sqrt(n / busiest), and one row for four or more empty months in a row. Runs
    end at year headings, so a silence over New Year is judged in two parts. All photos count for
    pending, not just the first 5000."""
    by = photos.where("captured_utc IS NOT NULL").groupBy(F.trunc("captured_utc", "month").alias("m"))
    counts = by.agg(F.count("*").alias("n"), F.bool_or(F.col("state") == PENDING).alias("pending"))  # one row a month
    span = counts.agg(F.min("m").alias("a"), F.max("m").alias("b"), F.max("n").alias("top"))
    every = span.select("top", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).join(counts, "m", "left")
    every = every.withColumns({"y": F.year("m"), "n": F.coalesce("n", F.lit(0)), "pending": F.coalesce("pending", F.lit(False))})
    w = W.partitionBy("y").orderBy("m")
    runs = every.where("n = 0").withColumn("run", F.month("m") - F.row_number().over(w))
    gaps = runs.groupBy("y", "run").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count("*").alias("months")).where("months >= 4")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    month = every.where("n > 0").select(F.lit("month").alias("kind"), "y", F.col("m").alias("first"), F.col("m").alias("last"), "n", F.sqrt(F.col("n") / F.col("top")).alias("share"), "pending", zero.alias("months"))
    year = every.groupBy("y").agg(F.sum("n").alias("n"), F.bool_or("pending").alias("pending"))
    year = year.select(F.lit("year").alias("kind"), "y", F.make_date("y", F.lit(1), F.lit(1)).alias("first"), F.make_date("y", F.lit(12), F.lit(31)).alias("last"), "n", F.lit(0.0).alias("share"), "pending", zero.alias("months"))
    gap = gaps.select(F.lit("gap").alias("kind"), "y", "first", "last", zero.alias("n"), F.lit(0.0).alias("share"), no.alias("pending"), "months")
    rows = year.unionByName(month).unionByName(gap)
    order = W.orderBy(F.desc("y"), F.when(F.col("kind") == "year", 0).otherwise(1), F.desc("last"))
    return rows.withColumn("position", F.row_number().over(order).cast("long"))  # some rows a month of the span


def state_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy("state").agg(F.count("*").alias("n"))


def library_status(photos: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return photos.agg(F.count("*").alias("total"), is_(PENDING).alias("pending"), is_(PROCESSING).alias("processing"), is_(UNREADABLE).alias("unreadable"), (is_(PROCESSING) > 0).alias("working"))


def description_coverage(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count_if(F.trim("ai_description") != "").alias("described"), F.count("*").alias("total"))


def face_counts(faces: DataFrame) -> DataFrame:
    return faces.agg(F.count("*").alias("faces"), F.count_distinct("photo_id").alias("photos"), F.count("embedding").alias("embedded"))


def named_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Each person with faces, photos and the crop of the largest face that has one; people without
    faces stay. Ordered by photos, then name."""
    has = F.col("crop_key").isNotNull()
    best = F.max(F.when(has, F.struct("area", (-F.col("face_id")).alias("_i"), "crop_key")))["crop_key"]
    found = faces.where("person_id IS NOT NULL").withColumnRenamed("id", "face_id").groupBy("person_id")
    found = found.agg(F.count("*").alias("faces"), F.count_distinct("photo_id").alias("photos"), best.alias("crop_key"))
    out = people.join(found, people.id == found.person_id, "left")
    zero = F.lit(0).cast("long")
    return out.select("id", "name", F.coalesce("faces", zero).alias("faces"), F.coalesce("photos", zero).alias("photos"), "crop_key").orderBy(F.desc("photos"), "name", "id")


def cache_size(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.char_length("payload")), F.lit(0)).alias("characters"))


def span_and_busiest(photos: DataFrame) -> DataFrame:
    """First and last capture, and the busiest month (the earliest of several)."""
    span = photos.agg(F.min("captured_utc").alias("first"), F.max("captured_utc").alias("last"))
    busiest = months(photos).agg(F.min(F.struct((-F.col("n")).alias("n"), "month")).alias("b"))
    return span.join(F.broadcast(busiest), how="cross").select("first", "last", F.col("b.month").alias("month"), (-F.col("b.n")).alias("n"))  # one row each


def siblings(faces: DataFrame, order: list[Column]) -> DataFrame:
    """Adds k and n: which of how many faces of its photo a face is, in listing order."""
    w = W.partitionBy("photo_id")
    return faces.withColumns({"k": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
