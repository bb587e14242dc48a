"""Listing faces: least confidence, chosen photos, one of four orders, a page."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.boxes import prominence
from lumenlake.plans.query import page


class FaceOrder(Enum):
    PROMINENCE = "prominence"
    NEWEST = "newest"
    OLDEST = "oldest"
    CONFIDENCE = "confidence"


def order_columns(order: FaceOrder) -> list[Column]:
    """Every order ends in the id."""
    return {
        FaceOrder.PROMINENCE: [prominence(F.col("area"), F.col("confidence")).desc(), F.asc("id")],
        FaceOrder.NEWEST: [F.desc("captured_utc"), F.desc("id")],
        FaceOrder.OLDEST: [F.asc("captured_utc"), F.asc("id")],
        FaceOrder.CONFIDENCE: [F.desc("confidence"), F.asc("id")],
    }[order]


def listing(faces: DataFrame, photos: DataFrame, people: DataFrame, order: FaceOrder = FaceOrder.PROMINENCE, least: float = 0.0, of: DataFrame | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Faces with their photo's time and their person's name. of (photo_id): only these photos; none given,
    all. The page is cut before the names are joined."""
    rows = faces.where(F.col("confidence") >= least)
    if of is not None:
        rows = rows.join(of.select("photo_id").distinct(), "photo_id", "left_semi")
    timed = rows.join(photos.select(F.col("id").alias("photo_id"), "captured_utc"), "photo_id")
    names = people.select(F.col("id").alias("person_id"), F.col("name").alias("person"))
    return page(timed, order_columns(order), limit, offset).join(names, "person_id", "left")


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(1.0)
