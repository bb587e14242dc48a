"""Reads of one row's neighbourhood, and of what a stage has not seen yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.boxes import prominence
from lumenlake.operators.edits import mark_swept, replace_faces


def photo(photos: DataFrame, photo_id: int) -> DataFrame:
    """The photo's row, or none. The id reaches the scan as a filter."""
    return photos.where(F.col("id") == photo_id)


def photo_by_hash(photos: DataFrame, content_hash: str) -> DataFrame:
    return photos.where(F.col("content_hash") == content_hash)


def segments_of(segments: DataFrame, photo_id: int) -> DataFrame:
    """A photo's segments, the most prominent first, ties by id."""
    shown = F.col("prominence") if "prominence" in segments.columns else prominence(F.col("w") * F.col("h"), F.col("confidence"))
    return segments.where(F.col("photo_id") == photo_id).orderBy(shown.desc(), "id")


def pending_faces(photos: DataFrame, sweeps: DataFrame, model: str, limit: int | None = 1000) -> DataFrame:
    """Photos that no sweep of the model has looked at, in order of id. A limit of None takes all."""
    seen = sweeps.where(F.col("model") == model).select(F.col("photo_id").alias("id"))
    out = photos.join(seen, "id", "left_anti")
    return out.orderBy("id").limit(limit) if limit is not None else out


def sweep_faces(photos: DataFrame, sweeps: DataFrame, faces: DataFrame, model: str, examine: Callable[[DataFrame], DataFrame], now: Column, limit: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """(sweeps, faces) after one sweep of the pending photos. examine gives the faces that it finds, as rows of
    faces; photos in which it finds none, or fails, are marked all the same and not looked at again."""
    pending = pending_faces(photos, sweeps, model, limit)
    marked = pending.select(F.col("id").alias("photo_id"), F.lit(model).alias("model"), now.alias("swept_utc"))
    return mark_swept(sweeps, marked), replace_faces(faces, examine(pending))
