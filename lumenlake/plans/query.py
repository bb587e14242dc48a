"""The catalogue's query record: optional predicates, an order and a page, compiled to a DataFrame.

Every predicate is an AND; null columns fail comparisons. All of them are expressions or semi
joins, so they reach the Parquet scan where their columns lie in the photo table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import nocase
from lumenlake.operators import fulltext
from lumenlake.operators.text_index import TextIndex


class Order(Enum):
    CAPTURED_DESCENDING = "captured_descending"
    CAPTURED_ASCENDING = "captured_ascending"
    INDEXED_DESCENDING = "indexed_descending"
    FILE_NAME = "file_name"
    RATING = "rating"
    SIZE = "size"
    CAMERA = "camera"
    FOLDER = "folder"
    SHUFFLE = "shuffle"


@dataclass(frozen=True)
class Query:
    """bounds: south, west, north, east, inclusive, without wrapping at the date line."""

    text: str | None = None
    from_utc: datetime | None = None
    to_utc: datetime | None = None
    camera: str | None = None
    bounds: tuple[float, float, float, float] | None = None
    favourites_only: bool = False
    min_rating: int | None = None
    state: int | None = None
    object: str | None = None
    city: str | None = None
    country: str | None = None
    source_folder: str | None = None
    collection_id: int | None = None
    tags: tuple[str, ...] = ()
    order: Order = Order.CAPTURED_DESCENDING
    limit: int = 200
    offset: int = 0

    def to_json(self) -> str:
        out = {k: v for k, v in asdict(self).items() if v not in (None, (), False)}
        out["order"] = self.order.value
        return json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in out.items()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> Query | None:
        """Null for what cannot be read."""
        try:
            found = {k: v for k, v in json.loads(text or "").items() if k in {f.name for f in fields(cls)}}
            for k in ("from_utc", "to_utc"):
                if k in found:
                    found[k] = datetime.fromisoformat(found[k])
            for k in ("bounds", "tags"):
                if k in found:
                    found[k] = tuple(found[k])
            return cls(**found | {"order": Order(found.get("order", Order.CAPTURED_DESCENDING.value))})
        except (ValueError, TypeError, AttributeError):
            return None


@dataclass(frozen=True)
class Catalog:
    """The tables that a query may touch; those it does not ask for can be absent. With a text index, text is looked
    up there; without one it is searched in the photos as they are read."""

    photos: DataFrame
    tags: DataFrame | None = None
    segments: DataFrame | None = None
    members: DataFrame | None = None
    text_index: TextIndex | None = None


def row_predicates(q: Query, semantic: bool = False) -> list[Column]:
    """Predicates on the photo table. semantic: those that the recheck of vector hits knows; city,
    country and folder are not among them, and the camera is matched over make and model together."""
    out: list[Column] = []
    if q.from_utc:
        out.append(F.col("captured_utc") >= F.lit(q.from_utc))
    if q.to_utc:
        out.append(F.col("captured_utc") <= F.lit(q.to_utc))
    if q.camera and q.camera.strip():
        if semantic:
            both = F.concat_ws(" ", F.coalesce("camera_make", F.lit("")), F.coalesce("camera_model", F.lit("")))
            out.append(nocase(both).contains(q.camera.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
        else:  # % and _ in the argument stay wildcards
            like = f"%{q.camera.strip().lower()}%"
            out.append(nocase("camera_model").like(like) | nocase("camera_make").like(like))
    if q.bounds:
        south, west, north, east = q.bounds
        out += [F.col("latitude").between(south, north), F.col("longitude").between(west, east)]
    if q.favourites_only:
        out.append(F.col("is_favourite"))
    if q.min_rating is not None:
        out.append(F.col("rating") >= q.min_rating)
    if q.state is not None:
        out.append(F.col("state") == q.state)
    if semantic:
        return out
    if q.city and q.city.strip():
        out.append(F.col("place_city") == q.city.strip())
    if q.country and q.country.strip():
        out.append(F.col("place_country") == q.country.strip())
    if q.source_folder and q.source_folder.strip():
        # a string range, not a path: /a also covers /ab
        low = q.source_folder.strip().rstrip("\\/")
        out.append((F.col("source_folder") >= low) & (F.col("source_folder") < low + "￿"))
    return out


def filtered(catalog: Catalog, q: Query) -> DataFrame:
    """All photos that pass, without order or page."""
    out = catalog.photos
    for p in row_predicates(q):
        out = out.where(p)
    if q.text and q.text.strip():
        out = fulltext.matching(out, catalog.tags, q.text) if catalog.text_index is None else out.join(catalog.text_index.lookup(q.text), "id", "left_semi")
    if q.object and q.object.strip():
        wanted = q.object.strip().lower()
        hits = catalog.segments.where(F.coalesce("user_label", "label") == wanted).select(F.col("photo_id").alias("id"))
        out = out.join(hits, "id", "left_semi")
    if q.collection_id is not None:
        out = out.join(catalog.members.where(F.col("collection_id") == q.collection_id).select(F.col("photo_id").alias("id")), "id", "left_semi")
    if wanted := sorted({t.strip().lower() for t in q.tags}):
        held = catalog.tags.where(F.col("tag").isin(wanted)).groupBy("photo_id").agg(F.count_distinct("tag").alias("n"))
        out = out.join(held.where(F.col("n") == len(wanted)).select(F.col("photo_id").alias("id")), "id", "left_semi")
    return out


def order_columns(order: Order) -> list[Column]:
    """Every order ends in the id."""
    newest = [F.desc("captured_utc"), F.desc("id")]
    return {
        Order.CAPTURED_DESCENDING: newest,
        Order.CAPTURED_ASCENDING: [F.asc("captured_utc"), F.asc("id")],
        Order.INDEXED_DESCENDING: [F.desc("indexed_utc"), F.desc("id")],
        Order.SIZE: [F.desc("file_size"), F.desc("id")],
        Order.FILE_NAME: [nocase("file_name").asc(), F.asc("id")],
        Order.FOLDER: [nocase("source_folder").asc(), F.asc("id")],
        Order.RATING: [F.desc("rating"), *newest],
        Order.CAMERA: [nocase(F.coalesce("camera_model", F.lit("~"))).asc(), *newest],
        Order.SHUFFLE: [F.substring("content_hash", 7, 8).asc(), F.asc("id")],
    }[order]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 5000) -> DataFrame:
    """A top-k page; the limit is clamped to 1..most, the offset to 0 or more."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(min(max(limit, 1), most))


def run(catalog: Catalog, q: Query) -> DataFrame:
    return page(filtered(catalog, q), order_columns(q.order), q.limit, q.offset)


def count(catalog: Catalog, q: Query, capped: bool = False) -> int:
    """How many photos pass; capped counts 5000 at most, as paged counting does."""
    found = filtered(catalog, q)
    return (found.limit(5000) if capped else found).count()


def evaluate_smart_folder(catalog: Catalog, query_json: str | None, limit: int | None = None) -> DataFrame:
    """Re-runs a stored query; one that cannot be read gives nothing."""
    q = Query.from_json(query_json)
    if q is None:
        return catalog.photos.limit(0)
    return run(catalog, replace(q, limit=limit) if limit else q)
