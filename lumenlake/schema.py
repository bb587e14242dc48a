"""Schemas of the catalogue's tables, and its codes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 11

_BOX = "struct<x:double,y:double,w:double,h:double>"
_DDL = {
    "photos": f"""id long, content_hash string, perceptual_hash string, original_path string, file_name string,
        source_folder string, mime_type string, width int, height int, file_size long, captured_utc timestamp,
        file_modified_utc timestamp, indexed_utc timestamp, capture_exact boolean, camera_make string,
        camera_model string, lens string, iso int, f_number double, exposure_seconds double,
        focal_length_mm double, latitude double, longitude double, altitude double, place_city string,
        place_country string, place_code string, place_label string, orientation int, thumbnail_key string,
        proxy_key string, state int, state_detail string, model_version string, ai_caption string,
        ai_description string, user_title string, user_notes string, rating int, is_favourite boolean, revision long""",
    "tags": "photo_id long, tag string, confidence double, source int",
    "embeddings": "photo_id long, model string, dims int, vector array<float>",
    "segments": f"id long, photo_id long, label string, confidence double, box {_BOX}, area double, prominence double, mask_key string, model string, user_label string",
    "faces": f"id long, photo_id long, confidence double, box {_BOX}, area double, roll double, landmarks array<struct<x:double,y:double>>, crop_key string, model string, embedding array<float>, embed_model string, person_id long",
    "sweeps": "photo_id long, model string, swept_utc timestamp",
    "people": "id long, name string, created_utc timestamp",
    "collections": "id long, name string, kind int, query_json string, cover_id long, position int",
    "members": "collection_id long, photo_id long, position int",
    "jobs": "photo_id long, stage string, ord int, state string, model string, attempts int, error string, updated_at timestamp",
    "stage_cache": "content_hash string, stage string, model string, payload string, created_at timestamp",
    "places": "city string, country string, code string, latitude double, longitude double",
}


def schema(table: str) -> T.StructType:
    """Needs a session, whose parser reads the text."""
    return T.StructType.fromDDL(_DDL[table])


#: What a column that an older table lacks is filled with; null for all others.
_FILLED = {"photos": {"state": 0, "rating": 0, "is_favourite": False, "revision": 1, "orientation": 1, "capture_exact": False}, "jobs": {"attempts": 0, "state": "pending"}, "members": {"position": 0}}


def upgraded(df: DataFrame, table: str) -> DataFrame:
    """A table of any earlier version with the columns, types and order of the present one. Columns that it
    lacks are filled, those that are no longer known are dropped; doing it again changes nothing."""
    have, filled = set(df.columns), _FILLED.get(table, {})
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(filled.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(table).fields])


#: Where a tag comes from, and the states of a photo.
FILE, AI, USER = 0, 1, 2
PENDING, PROCESSING, COMPLETE, FAILED, UNREADABLE = range(5)
