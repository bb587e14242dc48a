"""Writes as functions from a table's state to its next state: upserts, tags, collections, corrections.

Nothing overwrites what it reads: the caller writes the result as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions.text import nocase
from lumenlake.operators.grouping import match_in_turn, numbered
from lumenlake.schema import AI, COMPLETE, USER

MAX_LABEL = 60
KEEP_NAME, KEEP_LABEL = 0.6, 0.5
#: Numbers of incoming rows that meet their album's first together.
BLOCK = 1 << 16


def upsert_photos(photos: DataFrame, incoming: DataFrame) -> DataFrame:
    """Photos with the new ones, the first of each content hash (in order of seq); known hashes change
    nothing. Ids go on from the largest, in order of seq."""
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("seq"))
    new = incoming.withColumn("_r", first).where("_r = 1").drop("_r").join(photos.select("content_hash"), "content_hash", "left_anti")
    largest = photos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    counted = numbered(new.withColumn("o", F.struct("seq", "content_hash")), "_n").drop("o").join(F.broadcast(largest), how="cross")  # one row
    return photos.unionByName(counted.withColumn("id", (F.col("_n") + F.col("m") + 1).cast("long")).select(*photos.columns))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming: photo_id, tag, confidence, source, seq. Trimmed and lower-cased; a known (photo, tag,
    source) gets the new confidence."""
    keys = ["photo_id", "tag", "source"]
    clean = incoming.withColumn("tag", F.lower(F.trim("tag"))).where("tag <> ''")
    new = last_wins(clean, keys, "seq")
    return tags.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*tags.columns))


def replace_ai_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same, but photos with an incoming AI tag lose all AI tags they had."""
    touched = incoming.where(F.col("source") == AI).select("photo_id", "source").distinct()
    return upsert_tags(tags.join(touched, ["photo_id", "source"], "left_anti").select(*tags.columns), incoming)


def segment_tags(segments: DataFrame, seq: int = 0) -> DataFrame:
    """An AI tag for each distinct label of a photo, ignoring case, at its best confidence."""
    found = segments.groupBy("photo_id", F.lower("label").alias("tag")).agg(F.max("confidence").alias("confidence"))
    return found.select("photo_id", "tag", "confidence", F.lit(AI).alias("source"), F.lit(seq).alias("seq"))


def face_tags(faces: DataFrame, seq: int = 1) -> DataFrame:
    """The AI tag `person` for photos with a face."""
    return faces.groupBy("photo_id").agg(F.max("confidence").alias("confidence")).select("photo_id", F.lit("person").alias("tag"), "confidence", F.lit(AI).alias("source"), F.lit(seq).alias("seq"))


def add_user_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming: photo_id, tag, seq."""
    short = incoming.select("photo_id", F.substring(F.trim("tag"), 1, MAX_LABEL).alias("tag"), F.lit(1.0).alias("confidence"), F.lit(USER).alias("source"), "seq")
    return upsert_tags(tags, short)


def remove_user_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """Only the user's own tags go."""
    keys = gone.select("photo_id", F.lower(F.trim("tag")).alias("tag"), F.lit(USER).alias("source"))
    return tags.join(keys, ["photo_id", "tag", "source"], "left_anti").select(*tags.columns)


def correct_labels(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: id, label. Trimmed, at most 60 characters; blank clears."""
    new = corrections.select("id", F.nullif(F.substring(F.trim("label"), 1, MAX_LABEL), F.lit("")).alias("_label"), F.lit(True).alias("_set"))
    out = segments.join(new, "id", "left")
    return out.withColumn("user_label", F.when(F.col("_set"), F.col("_label")).otherwise(F.col("user_label"))).select(*segments.columns)


def replace_segments(segments: DataFrame, incoming: DataFrame) -> DataFrame:
    """New segments in place of all of their photos' old ones; a user's label goes on to the new segment
    that overlaps the old one most, by over half, each taken once."""
    photos = incoming.select("photo_id").distinct()
    old = segments.join(photos, "photo_id", "left_semi").where("user_label IS NOT NULL")
    pairs = match_in_turn(old, incoming, KEEP_LABEL)
    labels = pairs.join(old.select(F.col("id").alias("old_id"), F.col("user_label").alias("_label")), "old_id").select(F.col("new_id").alias("id"), "_label")
    new = incoming.join(labels, "id", "left").withColumn("user_label", F.coalesce("_label", "user_label")).select(*segments.columns)
    return segments.join(photos, "photo_id", "left_anti").select(*segments.columns).unionByName(new)


def replace_faces(faces: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same for faces and their names, over 0.6 of overlap."""
    photos = incoming.select("photo_id").distinct()
    old = faces.join(photos, "photo_id", "left_semi").where("person_id IS NOT NULL")
    pairs = match_in_turn(old, incoming, KEEP_NAME)
    names = pairs.join(old.select(F.col("id").alias("old_id"), F.col("person_id").alias("_person")), "old_id").select(F.col("new_id").alias("id"), "_person")
    new = incoming.join(names, "id", "left").withColumn("person_id", F.coalesce("_person", "person_id")).select(*faces.columns)
    return faces.join(photos, "photo_id", "left_anti").select(*faces.columns).unionByName(new)


def purge_other_models(rows: DataFrame, model: str) -> DataFrame:
    return rows.where(F.col("model") == model)


def name_faces(people: DataFrame, faces: DataFrame, face_ids: DataFrame, name: str | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """(people, faces): the faces (id) get the person of that name, ignoring case, who is made if new;
    a blank name clears them."""
    chosen = face_ids.select("id").distinct().withColumn("_set", F.lit(True))
    clean = (name or "").strip()
    own = None
    if clean:
        hit = people.where(nocase("name") == nocase(F.lit(clean))).agg(F.min("id")).first()[0]
        own = hit
        if hit is None:
            own = (people.agg(F.max("id")).first()[0] or 0) + 1
            people = people.unionByName(people.sparkSession.range(1).select(F.lit(own).cast("long").alias("id"), F.lit(clean).alias("name"), now.alias("created_utc")))
    out = faces.join(chosen, "id", "left").withColumn("person_id", F.when(F.col("_set"), F.lit(own).cast("long")).otherwise(F.col("person_id")))
    return people, out.select(*faces.columns)


def rename_person(people: DataFrame, person_id: int, name: str) -> tuple[DataFrame, bool]:
    """Unchanged, and false, for a blank name or one that somebody else has."""
    clean = name.strip()
    taken = people.where((nocase("name") == nocase(F.lit(clean))) & (F.col("id") != person_id)).limit(1).count()
    if not clean or taken:
        return people, False
    return people.withColumn("name", F.when(F.col("id") == person_id, F.lit(clean)).otherwise(F.col("name"))), True


def delete_person(people: DataFrame, faces: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    cleared = F.when(F.col("person_id") == person_id, F.lit(None).cast("long")).otherwise(F.col("person_id"))
    return people.where(F.col("id") != person_id), faces.withColumn("person_id", cleared)


def set_state(photos: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, state, detail, model. The revision goes up; a null model keeps the old one."""
    new = changes.select("id", F.col("state").alias("_s"), F.col("detail").alias("_d"), F.col("model").alias("_m"), F.lit(True).alias("_set"))
    out = photos.join(new, "id", "left")
    on = F.coalesce("_set", F.lit(False))
    return out.withColumns({
        "state": F.when(on, F.col("_s")).otherwise(F.col("state")), "state_detail": F.when(on, F.col("_d")).otherwise(F.col("state_detail")),
        "model_version": F.coalesce("_m", "model_version"), "revision": F.col("revision") + on.cast("long"),
    }).select(*photos.columns)


def set_descriptions(photos: DataFrame, texts: DataFrame) -> DataFrame:
    """texts: id, description. The revision stays."""
    out = photos.join(texts.select("id", F.col("description").alias("_d")), "id", "left")
    return out.withColumn("ai_description", F.coalesce("_d", "ai_description")).select(*photos.columns)


def complete(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return set_state(photos, ids.select("id", F.lit(COMPLETE).alias("state"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("model")))


def mark_swept(sweeps: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["photo_id", "model"]
    return sweeps.join(new.select(*keys), keys, "left_anti").select(*sweeps.columns).unionByName(new.select(*sweeps.columns))


def reset_faces(faces: DataFrame, sweeps: DataFrame) -> tuple[DataFrame, DataFrame]:
    return faces.limit(0), sweeps.limit(0)


# collections


def create_collection(collections: DataFrame, name: str, query_json: str | None = None) -> DataFrame:
    """An album, or a smart folder if it has a query; at the end of the list. A blank name or one that
    is taken, ignoring case, is an error."""
    clean = name.strip()
    if not clean:
        raise ValueError("a collection needs a name")
    if collections.where(nocase("name") == nocase(F.lit(clean))).limit(1).count():
        raise ValueError(f"there is a collection named {clean!r}")
    last = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("i"), F.coalesce(F.max("position"), F.lit(-1)).alias("p"))
    new = last.select((F.col("i") + 1).cast("long").alias("id"), F.lit(clean).alias("name"), F.lit(int(query_json is not None)).alias("kind"), F.lit(query_json).cast("string").alias("query_json"), F.lit(None).cast("long").alias("cover_id"), (F.col("p") + 1).cast("int").alias("position"))
    return collections.unionByName(new.select(*collections.columns))


def list_collections(collections: DataFrame, members: DataFrame) -> DataFrame:
    """In order of position and name, with n photos (-1 for smart folders)."""
    counts = members.groupBy("collection_id").agg(F.count("*").alias("n"))
    out = collections.join(counts, collections.id == counts.collection_id, "left")
    n = F.when(F.col("kind") == 1, F.lit(-1).cast("long")).otherwise(F.coalesce("n", F.lit(0).cast("long")))
    return out.select("id", "name", "kind", "query_json", "cover_id", "position", n.alias("n")).orderBy("position", "name")


def add_to_collection(members: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming: collection_id, photo_id, seq. Known photos are left alone, but their places count: the
    next position goes up for them too."""
    base = members.groupBy("collection_id").agg((F.max("position") + 1).alias("base"))
    # numbers over all albums in their order, less the album's first; joined by blocks of numbers, as one album may take most of the rows
    counted = numbered(incoming.select("collection_id", "photo_id", F.struct("collection_id", "seq", "photo_id").alias("o")), "_n").drop("o")
    block = lambda n: F.floor(F.col(n) / BLOCK)
    first = counted.groupBy(F.col("collection_id").alias("_c")).agg(F.min("_n").alias("_first"), F.max("_n").alias("_last")).join(base, F.col("_c") == F.col("collection_id"), "left")
    first = first.select("_c", "_first", "base", F.explode(F.sequence(block("_first"), block("_last"))).alias("_b"))
    placed = counted.join(first, F.col("collection_id").eqNullSafe(F.col("_c")) & (block("_n") == F.col("_b")))
    placed = placed.withColumn("position", (F.coalesce("base", F.lit(0)) + F.col("_n") - F.col("_first")).cast("int"))
    first = placed.groupBy("collection_id", "photo_id").agg(F.min("position").alias("position"))
    new = first.join(members.select("collection_id", "photo_id"), ["collection_id", "photo_id"], "left_anti")
    return members.unionByName(new.select(*members.columns))


def remove_from_collection(members: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["collection_id", "photo_id"]
    return members.join(gone.select(*keys), keys, "left_anti").select(*members.columns)


def move_between(members: DataFrame, source: int, target: int, photos: DataFrame) -> tuple[DataFrame, int]:
    """photos: photo_id, seq. Returns how many were asked for; 0, unchanged, for the same album or none."""
    asked = 0 if source == target else photos.count()
    if not asked:
        return members, 0
    into = photos.select(F.lit(target).cast("long").alias("collection_id"), "photo_id", "seq")
    added = add_to_collection(members, into)
    return remove_from_collection(added, photos.select(F.lit(source).cast("long").alias("collection_id"), "photo_id")), asked


def rename_collection(collections: DataFrame, collection_id: int, name: str) -> DataFrame:
    return collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(name.strip())).otherwise(F.col("name")))


def delete_collection(collections: DataFrame, members: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    return collections.where(F.col("id") != collection_id), members.where(F.col("collection_id") != collection_id)


def albums_of(members: DataFrame, photo_id: int) -> DataFrame:
    return members.where(F.col("photo_id") == photo_id).select("collection_id").orderBy("collection_id")
