"""More queries of the catalogue, with their SQL: lookups, collections, corrections, boxes, texts, ingest,
stores, and the queue at work. Importing this module registers them with those of `catalog`."""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import datetime
from datetime import time as clock

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.functions import boxes, text
from lumenlake.functions.schedule import Schedule
from lumenlake.operators import edits, fulltext, grouping, jobs, lookups, models, vectors
from lumenlake.plans import fixtures, search, service
from lumenlake.plans.catalog import IOU, JOBS_OUT, NOW, ORACLES, TAGS_OUT, UNIT, WAITS, jobs_out, placed, query, queue, tag_table, tags_out, units
from lumenlake.plans.fixtures import ctes
from lumenlake.plans.query import Order, Query, count, evaluate_smart_folder, order_columns
from lumenlake.session import table
from lumenlake.sources import folders, ingest, store


def rows_of(spark, sf_dir, name: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, name)


# lookups


@query(ctes("photos") + "SELECT id, file_name, content_hash FROM photos WHERE id = 14")
def point_lookup(spark, sf_dir):
    return lookups.photo(rows_of(spark, sf_dir, "photos"), 14).select("id", "file_name", "content_hash")


@query(ctes("photos") + "SELECT id, file_name FROM photos WHERE content_hash = sha256('21')")
def lookup_by_hash(spark, sf_dir):
    return lookups.photo_by_hash(rows_of(spark, sf_dir, "photos"), hashlib.sha256(b"21").hexdigest()).select("id", "file_name")


@query(ctes("segments") + "SELECT id, label, row_number() OVER (ORDER BY sqrt(w * h) * 0.7 + confidence * 0.3 DESC, id) AS position FROM segments WHERE photo_id = 7")
def segments_of_photo(spark, sf_dir):
    shown = boxes.prominence(F.col("w") * F.col("h"), F.col("confidence"))
    return lookups.segments_of(rows_of(spark, sf_dir, "segments"), 7).select("id", "label", F.row_number().over(W.orderBy(shown.desc(), "id")).cast("long").alias("position"))


@query(ctes("members") + "SELECT collection_id FROM members WHERE photo_id = 8")
def albums_of_photo(spark, sf_dir):
    return edits.albums_of(rows_of(spark, sf_dir, "members"), 8)


def swept(photos: DataFrame) -> DataFrame:
    model = F.when(F.col("id") % 3 == 0, "m1").otherwise("m0")
    return photos.where("id % 3 = 0 OR id % 5 = 0").select(F.col("id").alias("photo_id"), model.alias("model"), F.expr(NOW).alias("swept_utc"))


@query(ctes("photos") + "SELECT id FROM photos WHERE id % 3 <> 0 ORDER BY id LIMIT 1000")
def pending_faces(spark, sf_dir):
    photos = rows_of(spark, sf_dir, "photos")
    return lookups.pending_faces(photos, swept(photos), "m1").select("id")


@query(ctes("photos", "faces") + f"""SELECT 'sweep' AS kind, id, CAST(NULL AS BIGINT) AS photo_id FROM photos WHERE id % 3 = 0 OR id % 2 = 0
UNION ALL SELECT 'face', id, photo_id FROM faces WHERE photo_id % 3 = 0 OR photo_id % 2 = 1 UNION ALL SELECT 'face', -id, id FROM photos WHERE id % 3 <> 0 AND id % 4 = 0
UNION ALL SELECT 'face', f.id, photo_id FROM faces f WHERE photo_id % 3 <> 0 AND photo_id % 2 = 0 AND photo_id % 4 <> 0""")
def sweep_faces(spark, sf_dir):
    """A sweep of the even photos that finds one face in every fourth; the others are marked too."""
    photos, faces = rows_of(spark, sf_dir, "photos"), rows_of(spark, sf_dir, "faces")
    sweeps = swept(photos).where("model = 'm1'")

    def examine(pending: DataFrame) -> DataFrame:
        found = pending.where("id % 4 = 0").select((-F.col("id")).alias("id"), F.col("id").alias("photo_id"), *[F.lit(0.5).alias(c) for c in ("confidence", "x", "y", "w", "h", "area")], F.lit(None).cast("string").alias("crop_key"), F.lit(None).cast("long").alias("person_id"))
        return found.withColumn("box", F.struct("x", "y", "w", "h")).select(*faces.columns)

    marks, left = lookups.sweep_faces(photos.where("id % 2 = 0"), sweeps, faces, "m1", examine, F.expr(NOW), None)
    out = marks.select(F.lit("sweep").alias("kind"), F.col("photo_id").alias("id"), F.lit(None).cast("long").alias("photo_id"))
    return out.unionByName(left.select(F.lit("face").alias("kind"), "id", "photo_id"))


COUNTED = {
    "nikon": (Query(camera="nikon"), "lower(camera_make) LIKE '%nikon%' OR lower(camera_model) LIKE '%nikon%'"),
    "rated": (Query(min_rating=4, state=1), "rating >= 4 AND state = 1"),
    "city": (Query(city=" city 7 "), "place_city = 'city 7'"),
    "all": (Query(), "true"),
}


@query(ctes("photos") + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n, least(count(*), 5000) AS capped FROM photos WHERE {where}" for k, (_, where) in COUNTED.items()))
def query_count(spark, sf_dir):
    c = fixtures.catalog(spark, sf_dir)
    return spark.createDataFrame([(k, count(c, q), count(c, q, capped=True)) for k, (q, _) in COUNTED.items()], "name string, n long, capped long")


@query(ctes("photos") + "SELECT id, row_number() OVER (ORDER BY rating DESC, captured_utc DESC, id DESC) AS position FROM (SELECT * FROM photos WHERE rating >= 3 AND lower(camera_make) LIKE '%canon%' ORDER BY rating DESC, captured_utc DESC, id DESC LIMIT 80)")
def smart_folder(spark, sf_dir):
    q = Query(min_rating=3, camera="canon", order=Order.RATING, limit=80)
    return placed(evaluate_smart_folder(fixtures.catalog(spark, sf_dir), q.to_json()), order_columns(q.order))


@query(ctes("photos") + "SELECT id, 0.0 AS score, CAST(0 AS BIGINT) AS reasons, row_number() OVER (ORDER BY captured_utc DESC, id DESC) AS position FROM (SELECT * FROM photos WHERE rating >= 5 ORDER BY captured_utc DESC, id DESC LIMIT 25)")
def search_without_text(spark, sf_dir):
    hits = search.search(fixtures.catalog(spark, sf_dir), Query(text="  ", min_rating=5, limit=25)).hits
    return hits.select("id", "score", F.col("reasons").cast("long").alias("reasons"), "position")


@query(ctes("photos") + "SELECT id, row_number() OVER (ORDER BY captured_utc, id) AS position FROM (SELECT * FROM photos WHERE source_folder >= '/photos/1' AND is_favourite ORDER BY captured_utc, id LIMIT 40)")
def library_search(spark, sf_dir):
    """The same through the service, which calibrates only when there is a vector to search with."""
    library = service.Library(fixtures.catalog(spark, sf_dir), units(spark, sf_dir), [])
    q = Query(favourites_only=True, order=Order.CAPTURED_ASCENDING, limit=40)
    return library.search(q).hits.select("id", "position")


# collections


COLLECTION = "id, name, CAST(kind AS BIGINT) AS kind, CAST(position AS BIGINT) AS position"


def collections_out(df: DataFrame) -> DataFrame:
    return df.select("id", "name", F.col("kind").cast("long").alias("kind"), F.col("position").cast("long").alias("position"))


@query(ctes("collections") + f"""SELECT {COLLECTION} FROM collections UNION ALL SELECT max(id) + 1, 'New album', 0, max(position) + 1 FROM collections
UNION ALL SELECT max(id) + 2, 'Best of', 1, max(position) + 2 FROM collections""")
def create_collections(spark, sf_dir):
    made = edits.create_collection(rows_of(spark, sf_dir, "collections"), " New album ")
    return collections_out(edits.create_collection(made, "Best of", Query(min_rating=5).to_json()))


@query(ctes("members") + "SELECT collection_id, photo_id FROM members WHERE NOT (collection_id = 1 AND photo_id % 3 = 0)")
def album_remove(spark, sf_dir):
    members = rows_of(spark, sf_dir, "members")
    return edits.remove_from_collection(members, members.where("collection_id = 1 AND photo_id % 3 = 0")).select("collection_id", "photo_id")


@query(ctes("collections") + "SELECT id, CASE WHEN id = 2 THEN 'Renamed' ELSE name END AS name FROM collections")
def rename_collection(spark, sf_dir):
    return edits.rename_collection(rows_of(spark, sf_dir, "collections"), 2, " Renamed ").select("id", "name")


@query(ctes("collections", "members") + "SELECT 'collection' AS kind, id, count(*) AS n FROM collections WHERE id <> 4 GROUP BY id UNION ALL SELECT 'member', collection_id, count(*) FROM members WHERE collection_id <> 4 GROUP BY 2")
def delete_collection(spark, sf_dir):
    left, members = edits.delete_collection(rows_of(spark, sf_dir, "collections"), rows_of(spark, sf_dir, "members"), 4)
    both = left.select(F.lit("collection").alias("kind"), "id").unionByName(members.select(F.lit("member").alias("kind"), F.col("collection_id").alias("id")))
    return both.groupBy("kind", "id").agg(F.count("*").alias("n"))


# corrections and names


def same_boxes(old: str, value: str, kept: str) -> str:
    """New rows of the photos divisible by 2 in the same boxes as the old ones, ids negative: of equal boxes,
    the first that had a value meets the first new one."""
    return f"""whole AS (SELECT DISTINCT * FROM {old}), {kept} AS (SELECT * FROM whole WHERE photo_id % 2 = 0),
a AS (SELECT photo_id, x, y, w, h, {value}, row_number() OVER (PARTITION BY photo_id, x, y, w, h ORDER BY id) AS n FROM {kept} WHERE {value} IS NOT NULL),
b AS (SELECT -id AS id, photo_id, x, y, w, h, row_number() OVER (PARTITION BY photo_id, x, y, w, h ORDER BY -id) AS n FROM {kept})
SELECT id, photo_id, {value} FROM whole WHERE photo_id % 2 = 1 UNION ALL SELECT b.id, b.photo_id, a.{value} FROM b LEFT JOIN a USING (photo_id, x, y, w, h, n)"""


@query(ctes("segments").rstrip() + ",\n" + same_boxes("segments", "user_label", "again"))
def replace_segments(spark, sf_dir):
    old = rows_of(spark, sf_dir, "segments").distinct()
    new = old.where("photo_id % 2 = 0").withColumns({"id": -F.col("id"), "user_label": F.lit(None).cast("string")})
    return edits.replace_segments(old, new).select("id", "photo_id", "user_label")


@query(ctes("faces").rstrip() + ",\n" + same_boxes("faces", "person_id", "again"))
def replace_faces(spark, sf_dir):
    old = rows_of(spark, sf_dir, "faces").distinct()
    new = old.where("photo_id % 2 = 0").withColumns({"id": -F.col("id"), "person_id": F.lit(None).cast("long")})
    return edits.replace_faces(old, new).select("id", "photo_id", "person_id")


@query(ctes("segments") + "SELECT id FROM segments WHERE model = 'seg-1'")
def purge_models(spark, sf_dir):
    return edits.purge_other_models(rows_of(spark, sf_dir, "segments"), "seg-1").select("id")


@query(ctes("tags") + f"SELECT {TAGS_OUT} FROM tags WHERE NOT (source = 2 AND tag = 'view' AND photo_id % 4 = 0) UNION ALL SELECT DISTINCT photo_id, 'view', 2, 1.0 FROM tags WHERE photo_id % 4 = 0")
def add_user_tags(spark, sf_dir):
    tags = tag_table(spark, sf_dir)
    new = tags.where("photo_id % 4 = 0").select("photo_id").distinct().select("photo_id", F.lit("  VIEW ").alias("tag"), F.lit(0).alias("seq"))
    return tags_out(edits.add_user_tags(tags, new))


@query(ctes("faces", "people") + "SELECT id, CASE WHEN id % 7 = 0 THEN (SELECT max(id) + 1 FROM people) WHEN id % 7 = 1 THEN 3 WHEN id % 7 = 2 THEN NULL ELSE person_id END AS person_id FROM faces")
def name_faces(spark, sf_dir):
    """A new name, one that is known in other letters, and none."""
    people, faces = rows_of(spark, sf_dir, "people").withColumn("created_utc", F.expr(NOW)), rows_of(spark, sf_dir, "faces")
    third = people.where("id = 3").first()["name"]
    for k, name in enumerate((" Somebody New ", third.swapcase(), "  ")):
        people, faces = edits.name_faces(people, faces, faces.where(F.pmod("id", F.lit(7)) == k).select("id"), name, F.expr(NOW))
    return faces.select("id", "person_id")


@query(ctes("people") + "SELECT id, CASE WHEN id = 3 THEN 'Third' ELSE name END AS name FROM people WHERE id <> 5")
def rename_and_delete_person(spark, sf_dir):
    """A free name is taken over; one that somebody has, and a blank one, are not."""
    people, faces = rows_of(spark, sf_dir, "people"), rows_of(spark, sf_dir, "faces")
    people, done = edits.rename_person(people, 3, " Third ")
    for name in ("THIRD", "  "):
        people, again = edits.rename_person(people, 4, name)
        assert done and not again
    return edits.delete_person(people, faces, 5)[0].select("id", "name")


@query(ctes("faces") + "SELECT id, CASE WHEN person_id <> 5 THEN person_id END AS person_id FROM faces")
def faces_of_deleted_person(spark, sf_dir):
    return edits.delete_person(rows_of(spark, sf_dir, "people"), rows_of(spark, sf_dir, "faces"), 5)[1].select("id", "person_id")


@query(ctes("photos") + "SELECT id AS photo_id, CASE WHEN id % 3 = 0 THEN 'm1' ELSE 'm0' END AS model FROM photos WHERE id % 3 = 0 OR id % 5 = 0 UNION SELECT id, 'm1' FROM photos WHERE id % 2 = 0")
def mark_swept(spark, sf_dir):
    photos = rows_of(spark, sf_dir, "photos")
    new = photos.where("id % 2 = 0").select(F.col("id").alias("photo_id"), F.lit("m1").alias("model"), F.expr(NOW).alias("swept_utc"))
    return edits.mark_swept(swept(photos), new).select("photo_id", "model")


@query(ctes("faces") + "SELECT id, photo_id FROM faces WHERE false")
def reset_faces(spark, sf_dir):
    return edits.reset_faces(rows_of(spark, sf_dir, "faces"), swept(rows_of(spark, sf_dir, "photos")))[0].select("id", "photo_id")


@query(ctes("photos") + "SELECT id AS photo_id, 'm1' AS model FROM photos WHERE id % 2 = 0")
def reset_faces_then_sweep(spark, sf_dir):
    """After a reset no photo counts as swept, whatever it was before, until it is swept again."""
    photos = rows_of(spark, sf_dir, "photos")
    faces_, sweeps = edits.reset_faces(rows_of(spark, sf_dir, "faces"), swept(photos))
    new = photos.where("id % 2 = 0").select(F.col("id").alias("photo_id"), F.lit("m1").alias("model"), F.expr(NOW).alias("swept_utc"))
    pending = lookups.pending_faces(photos, sweeps, "m1", None)
    return edits.mark_swept(sweeps, new).join(pending.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("photo_id", "model")


@query(ctes("faces") + "SELECT photo_id, 'person' AS tag, max(confidence) AS confidence FROM faces GROUP BY 1")
def face_tags(spark, sf_dir):
    return edits.face_tags(rows_of(spark, sf_dir, "faces")).select("photo_id", "tag", "confidence")


@query(ctes("photos") + "SELECT id, CASE WHEN id % 4 = 0 THEN 'described ' || CAST(id AS VARCHAR) ELSE ai_description END AS ai_description, revision FROM photos")
def set_descriptions(spark, sf_dir):
    photos = rows_of(spark, sf_dir, "photos")
    new = photos.where("id % 4 = 0").select("id", F.concat(F.lit("described "), F.col("id").cast("string")).alias("description"))
    return edits.set_descriptions(photos, new).select("id", "ai_description", "revision")


# full text, vectors


@query(r"""WITH d AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 10 = 0 THEN 'a licensed boat in ' || lang ELSE text END)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT id FROM d WHERE contains(t, ' licensed')""")
def fts_reindex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    blank = [F.lit("").alias(c) for c in fulltext.COLUMNS if c != "description"]
    shaped = lambda d: d.select("id", F.col("text").alias("description"), *blank)
    changed = docs.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat(F.lit("a licensed boat in "), "lang")).otherwise(F.col("text")))
    postings = fulltext.index(shaped(docs)).where(F.col("token").startswith("licensed"))
    again = fulltext.reindex(postings, shaped(changed), docs.where("id % 10 = 0").select("id"))
    return fulltext.lookup(again, "licensed")


@query("SELECT vec_id AS photo_id FROM embeddings WHERE vec_id % 5 = 0")
def vectors_of_one_width(spark, sf_dir):
    cut = F.when(F.col("photo_id") % 5 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    return vectors.one_width(units(spark, sf_dir).withColumn("vector", cut)).select("photo_id")


@query("SELECT vec_id AS photo_id, CAST(CASE WHEN vec_id % 9 = 0 THEN 0 ELSE 64 END AS BIGINT) AS n, vec_id % 9 <> 0 AS same FROM embeddings")
def vector_codec(spark, sf_dir):
    """Vectors as text and back; a text with something that is no number is none."""
    shown = vectors.to_text(F.col("embedding"))
    back = vectors.from_text(F.when(F.col("vec_id") % 9 == 0, F.concat(shown, F.lit(" x"))).otherwise(shown))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), F.size(back).cast("long").alias("n"), (back == F.col("embedding").cast("array<float>")).alias("same"))


@query(UNIT + """, g AS (SELECT label, i, sum(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL), m AS (SELECT label, sqrt(sum(x * x)) AS m FROM g GROUP BY 1)
SELECT CAST(g.label AS BIGINT) AS label, i AS place, round(CAST(CAST(x / m AS FLOAT) AS DOUBLE), 4) AS x FROM g JOIN m USING (label)""")
def mean_vectors(spark, sf_dir):
    """The unit of the sum of each label's vectors, as of a caption's sentences or a query's prompts."""
    means = vectors.mean_unit(units(spark, sf_dir), "label", "vector")
    each = means.select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("i", "x"))
    return each.select("label", (F.col("i") + 1).cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("""SELECT DISTINCT p_name AS query, CAST(i AS BIGINT) AS place, CASE i WHEN 1 THEN p_name WHEN 2 THEN 'a photo of ' || p_name WHEN 3 THEN 'a photo of a ' || p_name WHEN 4 THEN 'a photograph of ' || p_name ELSE 'a close-up photo of ' || p_name END AS prompt
FROM part, (SELECT unnest(range(1, 6)) AS i)""")
def query_prompts(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    shaped = [F.regexp_replace(F.lit(t), r"\{0\}", F.col("query")) for t in vectors.QUERY_TEMPLATES]
    return names.select("query", F.posexplode(F.array(*shaped)).alias("i", "prompt")).select("query", (F.col("i") + 1).cast("long").alias("place"), "prompt")


@query(UNIT + """, b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, v FROM e WHERE vec_id < 32)
SELECT e.vec_id AS photo_id, round(avg(list_dot_product(e.v, b.v)), 5) AS hub FROM e, b GROUP BY 1""")
def reference_hub(spark, sf_dir):
    """Each row's mean similarity to the reference phrases, embedded here by a table of vectors."""
    rows = units(spark, sf_dir)
    known = [[float(x) for x in r["vector"]] for r in rows.where("photo_id < 32").orderBy("photo_id").collect()]  # one for each phrase
    bank = vectors.reference_bank(lambda phrases: known[: len(phrases)])
    return vectors.with_hub(rows, vectors.bank_mean(bank, 64)).select("photo_id", F.round("hub", 5).alias("hub"))


# texts


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 12)[1:8], '|') AS said FROM documents""")
def caption_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.sentences(F.coalesce("text", F.lit(""))), "|").alias("said"))


@query(r"""WITH c AS (SELECT conv_id, turn, text || ' ' || text AS t FROM conversations), p AS (SELECT *, regexp_extract_all(t, '(?s)[^.]*\.') AS p FROM c),
k AS (SELECT conv_id, turn, min(i) AS i FROM (SELECT conv_id, turn, i, s, row_number() OVER (PARTITION BY conv_id, turn, s ORDER BY i) AS r FROM (SELECT conv_id, turn, i, trim(lower(p[i]), ' ') AS s FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p))) WHERE r > 1 AND length(s) > 12 GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN k.i IS NULL THEN t ELSE array_to_string(p.p[1:k.i - 1], '') END AS said FROM p LEFT JOIN k ON k.conv_id = p.conv_id AND k.turn = p.turn""")
def until_repeat(spark, sf_dir):
    twice = F.concat("text", F.lit(" "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.until_repeat(twice).alias("said"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text || '<|im_end|>', '<\|im_end\|>|<\|endoftext\|>', '', 'g'), ' ') AS t FROM conversations),
l AS (SELECT *, length(regexp_extract(t, '(?s)^(.*[.!?])', 1)) AS last FROM t)
SELECT conv_id, turn, nullif(regexp_replace(CASE WHEN last > 1 AND last < length(t) AND last - 1 > length(t) // 2 THEN substr(t, 1, last) ELSE t END, '\.{2,}$', '.'), '') AS said FROM l""")
def tidy_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tidy(F.concat("text", F.lit("<|im_end|>"))).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'faces' END AS stage, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'pending' END AS state FROM events")
def stage_codes(spark, sf_dir):
    stage = F.when(F.col("event_id") % 4 == 0, "faces").otherwise(F.col("event_type"))
    state = F.when(F.col("event_id") % 3 == 0, "failed").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", jobs.known_stage(stage).alias("stage"), jobs.known_state(state).alias("state"))


# boxes and faces

ITEM = "SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s FROM lineitem"


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))


def part_of(name: str, n: int, by: float) -> Column:
    return (F.col(name) % n).cast("double") / by


@query(f"""WITH l AS ({ITEM}), b AS (SELECT l_orderkey, l_linenumber, p, s, exp((p % 7) / 4.0) * 8 AS w, exp((s % 5) / 4.0) * 8 AS h FROM l)
SELECT l_orderkey, l_linenumber, p, s, round(sqrt((p % 10) / 10.0 * ((s % 9) / 9.0)), 6) AS score, round((p % 80 + (s % 4) / 4.0) * 8 - w / 2, 6) AS x, round((s % 80 + (p % 4) / 4.0) * 8 - h / 2, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM b""")
def anchor_boxes(spark, sf_dir):
    whole = lambda c, n: F.col(c) % n
    b = boxes.anchor_decode(part_of("p", 10, 10.0), part_of("s", 9, 9.0), part_of("s", 4, 4.0), part_of("p", 4, 4.0), part_of("p", 7, 4.0), part_of("s", 5, 4.0), whole("p", 80), whole("s", 80), F.lit(8))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "p", "s", *[F.round(b[k], 6).alias(k) for k in ("score", "x", "y", "w", "h")])


@query(f"""WITH l AS ({ITEM}), e AS (SELECT l_orderkey, l_linenumber, p, s, greatest(0, least((p % 640 - 80) / 0.5, 960)) AS a, greatest(0, least((s % 640) / 0.5, 1280)) AS b,
  greatest(0, least((p % 640 - 80 + s % 90) / 0.5, 960)) AS c, greatest(0, least((s % 640 + p % 70) / 0.5, 1280)) AS d FROM l)
SELECT l_orderkey, l_linenumber, p, s, CASE WHEN c - a >= 2 AND d - b >= 2 THEN round(CAST(a AS DOUBLE), 4) END AS x, CASE WHEN c - a >= 2 AND d - b >= 2 THEN round(CAST(c - a AS DOUBLE), 4) END AS w FROM e""")
def letterbox_boxes(spark, sf_dir):
    d = lambda c, n: (F.col(c) % n).cast("double")
    b = boxes.letterbox_inverse(d("p", 640), d("s", 640), d("s", 90), d("p", 70), F.lit(80.0), F.lit(0.0), F.lit(0.5), F.lit(960.0), F.lit(1280.0))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "p", "s", F.round(b["x"], 4).alias("x"), F.round(b["w"], 4).alias("w"))


@query("SELECT s_suppkey AS id, round((s_suppkey % 7 + 1) / 4.0, 5) AS a, round((s_suppkey % 5) / 4.0, 5) AS b, round(s_suppkey % 11 + 0.5, 5) AS tx, round(s_suppkey % 13 - 6.0, 5) AS ty FROM supplier")
def face_fits(spark, sf_dir):
    """Points turned, scaled and moved by known amounts: the fit gives these back."""
    k = F.col("s_suppkey")
    a, b, tx, ty = (k % 7 + 1) / 4.0, (k % 5) / 4.0, k % 11 + 0.5, k % 13 - 6.0
    marks = [(0.3, 0.4), (0.7, 0.4), (0.5, 0.6), (0.35, 0.8), (0.65, 0.8)]
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in marks])
    moved = F.array(*[F.struct((a * x - b * y + tx).cast("double").alias("x"), (b * x + a * y + ty).cast("double").alias("y")) for x, y in marks])
    fit = boxes.similarity_fit(points, moved)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), *[F.round(fit[c], 5).alias(c) for c in ("a", "b", "tx", "ty")])


@query(r"""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 8 / 8.0 AS x, s_suppkey % 32 / 32.0 AS y FROM supplier)
SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE regexp_replace(printf('%.5f', CAST(x AS DOUBLE)), '\.?0+$', '') || ',' || regexp_replace(printf('%.5f', CAST(y AS DOUBLE)), '\.?0+$', '') END AS marks FROM t""")
def landmark_codec(spark, sf_dir):
    k = F.col("s_suppkey")
    shown = F.concat(F.lit(" "), ((k % 8) / 8.0).cast("string"), F.lit(" ,"), ((k % 32) / 32.0).cast("string"))
    points = boxes.parse_landmarks(F.when(k % 9 == 0, F.concat(shown, F.lit(",1"))).otherwise(shown))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), boxes.format_landmarks(points).alias("marks"))


FNV = "list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT name, CAST(floor((CAST({FNV} AS DOUBLE) * 0.618033988749895) % 360) AS BIGINT) AS hue FROM n),
c AS (SELECT name, hue, [round((0.58 - 0.714 / 2 + 0.714 * least(greatest(abs((hue / 60.0 + k) % 6 - 3) - 1, 0), 1)) * 255) FOR k IN [0, 4, 2]] AS c FROM h)
SELECT name, hue, CAST(c[1] AS BIGINT) AS r, CAST(c[2] AS BIGINT) AS g, CAST(c[3] AS BIGINT) AS b FROM c""")
def label_colours(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("hue", boxes.label_hue(F.col("name")))
    rgb = boxes.hsl_to_rgb(F.col("hue"))
    return names.select("name", F.col("hue").cast("long").alias("hue"), *[rgb[k].cast("long").alias(k) for k in ("r", "g", "b")])


@query(ctes("faces") + """, q AS (SELECT id, least(1.6 * greatest(w * 400, h * 300), 400, 300) AS side, (x + w / 2) * 400 AS cx, (y + h / 2) * 300 AS cy FROM faces)
SELECT id, CASE WHEN side >= 8 THEN round(greatest(0, least(cx - side / 2, 400 - side)), 4) END AS x, CASE WHEN side >= 8 THEN round(greatest(0, least(cy - side / 2, 300 - side)), 4) END AS y, CASE WHEN side >= 8 THEN round(side, 4) END AS side FROM q""")
def face_crops(spark, sf_dir):
    crop = boxes.crop_square(F.col("box"), F.lit(400.0), F.lit(300.0))
    return rows_of(spark, sf_dir, "faces").select("id", *[F.round(crop[k], 4).alias(k) for k in ("x", "y", "side")])


@query(ctes("faces") + "SELECT id, id % 7 >= 5 AND least(w, h) >= 0.08 AS good FROM faces")
def faces_to_embed(spark, sf_dir):
    point = F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    marks = F.array_repeat(point, (F.col("id") % 7).cast("int"))
    return rows_of(spark, sf_dir, "faces").select("id", boxes.eligible_face(marks, F.col("box"), 0.08).alias("good"))


@query(ctes("faces").replace("WITH faces", "WITH RECURSIVE faces") + f""", s AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, id) AS n FROM faces WHERE confidence >= 0.8),
near AS (SELECT a.photo_id, a.n AS a, b.n AS b FROM s a JOIN s b ON a.photo_id = b.photo_id AND a.n < b.n WHERE {IOU} / (a.w * a.h + b.w * b.h - {IOU}) > 0.3),
m AS (SELECT photo_id, max(n) AS most FROM s GROUP BY ALL),
walk(photo_id, i, kept) AS (SELECT photo_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM m UNION ALL
  SELECT w.photo_id, i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.photo_id = w.photo_id AND b = i + 1 AND list_contains(kept, a)) THEN kept ELSE list_append(kept, i + 1) END FROM walk w JOIN m ON m.photo_id = w.photo_id WHERE i < most),
k AS (SELECT s.* FROM s JOIN m USING (photo_id) JOIN walk w ON w.photo_id = s.photo_id AND w.i = m.most WHERE list_contains(w.kept, s.n) AND least(s.w, s.h) >= 0.018 AND s.x >= -0.05 AND s.y >= -0.05 AND s.x + s.w <= 1.05 AND s.y + s.h <= 1.05)
SELECT id, row_number() OVER (PARTITION BY photo_id ORDER BY w * h DESC, id) AS place FROM k""")
def suppress_faces(spark, sf_dir):
    found = rows_of(spark, sf_dir, "faces").select("id", "photo_id", F.col("confidence").alias("score"), "x", "y", "w", "h")
    return grouping.suppress_faces(found).select("id", F.col("place").cast("long").alias("place"))


@query(ctes("faces", "segments").replace("WITH faces", "WITH RECURSIVE faces") + f""", pairs AS (SELECT b.photo_id, b.id AS face_id, a.id AS segment_id, {IOU} / (b.w * b.h) AS c, a.w * a.h AS sa FROM segments a JOIN faces b ON a.photo_id = b.photo_id
  WHERE lower(a.label) = 'person' AND a.user_label IS NULL AND b.person_id IS NOT NULL AND {IOU} / (b.w * b.h) >= 0.75),
p AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY c DESC, sa, face_id, segment_id) AS n FROM pairs), m AS (SELECT photo_id, max(n) AS most FROM p GROUP BY 1),
walk(photo_id, i, f, g) AS (SELECT photo_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM m UNION ALL
  SELECT w.photo_id, i + 1, CASE WHEN list_contains(f, p.face_id) OR list_contains(g, p.segment_id) THEN f ELSE list_append(f, p.face_id) END, CASE WHEN list_contains(f, p.face_id) OR list_contains(g, p.segment_id) THEN g ELSE list_append(g, p.segment_id) END
  FROM walk w JOIN p ON p.photo_id = w.photo_id AND p.n = i + 1)
SELECT photo_id, unnest(f) AS face_id, unnest(g) AS segment_id FROM walk JOIN m USING (photo_id) WHERE i = most""")
def person_segments(spark, sf_dir):
    faces, segments = rows_of(spark, sf_dir, "faces"), rows_of(spark, sf_dir, "segments").withColumn("area", F.col("w") * F.col("h"))
    return grouping.person_segments(faces, segments).select("photo_id", "face_id", "segment_id")


GREY = "(s_suppkey * ({0} + 1) * 37 + s_suppkey * s_suppkey) % 256"
BIT = "CASE WHEN " + GREY.format("(j // 8) * 9 + j % 8") + " > " + GREY.format("(j // 8) * 9 + j % 8 + 1") + " THEN 1 ELSE 0 END"


@query("SELECT s_suppkey AS id, array_to_string(list_transform(range(0, 16), lambda n: substr('0123456789abcdef', CAST(1 + " + " + ".join(f"{8 >> b} * ({BIT.replace('j', f'(4 * n + {b})')})" for b in range(4)) + " AS BIGINT), 1)), '') AS hash FROM supplier")
def difference_hashes(spark, sf_dir):
    k = F.col("s_suppkey")
    samples = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (k * (i + 1) * 37 + k * k) % 256)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), grouping.difference_hash(samples).alias("hash"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE (s_suppkey % 4 + 1) / 8.0 * 0.25 END AS area FROM supplier")
def segment_masks(spark, sf_dir):
    """Planes of one value: the mask is the whole box where the weighted plane is positive."""
    k = F.col("s_suppkey")
    segments = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 2).alias("photo_id"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), ((k % 4 + 1) / 8.0).cast("double").alias("w"), F.lit(0.25).alias("h"), F.array(F.when(k % 3 == 0, -1.0).otherwise(1.0)).alias("weights"))
    planes = spark.range(2).select(F.col("id").alias("photo_id"), F.lit(1).alias("channels"), F.lit(4).alias("side"), F.array_repeat(F.lit(2.0), 16).alias("plane"))
    return models.masks(segments, planes)


def describe(model, doc_id, body) -> str | None:
    if doc_id % 10 == 0:
        raise ValueError("bad")
    return None if doc_id % 10 == 1 else f"{model} {len(body)}"


@query("SELECT doc_id, CASE WHEN doc_id % 10 > 1 THEN 'm ' || CAST(length(text) AS VARCHAR) END AS payload, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: bad' END AS error FROM documents")
def examine_items(spark, sf_dir):
    return models.examine(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text"], describe, lambda: "m")


# the queue at work


@query(ctes("jobs", "photos") + f""", free AS (SELECT photo_id, stage FROM jobs j WHERE {WAITS} AND photo_id IN (SELECT id FROM photos) AND NOT EXISTS (SELECT 1 FROM jobs e WHERE e.photo_id = j.photo_id AND e.ord < j.ord AND e.state = 'running'))
SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE WHEN (photo_id, stage) IN (SELECT (photo_id, stage) FROM free) THEN 'skipped' ELSE state END AS state, model, CAST(attempts AS BIGINT) AS attempts, CASE WHEN (photo_id, stage) IN (SELECT (photo_id, stage) FROM free) THEN 'no model' ELSE error END AS error FROM jobs""")
def queue_drain(spark, sf_dir):
    """Without models every row that can be reached is skipped, stage after stage."""
    all_, now = queue(spark, sf_dir)
    cache = spark.createDataFrame([], "content_hash string, stage string, model string, payload string, created_at timestamp")
    return jobs_out(jobs.drain(all_, rows_of(spark, sf_dir, "photos"), cache, {}, now)[0])


def answered(asked: DataFrame) -> DataFrame:
    k = F.col("photo_id")
    return asked.select("photo_id", F.when((k % 3 != 0) & (k % 5 != 0), F.concat(F.lit("said "), k.cast("string"))).alias("payload"), F.when(k % 5 == 0, "no luck").alias("error"))


@query(ctes("jobs", "photos") + f"""SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'reused' WHEN photo_id % 5 = 0 THEN 'failed' WHEN photo_id % 3 = 0 THEN 'skipped' ELSE 'computed' END AS outcome,
  CASE WHEN photo_id % 2 = 0 THEN 'known' WHEN photo_id % 5 > 0 AND photo_id % 3 > 0 THEN 'said ' || CAST(photo_id AS VARCHAR) END AS payload
FROM jobs j WHERE stage = 'describe' AND {WAITS} AND photo_id IN (SELECT id FROM photos)""")
def queue_stage(spark, sf_dir):
    """One pass over a stage: cached payloads are used again, the others are made, fail, or say nothing."""
    all_, now = queue(spark, sf_dir)
    photos = rows_of(spark, sf_dir, "photos")
    cache = photos.where("id % 2 = 0").select("content_hash", F.lit("describe").alias("stage"), F.lit("m").alias("model"), F.lit("known").alias("payload"), now.alias("created_at"))
    return jobs.run_stage(all_, photos, cache, "describe", jobs.Handler("m", answered), now)[2].select("photo_id", "outcome", "payload")


@query("SELECT CAST(hour AS BIGINT) AS hour, hour >= 22 OR hour < 6 AS ran FROM (SELECT unnest(range(0, 24)) AS hour)")
def queue_tick(spark, sf_dir):
    """A tick runs only while the schedule is open; here there is nothing to run."""
    c = fixtures.catalog(spark, sf_dir)
    none = fixtures.table(spark, sf_dir, "jobs").limit(0)
    cache = spark.createDataFrame([], "content_hash string, stage string, model string, payload string, created_at timestamp")
    owner = service.QueueService(c, none, cache, swept(c.photos), {}, Schedule("window", clock(22), clock(6)))
    return spark.createDataFrame([(h, owner.tick(datetime(2024, 1, 20, h))) for h in range(24)], "hour long, ran boolean")


@query(ORACLES["queue_drain"])
def queue_tick_jobs(spark, sf_dir):
    """The service's tick over all jobs: nothing while the schedule is closed, all that can be reached once it is open."""
    all_, _ = queue(spark, sf_dir)
    cache = spark.createDataFrame([], "content_hash string, stage string, model string, payload string, created_at timestamp")
    photos = rows_of(spark, sf_dir, "photos")
    owner = service.QueueService(fixtures.catalog(spark, sf_dir), all_, cache, swept(photos), {}, Schedule("window", clock(22), clock(6)))
    if owner.tick(datetime(2024, 1, 20, 12)) or owner.jobs is not all_:
        raise AssertionError("a closed schedule ran something")
    owner.tick(datetime(2024, 1, 20, 23))
    return jobs_out(owner.jobs)


# ingest


def tiff(k: int) -> bytes:
    """A small TIFF file with tags that depend on k."""
    entries, extra = [], b""
    base = 8 + 2 + 12 * 7 + 4

    def add(tag: int, kind: int, n: int, value: bytes):
        nonlocal extra
        if len(value) > 4:
            value, extra = struct.pack("<I", base + len(extra)), extra + value + b"\0" * (len(value) % 2)
        entries.append(struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0"))

    make, when, words = b"  Maker%d \0" % k, b"20%02d:03:04 05:06:0%d\0" % (10 + k, k), "Sea;sea , b|Old Town,x%d" % k
    add(0x10F, 2, len(make), make)
    add(0x110, 2, 2, b"\0\0")
    add(0x112, 3, 1, struct.pack("<H", k + 1))
    add(0x132, 2, len(when), when)
    add(0x4746, 3, 1, struct.pack("<H", k % 4))
    add(0x4749, 3, 1, struct.pack("<H", 20 * k))
    raw = words.encode("utf-16-le")
    add(0x9C9E, 1, len(raw), raw)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + extra + b"\0" * 64


def gps_tiff(k: int) -> bytes:
    """A TIFF with a GPS directory that depends on k; k = 0 has the zeros that cameras write for no fix."""
    rational = lambda *v: b"".join(struct.pack("<II", n, d) for n, d in v)
    lat, lon = ((0, 1),) * 3, ((0, 1),) * 3
    if k:
        lat, lon = ((10 * k, 1), (7 * k, 1), (100 * k + 25, 100)), ((20 * k, 1), (30, 1), (9, 4))
    at = 8 + 2 + 12 + 4
    data = at + 2 + 12 * 6 + 4
    values = rational(*lat) + rational(*lon) + rational((50 * k + 1, 2))
    rows = [(1, 2, 2, b"S\0" if k % 2 else b"N\0"), (2, 5, 3, struct.pack("<I", data)), (3, 2, 2, b"W\0" if k % 3 == 1 else b"E\0"), (4, 5, 3, struct.pack("<I", data + 24)), (5, 1, 1, bytes([k % 2])), (6, 5, 1, struct.pack("<I", data + 48))]
    gps = struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHI", tag, kind, n) + v.ljust(4, b"\0") for tag, kind, n, v in rows) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x8825, 4, 1, at) + struct.pack("<I", 0) + gps + values


def as_jpeg(tiff_: bytes) -> bytes:
    """A JPEG header with an application segment before the EXIF one."""
    exif = b"Exif\0\0" + tiff_
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + b"\0" * 9 + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\x00\x02"


@query("""WITH p AS (SELECT page_id, page_id % 5 AS k FROM pages)
SELECT 'g' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.tif' ELSE '.jpg' END AS file_name,
  CASE WHEN k > 0 THEN round((10 * k + 7 * k / 60.0 + (100 * k + 25) / 100.0 / 3600.0) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END, 9) END AS latitude,
  CASE WHEN k > 0 THEN round((20 * k + 30 / 60.0 + 9 / 4.0 / 3600.0) * CASE WHEN k % 3 = 1 THEN -1 ELSE 1 END, 9) END AS longitude,
  (50 * k + 1) / 2.0 * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END AS altitude FROM p""")
def import_gps(spark, sf_dir):
    """Every page as a TIFF or a JPEG with a GPS directory before its html."""
    k = (F.col("page_id") % 5).cast("int")
    heads = lambda form: F.get(F.array(*[F.lit(form(gps_tiff(i))) for i in range(5)]), k)
    even = F.col("page_id") % 2 == 0
    pages = table(spark, sf_dir, "pages").withColumn("content", F.concat(F.when(even, heads(lambda t: t)).otherwise(heads(as_jpeg)), F.encode(F.col("html"), "UTF-8")))
    path = F.concat(F.lit("/in/g"), F.col("page_id").cast("string"), F.when(even, ".tif").otherwise(".jpg"))
    rows = ingest.photo_rows(pages.select(path.alias("path"), F.expr(NOW).alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content"))
    return rows.select("file_name", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "altitude")


def files(spark, sf_dir) -> DataFrame:
    """Every page as a file: its html after the header of one of seven small images, or, one in eight, by itself."""
    k = (F.col("page_id") % 7).cast("int")
    head = F.get(F.array(*[F.lit(tiff(i)) for i in range(7)]), k)
    body = F.encode(F.col("html"), "UTF-8")
    content = F.when(F.col("page_id") % 8 == 0, body).otherwise(F.concat(head, body))
    pages = table(spark, sf_dir, "pages").withColumn("content", content)
    path = F.concat(F.lit("/in/"), (F.col("page_id") % 5).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".TIF"))
    return pages.select(path.alias("path"), F.expr(NOW).alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")


FILES = "f AS (SELECT page_id, page_id % 7 AS k, page_id % 8 <> 0 AS ok, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{tiff(i).hex()}'" for i in range(7)) + " END AS head, html FROM pages)"


@query(f"""WITH {FILES} SELECT 'p' || CAST(page_id AS VARCHAR) || '.TIF' AS file_name, '/in/' || CAST(page_id % 5 AS VARCHAR) AS source_folder, 'image/tiff' AS mime_type,
  CASE WHEN ok THEN sha256(unhex(head) || encode(html)) ELSE sha256(html) END AS content_hash, CASE WHEN NOT ok THEN repeat('0', 16) END AS perceptual_hash,
  CASE WHEN ok THEN CAST(make_timestamp(2010 + k, 3, 4, 5, 6, k) AS VARCHAR) ELSE '2024-01-20 00:00:00' END AS captured, ok AS capture_exact, CASE WHEN ok THEN 'Maker' || CAST(k AS VARCHAR) END AS camera_make,
  CASE WHEN ok THEN k + 1 ELSE 1 END AS orientation, CAST(CASE WHEN ok THEN 0 ELSE 4 END AS BIGINT) AS state, CASE WHEN ok THEN CASE WHEN k % 4 > 0 THEN k % 4 ELSE k END ELSE 0 END AS rating,
  CASE WHEN NOT ok THEN '' ELSE 'sea|old town|x' || CAST(k AS VARCHAR) END AS keywords FROM f""")
def import_photos(spark, sf_dir):
    """Files as rows: type, hash, time, camera, orientation, rating and keywords from their tags; unreadable ones too."""
    rows = ingest.photo_rows(files(spark, sf_dir))
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("file_name", "source_folder", "mime_type", "content_hash", "perceptual_hash", F.date_format("captured_utc", "yyyy-MM-dd HH:mm:ss").alias("captured"), "capture_exact", "camera_make", long("orientation"), long("state"), long("rating"), F.array_join("keywords", "|").alias("keywords"))


@query(f"""WITH {FILES}, h AS (SELECT page_id, ok, CASE WHEN ok THEN sha256(unhex(head) || encode(html)) ELSE sha256(html) END AS h FROM f),
g AS (SELECT h, count(*) AS n, bool_or(page_id % 4 = 1) AS known, bool_and(ok) AS ok FROM h GROUP BY 1),
o AS (SELECT CASE WHEN ok THEN 'imported' ELSE 'failed' END AS outcome, CASE WHEN known THEN 0 ELSE 1 END AS n FROM g UNION ALL SELECT 'duplicate', n - CASE WHEN known THEN 0 ELSE 1 END FROM g)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1 HAVING sum(n) > 0""")
def import_outcomes(spark, sf_dir):
    rows = ingest.photo_rows(files(spark, sf_dir))
    known = rows.where(F.regexp_extract("file_name", r"\d+", 0).cast("long") % 4 == 1)
    return ingest.outcomes(known, rows)


@query(f"""WITH {FILES} SELECT page_id AS photo_id, unnest(['sea', 'old town', 'x' || CAST(k AS VARCHAR)]) AS tag FROM f WHERE ok""")
def import_tags(spark, sf_dir):
    rows = ingest.photo_rows(files(spark, sf_dir))
    photos = rows.select(F.regexp_extract("file_name", r"\d+", 0).cast("long").alias("id"), "content_hash")
    return ingest.file_tags(photos, rows).select("photo_id", "tag")


@query(ctes("photos") + "SELECT id, CASE WHEN id % 3 = 0 THEN 'proxy/' || CAST(id AS VARCHAR) ELSE file_name END AS path FROM photos")
def analysis_sources(spark, sf_dir):
    photos = rows_of(spark, sf_dir, "photos").withColumn("proxy_key", F.concat(F.lit("proxy/"), F.col("id").cast("string"))).withColumnRenamed("file_name", "original_path")
    return ingest.analysis_source(photos, photos.where("id % 3 = 0").select(F.col("proxy_key").alias("key")))


@query("SELECT s_name AS city, n_name AS country, CAST(n_nationkey AS VARCHAR) AS code, CAST(CAST(s_suppkey % 90 AS FLOAT) AS DOUBLE) AS lat FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 6 <> 0")
def build_places(spark, sf_dir):
    """Cities of countries that are not in the list drop out."""
    cities = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.col("s_nationkey").cast("string").alias("code"))
    countries = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("country"))
    return ingest.build_places(cities, countries, 1).select("city", "country", "code", F.col("lat").cast("double").alias("lat"))


# stores


def shelf(spark) -> store.ObjectStore:
    """An object store of its own in the shared folder."""
    return store.ObjectStore(spark, f"{store.shared_dir(spark)}/{spark.sparkContext.applicationId}/shelf-{uuid.uuid4().hex}")


def nations(spark, sf_dir) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows


@query("SELECT 'k/' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN '.jpg' ELSE '.txt' END AS key, length(n_name) + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS length FROM nation WHERE n_nationkey <> 7")
def object_store(spark, sf_dir):
    """Written, written again, not overwritten, deleted and listed through Hadoop's file systems."""
    s = shelf(spark)
    for r in nations(spark, sf_dir):
        key = f"k/{r.n_nationkey}" + (".jpg" if r.n_nationkey % 2 == 0 else ".txt")
        s.write(key, r.n_name.encode())
        if r.n_nationkey % 5 == 0:
            s.write(key, s.read(key) + b"!")
        s.write(key, b"", only_new=True)
    s.delete("k/7.txt")
    return s.listing("k/").select("key", "length")


@query("SELECT 'k' || CAST(n_nationkey AS VARCHAR) || '.jpg' AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'missing'")
def discover_files(spark, sf_dir):
    """Files of known types in the folders; a folder that is not there is told, not failed on."""
    s = shelf(spark)
    for r in nations(spark, sf_dir):
        s.write(f"in/k{r.n_nationkey}" + (".jpg" if r.n_nationkey % 2 == 0 else ".txt"), b"x")
    found, missing = ingest.discover(spark, [f"{s.root}/in", f"{s.root}/out"])
    return found.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name")).unionByName(spark.createDataFrame([("missing",) for _ in missing], "name string"))


@query("SELECT n_name AS file, 'by ' || CAST(n_regionkey AS VARCHAR) AS author FROM nation")
def attribution_list(spark, sf_dir):
    s = shelf(spark)
    lines = ["# file\tauthor"] + [f"{r.n_name}\tby {r.n_regionkey}" for r in nations(spark, sf_dir)]
    s.write("list.tsv", "\n".join(lines).encode())
    return ingest.read_attribution(spark, f"{s.root}/list.tsv", ["file", "author"])


@query("SELECT 'a' AS name, '2' AS value UNION ALL SELECT 'b', 'x' UNION ALL SELECT 'c', 'none'")
def settings_store(spark, sf_dir):
    kept_ = service.Settings(shelf(spark))
    for name, value in (("a", "1"), ("b", "x"), ("a", "2")):
        kept_.set(name, value)
    return spark.createDataFrame([(n, kept_.get(n, "none")) for n in "abc"], "name string, value string")


@query("SELECT unnest(['/photos', '/archive/b', 'C:\\Fotos']) AS folder")
def source_folders(spark, sf_dir):
    """Folders that lie in others give way; their sub-folders are not added again."""
    held: list[str] = []
    for f in ("/photos/1995", "/archive/b", "/photos/", "/PHOTOS/2001/x", "/archive/b/../b/c", "C:\\Fotos\\", "c:\\fotos\\neu", "/gone"):
        held = folders.add(held, f)
    return spark.createDataFrame([(f,) for f in folders.parse(folders.to_text(folders.remove(held, "/gone/")))], "folder string")


@query("SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS state, CAST(1 AS BIGINT) AS revision, CAST(o_custkey AS VARCHAR) AS file_name, true AS bare, CAST(41 AS BIGINT) AS columns FROM orders")
def upgrade_table(spark, sf_dir):
    """A table of an early version with the columns of the present one; a second time changes nothing."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), F.col("o_custkey").alias("file_name"), F.lit(1).alias("forgotten"))
    new = schema.upgraded(schema.upgraded(old, "photos"), "photos")
    bare = F.col("content_hash").isNull() & F.col("width").isNull()
    return new.select("id", F.col("state").cast("long").alias("state"), "revision", "file_name", bare.alias("bare"), F.lit(len(new.columns)).cast("long").alias("columns"))


@query()
def prompt_ids(spark, sf_dir):
    """Prompt tokens between start and end, at most 77, by the vocabulary file of the prompts' model."""
    import public_tokenizers

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("prompt")).distinct()
    return names.select("prompt", models.prompt_tokens(F.col("prompt"), public_tokenizers.path("word_bpe_49k.json")).alias("ids"))


@query(ctes("jobs", "photos") + f"SELECT {JOBS_OUT} FROM jobs WHERE photo_id NOT IN (SELECT id FROM photos WHERE id % 2 = 0) UNION ALL SELECT {JOBS_OUT} FROM jobs WHERE photo_id IN (SELECT id FROM photos WHERE id % 2 = 0) AND stage <> 'describe' UNION ALL SELECT photo_id, stage, CAST(ord AS BIGINT), CASE WHEN {WAITS} THEN 'done' ELSE state END, CASE WHEN {WAITS} THEN 'm' ELSE model END, CAST(CASE WHEN {WAITS} THEN 0 ELSE attempts END AS BIGINT), CASE WHEN {WAITS} THEN NULL ELSE error END FROM jobs WHERE photo_id IN (SELECT id FROM photos WHERE id % 2 = 0) AND stage = 'describe'")
def queue_after_stage(spark, sf_dir):
    """The queue after a stage whose model answers for every second photo."""
    all_, now = queue(spark, sf_dir)
    photos = rows_of(spark, sf_dir, "photos").where("id % 2 = 0")
    cache = photos.limit(0).select("content_hash", F.lit("").alias("stage"), F.lit("").alias("model"), F.lit("").alias("payload"), now.alias("created_at"))
    work = jobs.Handler("m", lambda asked: asked.select("photo_id", F.lit("said").alias("payload"), F.lit(None).cast("string").alias("error")))
    return jobs_out(jobs.run_stage(all_, photos, cache, "describe", work, now)[0])
