"""Queries of the catalogue operators on the fixture tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from datetime import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import boxes, fuzzy, text
from lumenlake.functions.schedule import Schedule
from lumenlake.operators import edits, facets, faces, fulltext, grouping, jobs, places, vectors
from lumenlake.operators.job_table import JobTable
from lumenlake.operators.term_index import TermIndex
from lumenlake.operators.text_index import index_photos
from lumenlake.operators.vector_index import VectorIndex
from lumenlake.plans import fixtures, search
from lumenlake.plans.fixtures import ctes
from lumenlake.plans.query import Catalog, Order, Query, filtered, order_columns, run
from lumenlake.session import table
from lumenlake.sources import ingest, store
from lumenlake.sources.keyed import KeyedTable
from lumenlake.sources.store import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def placed(df: DataFrame, order: list) -> DataFrame:
    """id and position of a page."""
    return df.select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias("position"))


# predicates, orders, pages


@query("""
SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position, doc_id, lang, source, n_chars
FROM (SELECT * FROM documents WHERE lang = 'en' AND n_chars >= 500 AND source >= 'src1'
      ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 20)
""")
def browse_filters(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars >= 500 AND source >= 'src1'")
    page = kept.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(100)
    return page.select(F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("position"), "doc_id", "lang", "source", "n_chars")


def browse(name: str, q: Query, where: str, order: str = "captured_utc DESC, id DESC", tables: tuple = ("photos",)):
    def f(spark, sf_dir):
        return placed(run(fixtures.catalog(spark, sf_dir), q), order_columns(q.order))

    f.__name__ = name
    query(f"{ctes(*tables)}SELECT id, row_number() OVER (ORDER BY {order}) AS position FROM (SELECT * FROM photos WHERE {where} ORDER BY {order} LIMIT {q.limit} OFFSET {q.offset})")(f)


browse("browse_dates", Query(from_utc=datetime(1996, 3, 1), to_utc=datetime(1997, 6, 15, 12), limit=5000), "captured_utc >= TIMESTAMP '1996-03-01' AND captured_utc <= TIMESTAMP '1997-06-15 12:00:00'")
browse("browse_rating_state", Query(min_rating=3, state=2, favourites_only=True, limit=5000), "rating >= 3 AND state = 2 AND is_favourite")
browse("browse_camera", Query(camera=" nik", limit=5000), "lower(camera_model) LIKE '%nik%' OR lower(camera_make) LIKE '%nik%'")
browse("browse_bounds", Query(bounds=(-20.0, 10.0, 35.5, 120.0), limit=5000), "latitude BETWEEN -20 AND 35.5 AND longitude BETWEEN 10 AND 120")
browse("browse_place", Query(city=" city 7 ", country="country 4", limit=5000), "place_city = 'city 7' AND place_country = 'country 4'")
browse("browse_folder_prefix", Query(source_folder="/photos/1-/", limit=5000), "source_folder >= '/photos/1-' AND source_folder < '/photos/1-' || chr(65535)")
browse("browse_object", Query(object=" Boat ", limit=5000), "EXISTS (SELECT 1 FROM segments s WHERE s.photo_id = photos.id AND coalesce(s.user_label, s.label) = 'boat')", tables=("photos", "segments"))
browse("browse_collection", Query(collection_id=3, limit=5000), "EXISTS (SELECT 1 FROM members m WHERE m.photo_id = photos.id AND m.collection_id = 3)", tables=("photos", "members"))
browse("browse_tags_all", Query(tags=("view", "Click "), limit=5000), "EXISTS (SELECT 1 FROM tags t WHERE t.photo_id = photos.id AND t.tag = 'view') AND EXISTS (SELECT 1 FROM tags t WHERE t.photo_id = photos.id AND t.tag = 'click')", tables=("photos", "tags"))
browse("browse_text", Query(text="red BOAT, numero 1", limit=5000), "id % 3 = 0 AND regexp_matches(concat_ws(' ', ai_caption, ai_description, file_name, camera_make, camera_model, place_city, place_country), '(^|[^a-z0-9A-Z])1')")


@query(ORACLES["browse_text"])
def browse_text_indexed(spark, sf_dir):
    """browse_text through an index of two segments, the second with documents of the first again."""
    catalog = fixtures.catalog(spark, sf_dir)
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex}"
    index = index_photos(catalog.photos, catalog.tags, root)
    some = fulltext.documents(catalog.photos, catalog.tags).where("id % 50 = 0")
    index.update(some)
    q = Query(text="red BOAT, numero 1", limit=5000)
    return placed(run(replace(catalog, text_index=index), q), order_columns(q.order))


browse("browse_nothing", Query(text="boat &", limit=5000), "false")
browse("browse_page", Query(limit=70, offset=35), "true")

SORTS = {
    Order.CAPTURED_DESCENDING: "captured_utc DESC, id DESC", Order.CAPTURED_ASCENDING: "captured_utc, id", Order.INDEXED_DESCENDING: "indexed_utc DESC, id DESC",
    Order.SIZE: "file_size DESC, id DESC", Order.FILE_NAME: "lower(file_name), id", Order.FOLDER: "lower(source_folder), id", Order.RATING: "rating DESC, captured_utc DESC, id DESC",
    Order.CAMERA: "lower(coalesce(camera_model, '~')), captured_utc DESC, id DESC", Order.SHUFFLE: "substr(content_hash, 7, 8), id",
}
for _order, _sql in SORTS.items():
    browse(f"sort_{_order.value}", Query(order=_order, limit=500, offset=10), "true", _sql)


@query(ctes("photos") + """SELECT id, coalesce(nullif(trim(user_title), ''), nullif(trim(ai_caption), ''), file_name) AS title,
  CASE WHEN trim(user_title) <> '' THEN 2 WHEN trim(ai_caption) <> '' THEN 1 ELSE 0 END AS source FROM photos""")
def display_titles(spark, sf_dir):
    title, source = text.display_title(F.col("user_title"), F.col("ai_caption"), F.col("file_name"))
    return fixtures.table(spark, sf_dir, "photos").select("id", title.alias("title"), source.cast("long").alias("source"))


@query(ctes("photos") + "SELECT id FROM photos WHERE ai_description IS NULL OR trim(ai_description) = '' ORDER BY id LIMIT 100")
def undescribed(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "photos").where("ai_description IS NULL OR trim(ai_description) = ''").orderBy("id").limit(100).select("id")


@query(ctes("photos") + "SELECT id FROM photos WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = photos.id AND e.label <> 3)")
def pending_vectors(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").where("label <> 3").select(F.col("vec_id").alias("id"))
    return fixtures.table(spark, sf_dir, "photos").join(have, "id", "left_anti").select("id")


@query(ctes("tags") + "SELECT tag, CAST(source AS BIGINT) AS source, row_number() OVER (ORDER BY source DESC, confidence DESC, tag) AS position FROM tags WHERE photo_id = 14")
def tags_of_photo(spark, sf_dir):
    own = fixtures.table(spark, sf_dir, "tags").where("photo_id = 14")
    return own.select("tag", F.col("source").cast("long").alias("source"), F.row_number().over(W.orderBy(F.desc("source"), F.desc("confidence"), "tag")).cast("long").alias("position"))


@query(ctes("faces", "people") + """SELECT f.id, p.name, row_number() OVER (PARTITION BY photo_id ORDER BY area DESC, f.id) AS k, count(*) OVER (PARTITION BY photo_id) AS n
FROM faces f LEFT JOIN people p ON f.person_id = p.id""")
def faces_with_names(spark, sf_dir):
    people = fixtures.table(spark, sf_dir, "people").select(F.col("id").alias("person_id"), "name")
    out = fixtures.table(spark, sf_dir, "faces").join(people, "person_id", "left")
    return facets.siblings(out, [F.desc("area"), F.asc("id")]).select("id", "name", F.col("k").cast("long").alias("k"), "n")


@query(ctes("faces") + """SELECT id, row_number() OVER (ORDER BY sqrt(area) * 0.7 + confidence * 0.3 DESC, id) AS position
FROM (SELECT * FROM faces WHERE confidence >= 0.5 ORDER BY sqrt(area) * 0.7 + confidence * 0.3 DESC, id LIMIT 300)""")
def faces_by_prominence(spark, sf_dir):
    order = [boxes.prominence(F.col("area"), F.col("confidence")).desc(), F.asc("id")]
    return placed(fixtures.table(spark, sf_dir, "faces").where("confidence >= 0.5").orderBy(*order).limit(300), order)


def face_listing(order: faces.FaceOrder, by: str):
    def f(spark, sf_dir):
        t = lambda n: fixtures.table(spark, sf_dir, n)
        some = t("photos").where("id % 3 = 1").select(F.col("id").alias("photo_id"))
        out = faces.listing(t("faces"), t("photos"), t("people"), order, 0.3, some, 150, 20)
        return out.select("id", "person", F.row_number().over(W.orderBy(*faces.order_columns(order))).cast("long").alias("position"))

    f.__name__ = f"faces_{order.value}"
    query(f"""{ctes("faces", "photos", "people")}SELECT id, person, row_number() OVER (ORDER BY {by}) AS position FROM (
    SELECT f.id, p.name AS person, captured_utc, area, confidence FROM faces f JOIN photos ph ON ph.id = f.photo_id LEFT JOIN people p ON p.id = f.person_id
    WHERE confidence >= 0.3 AND f.photo_id % 3 = 1 ORDER BY {by.replace(" id", " f.id")} LIMIT 150 OFFSET 20)""")(f)


face_listing(faces.FaceOrder.PROMINENCE, "sqrt(area) * 0.7 + confidence * 0.3 DESC, id")
face_listing(faces.FaceOrder.NEWEST, "captured_utc DESC, id DESC")
face_listing(faces.FaceOrder.OLDEST, "captured_utc, id")
face_listing(faces.FaceOrder.CONFIDENCE, "confidence DESC, id")


@query("SELECT l_linenumber, l_orderkey, l_partkey, round(CASE WHEN l_quantity % 7 = 0 THEN 1 ELSE l_partkey / (l_quantity % 7) END, 6) AS ratio FROM lineitem")
def aspect_ratios(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_linenumber", "l_orderkey", "l_partkey", F.round(faces.aspect_ratio(F.col("l_partkey").cast("double"), F.col("l_quantity") % 7), 6).alias("ratio"))


@query(ctes("faces") + "SELECT DISTINCT photo_id FROM faces WHERE crop_key IS NOT NULL")
def photos_with_faces(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "faces").where("crop_key IS NOT NULL").select("photo_id").distinct()


# counts

FACETS = ctes("photos", "tags", "segments") + """
SELECT * FROM (SELECT 'folder' AS facet, source_folder AS value, count(*) AS n FROM photos WHERE source_folder <> '' GROUP BY 2)
UNION ALL SELECT * FROM (SELECT 'camera', camera_model, count(*) FROM photos WHERE camera_model IS NOT NULL GROUP BY 2)
UNION ALL SELECT * FROM (SELECT 'year', strftime(captured_utc, '%Y'), count(*) FROM photos GROUP BY 2)
UNION ALL SELECT * FROM (SELECT 'tag', tag, count(*) AS n FROM tags GROUP BY 2 ORDER BY n DESC, tag LIMIT 60)
UNION ALL SELECT * FROM (SELECT 'city', place_city, count(*) AS n FROM photos WHERE place_city <> '' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'country', place_country, count(*) AS n FROM photos WHERE place_country IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'object', coalesce(user_label, label), count(DISTINCT photo_id) AS n FROM segments GROUP BY 2 ORDER BY n DESC, 2 LIMIT 40)
"""


@query(FACETS)
def facets_all(spark, sf_dir):
    c = fixtures.catalog(spark, sf_dir)
    return facets.all_facets(c.photos, c.tags, c.segments)


@query(ctes("photos") + "SELECT strftime(captured_utc, '%Y-%m') AS month, count(*) AS n FROM photos GROUP BY 1")
def time_buckets(spark, sf_dir):
    return facets.months(fixtures.table(spark, sf_dir, "photos"))


@query(ctes("photos") + """,
counts AS (SELECT date_trunc('month', captured_utc) AS m, count(*) AS n, bool_or(state = 0) AS pending FROM photos GROUP BY 1),
every AS (SELECT g.m AS m, year(g.m) AS y, month(g.m) AS k, coalesce(n, 0) AS n, coalesce(pending, false) AS pending, (SELECT max(n) FROM counts) AS top
  FROM (SELECT unnest(generate_series((SELECT min(m) FROM counts), (SELECT max(m) FROM counts), INTERVAL 1 MONTH)) AS m) g LEFT JOIN counts USING (m)),
gaps AS (SELECT y, min(m) AS a, max(m) AS b, count(*) AS months FROM (SELECT *, k - row_number() OVER (PARTITION BY y ORDER BY m) AS run FROM every WHERE n = 0) GROUP BY y, run HAVING count(*) >= 4),
rail AS (SELECT 'year' AS kind, y, strftime(make_date(y, 1, 1), '%Y-%m-%d') AS first, strftime(make_date(y, 12, 31), '%Y-%m-%d') AS last, sum(n) AS n, 0.0 AS share, bool_or(pending) AS pending, 0 AS months FROM every GROUP BY y
  UNION ALL SELECT 'month', y, strftime(m, '%Y-%m-%d'), strftime(m, '%Y-%m-%d'), n, sqrt(n / top), pending, 0 FROM every WHERE n > 0
  UNION ALL SELECT 'gap', y, strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d'), 0, 0.0, false, months FROM gaps)
SELECT kind, CAST(y AS BIGINT) AS y, first, last, CAST(n AS BIGINT) AS n, round(CAST(share AS DOUBLE), 6) AS share, pending, CAST(months AS BIGINT) AS months,
  row_number() OVER (ORDER BY y DESC, CASE WHEN kind = 'year' THEN 0 ELSE 1 END, last DESC) AS position FROM rail""")
def time_rail(spark, sf_dir):
    return rail(fixtures.table(spark, sf_dir, "photos"))


def rail(photos: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return facets.time_rail(photos).select("kind", F.col("y").cast("long").alias("y"), day("first"), day("last"), "n", F.round("share", 6).alias("share"), "pending", F.col("months").cast("long").alias("months"), "position")


@query(ctes("photos") + "SELECT CAST(state AS BIGINT) AS state, count(*) AS n FROM photos GROUP BY 1")
def state_counts(spark, sf_dir):
    return facets.state_counts(fixtures.table(spark, sf_dir, "photos")).select(F.col("state").cast("long").alias("state"), "n")


@query(ctes("photos") + "SELECT count(*) AS total, count(*) FILTER (state = 0) AS pending, count(*) FILTER (state = 1) AS processing, count(*) FILTER (state = 4) AS unreadable, count(*) FILTER (state = 1) > 0 AS working FROM photos")
def library_status(spark, sf_dir):
    return facets.library_status(fixtures.table(spark, sf_dir, "photos"))


@query(ctes("photos") + "SELECT count(*) FILTER (trim(ai_description) <> '') AS described, count(*) AS total FROM photos")
def description_coverage(spark, sf_dir):
    return facets.description_coverage(fixtures.table(spark, sf_dir, "photos"))


@query(ctes("faces") + "SELECT count(*) AS faces, count(DISTINCT photo_id) AS photos, count(crop_key) AS embedded FROM faces")
def face_counts(spark, sf_dir):
    return facets.face_counts(fixtures.table(spark, sf_dir, "faces").withColumn("embedding", F.col("crop_key")))


@query(ctes("faces", "people") + """SELECT p.id, p.name, count(f.id) AS faces, count(DISTINCT f.photo_id) AS photos,
  (SELECT crop_key FROM faces b WHERE b.person_id = p.id AND crop_key IS NOT NULL ORDER BY area DESC, b.id LIMIT 1) AS crop_key
FROM people p LEFT JOIN faces f ON f.person_id = p.id GROUP BY p.id, p.name""")
def named_people(spark, sf_dir):
    return facets.named_people(fixtures.table(spark, sf_dir, "people"), fixtures.table(spark, sf_dir, "faces"))


@query("SELECT count(*) AS entries, coalesce(sum(length(text)), 0) AS characters FROM documents")
def cache_size(spark, sf_dir):
    return facets.cache_size(table(spark, sf_dir, "documents").withColumnRenamed("text", "payload"))


@query(ctes("photos") + """SELECT strftime(min(captured_utc), '%Y-%m-%d') AS first, strftime(max(captured_utc), '%Y-%m-%d') AS last,
  (SELECT strftime(captured_utc, '%Y-%m') AS m FROM photos GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1) AS month,
  (SELECT count(*) AS n FROM photos GROUP BY strftime(captured_utc, '%Y-%m') ORDER BY n DESC LIMIT 1) AS n FROM photos""")
def span_and_busiest(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return facets.span_and_busiest(fixtures.table(spark, sf_dir, "photos")).select(day("first"), day("last"), "month", "n")


# words


VOCABULARY = r"""WITH words AS (SELECT p_name AS t FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region),
terms AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_split_to_array(t, '[-_ .,/\()]+')) AS w FROM words) WHERE length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+'))
"""
TYPED = ("wigdet", "gaget", "EUORPE", "natoin", "ameriac", "asia", "widget", "spocket", "middel", "red")


def terms(spark, sf_dir) -> DataFrame:
    return fuzzy.vocabulary([(table(spark, sf_dir, "part"), "p_name"), (table(spark, sf_dir, "nation"), "n_name"), (table(spark, sf_dir, "region"), "r_name")])


@query(VOCABULARY + "SELECT term FROM terms")
def vocabulary(spark, sf_dir):
    return terms(spark, sf_dir)


GRAMS = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || ' ') - 1), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"
LIKE = f"len(list_intersect({GRAMS.format('query')}, {GRAMS.format('term')})) / CAST(len(list_distinct(list_concat({GRAMS.format('query')}, {GRAMS.format('term')}))) AS DOUBLE)"
NEAR = "damerau_levenshtein(lower(query), lower(term)) <= CASE WHEN length(query) <= 3 THEN 0 WHEN length(query) <= 7 THEN 1 ELSE 2 END AND length(query) > 3"


@query(VOCABULARY + f""", asked AS (SELECT unnest({list(TYPED)}) AS query),
scored AS (SELECT query, term, {LIKE} AS score FROM asked, terms WHERE length(query) >= 4 AND lower(term) <> lower(query) AND {NEAR})
SELECT query, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS rank FROM scored) WHERE rank <= 3""")
def fuzzy_correct(spark, sf_dir):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, TYPED))).alias("query"))
    return fuzzy.correct(asked, terms(spark, sf_dir)).select("query", "term", F.round("score", 6).alias("score"), "rank")


def term_index(spark, sf_dir) -> TermIndex:
    return TermIndex.build(terms(spark, sf_dir), f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/terms-{uuid.uuid4().hex}")


@query(ORACLES["fuzzy_correct"])
def fuzzy_correct_indexed(spark, sf_dir):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, TYPED))).alias("query"))
    return term_index(spark, sf_dir).correct(asked).select("query", "term", F.round("score", 6).alias("score"), "rank")


def suggestion(name: str, typed: str, indexed: bool = False):
    def f(spark, sf_dir):
        found = term_index(spark, sf_dir).suggest(typed) if indexed else fuzzy.suggest(typed, terms(spark, sf_dir))
        return found.select("term", F.round("score", 6).alias("score"))

    f.__name__ = name
    query(VOCABULARY + f""", scored AS (SELECT term, CASE WHEN starts_with(term, query) THEN 1 - 0.001 * least(length(term), 100) WHEN contains(term, query) THEN 0.8
      WHEN {NEAR} THEN 0.7 WHEN {LIKE} >= 0.42 THEN {LIKE} * 0.65 END AS score FROM terms, (SELECT '{typed}' AS query))
    SELECT term, round(CAST(score AS DOUBLE), 6) AS score FROM scored WHERE score IS NOT NULL ORDER BY scored.score DESC, term LIMIT 8""")(f)


suggestion("suggest_prefix", "wi")
suggestion("suggest_close", "wigdet")
suggestion("suggest_contained", "ation")
suggestion("suggest_indexed", "widgte", indexed=True)


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)")
def vocabulary_union(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query(VOCABULARY + ctes("segments").replace("WITH", ",") + """SELECT DISTINCT term FROM (SELECT lower(term) AS term FROM terms UNION ALL SELECT lower(coalesce(user_label, label)) FROM segments) ORDER BY term LIMIT 400""")
def label_vocabulary(spark, sf_dir):
    return fuzzy.label_vocabulary(facets.objects(fixtures.table(spark, sf_dir, "segments")), terms(spark, sf_dir)).select(F.lower("term").alias("term"))


def found_text(name: str, typed: str, where: str, inverted: bool = False):
    """Full text over documents.text, by scan or by the inverted index."""

    def f(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
        return fulltext.lookup(fulltext.index(docs, ("text",)), typed) if inverted else fulltext.matches(docs, typed, ("text",))

    f.__name__ = name
    query(rf"WITH d AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM documents) SELECT id FROM d WHERE {where}")(f)


found_text("fts_words", "the LICENSED apac", "contains(t, ' the ') AND contains(t, ' licensed ') AND contains(t, ' apac')")
found_text("fts_phrase", '"and(thea)" tion*', "contains(t, ' and thea ') AND contains(t, ' tion')")
found_text("fts_accents", "los ENTRÉ", "contains(t, ' los ') AND contains(t, ' entre')")
found_text("fts_index", "the LICENSED apac", "contains(t, ' the ') AND contains(t, ' licensed ') AND contains(t, ' apac')", inverted=True)
found_text("fts_index_phrase", "license,version.2", "contains(t, ' license ') AND contains(t, ' version 2')", inverted=True)


# vectors

UNIT = """WITH u AS (SELECT vec_id, label, [CAST(CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS FLOAT) FOR x IN embedding] AS v FROM embeddings),
e AS (SELECT vec_id, label, CAST(v AS DOUBLE[]) AS v FROM u)
"""


def units(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "photo_id")
    return vectors.normalised(rows, "embedding", "photo_id", "label")


def vector_of(rows: DataFrame, photo_id: int) -> list[float]:
    return [float(x) for x in rows.where(F.col("photo_id") == photo_id).first()["vector"]]


@query(UNIT + """, s AS (SELECT e.vec_id AS photo_id, list_dot_product(e.v, q.v) AS s FROM e, (SELECT v FROM e WHERE vec_id = 0) q)
SELECT photo_id, round(s, 5) AS score, round((s - (SELECT avg(s) FROM s)) / (SELECT stddev_pop(s) FROM s), 4) AS z FROM s WHERE s >= 0.18 ORDER BY s.s DESC, photo_id LIMIT 40""")
def vector_topk(spark, sf_dir):
    rows = units(spark, sf_dir)
    return vectors.search(rows, vector_of(rows, 0), 40).select("photo_id", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"))


HUB = UNIT + """, hub AS (SELECT e.vec_id, avg(list_dot_product(e.v, b.v)) AS hub FROM e, (SELECT v FROM e WHERE vec_id < 32) b GROUP BY 1),
s AS (SELECT e.vec_id AS photo_id, list_dot_product(e.v, q.v) - hub AS s FROM e JOIN hub USING (vec_id), (SELECT v FROM e WHERE vec_id = 40) q)
"""


@query(HUB + "SELECT photo_id, round(s, 5) AS score, round((s - (SELECT avg(s) FROM s)) / (SELECT stddev_pop(s) FROM s), 4) AS z FROM s ORDER BY s.s DESC, photo_id LIMIT 40")
def vector_hub(spark, sf_dir):
    rows = units(spark, sf_dir)
    bank = [[float(x) for x in r["vector"]] for r in rows.where("photo_id < 32").orderBy("photo_id").collect()]  # 32 phrases
    calibrated = vectors.with_hub(rows, vectors.bank_mean(bank, 64))
    return vectors.search(calibrated, vector_of(rows, 40), 40).select("photo_id", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"))


def index_of(rows: DataFrame, cells: int = 12) -> VectorIndex:
    """A new index in the shared folder, of two batches."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}"
    index = VectorIndex.build(rows.where("photo_id % 3 > 0").select("photo_id", "vector"), root, cells)
    index.append(rows.where("photo_id % 3 = 0").select("photo_id", "vector"))
    return index


INDEXED = "round(s, 5) AS score, round((s - (SELECT avg(s) FROM s)) / (SELECT stddev_pop(s) FROM s), 4) AS z FROM s"


@query(UNIT + f""", s AS (SELECT e.vec_id AS photo_id, list_dot_product(e.v, q.v) AS s FROM e, (SELECT v FROM e WHERE vec_id = 0) q)
SELECT photo_id, {INDEXED} WHERE s >= 0.18 ORDER BY s.s DESC, photo_id LIMIT 40""")
def vector_index_topk(spark, sf_dir):
    rows = units(spark, sf_dir)
    return index_of(rows).search(vector_of(rows, 0), 40).select("photo_id", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"))


@query(HUB + f"SELECT photo_id, {INDEXED} ORDER BY s.s DESC, photo_id LIMIT 40")
def vector_index_hub(spark, sf_dir):
    rows = units(spark, sf_dir)
    bank = [[float(x) for x in r["vector"]] for r in rows.where("photo_id < 32").orderBy("photo_id").collect()]  # 32 phrases
    found = index_of(rows).search(vector_of(rows, 40), 40, vectors.bank_mean(bank, 64))
    return found.select("photo_id", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"))


@query(UNIT + "SELECT e.vec_id AS photo_id, round(list_dot_product(e.v, q.v), 5) AS score FROM e, (SELECT v FROM e WHERE vec_id = 7) q WHERE e.vec_id <> 7 AND list_dot_product(e.v, q.v) >= 0 ORDER BY list_dot_product(e.v, q.v) DESC, photo_id LIMIT 24")
def similar_to(spark, sf_dir):
    return vectors.similar_to(units(spark, sf_dir), 7).select("photo_id", F.round("score", 5).alias("score"))


@query(UNIT + "SELECT e.vec_id AS id, round(CASE WHEN e.vec_id = 5 THEN 1 ELSE list_dot_product(e.v, q.v) END, 5) AS score FROM e, (SELECT v, label % 2 AS m FROM e WHERE vec_id = 5) q WHERE e.label % 2 = q.m AND (e.vec_id = 5 OR list_dot_product(e.v, q.v) >= 0.2)")
def similar_faces(spark, sf_dir):
    faces = units(spark, sf_dir).select(F.col("photo_id").alias("id"), F.col("vector").alias("embedding"), (F.col("label") % 2).cast("string").alias("embed_model"))
    return vectors.similar_faces(faces, 5, 0.2).select("id", F.round("score", 5).alias("score"))


@query("SELECT (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM documents) AS photos")
def vector_coverage(spark, sf_dir):
    return vectors.coverage(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents"))


@query(UNIT + """, q AS (SELECT vec_id AS query_id, v, label FROM e WHERE vec_id < 20),
w AS (SELECT unnest([0.0, 0.5, 0.8]) AS weight),
b AS (SELECT e.vec_id, e.label, w.weight, [CAST(w.weight AS DOUBLE) * a.x + (1 - CAST(w.weight AS DOUBLE)) * a.y FOR a IN list_transform(range(1, 65), lambda i: {'x': e.v[i], 'y': c.v[i]})] AS m FROM e JOIN e c ON c.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings), w),
n AS (SELECT vec_id, label, weight, CAST([CAST(x / sqrt(list_dot_product(m, m)) AS FLOAT) FOR x IN m] AS DOUBLE[]) AS v FROM b),
r AS (SELECT weight, query_id, n.label = q.label AS relevant, row_number() OVER (PARTITION BY weight, query_id ORDER BY list_dot_product(n.v, q.v) DESC, n.vec_id) AS k FROM n, q)
SELECT CAST(weight AS DOUBLE) AS weight, round(avg(p), 6) AS precision FROM (SELECT weight, query_id, count(*) FILTER (relevant) / 5.0 AS p FROM r WHERE k <= 5 GROUP BY ALL) GROUP BY 1""")
def blend_precision(spark, sf_dir):
    rows = units(spark, sf_dir)
    return blended(rows, rows.count())  # ids run from 0


def blended(rows: DataFrame, n: int) -> DataFrame:
    some = rows.where(F.col("photo_id") < n)
    captions = some.select(((F.col("photo_id") + (n - 1)) % n).alias("photo_id"), F.col("vector").alias("caption"))
    both = some.join(captions, "photo_id")
    out = None
    for w in (0.0, 0.5, 0.8):
        own = both.select("photo_id", "label", F.lit(w).alias("weight"), vectors.blend(F.col("vector"), F.col("caption"), w).alias("v"))
        out = own if out is None else out.unionByName(own)
    asked = rows.where("photo_id < 20").select(F.col("photo_id").alias("query_id"), F.col("vector").alias("q"), F.col("label").alias("want"))
    scored = out.join(F.broadcast(asked), how="cross")  # twenty queries
    return vectors.precision_at(scored.select("weight", "query_id", "photo_id", vectors.dot(F.col("v"), F.col("q")).alias("score"), (F.col("label") == F.col("want")).alias("relevant"))).select("weight", F.round("precision", 6).alias("precision"))


@query(UNIT + "SELECT a.vec_id AS query_id, b.vec_id AS photo_id, round(list_dot_product(a.v, b.v), 5) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) <= 5")
def search_many(spark, sf_dir):
    rows = units(spark, sf_dir)
    asked = [(r["photo_id"], [float(x) for x in r["vector"]]) for r in rows.where("photo_id % 100 = 0").collect()]  # one row in a hundred asks
    return vectors.search_many(rows, asked, 5).select("query_id", "photo_id", F.round("score", 5).alias("score"))


# hybrid search

MERGED = r""", d AS (SELECT doc_id AS id, n_chars, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE lang = 'en'),
x AS (SELECT id, row_number() OVER (ORDER BY n_chars DESC, id DESC) - 1 AS i FROM d WHERE contains(t, ' worthless') LIMIT 200),
zs AS (SELECT photo_id, (s - (SELECT avg(s) FROM s)) / (SELECT stddev_pop(s) FROM s) AS z FROM (SELECT * FROM s)),
near AS (SELECT z.photo_id AS id, z.z, row_number() OVER (ORDER BY z DESC, photo_id) AS k FROM (SELECT * FROM zs ORDER BY z DESC, photo_id LIMIT 120) z WHERE z.z >= 2),
parts AS (SELECT id, 1.0 / (1 + 0.06 * i) AS score, 1 AS reason, i AS seen FROM x UNION ALL
  SELECT id, 0.8 * least(greatest((z - 2) / 3, 0), 1), 2, 1000000 + k FROM near WHERE id IN (SELECT doc_id FROM documents)),
m AS (SELECT id, sum(CAST(score AS DOUBLE)) AS score, bit_or(reason) AS reasons, min(seen) AS seen FROM parts GROUP BY id)
SELECT m.id, round(m.score, 4) AS score, CAST(reasons AS BIGINT) AS reasons FROM m JOIN documents ON doc_id = m.id ORDER BY m.score DESC, n_chars DESC, seen, m.id LIMIT 50"""


def document_catalog(spark, sf_dir) -> Catalog:
    """documents as photos: text as description, size and time from n_chars."""
    docs = table(spark, sf_dir, "documents")
    return Catalog(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("ai_description"), F.col("lang").alias("place_country"), F.timestamp_seconds("n_chars").alias("captured_utc"), F.col("n_chars").alias("file_size")))


@query(HUB + MERGED)
def hybrid_search(spark, sf_dir):
    rows = units(spark, sf_dir)
    bank = [[float(x) for x in r["vector"]] for r in rows.where("photo_id < 32").orderBy("photo_id").collect()]  # 32 phrases
    calibrated = vectors.with_hub(rows, vectors.bank_mean(bank, 64))
    q = Query(text="worthless", country="en", limit=50)
    return search.search(document_catalog(spark, sf_dir), q, calibrated, vector_of(rows, 40)).hits.select("id", F.round("score", 4).alias("score"), F.col("reasons").cast("long").alias("reasons"))


@query(r"""WITH d AS (SELECT doc_id AS id, n_chars, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents),
x AS (SELECT id, row_number() OVER (ORDER BY n_chars DESC, id DESC) - 1 AS i FROM d WHERE contains(t, ' pathetic') ORDER BY i LIMIT 100)
SELECT id, round(0.55 * (5.0 / 13) / (1 + 0.06 * i), 4) AS score, CAST(4 AS BIGINT) AS reasons, '“pahtetic” → pathetic' AS explanation FROM x ORDER BY i LIMIT 60""")
def fuzzy_search(spark, sf_dir):
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, ("pathetic", "sympathetic", "path", "arithmetic")))).alias("term"))
    found = search.search(document_catalog(spark, sf_dir), Query(text="pahtetic", limit=60), vocabulary=words)
    return found.hits.select("id", F.round("score", 4).alias("score"), F.col("reasons").cast("long").alias("reasons"), "explanation")


# grouping

PAIRS = UNIT + ", near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4)\n"


@query(PAIRS + "SELECT a, b FROM near")
def vector_pairs(spark, sf_dir):
    return grouping.vector_pairs(units(spark, sf_dir).withColumnRenamed("photo_id", "seq"), 0.4).select("a", "b")


@query(PAIRS + "SELECT a, b FROM near")
def vector_pairs_in_cells(spark, sf_dir):
    return grouping.vector_pairs(units(spark, sf_dir).withColumnRenamed("photo_id", "seq"), 0.4, cells=12).select("a", "b")


@query(PAIRS.replace("WITH u AS", "WITH RECURSIVE u AS") + """, walk(i, anchors) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = i + 1 AND list_contains(anchors, a)) THEN anchors ELSE list_append(anchors, i + 1) END FROM walk WHERE i + 1 < (SELECT count(*) FROM e)),
k AS (SELECT unnest(anchors) AS a FROM walk WHERE i = (SELECT max(i) FROM walk))
SELECT vec_id AS id, coalesce((SELECT vec_id FROM k WHERE k.a = e.vec_id), (SELECT min(near.a) FROM near JOIN k ON k.a = near.a WHERE near.b = e.vec_id)) AS anchor FROM e""")
def group_first_claim(spark, sf_dir):
    rows = units(spark, sf_dir).select(F.col("photo_id").alias("seq"), "vector")
    return grouping.anchors(rows, grouping.vector_pairs(rows, 0.4)).select(F.col("seq").alias("id"), "anchor")


HASHED = "WITH h AS (SELECT o_orderkey AS id, o_orderdate AS t, substr('0123456789abcdef', CAST(o_custkey % 3 AS INT) + 1, 1) || '00' || right('000000000000' || CAST(o_custkey % 50 AS VARCHAR), 12) || substr('0123456789abcdef', CAST(o_orderkey % 4 AS INT) + 1, 1) AS x FROM orders)\n"
BITS = "bit_count(xor(CAST('0x' || substr(a.x, 1, 8) AS BIGINT), CAST('0x' || substr(b.x, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.x, 9, 8) AS BIGINT), CAST('0x' || substr(b.x, 9, 8) AS BIGINT)))"


def hashes(spark, sf_dir) -> DataFrame:
    digit = lambda c: F.substring(F.lit("0123456789abcdef"), (c + 1).cast("int"), F.lit(1))
    x = F.concat(digit(F.col("o_custkey") % 3), F.lit("00"), F.lpad((F.col("o_custkey") % 50).cast("string"), 12, "0"), digit(F.col("o_orderkey") % 4))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("captured_utc"), x.alias("perceptual_hash"))


@query(HASHED + f", k AS (SELECT DISTINCT x FROM h) SELECT a.x AS a, b.x AS b, CAST({BITS} AS BIGINT) AS bits FROM k a JOIN k b ON a.x < b.x WHERE {BITS} <= 6")
def hash_pairs(spark, sf_dir):
    return kind_pairs(hashes(spark, sf_dir))


def kind_pairs(photos: DataFrame) -> DataFrame:
    return grouping.near_hashes(photos.select(F.col("perceptual_hash").alias("hash"))).select(F.col("x").alias("a"), F.col("y").alias("b"), "bits")


@query(HASHED.replace("WITH h", "WITH RECURSIVE h") + f""", r AS (SELECT id, x, row_number() OVER (ORDER BY t, id) AS i FROM h),
o AS (SELECT x, min_by(id, i) AS id, row_number() OVER (ORDER BY min(i)) AS n FROM r GROUP BY x),
near AS (SELECT a.n AS a, b.n AS b FROM o a JOIN o b ON a.n < b.n WHERE {BITS} <= 6),
walk(i, anchors) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = i + 1 AND list_contains(anchors, a)) THEN anchors ELSE list_append(anchors, i + 1) END FROM walk WHERE i < (SELECT count(*) FROM o)),
k AS (SELECT unnest(anchors) AS a FROM walk WHERE i = (SELECT max(i) FROM walk)),
g AS (SELECT x, coalesce((SELECT a FROM k WHERE k.a = o.n), (SELECT min(near.a) FROM near JOIN k ON k.a = near.a WHERE near.b = o.n)) AS a FROM o)
SELECT r.id, o.id AS anchor_id, count(*) OVER (PARTITION BY g.a) AS size FROM r JOIN g USING (x) JOIN o ON o.n = g.a QUALIFY count(*) OVER (PARTITION BY g.a) > 1""")
def near_duplicate_groups(spark, sf_dir):
    return grouping.near_duplicate_groups(hashes(spark, sf_dir))


@query(UNIT.replace("WITH u", "WITH RECURSIVE u") + """, o AS (SELECT vec_id, v, row_number() OVER (ORDER BY sqrt(vec_id % 37 / 37.0) * 0.7 + (vec_id % 11) / 11.0 * 0.3 DESC, vec_id) AS n FROM e WHERE (vec_id % 11) / 11.0 >= 0.2),
near AS (SELECT a.n AS a, b.n AS b FROM o a JOIN o b ON a.n < b.n WHERE list_dot_product(a.v, b.v) >= 0.35),
walk(i, anchors) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = i + 1 AND list_contains(anchors, a)) THEN anchors ELSE list_append(anchors, i + 1) END FROM walk WHERE i < (SELECT count(*) FROM o)),
k AS (SELECT unnest(anchors) AS a FROM walk WHERE i = (SELECT max(i) FROM walk)),
g AS (SELECT vec_id, coalesce((SELECT a FROM k WHERE k.a = o.n), (SELECT min(near.a) FROM near JOIN k ON k.a = near.a WHERE near.b = o.n)) AS a FROM o)
SELECT g.vec_id AS face_id, o.vec_id AS anchor_id, c.n_faces, c.n_photos FROM g JOIN o ON o.n = g.a JOIN (SELECT a, count(*) AS n_faces, count(DISTINCT vec_id % 100) AS n_photos FROM g GROUP BY a) c ON c.a = g.a""")
def people_groups(spark, sf_dir):
    faces = units(spark, sf_dir).select(
        F.col("photo_id").alias("id"), (F.col("photo_id") % 100).alias("photo_id"), ((F.col("photo_id") % 37) / 37.0).alias("area"),
        ((F.col("photo_id") % 11) / 11.0).alias("confidence"), F.col("vector").alias("embedding"), F.lit("m").alias("embed_model"),
    )
    return grouping.people_groups(faces, 0.35, None, 0.2).select("face_id", "anchor_id", "n_faces", "n_photos")


# boxes

IOU = """greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"""


@query(ctes("segments") + f"""SELECT a.id AS a, b.id AS b, round(i / (a_area + b_area - i), 6) AS iou FROM (SELECT a.id, b.id AS id_1, a.w * a.h AS a_area, b.w * b.h AS b_area, {IOU} AS i FROM segments a JOIN segments b ON a.photo_id = b.photo_id AND a.id < b.id) AS t(id_a, id_b, a_area, b_area, i)
JOIN segments a ON a.id = id_a JOIN segments b ON b.id = id_b WHERE i / (a_area + b_area - i) > 0.2""".replace("SELECT a.id, b.id AS id_1", "SELECT a.id, b.id"))
def iou_pairs(spark, sf_dir):
    segments = fixtures.table(spark, sf_dir, "segments")
    s = segments.select("photo_id", "id", "box")
    both = s.select("photo_id", F.col("id").alias("a"), F.col("box").alias("p")).join(s.select("photo_id", F.col("id").alias("b"), F.col("box").alias("q")), "photo_id").where("a < b")
    return both.select("a", "b", boxes.iou(F.col("p"), F.col("q")).alias("v")).where("v > 0.2").select("a", "b", F.round("v", 6).alias("iou"))


@query(ctes("segments").replace("WITH segments", "WITH RECURSIVE segments") + f""", s AS (SELECT *, row_number() OVER (PARTITION BY photo_id, label ORDER BY confidence DESC, id) AS n FROM segments WHERE confidence > 0.35),
near AS (SELECT a.photo_id, a.label, a.n AS a, b.n AS b FROM s a JOIN s b ON a.photo_id = b.photo_id AND a.label = b.label AND a.n < b.n WHERE {IOU} / (a.w * a.h + b.w * b.h - {IOU}) > 0.45),
m AS (SELECT photo_id, label, max(n) AS most FROM s GROUP BY ALL),
walk(photo_id, label, i, kept) AS (SELECT photo_id, label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM m UNION ALL
  SELECT w.photo_id, w.label, i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.photo_id = w.photo_id AND near.label = w.label AND b = i + 1 AND list_contains(kept, a)) THEN kept ELSE list_append(kept, i + 1) END
  FROM walk w JOIN m ON m.photo_id = w.photo_id AND m.label = w.label WHERE i < most)
SELECT s.id FROM s JOIN m USING (photo_id, label) JOIN walk w ON w.photo_id = s.photo_id AND w.label = s.label AND w.i = m.most WHERE list_contains(w.kept, s.n)""")
def suppress_boxes(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "segments").withColumnRenamed("confidence", "score")
    return grouping.suppress(rows.select("id", "photo_id", "label", "score", "x", "y", "w", "h"), ["photo_id", "label"], 0.35, 0.45).select("id")


@query(ctes("segments").replace("WITH segments", "WITH RECURSIVE segments") + f""", old AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY id) AS n FROM segments WHERE user_label IS NOT NULL),
new AS (SELECT id + 7 AS id, photo_id, x + 0.01 AS x, y, w, h FROM segments WHERE l_keep),
near AS (SELECT a.photo_id, a.n, a.id AS old_id, b.id AS new_id, {IOU} / (a.w * a.h + b.w * b.h - {IOU}) AS s FROM old a JOIN new b ON a.photo_id = b.photo_id WHERE {IOU} / (a.w * a.h + b.w * b.h - {IOU}) > 0.5),
walk(photo_id, n, taken, pairs) AS (SELECT DISTINCT photo_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM near UNION ALL
  SELECT photo_id, n + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, CASE WHEN pick IS NULL THEN pairs ELSE list_append(pairs, n + 1) END
  FROM (SELECT w.*, (SELECT new_id FROM near WHERE near.photo_id = w.photo_id AND near.n = w.n + 1 AND NOT list_contains(w.taken, new_id) ORDER BY s DESC, new_id LIMIT 1) AS pick FROM walk w) WHERE n < (SELECT max(n) FROM near))
SELECT w.photo_id, old.id AS old_id, w.taken[i] AS new_id FROM (SELECT photo_id, taken, pairs, unnest(range(1, len(pairs) + 1)) AS i FROM walk WHERE n = (SELECT max(n) FROM near)) w JOIN old ON old.photo_id = w.photo_id AND old.n = w.pairs[i]""".replace("l_keep", "id % 3 > 0"))
def reapply_labels(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "segments")
    moved = rows.where("id % 3 > 0").selectExpr("id + 7 AS id", "photo_id", "struct(x + 0.01D AS x, y, w, h) AS box")
    return grouping.match_in_turn(rows.where("user_label IS NOT NULL"), moved, edits.KEEP_LABEL)


@query(ctes("faces", "segments") + f"""SELECT b.id AS face_id, a.id AS segment_id, round({IOU} / (b.w * b.h), 6) AS covered FROM segments a JOIN faces b USING (photo_id)
WHERE lower(a.label) = 'person' AND {IOU} / (b.w * b.h) >= 0.75""")
def face_containment(spark, sf_dir):
    s = fixtures.table(spark, sf_dir, "segments").where("lower(label) = 'person'").select("photo_id", F.col("id").alias("segment_id"), F.col("box").alias("s"))
    both = fixtures.table(spark, sf_dir, "faces").select("photo_id", F.col("id").alias("face_id"), F.col("box").alias("f")).join(s, "photo_id")
    return both.select("face_id", "segment_id", boxes.containment(F.col("f"), F.col("s")).alias("c")).where("c >= 0.75").select("face_id", "segment_id", F.round("c", 6).alias("covered"))


@query("SELECT s_suppkey AS id, CAST(s_suppkey % 360 AS BIGINT) AS d, round(degrees(atan2(s_suppkey % 7 - 3.0, s_suppkey % 5 - 2.0)), 6) AS roll FROM supplier")
def face_roll(spark, sf_dir):
    k = F.col("s_suppkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    marks = F.array(point(F.lit(3), F.lit(4)), point(k % 5 + 1, k % 7 + 1))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 360).alias("d"), F.round(boxes.roll(marks), 6).alias("roll"))


# places

POINTS = "p AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 18001 AS DOUBLE) / 100 - 90 AS lat, CAST(c_custkey * 104729 % 36001 AS DOUBLE) / 100 - 180 AS lon FROM customer)"
SPOTS = "s AS (SELECT s_suppkey AS place_id, CAST(s_suppkey * 4421 % 17001 AS DOUBLE) / 100 - 85 AS lat, CAST(s_suppkey * 98893 % 36001 AS DOUBLE) / 100 - 180 AS lon, s_name AS city, 'country ' || CAST(s_nationkey AS VARCHAR) AS country FROM supplier)"
KM = "2 * 6371 * atan2(sqrt(a), sqrt(greatest(1 - a, 0)))"
HAV = "pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)"


def globe(spark, sf_dir):
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919 % 18001).cast("double") / 100 - 90).alias("lat"), ((k * 104729 % 36001).cast("double") / 100 - 180).alias("lon"))
    spots = table(spark, sf_dir, "supplier").select(j.alias("place_id"), ((j * 4421 % 17001).cast("double") / 100 - 85).alias("lat"), ((j * 98893 % 36001).cast("double") / 100 - 180).alias("lon"), F.col("s_name").alias("city"), F.concat(F.lit("country "), F.col("s_nationkey").cast("string")).alias("country"))
    return points, spots


@query(f"""WITH {POINTS}, {SPOTS}, d AS (SELECT p.id, s.place_id, s.city, s.country, {KM} AS km FROM (SELECT p.id, s.place_id, s.city, s.country, {HAV} AS a FROM p, s) AS t(id, place_id, city, country, a), LATERAL (SELECT 1) AS p1(id1), LATERAL (SELECT 1) AS s1(id2))
SELECT id, place_id, round(km, 3) AS km, CASE WHEN km <= 20 THEN city || ', ' || country WHEN km <= 150 THEN 'near ' || city || ', ' || country ELSE country END AS label
FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, place_id) = 1""".replace(", LATERAL (SELECT 1) AS p1(id1), LATERAL (SELECT 1) AS s1(id2)", "").replace("SELECT p.id, s.place_id, s.city, s.country, 2 *", "SELECT id, place_id, city, country, 2 *"))
def nearest_place(spark, sf_dir):
    points, spots = globe(spark, sf_dir)
    out = places.nearest(points, spots).join(spots.select("place_id", "city", "country"), "place_id")
    return out.select("id", "place_id", F.round("km", 3).alias("km"), places.label(F.col("city"), F.col("country"), F.col("km")).alias("label"))


@query(f"WITH {POINTS} SELECT id, printf('%.3f', abs(lat)) || '°' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ' ' || printf('%.3f', abs(lon)) || '°' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS place FROM p")
def coordinates(spark, sf_dir):
    points, _ = globe(spark, sf_dir)
    return points.select("id", places.coordinates(F.col("lat"), F.col("lon")).alias("place"))


# the queue

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
WAITS = "(state = 'pending' OR state = 'failed' AND attempts < 3)"


def queue(spark, sf_dir) -> tuple[DataFrame, object]:
    return fixtures.table(spark, sf_dir, "jobs"), F.expr(NOW)


def jobs_out(df: DataFrame) -> DataFrame:
    return df.select("photo_id", "stage", F.col("ord").cast("long").alias("ord"), "state", "model", F.col("attempts").cast("long").alias("attempts"), "error")


JOBS_OUT = "photo_id, stage, CAST(ord AS BIGINT) AS ord, state, model, CAST(attempts AS BIGINT) AS attempts, error"


@query(ctes("jobs") + f""", people AS (SELECT c_custkey AS id FROM customer), st AS (SELECT * FROM (VALUES (0, 'describe'), (1, 'segment'), (2, 'faces'), (3, 'embed')) AS s(ord, stage))
SELECT {JOBS_OUT} FROM jobs UNION ALL SELECT id, st.stage, CAST(st.ord AS BIGINT), 'pending', NULL, 0, NULL FROM people, st WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.photo_id = id AND j.stage = st.stage)""")
def queue_reconcile(spark, sf_dir):
    all_, now = queue(spark, sf_dir)
    return jobs_out(jobs.reconcile(all_, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), now))


@query(ctes("jobs", "photos", "segments") + f""", m AS (SELECT photo_id, max(model) AS m FROM segments GROUP BY 1),
d AS (SELECT id FROM photos WHERE trim(ai_description) <> '')
SELECT j.photo_id, j.stage, CAST(ord AS BIGINT) AS ord, CASE WHEN hit THEN 'done' ELSE state END AS state, CASE WHEN hit THEN found ELSE model END AS model, CAST(attempts AS BIGINT) AS attempts, error
FROM (SELECT j.*, CASE j.stage WHEN 'describe' THEN CASE WHEN d.id IS NOT NULL THEN 'legacy' END WHEN 'segment' THEN m.m WHEN 'faces' THEN CASE WHEN j.photo_id % 2 = 0 THEN 'sweep' END END AS found,
  state = 'pending' AND attempts = 0 AND found IS NOT NULL AS hit FROM jobs j LEFT JOIN d ON d.id = j.photo_id LEFT JOIN m ON m.photo_id = j.photo_id) j""")
def queue_adopt(spark, sf_dir):
    all_, _ = queue(spark, sf_dir)
    c = fixtures.catalog(spark, sf_dir)
    sweeps = all_.where("photo_id % 2 = 0").select("photo_id", F.lit("sweep").alias("model"))
    return jobs_out(jobs.adopt(all_, c.photos, c.segments, sweeps))


@query(ctes("jobs") + f"SELECT photo_id, stage FROM jobs j WHERE {WAITS} AND NOT EXISTS (SELECT 1 FROM jobs e WHERE e.photo_id = j.photo_id AND e.ord < j.ord AND (e.state = 'running' OR e.state = 'pending' OR e.state = 'failed' AND e.attempts < 3))")
def queue_runnable(spark, sf_dir):
    return jobs.runnable(queue(spark, sf_dir)[0]).select("photo_id", "stage")


@query(ctes("jobs") + f""", first AS (SELECT photo_id, stage FROM jobs j WHERE {WAITS} AND NOT EXISTS (SELECT 1 FROM jobs e WHERE e.photo_id = j.photo_id AND e.ord < j.ord AND (e.state = 'running' OR e.state = 'pending' OR e.state = 'failed' AND e.attempts < 3)) ORDER BY ord, attempts, photo_id LIMIT 12)
SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE WHEN (photo_id, stage) IN (SELECT (photo_id, stage) FROM first) THEN 'running' ELSE state END AS state, model, CAST(attempts AS BIGINT) AS attempts, error FROM jobs""")
def queue_claim(spark, sf_dir):
    all_, now = queue(spark, sf_dir)
    return jobs_out(jobs.claim(all_, now, 12))


@query(ORACLES["queue_claim"])
def queue_claim_versions(spark, sf_dir):
    """The same twelve claimed by two drivers in turn, from a stored queue."""
    all_, now = queue(spark, sf_dir)
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/jobs-{uuid.uuid4().hex}"
    one = JobTable.create(all_, root, 16)
    one.claim(now, 5)
    # a photo with a running stage has no other runnable one, so the rest of the twelve are next
    JobTable(spark, root).claim(now, 7)
    return jobs_out(one.read())


@query(ctes("jobs") + """SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE photo_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE state END AS state,
  CASE photo_id % 4 WHEN 0 THEN 'new' ELSE model END AS model, CAST(CASE photo_id % 4 WHEN 0 THEN 0 WHEN 1 THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts,
  CASE photo_id % 4 WHEN 0 THEN NULL WHEN 3 THEN error ELSE repeat('x', 500) END AS error FROM jobs""")
def queue_outcomes(spark, sf_dir):
    all_, now = queue(spark, sf_dir)
    k = F.col("photo_id") % 4
    done = all_.where(k < 3).select("photo_id", "stage", F.when(k == 0, "done").when(k == 1, "failed").otherwise("skipped").alias("outcome"), F.when(k == 0, "new").alias("model"), F.when(k > 0, F.repeat(F.lit("x"), 600)).alias("error"))
    return jobs_out(jobs.apply_outcomes(all_, done, now))


@query(ctes("jobs") + f"SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE WHEN state = 'running' AND updated_at < {NOW} - INTERVAL 15 MINUTE THEN 'pending' ELSE state END AS state, model, CAST(attempts AS BIGINT) AS attempts, error FROM jobs")
def queue_release(spark, sf_dir):
    return jobs_out(jobs.release_stale(*queue(spark, sf_dir)))


@query(ctes("jobs") + """SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE WHEN r THEN 'pending' ELSE state END AS state, model, CAST(CASE WHEN r THEN 0 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN r THEN NULL ELSE error END AS error
FROM (SELECT *, stage = 'faces' AND model IS DISTINCT FROM 'm1' AS r FROM jobs)""")
def queue_requeue(spark, sf_dir):
    all_, now = queue(spark, sf_dir)
    return jobs_out(jobs.requeue(all_, now, "faces", "m1"))


@query(ctes("jobs") + """SELECT photo_id, stage, CAST(ord AS BIGINT) AS ord, CASE WHEN r THEN 'pending' ELSE state END AS state, model, CAST(CASE WHEN r THEN 0 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN r THEN NULL ELSE error END AS error
FROM (SELECT *, state = 'failed' AND attempts >= 3 AS r FROM jobs)""")
def queue_retry(spark, sf_dir):
    return jobs_out(jobs.retry_stuck(*queue(spark, sf_dir)))


@query(ctes("jobs") + """SELECT s.stage, CAST(s.ord AS BIGINT) AS ord, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state IN ('pending', 'running')) AS pending, count(*) FILTER (state = 'failed' AND attempts < 3) AS failed,
  count(*) FILTER (state = 'failed' AND attempts >= 3) AS stuck, count(*) FILTER (state = 'skipped') AS skipped, count(j.stage) AS total, round(CASE WHEN count(j.stage) = 0 THEN 1 ELSE count(*) FILTER (state IN ('done', 'skipped')) / CAST(count(j.stage) AS DOUBLE) END, 6) AS fraction
FROM (VALUES (0, 'describe'), (1, 'segment'), (2, 'faces'), (3, 'embed')) AS s(ord, stage) LEFT JOIN (SELECT * FROM jobs WHERE stage <> 'embed') j ON j.stage = s.stage GROUP BY s.stage, s.ord""")
def queue_status(spark, sf_dir):
    out = jobs.status(queue(spark, sf_dir)[0].where("stage <> 'embed'"))
    return out.withColumns({"ord": F.col("ord").cast("long"), "fraction": F.round("fraction", 6)})


@query(ctes("jobs") + "SELECT stage, CASE WHEN state = 'failed' AND attempts >= 3 THEN 'skipped' ELSE state END AS state FROM jobs WHERE photo_id = 7")
def queue_explain(spark, sf_dir):
    return jobs.explain(queue(spark, sf_dir)[0], 7).select("stage", "state")


@query("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 375 AS BOOLEAN) AS night, hour(ts) >= 9 AND hour(ts) < 17 AS office FROM events")
def schedule_window(spark, sf_dir):
    night, office = Schedule("window", clock(22, 30), clock(6, 15)), Schedule("window", clock(9), clock(17))
    return table(spark, sf_dir, "events").select("event_id", night.open_at(F.col("ts")).alias("night"), office.open_at(F.col("ts")).alias("office"))


@query(ctes("photos") + "SELECT content_hash FROM photos WHERE id % 3 = 0 AND content_hash IN (SELECT content_hash FROM photos WHERE id % 2 = 0)")
def cache_prune(spark, sf_dir):
    photos = fixtures.table(spark, sf_dir, "photos")
    return store.cache_prune(photos.where("id % 3 = 0").select("content_hash"), photos.where("id % 2 = 0")).select("content_hash")


@query(ctes("photos") + "SELECT content_hash, CASE WHEN id % 3 = 0 THEN file_name END AS payload FROM photos WHERE id % 2 = 0")
def cache_lookup(spark, sf_dir):
    photos = fixtures.table(spark, sf_dir, "photos")
    keyed = lambda df: df.withColumns({"stage": F.lit("embed"), "model": F.lit("m")})
    cache = keyed(photos.where("id % 3 = 0").select("content_hash", F.col("file_name").alias("payload")))
    return store.cache_get(keyed(photos.where("id % 2 = 0").select("content_hash")), cache).select("content_hash", "payload")


# writes

TAG_BASE = ctes("tags") + ", incoming AS (SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'Sunset ' ELSE upper(tag) END AS tag, CAST(photo_id % 3 AS INT) AS source, photo_id % 10 / 10.0 AS confidence FROM tags WHERE photo_id % 4 < 2)\n"
TAG_NEW = ", clean AS (SELECT DISTINCT photo_id, lower(trim(tag)) AS tag, source, confidence FROM incoming)\n"


def incoming_tags(tags: DataFrame) -> DataFrame:
    tag = F.when(F.col("photo_id") % 2 == 0, "Sunset ").otherwise(F.upper("tag"))
    return tags.where("photo_id % 4 < 2").select("photo_id", tag.alias("tag"), ((F.col("photo_id") % 10) / 10.0).alias("confidence"), (F.col("photo_id") % 3).cast("int").alias("source"), F.lit(0).alias("seq"))


def tags_out(df: DataFrame) -> DataFrame:
    return df.select("photo_id", "tag", F.col("source").cast("long").alias("source"), F.col("confidence").cast("double").alias("confidence"))


TAGS_OUT = "photo_id, tag, CAST(source AS BIGINT) AS source, CAST(confidence AS DOUBLE) AS confidence"


def tag_table(spark, sf_dir) -> DataFrame:
    return fixtures.table(spark, sf_dir, "tags").withColumn("confidence", F.col("confidence").cast("double"))


@query(TAG_BASE + TAG_NEW + f"SELECT {TAGS_OUT} FROM tags t WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.photo_id = t.photo_id AND c.tag = t.tag AND c.source = t.source) UNION ALL SELECT {TAGS_OUT} FROM clean")
def upsert_tags(spark, sf_dir):
    tags = tag_table(spark, sf_dir)
    return tags_out(edits.upsert_tags(tags, incoming_tags(tags)))


@query(TAG_BASE + TAG_NEW + f"""SELECT {TAGS_OUT} FROM tags t WHERE NOT (t.source = 1 AND t.photo_id IN (SELECT photo_id FROM clean WHERE source = 1))
AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.photo_id = t.photo_id AND c.tag = t.tag AND c.source = t.source) UNION ALL SELECT {TAGS_OUT} FROM clean""")
def replace_ai_tags(spark, sf_dir):
    tags = tag_table(spark, sf_dir)
    return tags_out(edits.replace_ai_tags(tags, incoming_tags(tags)))


@query(ctes("tags") + f"SELECT {TAGS_OUT} FROM tags WHERE NOT (source = 2 AND tag = 'view')")
def remove_user_tags(spark, sf_dir):
    tags = tag_table(spark, sf_dir)
    return tags_out(edits.remove_user_tags(tags, tags.select("photo_id").distinct().withColumn("tag", F.lit(" View"))))


@query(ctes("segments") + "SELECT photo_id, lower(label) AS tag, max(confidence) AS confidence FROM segments GROUP BY ALL")
def segment_tags(spark, sf_dir):
    return edits.segment_tags(fixtures.table(spark, sf_dir, "segments")).select("photo_id", "tag", "confidence")


@query("""WITH known AS (SELECT sha256(text) AS h FROM documents WHERE doc_id < 100), new AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE doc_id >= 50),
first AS (SELECT h, min(doc_id) AS doc_id FROM new WHERE h NOT IN (SELECT h FROM known) GROUP BY h)
SELECT h AS content_hash, 99 + row_number() OVER (ORDER BY doc_id) AS id FROM first UNION ALL SELECT sha256(text), doc_id FROM documents WHERE doc_id < 100""")
def upsert_photos(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("id"))
    incoming = docs.where("id >= 50").select("content_hash", F.col("id").alias("seq"))
    return edits.upsert_photos(docs.where("id < 100").select("id", "content_hash"), incoming).select("content_hash", "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 = 7 THEN 'new' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 40 <> 9 UNION ALL SELECT o_orderkey + 10000000, 'added', 0 FROM orders WHERE o_orderkey % 100 = 0")
def keyed_changes(spark, sf_dir):
    """Orders as a stored table: rows replaced, added and deleted in the buckets that they are in."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stored = KeyedTable.create(orders, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/orders-{uuid.uuid4().hex}", ["id"], 8)
    stored.upsert(orders.where("id % 40 = 7").withColumn("status", F.lit("new")))
    stored.upsert(orders.where("id % 100 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit("added").alias("status"), F.lit(0.0).alias("price")))
    stored.delete(orders.where("id % 40 = 9"))
    return stored.read()


@query(ctes("photos") + "SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE state END AS BIGINT) AS state, CASE WHEN id % 6 = 0 THEN 'm2' END AS model, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision FROM photos")
def set_state(spark, sf_dir):
    photos = fixtures.table(spark, sf_dir, "photos")
    changes = photos.where("id % 3 = 0").select("id", F.lit(2).alias("state"), F.lit("ok").alias("detail"), F.when(F.col("id") % 6 == 0, "m2").alias("model"))
    return edits.set_state(photos, changes).select("id", F.col("state").cast("long").alias("state"), F.col("model_version").alias("model"), "revision")


@query(ctes("segments") + "SELECT id, CASE WHEN id % 10 = 3 THEN 'Big Car' WHEN id % 10 = 4 THEN NULL ELSE user_label END AS user_label FROM segments")
def correct_labels(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "segments")
    fixes = rows.where("id % 10 IN (3, 4)").select("id", F.when(F.col("id") % 10 == 3, "  Big Car ").otherwise("  ").alias("label"))
    return edits.correct_labels(rows, fixes).select("id", "user_label")


@query(ctes("members", "collections") + """SELECT c.id, c.name, CAST(kind AS BIGINT) AS kind, CASE WHEN kind = 1 THEN -1 ELSE count(m.photo_id) END AS n
FROM collections c LEFT JOIN members m ON m.collection_id = c.id GROUP BY c.id, c.name, kind""")
def list_collections(spark, sf_dir):
    out = edits.list_collections(fixtures.table(spark, sf_dir, "collections"), fixtures.table(spark, sf_dir, "members"))
    return out.select("id", "name", F.col("kind").cast("long").alias("kind"), "n")


@query(ctes("members") + """, incoming AS (SELECT CAST(2 AS BIGINT) AS collection_id, o_orderkey AS photo_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 8 < 5)
SELECT collection_id, photo_id, CAST(position AS BIGINT) AS position FROM members UNION ALL
SELECT collection_id, photo_id, n + (SELECT max(position) + 1 FROM members WHERE collection_id = 2) FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.collection_id = 2 AND m.photo_id = i.photo_id)""")
def album_add(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderkey % 8 < 5").select(F.lit(2).cast("long").alias("collection_id"), F.col("o_orderkey").alias("photo_id"), F.col("o_orderkey").alias("seq"))
    return edits.add_to_collection(fixtures.table(spark, sf_dir, "members"), new).withColumn("position", F.col("position").cast("long"))


@query(ctes("members") + """, moved AS (SELECT photo_id, row_number() OVER (ORDER BY photo_id) - 1 AS n FROM members WHERE collection_id = 1 AND photo_id % 3 = 0)
SELECT collection_id, photo_id FROM members WHERE NOT (collection_id = 1 AND photo_id IN (SELECT photo_id FROM moved))
UNION SELECT CAST(5 AS BIGINT), photo_id FROM moved""")
def album_move(spark, sf_dir):
    members = fixtures.table(spark, sf_dir, "members")
    chosen = members.where("collection_id = 1 AND photo_id % 3 = 0").select("photo_id", F.col("photo_id").alias("seq"))
    return edits.move_between(members, 1, 5, chosen)[0].select("collection_id", "photo_id")


# ingest


@query("SELECT page_id, CASE WHEN url LIKE '%.html%' THEN 'application/octet-stream' ELSE 'image/jpeg' END AS mime, 'thumb/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.jpg' AS key FROM pages")
def mime_and_keys(spark, sf_dir):
    path = F.when(F.col("url").contains(".html"), F.lit("a/b.html")).otherwise(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".JPEG")))
    return table(spark, sf_dir, "pages").select("page_id", ingest.mime_type(path).alias("mime"), store.derivative_key("thumb", F.sha2("html", 256)).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN CASE WHEN p_size % 10 = 0 THEN CAST(p_size // 10 AS VARCHAR) ELSE printf('%.1f', p_size / 10.0) END || 's' ELSE '1/' || CAST(p_size * 50 AS VARCHAR) END AS shown FROM part")
def shutter_format(spark, sf_dir):
    seconds = F.when(F.col("p_size") >= 25, F.col("p_size") / 10.0).otherwise(1 / (F.col("p_size") * 50.0))
    return table(spark, sf_dir, "part").select("p_partkey", text.shutter(seconds.cast("double")).alias("shown"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", store.read_json(F.col("props"), "k long")["k"].alias("k"))
