"""Hand-computed values and invariants of the catalogue's operators."""

import random
import struct
from datetime import datetime, time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.functions import boxes, fuzzy, text
from lumenlake.functions.schedule import Schedule
from lumenlake.operators import edits, facets, fulltext, grouping, jobs, places, vectors
from lumenlake.plans import fixtures, search
from lumenlake.plans.query import Catalog, Order, Query, count, evaluate_smart_folder, filtered, run
from lumenlake.sources import folders, ingest, store
from lumenlake.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def catalog(spark, sf_dir):
    return fixtures.catalog(spark, sf_dir)


# the query record


@pytest.mark.parametrize("order", list(Order))
def test_pages_join_to_the_whole(catalog, order):
    whole = [r.id for r in run(catalog, Query(order=order, min_rating=4, limit=400)).collect()]
    pages = [r.id for k in range(0, 400, 100) for r in run(catalog, Query(order=order, min_rating=4, limit=100, offset=k)).collect()]
    assert pages == whole and len(set(whole)) == len(whole)


def test_filters_exclude_and_facets_lead_to_their_counts(catalog):
    total = catalog.photos.count()
    for q in (Query(camera="nikon"), Query(bounds=(0, 0, 50, 50)), Query(object="boat"), Query(tags=("view",)), Query(favourites_only=True)):
        assert 0 < count(catalog, q) < total
    for r in facets.cities(catalog.photos).limit(3).collect():
        assert count(catalog, Query(city=r.value)) == r.n
    assert count(catalog, Query(favourites_only=False)) == total
    assert count(catalog, Query(), capped=True) == min(total, 5000)


def test_query_round_trip_and_smart_folders(catalog):
    q = Query(text="boat", from_utc=datetime(1996, 1, 1), bounds=(-1.0, 2.0, 3.0, 4.0), tags=("a", "b"), order=Order.RATING, limit=7)
    assert Query.from_json(q.to_json()) == q
    assert Query.from_json("{bad") is None and Query.from_json(None) is None
    stored = Query(min_rating=5, limit=30).to_json()
    assert [r.id for r in evaluate_smart_folder(catalog, stored).collect()] == [r.id for r in run(catalog, Query(min_rating=5, limit=30)).collect()]
    assert evaluate_smart_folder(catalog, "nonsense").count() == 0


@pytest.mark.parametrize("typed", ['"', "*", "(", "a AND", "^x", "a-b", "  ", "NEAR(", "é'"])
def test_any_text_is_safe(catalog, typed):
    assert filtered(catalog, Query(text=typed)).count() >= 0


# words


def test_full_text_rules(spark):
    docs = spark.createDataFrame([(1, "Crème brûlée at Ely", "red car"), (2, "a(b)c", "x"), (3, "car", "Elysium"), (4, None, "")], "id long, title string, tags string")
    hit = lambda q: sorted(r.id for r in fulltext.matches(docs, q, ("title", "tags")).collect())
    assert hit("creme") == [1] and hit("car ely") == [1, 3] and hit("ely car") == [1]
    assert hit("ely brulee") == [1] and hit("a(b)c") == [2] and hit('"b c"') == [2] and hit("c b a") == [2]
    assert hit("&") == [] and hit("car &") == [] and hit("") == []
    assert fulltext.compile_query("don't stop") == [fulltext.Term(("don", "t"), False), fulltext.Term(("stop",), True)]
    index = fulltext.index(docs, ("title", "tags"))
    for q in ("creme", "car ely", "a(b)c", "ely", "&"):
        assert sorted(r.id for r in fulltext.lookup(index, q).collect()) == hit(q)
    changed = docs.withColumn("title", F.when(F.col("id") == 3, "boat").otherwise(F.col("title")))
    again = fulltext.reindex(index, changed.select("id", "title", "tags", *[F.lit("").alias(c) for c in ("caption", "description", "file_name", "camera")]), spark.createDataFrame([(3,)], "id long"))
    assert [r.id for r in fulltext.lookup(again, "boat").collect()] == [3]


@pytest.mark.parametrize(("a", "b", "most", "want"), [("car", "CAR", 3, 0), ("ca", "abc", 3, 3), ("wigdet", "widget", 3, 1), ("a", "abcdef", 3, 4), ("", "ab", 3, 2), ("kitten", "sitting", 3, 3), ("abcdef", "ghijkl", 2, 3)])
def test_distance(a, b, most, want):
    assert fuzzy.distance(a, b, most) == want


def test_distance_bounds(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words for b in words[:20]], "a string, b string").withColumn("near", fuzzy.is_close(F.col("a"), F.col("b")))
    for r in df.collect():
        budget = 1 if len(r.a) <= 7 else 2
        assert r.near == (fuzzy.distance(r.a, r.b, budget) <= budget), (r.a, r.b)
    assert value(spark, fuzzy.is_close(F.lit("cat"), F.lit("car"))) is False


def test_text_expressions(spark):
    assert value(spark, text.tidy(F.lit("A dog.. It runs. And then<|im_end|>"))) == "A dog.. It runs."
    assert value(spark, text.tidy(F.lit("  <|endoftext|> "))) is None and value(spark, text.tidy(F.lit("end..."))) == "end."
    assert value(spark, text.until_repeat(F.lit("There is a box. A cat sits here. there is a box. More."))) == "There is a box. A cat sits here."
    assert value(spark, text.until_repeat(F.lit("Yes. Yes. No end"))) == "Yes. Yes. No end"
    assert value(spark, text.sentences(F.lit("Short. This one is long enough! x\nAnother long sentence"))) == ["This one is long enough", "Another long sentence"]
    assert [value(spark, text.shutter(F.lit(x).cast("double"))) for x in (2.0, 1.5, 0.004, 0.0, None)] == ["2s", "1.5s", "1/250", None, None]
    assert value(spark, text.clean(F.lit(" a\0b "))) == "ab" and value(spark, text.clean(F.lit("  "))) is None


# vectors and search


def test_vectors(spark):
    assert value(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>"))) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="length"):
        value(spark, vectors.unit(F.array(F.lit(0.0)).cast("array<float>")))
    assert value(spark, vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert value(spark, vectors.from_text(vectors.to_text(F.array(F.lit(0.25), F.lit(-1.5)).cast("array<float>")))) == [0.25, -1.5]
    assert value(spark, vectors.from_text(F.lit("1 x"))) == []
    assert value(spark, vectors.blend(F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), F.lit(None).cast("array<float>"))) == [1.0, 0.0]
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [1.0, 0.0, 0.0])], "photo_id long, vector array<float>")
    assert [r.photo_id for r in vectors.search(vectors.one_width(rows), [1.0, 0.0], 2, 0.0).collect()] == [1, 3]
    assert vectors.search(rows, [1.0]).count() == 0 and vectors.similar_to(rows, 99).count() == 0
    assert [r.photo_id for r in vectors.similar_to(vectors.one_width(rows), 1).collect()] == [3, 2]
    means = vectors.mean_unit(spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 2.0])], "k long, v array<double>"), "k", "v").first()
    assert means.vector == pytest.approx([0.5**0.5] * 2)
    assert len(vectors.REFERENCE_PHRASES) == 32


def test_hybrid_without_text_and_strict_recheck(spark, catalog):
    found = search.search(catalog, Query(min_rating=5, limit=20))
    assert found.total == 20 and {r.reasons for r in found.hits.collect()} == {search.FACET}
    near = spark.createDataFrame([(r.id, [1.0 if i == 0 else 0.01 * i, 1.0]) for i, r in enumerate(catalog.photos.orderBy("id").limit(50).collect())], "photo_id long, vector array<float>")
    q = Query(text="nothing", city="no such city", limit=5)
    assert search.semantic_hits(catalog, q, near, [1.0, 0.0]).count() > 0
    assert search.semantic_hits(catalog, q, near, [1.0, 0.0], strict=True).count() == 0


# grouping and boxes


def brute_anchors(n, links):
    anchors, out = [], {}
    for i in range(n):
        own = [a for a in anchors if (a, i) in links]
        out[i] = own[0] if own else i
        anchors += [] if own else [i]
    return out


def test_first_claim_is_greedy(spark):
    draw = random.Random(4)
    for n, density in ((25, 0.2), (25, 0.05), (12, 0.6)):
        links = {(a, b) for a in range(n) for b in range(a + 1, n) if draw.random() < density}
        got = grouping.anchors(spark.range(n).select(F.col("id").alias("seq")), spark.createDataFrame(sorted(links), "a long, b long"))
        assert {r.seq: r.anchor for r in got.collect()} == brute_anchors(n, links)


def test_hashes(spark):
    assert value(spark, grouping.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    with pytest.raises(Exception, match="16 hex"):
        value(spark, grouping.hamming(F.lit("xyz"), F.lit("0000000000000001")))
    samples = [9 - i % 9 for i in range(72)]
    assert value(spark, grouping.difference_hash(F.array(*map(F.lit, samples)))) == "ffffffffffffffff"
    assert value(spark, grouping.difference_hash(F.array(*map(F.lit, samples[::-1])))) == "0000000000000000"
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 8))) for b in base]
    rows = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "seq long, hash string")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (values[i] ^ values[j]).bit_count() <= 6}
    assert {(r.a, r.b) for r in grouping.hash_pairs(rows).collect()} == want


def box(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", (x, y, w, h))])


def test_boxes(spark):
    assert value(spark, boxes.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    assert value(spark, boxes.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0 and value(spark, boxes.iou(box(0, 0, 1, 1), box(2, 2, 1, 1))) == 0
    assert value(spark, boxes.containment(box(0, 0, 1, 1), box(0, 0, 0.5, 1))) == 0.5
    points = boxes.parse_landmarks(F.lit("0.1,0.2, 0.3,0.4"))
    assert value(spark, boxes.format_landmarks(points)) == "0.1,0.2,0.3,0.4"
    assert [value(spark, F.size(boxes.parse_landmarks(F.lit(t)))) for t in ("0.1", "0.1,0.2,0.3", "a,b", "")] == [0, 0, 0, 0]
    assert value(spark, boxes.roll(boxes.parse_landmarks(F.lit("0,0,1,1")))) == pytest.approx(45)
    assert value(spark, boxes.label_hue(F.lit("cat"))) == int(fnv("cat") * boxes.TAU % 360)
    square = boxes.parse_landmarks(F.lit("0,0,1,0,1,1,0,1"))
    turned = boxes.parse_landmarks(F.lit("2,3,2,5,0,5,0,3"))
    fit = value(spark, boxes.similarity_fit(square, turned))
    assert (fit.a, fit.b, fit.tx, fit.ty) == pytest.approx((0, 2, 2, 3))
    assert value(spark, boxes.letterbox_inverse(*map(F.lit, (110.0, 10.0, 50.0, 50.0, 100.0, 0.0, 0.5, 400.0, 300.0)))).asDict() == {"x": 20.0, "y": 20.0, "w": 100.0, "h": 100.0}
    assert value(spark, boxes.letterbox_inverse(*map(F.lit, (0.0, 10.0, 50.0, 50.0, 100.0, 0.0, 0.5, 400.0, 300.0)))) is None
    assert value(spark, boxes.crop_square(box(0.4, 0.4, 0.1, 0.1), F.lit(100.0), F.lit(100.0))).side == pytest.approx(16)
    assert value(spark, boxes.crop_square(box(0.4, 0.4, 0.01, 0.01), F.lit(100.0), F.lit(100.0))) is None
    assert value(spark, boxes.hsl_to_rgb(F.lit(0))).asDict() == {"r": 239, "g": 57, "b": 57}


def fnv(label):
    h = 2166136261
    for c in label:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_faces_and_segments_are_matched_once(spark):
    f = spark.createDataFrame([(1, 10, 5), (2, 10, 6)], "id long, photo_id long, person_id long").select("*", box(0.1, 0.1, 0.1, 0.1).alias("box"))
    s = spark.createDataFrame([(7, 10, "Person", 0.5), (8, 10, "person", 0.2), (9, 10, "dog", 0.1)], "id long, photo_id long, label string, area double").select("*", F.lit(None).cast("string").alias("user_label"), box(0.05, 0.05, 0.3, 0.3).alias("box"))
    assert sorted((r.face_id, r.segment_id) for r in grouping.person_segments(f, s).collect()) == [(1, 8), (2, 7)]


def test_corrections_survive_new_segments(spark):
    kind = schema.schema("segments")
    old = spark.createDataFrame([(1, 5, "dog", 0.9, (0.1, 0.1, 0.2, 0.2), 0.04, 0.5, None, "m", "Rex"), (2, 6, "cat", 0.9, (0.1, 0.1, 0.2, 0.2), 0.04, 0.5, None, "m", None)], kind)
    new = spark.createDataFrame([(3, 5, "dog", 0.9, (0.11, 0.1, 0.2, 0.2), 0.04, 0.5, None, "n", None), (4, 5, "dog", 0.9, (0.8, 0.8, 0.1, 0.1), 0.01, 0.5, None, "n", None)], kind)
    assert sorted((r.id, r.user_label) for r in edits.replace_segments(old, new).collect()) == [(2, None), (3, "Rex"), (4, None)]


# places


def test_nearest_equals_all_pairs(spark):
    draw = random.Random(6)
    spots = [(i, draw.uniform(-89, 89), draw.uniform(-180, 180)) for i in range(300)] + [(400, 10.0, 20.0), (399, 10.0, 20.0)]
    points = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(400)] + [(500, 90.0, 0.0), (501, 0.0, 180.0), (502, 91.0, 0.0), (503, float("nan"), 0.0), (504, None, 1.0), (505, -89.9, -179.9), (506, 10.0, 20.0), (507, 89.99, 1.0), (508, -90.0, 0.0)]
    s, p = spark.createDataFrame(spots, "place_id long, lat double, lon double"), spark.createDataFrame(points, "id long, lat double, lon double")
    got = {r.id: (r.place_id, r.km) for r in places.nearest(p, s).collect()}
    want = {i: found[0] for i, found in got.items()}
    assert got == {r.id: (r.place_id, r.km) for r in places.nearest(p, s, 40).collect()}  # places in parts
    for i, lat, lon in points:
        if i not in (502, 503, 504):
            a = places.axes(np.array(lat), np.array(lon)) - places.axes(np.array([x[1] for x in spots]), np.array([x[2] for x in spots]))
            far = 2 * places.RADIUS * np.arcsin(np.sqrt((a * a).sum(axis=1)) / 2)
            assert got[i][1] == pytest.approx(far.min(), abs=1e-6) and got[i][0] == min(s_[0] for s_, d in zip(spots, far) if d <= far.min() + 1e-9)
    assert places.nearest(p, s.limit(0)).where("place_id IS NULL").count() == len(points)
    assert want[502] is None and want[503] is None and want[504] is None and want[500] is not None
    assert value(spark, places.haversine(*map(F.lit, (52.0, 0.0, 52.0, 1.0)))) == pytest.approx(68.46, abs=0.05)
    assert [value(spark, places.label(F.lit("Ely"), F.lit("UK"), F.lit(km))) for km in (20, 150, 151)] == ["Ely, UK", "near Ely, UK", "UK"]


# the queue


WINDOWS = [(22, 6, 23, True), (22, 6, 5, True), (22, 6, 6, False), (22, 6, 12, False), (9, 17, 9, True), (9, 17, 17, False), (9, 17, 3, False), (8, 8, 3, True), (0, 23, 22, True)]


@pytest.mark.parametrize(("a", "b", "hour", "want"), WINDOWS)
def test_schedule(spark, a, b, hour, want):
    s = Schedule("window", time(a), time(b))
    now = datetime(2024, 5, 1, hour)
    assert s.is_open(now) is want and value(spark, s.open_at(F.lit(now))) is want
    assert (s.next_opening(now) is None) is want
    assert Schedule.from_text(s.to_text()) == s


def test_schedule_text():
    assert Schedule.from_text(None) == Schedule() == Schedule.from_text("x;y")
    assert Schedule.from_text("off;25:00;06:30;-3") == Schedule("off", time(22), time(6, 30), 20)


def test_queue_runs_stage_by_stage(spark):
    photos = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "id long, content_hash string")
    now = F.lit(datetime(2024, 1, 1))
    all_ = jobs.reconcile(spark.createDataFrame([], schema.schema("jobs")), photos, now)
    assert all_.count() == 12 and jobs.reconcile(all_, photos, now).count() == 12
    assert {r.stage for r in jobs.runnable(all_).collect()} == {"describe"}
    cache = spark.createDataFrame([("h1", "describe", "v1", "old", datetime(2023, 1, 1))], schema.schema("stage_cache"))

    def work(rows):
        bad = F.when(F.col("content_hash") == "h3", "broken")
        return rows.select("photo_id", F.when(bad.isNull(), F.concat(F.lit("text "), "content_hash")).alias("payload"), bad.alias("error"))

    after, cached, results = jobs.run_stage(all_, photos, cache, "describe", jobs.Handler("v1", work), now)
    assert {r.photo_id: r.outcome for r in results.collect()} == {1: "reused", 2: "computed", 3: "failed"}
    assert cached.count() == 2
    state = {(r.photo_id, r.stage): (r.state, r.attempts) for r in after.collect()}
    assert state[1, "describe"] == ("done", 0) and state[3, "describe"] == ("failed", 1)
    done, _ = jobs.drain(after, photos, cached, {s: jobs.Handler("v1", work) for s in jobs.STAGES[:3]}, now)
    state = {(r.photo_id, r.stage): (r.state, r.attempts) for r in done.collect()}
    assert state[3, "describe"] == ("failed", 3) and state[1, "embed"][0] == "skipped" and jobs.runnable(done).count() == 0
    assert {r.stage: r.fraction for r in jobs.status(done).collect()}["embed"] == 1.0
    assert jobs.explain(done, 3).first().state == "skipped"
    assert value(spark, jobs.known_stage(F.lit("x"))) is None and value(spark, jobs.known_state(F.lit("x"))) == "pending"


# writes


def test_collections(spark):
    none = spark.createDataFrame([], schema.schema("collections"))
    one = edits.create_collection(none, " Trips ")
    two = edits.create_collection(one, "Best", Query(min_rating=5).to_json())
    assert [(r.id, r.name, r.kind, r.position) for r in two.orderBy("id").collect()] == [(1, "Trips", 0, 0), (2, "Best", 1, 1)]
    with pytest.raises(ValueError, match="there is"):
        edits.create_collection(two, "TRIPS")
    with pytest.raises(ValueError, match="needs"):
        edits.create_collection(two, "  ")
    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], schema.schema("members"))
    more = edits.add_to_collection(members, spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "collection_id long, photo_id long, seq int"))
    assert sorted((r.photo_id, r.position) for r in more.collect()) == [(10, 0), (11, 1), (12, 3)]
    moved, n = edits.move_between(more, 1, 2, spark.createDataFrame([(11, 0), (99, 1)], "photo_id long, seq int"))
    assert n == 2 and sorted((r.collection_id, r.photo_id) for r in moved.collect()) == [(1, 10), (1, 12), (2, 11), (2, 99)]
    assert edits.move_between(more, 1, 1, members)[1] == 0
    assert [r.collection_id for r in edits.albums_of(moved, 11).collect()] == [2]


def test_people(spark):
    people = spark.createDataFrame([(4, "Ann", None)], schema.schema("people"))
    faces = spark.createDataFrame([(1, None), (2, 4)], "id long, person_id long")
    now, ids = F.lit(datetime(2024, 1, 1)), spark.createDataFrame([(1,)], "id long")
    p, f = edits.name_faces(people, faces, ids, " ANN ", now)
    assert p.count() == 1 and {r.id: r.person_id for r in f.collect()} == {1: 4, 2: 4}
    p, f = edits.name_faces(people, faces, ids, "Bob", now)
    assert {r.id: r.name for r in p.collect()} == {4: "Ann", 5: "Bob"} and {r.id: r.person_id for r in f.collect()} == {1: 5, 2: 4}
    assert edits.rename_person(p, 5, "ann")[1] is False and edits.rename_person(p, 5, "Cy")[1] is True
    _, f = edits.name_faces(p, f, ids, "", now)
    assert {r.id: r.person_id for r in f.collect()} == {1: None, 2: 4}
    p, f = edits.delete_person(p, f, 4)
    assert {r.id: r.person_id for r in f.collect()} == {1: None, 2: None}


def test_user_tags(spark):
    tags = spark.createDataFrame([(1, "dog", 0.5, schema.AI)], "photo_id long, tag string, confidence double, source int")
    more = edits.add_user_tags(tags, spark.createDataFrame([(1, " Dog ", 0), (1, "x" * 80, 1), (1, " ", 2)], "photo_id long, tag string, seq int"))
    assert sorted((r.tag, r.source) for r in more.collect()) == [("dog", schema.AI), ("dog", schema.USER), ("x" * 60, schema.USER)]
    left = edits.remove_user_tags(more, spark.createDataFrame([(1, "DOG")], "photo_id long, tag string"))
    assert sorted((r.tag[:3], r.source) for r in left.collect()) == [("dog", schema.AI), ("xxx", schema.USER)]


# sources


def jpeg(make=b"Canon\0", rating=4):
    entries = [(0x10F, 2, len(make), 200), (0x112, 3, 1, 6), (0x132, 2, 20, 220), (0x4746, 3, 1, rating)]
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    body = body.ljust(200, b"\0") + make.ljust(20, b"\0") + b"2020:02:03 04:05:06\0"
    exif = b"Exif\0\0" + body
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda" + b"\0" * 64


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(jpeg())
    (tmp_path / "sub" / "b.jpg").write_bytes(jpeg())
    (tmp_path / "c.png").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"no photo")
    files, missing = ingest.discover(spark, [str(tmp_path), str(tmp_path / "gone")])
    assert missing == [str(tmp_path / "gone")] and files.count() == 3
    rows = ingest.photo_rows(files, datetime(2024, 1, 1))
    by = {r.file_name: r for r in rows.collect()}
    a, c = by["a.JPG"], by["c.png"]
    assert (a.camera_make, a.orientation, a.rating, a.is_favourite, a.capture_exact, a.mime_type) == ("Canon", 6, 4, False, True, "image/jpeg")
    assert a.captured_utc == datetime(2020, 2, 3, 4, 5, 6) and a.thumbnail_key.startswith(f"thumb/{a.content_hash[:2]}/")
    assert (c.state, c.perceptual_hash, c.thumbnail_key, c.capture_exact) == (schema.UNREADABLE, "0" * 16, None, False)
    photos = spark.createDataFrame([], "id long, content_hash string, state int")
    assert {r.outcome: r.n for r in ingest.outcomes(photos, rows).collect()} == {"imported": 1, "duplicate": 1, "failed": 1}
    after = edits.upsert_photos(photos, rows.select("content_hash", "state", "seq"))
    assert sorted(r.id for r in after.collect()) == [1, 2]
    assert {r.outcome: r.n for r in ingest.outcomes(after, rows).collect()} == {"duplicate": 3}
    assert edits.upsert_photos(after, rows.select("content_hash", "state", "seq")).count() == 2


def test_exif_fields(spark):
    assert ingest.parse_exif(b"") == {} and ingest.parse_exif(b"\xff\xd8\xff\xe1\x00") == {}
    assert value(spark, ingest.keywords(F.lit("Sea; sky,SEA|x| long " + "y" * 70))) == ["sea", "sky"]
    exif = F.struct(F.lit(0).alias("rating"), F.lit(50).alias("rating_percent"))
    assert value(spark, ingest.rating(exif)) == 2
    times = F.struct(F.lit("1700:01:01 00:00:00").alias("original"), F.lit("2021:05:06 07:08:09").alias("digitized"), F.lit(None).cast("string").alias("plain"))
    assert value(spark, ingest.capture_time(times, F.lit(datetime(2024, 1, 1)))) == datetime(2021, 5, 6, 7, 8, 9)


def test_object_store(spark, tmp_path):
    s = store.ObjectStore(spark, str(tmp_path))
    assert s.read("a/b.json") is None and s.stat("a/b.json") is None
    assert s.write("a/b.json", b'{"K": 1}') and s.read("a/b.json") == b'{"K": 1}'
    assert not s.write("a/b.json", b"x", only_new=True) and s.write("a/b.json", b"y") and s.read("a/b.json") == b"y"
    assert s.write("ab.json", b"1", only_new=True) and s.stat("ab.json")[0] == 1
    assert sorted(r.key for r in s.listing("a").collect()) == ["a/b.json", "ab.json"]
    s.delete("ab.json")
    s.delete("ab.json")
    assert [r.key for r in s.listing().collect()] == ["a/b.json"]
    for key in ("/x", "../x", "a/../../x", "", "c:/x"):
        with pytest.raises(ValueError, match="key"):
            s.read(key)
    assert value(spark, store.read_json(F.lit("{bad"), "k long")) is None and value(spark, store.read_json(F.lit('{"k": 3}'), "k long")).k == 3


def test_source_folders():
    assert folders.add(["/p/a"], "/p/a/b/") == ["/p/a"] and folders.add(["/p/a", "/q"], "/p") == ["/q", "/p"]
    assert folders.add(["/p/a"], "/p/ab") == ["/p/a", "/p/ab"] and folders.add([], "  ") == []
    assert folders.covers("C:\\Photos", "c:\\photos\\x") and not folders.covers("C:\\Photos", "C:\\PhotosOld")
    assert folders.remove(["/P/a", "/q"], "/p/A/") == ["/q"] and folders.parse(folders.to_text(["/a", "/b"]) + "\n\n") == ["/a", "/b"]


def test_places_table(spark):
    cities = spark.createDataFrame([("Ely", 52.4, 0.26, "GB"), ("Nowhere", 0.0, 0.0, "XX")], "name string, lat double, lon double, code string")
    countries = spark.createDataFrame([("GB", "United Kingdom")], "code string, country string")
    assert ingest.build_places(cities, countries, 1).count() == 1
    with pytest.raises(ValueError, match="fewer"):
        ingest.build_places(cities, countries)


# streaming


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit("same").alias("content_hash"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.counts_by_window(stream(), "1 hour", "40 days").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.table("hours").count() == want.count() and spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
    q = live.first_of_each(stream(), within="60 days").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1
    (tmp_path / "photos").mkdir()
    (tmp_path / "photos" / "a.jpg").write_bytes(jpeg())
    seen = []
    live.watch_folder(spark, str(tmp_path / "photos"), str(tmp_path / "cp"), lambda df, n: seen.append([r.camera_make for r in df.collect()])).awaitTermination()
    assert seen == [["Canon"]]
