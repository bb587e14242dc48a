"""Greedy first-claim grouping, near-duplicate pairs, suppression and one-to-one matching.

First-claim grouping in order: an item is an anchor if no earlier anchor is linked to it, and any
other item belongs to its earliest linked anchor (claims.anchors(), over the links of neighbours.py). Where groups are
bounded by what they lie in (the boxes of one image), they are short arrays and a fold over each does it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions.boxes import containment, iou
from lumenlake.operators.claims import anchors
from lumenlake.operators.neighbours import code_pairs, vector_pairs
from lumenlake.sources.store import kept, released

SAME_PHOTO_BITS = 6


def difference_hash(samples: Column) -> Column:
    """16 hex digits from 9 x 8 grey values, row by row: a bit is set where a value exceeds its right
    neighbour, first bit highest."""

    def digits(s):  # a row's samples are made once: s stands for their array wherever a bit asks for two of them
        bit = lambda i: (F.get(s, F.lit(i // 8 * 9 + i % 8)) > F.get(s, F.lit(i // 8 * 9 + i % 8 + 1))).cast("long")
        byte = lambda a: reduce(lambda x, y: x + y, (bit(a + k) * (128 >> k) for k in range(8)))
        return F.when(F.size(s) == 72, F.concat(*[F.lower(F.lpad(F.hex(byte(a)), 2, "0")) for a in range(0, 64, 8)]))

    return F.get(F.transform(F.array(samples), digits), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; anything else is an error."""
    part = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    return F.when(good, bits).otherwise(F.raise_error("a perceptual hash has 16 hex digits").cast("int"))


def code_of(hash_: Column) -> Column:
    """The 64 bits of a hash of 16 hex digits as a long; anything else is an error."""
    part = lambda at: F.conv(F.substring(hash_, at, 8), 16, 10).cast("long")
    bad = F.raise_error("a perceptual hash has 16 hex digits").cast("long")
    return F.when(hash_.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(part(1), 32).bitwiseOR(part(9))).otherwise(bad)


def near_hashes(hashes: DataFrame, bits: int = SAME_PHOTO_BITS) -> DataFrame:
    """x, y, bits: pairs of different hashes (column hash) within so many bits, each once. Copies are one hash."""
    found = code_pairs(hashes.select(code_of(F.col("hash")).alias("code")), bits)
    named = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    x, y = named("x"), named("y")
    return found.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "bits")


def hash_pairs(rows: DataFrame, bits: int = SAME_PHOTO_BITS) -> DataFrame:
    """a, b, bits: pairs of rows (seq, hash) within so many bits, a before b, those of equal hashes too: as many
    as there are. near_hashes() has each pair of hashes once and leaves copies to their hash."""
    rows = rows.select("seq", F.lower("hash").alias("hash"))
    near = near_hashes(rows, bits)
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "bits"))
    both = both.unionByName(rows.select(F.col("hash").alias("x"), F.col("hash").alias("y"), F.lit(0).cast("long").alias("bits")).distinct())
    a = rows.select(F.col("seq").alias("a"), F.col("hash").alias("x"))
    b = rows.select(F.col("seq").alias("b"), F.col("hash").alias("y"))
    return a.join(both, "x").join(b, "y").where("a < b").select("a", "b", F.col("bits").cast("int").alias("bits"))


def near_duplicate_groups(photos: DataFrame, bits: int = SAME_PHOTO_BITS) -> DataFrame:
    """id, anchor_id, size of photos in groups of two or more; the earliest captured claims first, ties
    by id. Only the first photo of each distinct hash takes part in the claiming: later copies see the
    same anchors before it, so they join the same one, or it if it is one."""
    ranked = kept(photos.where("perceptual_hash IS NOT NULL").select("id", F.struct("captured_utc", "id").alias("o"), F.lower("perceptual_hash").alias("hash")), "ranked")
    rows = numbered(ranked)
    kinds = kept(rows.groupBy("hash").agg(F.min("seq").alias("seq")), "kinds")
    near = near_hashes(kinds, bits)
    at = lambda c: kinds.select(F.col("hash").alias(c), F.col("seq").alias(f"{c}_seq"))
    links = near.join(at("x"), "x").join(at("y"), "y").select(F.least("x_seq", "y_seq").alias("a"), F.greatest("x_seq", "y_seq").alias("b"))
    claimed = anchors(kinds, links).join(kinds, "seq").select("hash", "anchor")
    groups = rows.select("seq", "hash").join(claimed, "hash").select("seq", "anchor")
    size = groups.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1")
    named = rows.select("seq", "id")
    first = named.select(F.col("seq").alias("anchor"), F.col("id").alias("anchor_id"))
    return groups.join(size, "anchor").join(first, "anchor").join(named, "seq").select("id", "anchor_id", "size")


def numbered(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Adds a number from 0 in the order of column o: by range partitions, whose counts are added up,
    so that no task sees all rows."""
    dealt = kept(rows.repartitionByRange("o").withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    base = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_base"))  # a row a partition
    own = F.row_number().over(W.partitionBy("_part").orderBy("o"))
    out = dealt.withColumn("_own", own).join(F.broadcast(base), "_part")
    out = kept(out.withColumn(name, F.col("_base") + F.col("_own") - 1).drop("_part", "_base", "_own"), "numbered")
    released(dealt)
    return out


def people_groups(faces: DataFrame, threshold: float, most: int | None = None, least_confidence: float = 0.0, order: str = "photos") -> DataFrame:
    """face_id, anchor_id, n_faces, n_photos, place. Faces in order of prominence (all, or the first `most`
    only); an anchor absorbs later faces of the same embedding model; faces without
    a vector stand alone. Groups in order of photos, prominence and id, or newest, oldest, confidence."""
    rank = F.sqrt("area") * 0.7 + F.col("confidence") * 0.3
    rows = faces.where(F.col("confidence") >= least_confidence).withColumn("rank", rank)
    if most:
        rows = rows.orderBy(F.desc("rank"), "id").limit(most)
    rows = numbered(rows.withColumn("o", F.struct((-F.col("rank")).alias("r"), "id")))
    links = None
    models = [r[0] for r in rows.where("embedding IS NOT NULL").select("embed_model").distinct().collect()]  # a few model names
    for m in models:
        own = vector_pairs(rows.where(F.col("embedding").isNotNull() & F.col("embed_model").eqNullSafe(F.lit(m))).select("seq", F.col("embedding").alias("vector")), threshold)
        links = own if links is None else links.unionByName(own)
    none = rows.select(F.col("seq").alias("a"), F.col("seq").alias("b")).limit(0)
    groups = anchors(rows, links if links is not None else none)
    info = rows.select("seq", "id", "photo_id", "rank", "confidence", *[c for c in ("captured_utc",) if c in rows.columns])
    members = groups.join(info, "seq")
    size = members.groupBy("anchor").agg(F.count("*").alias("n_faces"), F.count_distinct("photo_id").alias("n_photos"))
    first = info.withColumnsRenamed({"seq": "anchor", "id": "anchor_id", "rank": "a_rank", "confidence": "a_confidence"}).drop("photo_id")
    time = lambda sign: F.struct(F.col("captured_utc").isNull() if sign < 0 else F.col("captured_utc").isNotNull(), sign * F.unix_micros("captured_utc"), sign * F.col("anchor_id"))  # noqa: E731  nulls last, or first
    keys = {"photos": lambda: F.struct(-F.col("n_photos"), -F.col("a_rank"), "anchor_id"), "newest": lambda: time(-1), "oldest": lambda: time(1), "confidence": lambda: F.struct(-F.col("a_confidence"), "anchor_id")}[order]()
    placed = numbered(size.join(first, "anchor").withColumn("o", keys)).withColumn("place", (F.col("seq") + 1).cast("int"))
    return members.select("anchor", F.col("id").alias("face_id")).join(placed.select("anchor", "anchor_id", "n_faces", "n_photos", "place"), "anchor").drop("anchor")


def suppress(boxes: DataFrame, keys: list[str], least: float, threshold: float) -> DataFrame:
    """Non-maximum suppression: boxes (id, score, x, y, w, h and keys) above the least score, best
    first, those kept that overlap no better one of their keys by more than the threshold. The boxes
    of one image and class are one short array."""
    good = boxes.where(F.col("score") > least)
    box = F.struct("x", "y", "w", "h").alias("b")
    listed = good.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", box, F.struct(*good.columns).alias("row")))).alias("all"))

    def step(kept_, item):
        over = F.exists(kept_, lambda k: iou(k["b"], item["b"]) > threshold)
        return F.when(over, kept_).otherwise(F.array_append(kept_, item))

    kind = listed.schema["all"].dataType.simpleString()
    return listed.select(F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("k")).select("k.row.*")


def suppress_faces(boxes: DataFrame) -> DataFrame:
    """A detector's faces: score at least 0.8, overlap over 0.3 suppressed, then of a size and on the
    image, largest first (column place within the image)."""
    out = suppress(boxes.where("score >= 0.8"), ["photo_id"], 0.0, 0.3)
    on = (F.col("x") >= -0.05) & (F.col("y") >= -0.05) & (F.col("x") + F.col("w") <= 1.05) & (F.col("y") + F.col("h") <= 1.05)
    out = out.where((F.least("w", "h") >= 0.018) & on)
    return out.withColumn("place", F.row_number().over(W.partitionBy("photo_id").orderBy((F.col("w") * F.col("h")).desc(), "id")))


def take_greedily(pairs: DataFrame, key: str, order: list[Column], left: str, right: str) -> DataFrame:
    """key, left, right: for each key the pairs in order, those whose left and right are both untaken.
    The pairs of a key (one photo's boxes) are one short array."""
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    listed = pairs.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("all"))
    none = F.array().cast("array<struct<l:bigint,r:bigint>>")

    def step(taken, p):
        used = F.exists(taken, lambda t: (t["l"] == p["l"]) | (t["r"] == p["r"]))
        return F.when(used, taken).otherwise(F.array_append(taken, F.struct(p["l"].alias("l"), p["r"].alias("r"))))

    out = listed.select(key, F.explode(F.aggregate("all", none, step)).alias("t"))
    return out.select(key, F.col("t.l").alias(left), F.col("t.r").alias(right))


def match_in_turn(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """photo_id, old_id, new_id: for each old box in order of id, the best new box of its photo not yet
    taken whose overlap is over the least."""
    pairs = old.select("photo_id", F.col("id").alias("old_id"), F.col("box").alias("ob")).join(new.select("photo_id", F.col("id").alias("new_id"), F.col("box").alias("nb")), "photo_id")
    near = pairs.select("photo_id", "old_id", "new_id", iou(F.col("ob"), F.col("nb")).alias("s")).where(F.col("s") > least)
    return take_greedily(near, "photo_id", [F.col("old_id"), -F.col("s"), F.col("new_id")], "old_id", "new_id")


def person_segments(faces: DataFrame, segments: DataFrame, least: float = 0.75) -> DataFrame:
    """photo_id, face_id, segment_id: named faces and uncorrected person segments, best containment
    first, smaller segment first, then ids; each used once."""
    people = segments.where((F.lower("label") == "person") & F.col("user_label").isNull())
    named = faces.where("person_id IS NOT NULL")
    pairs = named.select("photo_id", F.col("id").alias("face_id"), F.col("box").alias("fb")).join(people.select("photo_id", F.col("id").alias("segment_id"), F.col("box").alias("sb"), F.col("area").alias("sa")), "photo_id")
    near = pairs.select("photo_id", "face_id", "segment_id", "sa", containment(F.col("fb"), F.col("sb")).alias("s")).where(F.col("s") >= least)
    return take_greedily(near, "photo_id", [-F.col("s"), F.col("sa"), F.col("face_id"), F.col("segment_id")], "face_id", "segment_id")
