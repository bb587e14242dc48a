"""From image files to photo rows: discovery, content hash, EXIF, derived fields, outcomes.

Files come from Spark's binaryFile source; hash and fields are expressions, and only the EXIF block (cut out by
an expression) is read in Python, by Arrow batches. Pixels are not decoded here: a decoder is a function given by the
caller from (photo path, content) to width, height and a perceptual hash; without one the header
decides whether a file is readable.
"""

from __future__ import annotations


import struct
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.text import clean
from lumenlake.schema import FILE, PENDING, UNREADABLE
from lumenlake.sources.store import derivative_key

#: File types by extension.
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".jpe": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".tif": "image/tiff",
    ".tiff": "image/tiff", ".bmp": "image/bmp", ".gif": "image/gif", ".heic": "image/heic", ".heif": "image/heif",
}
OLDEST_YEAR = 1826
#: Segments of a JPEG that are walked; all but its image data, of which there are a few hundred at most (255 of a colour profile).
SEGMENTS = 1024
ZERO_HASH = "0" * 16
EXIF = "struct<make:string,model:string,lens:string,iso:int,f_number:double,exposure_seconds:double,focal_length_mm:double,latitude:double,longitude:double,altitude:double,original:string,digitized:string,plain:string,orientation:int,keywords:string,rating:int,rating_percent:int>"
_FIELDS = [f.split(":")[0] for f in EXIF[7:-1].split(",")]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("application/octet-stream"))


def discover(spark: SparkSession, folders: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Files of the known types under the folders, and the folders that are missing (no error)."""
    found, missing = None, []
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            missing.append(folder)
            continue
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(extension(F.col("path")).isin(list(MIME)))
        found = own if found is None else found.unionByName(own)
    return found, missing


def _rational(num: int, den: int) -> float | None:
    return num / den if den else None


def parse_exif(data: bytes) -> dict:
    """The tags that the catalogue keeps, from the EXIF block of a JPEG or a TIFF; {} if there is none."""
    try:
        tiff = data if data[:4] in (b"II*\0", b"MM\0*") else _jpeg_exif(data)
        return _read_tiff(tiff) if tiff else {}
    except (struct.error, IndexError, ValueError, OverflowError):
        return {}


def _jpeg_exif(data: bytes) -> bytes | None:
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def parse_tiff(block: bytes | None) -> dict:
    """The tags in an EXIF block; {} if there are none."""
    try:
        return _read_tiff(block) if block else {}
    except (struct.error, IndexError, ValueError, OverflowError):
        return {}


def _read_tiff(t: bytes) -> dict:
    e = "<" if t[:2] == b"II" else ">"
    # sizes and formats of the TIFF field types that EXIF uses
    kinds = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii")}

    def directory(at: int) -> dict:
        out = {}
        for i in range(struct.unpack_from(e + "H", t, at)[0]):
            tag, kind, n = struct.unpack_from(e + "HHI", t, at + 2 + 12 * i)
            if kind not in kinds or n > 65_536:
                continue
            size, form = kinds[kind]
            place = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(e + "I", t, at + 10 + 12 * i)[0]
            if kind == 2:
                out[tag] = t[place : place + n].split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                out[tag] = [_rational(*struct.unpack_from(e + form, t, place + 8 * k)) for k in range(n)]
            else:
                out[tag] = list(struct.unpack_from(e + form * n, t, place))
        return out

    main = directory(struct.unpack_from(e + "I", t, 4)[0])
    exif = directory(main[0x8769][0]) if 0x8769 in main else {}
    gps = directory(main[0x8825][0]) if 0x8825 in main else {}
    first = lambda d, k: (d.get(k) or [None])[0]

    def degrees(tag: int, ref: str) -> float | None:
        parts = gps.get(tag) or []
        if len(parts) < 3 or None in parts:
            return None
        value = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -value if str(gps.get(tag - 1, "")).upper().startswith(ref) else value

    lat, lon, alt = degrees(2, "S"), degrees(4, "W"), first(gps, 6)
    if not lat and not lon:  # zero is what cameras write for no fix
        lat = lon = None
    keywords = bytes(main.get(0x9C9E) or []).decode("utf-16-le", "ignore").strip("\0")
    return {
        "make": main.get(0x10F), "model": main.get(0x110), "lens": exif.get(0xA434), "iso": first(exif, 0x8827), "f_number": first(exif, 0x829D), "exposure_seconds": first(exif, 0x829A),
        "focal_length_mm": first(exif, 0x920A), "latitude": lat, "longitude": lon, "altitude": -alt if alt is not None and first(gps, 5) == 1 else alt, "original": exif.get(0x9003),
        "digitized": exif.get(0x9004), "plain": main.get(0x132), "orientation": first(main, 0x112), "keywords": keywords or None, "rating": first(main, 0x4746), "rating_percent": first(main, 0x4749),
    }


def exif_block(content: Column) -> Column:
    """The bytes that EXIF lies in: a JPEG's APP1 segment, which the walk from segment to segment finds in place, or a whole
    TIFF, whose directories lie anywhere; null for other files. So of a JPEG 64 KB at most go on, not the image."""
    part = lambda at, n: F.substring(content, at, F.lit(n) if isinstance(n, int) else n)  # noqa: E731  places from 1
    number = lambda at: F.conv(F.hex(part(at, 2)), 16, 10).cast("int")
    state = lambda at, size, done: F.struct(at.cast("int").alias("at"), size.cast("int").alias("size"), done.alias("done"))

    def step(s, _):
        at = s["at"]
        mark, size = F.hex(part(at, 2)), number(at + 2)
        ends = (at + 3 > F.length(content)) | ~mark.startswith("FF") | (mark == "FFDA")
        mine = (mark == "FFE1") & (F.hex(part(at + 4, 6)) == "457869660000")
        return F.when(s["done"], s).when(ends, state(F.lit(0), F.lit(0), F.lit(True))).when(mine, state(at + 10, size - 8, F.lit(True))).otherwise(state(at + 2 + size, F.lit(0), F.lit(False)))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state(F.lit(3), F.lit(0), F.lit(False)), step)
    head = F.hex(F.substring(content, 1, 4))
    jpeg = F.transform(F.array(walk), lambda w: F.when(w["done"] & (w["at"] > 0), F.substring(content, w["at"], w["size"])))[0]
    return F.when(head.isin("49492A00", "4D4D002A"), content).when(head.startswith("FFD8"), jpeg)


def with_exif(files: DataFrame, block: str = "block") -> DataFrame:
    """Adds exif (null fields where there is none) from a column that exif_block() made, in its place."""

    def read(batches):
        kind = pa.struct([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split(":")[1]]) for n, f in zip(_FIELDS, EXIF[7:-1].split(","))])
        for batch in batches:
            at = batch.schema.get_field_index(block)
            found = [parse_tiff(x.as_py()) for x in batch.column(at)]  # one file at a time
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array([{n: f.get(n) for n in _FIELDS} for f in found], kind)], [*(batch.schema.names[i] for i in rest), "exif"])

    from pyspark.sql.types import StructType

    return files.mapInArrow(read, StructType([*(f for f in files.schema.fields if f.name != block), *StructType.fromDDL(f"exif {EXIF}").fields]))


def capture_time(exif: Column, now: Column) -> Column:
    """The first plausible of the three times, taken as UTC."""
    times = [F.try_to_timestamp(exif[k], F.lit("yyyy:MM:dd HH:mm:ss")) for k in ("original", "digitized", "plain")]
    good = [F.when((F.year(t) >= OLDEST_YEAR) & (t <= now + F.expr("INTERVAL 2 DAYS")), t) for t in times]
    return F.coalesce(*good)


def keywords(text: Column) -> Column:
    """Parts between ; , | of 2 to 63 characters, each once ignoring case."""
    parts = F.transform(F.split(text, "[;,|]"), lambda s: F.lower(F.trim(s)))
    return F.array_distinct(F.filter(parts, lambda s: F.char_length(s).between(2, 63)))


def rating(exif: Column) -> Column:
    """Stars as they are, up to 5; else from percent, half to even."""
    percent = F.bround(exif["rating_percent"] / 20).cast("int")
    return F.least(F.when(exif["rating"] > 0, exif["rating"]).when(exif["rating_percent"] > 0, percent).otherwise(0), F.lit(5))


def readable(content: Column) -> Column:
    """Whether the header is that of a known image format and the file is not just a header."""
    head = F.hex(F.substring(content, 1, 12))
    known = head.rlike("^(FFD8FF|89504E470D0A1A0A|52494646.{8}57454250|49492A00|4D4D002A|424D|474946383[79]61|.{8}66747970)")
    return known & (F.length(content) > 64)


def photo_rows(files: DataFrame, now: datetime | None = None) -> DataFrame:
    """Rows for upsert_photos, with seq, and tags (an array) from the file's keywords. A file that
    cannot be read is a row too: state unreadable, a hash of zeros, no keys."""
    at = F.lit(now or datetime.now(timezone.utc).replace(tzinfo=None))
    # hash, header and EXIF block are taken of the content where it is read; the content itself goes no further
    content = F.col("content")
    rows = with_exif(files.select("path", "modificationTime", "length", F.sha2(content, 256).alias("content_hash"), readable(content).alias("ok"), exif_block(content).alias("block")))
    exif, ok, hashed = F.col("exif"), F.col("ok"), F.col("content_hash")
    taken = capture_time(exif, at)
    stars = rating(exif)
    name = F.regexp_extract("path", r"[^/\\]+$", 0)
    place = F.regexp_extract("path", r"^(.*)[/\\][^/\\]+$", 1)
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.xxhash64("path").alias("seq"), hashed, F.when(ok, null("string")).otherwise(ZERO_HASH).alias("perceptual_hash"), F.col("path").alias("original_path"),
        name.alias("file_name"), place.alias("source_folder"), mime_type(F.col("path")).alias("mime_type"), F.col("length").alias("file_size"),
        F.date_trunc("millisecond", F.coalesce(taken, F.col("modificationTime"))).alias("captured_utc"), F.col("modificationTime").alias("file_modified_utc"), at.alias("indexed_utc"),
        taken.isNotNull().alias("capture_exact"), clean(exif["make"]).alias("camera_make"), clean(exif["model"]).alias("camera_model"), clean(exif["lens"]).alias("lens"),
        exif["iso"].alias("iso"), exif["f_number"].alias("f_number"), exif["exposure_seconds"].alias("exposure_seconds"), exif["focal_length_mm"].alias("focal_length_mm"),
        exif["latitude"].alias("latitude"), exif["longitude"].alias("longitude"), exif["altitude"].alias("altitude"),
        F.when(exif["orientation"].between(1, 8), exif["orientation"]).otherwise(1).alias("orientation"), F.when(ok, derivative_key("thumb", hashed)).alias("thumbnail_key"),
        F.when(ok, derivative_key("proxy", hashed)).alias("proxy_key"), F.when(ok, PENDING).otherwise(UNREADABLE).alias("state"), F.when(ok, null("string")).otherwise("cannot be decoded").alias("state_detail"),
        stars.alias("rating"), (stars >= 5).alias("is_favourite"), F.coalesce(keywords(exif["keywords"]), F.array().cast("array<string>")).alias("keywords"),
    )


def file_tags(photos: DataFrame, rows: DataFrame) -> DataFrame:
    """photo_id, tag, confidence, source, seq for upsert_tags."""
    each = rows.select("content_hash", F.explode("keywords").alias("tag"), "seq")
    return each.join(photos.select(F.col("id").alias("photo_id"), "content_hash"), "content_hash").select("photo_id", "tag", F.lit(1.0).alias("confidence"), F.lit(FILE).alias("source"), "seq")


def outcomes(photos: DataFrame, rows: DataFrame) -> DataFrame:
    """outcome (imported, duplicate, failed) and n of a batch against the photos known before it."""
    known = photos.select("content_hash", F.lit(True).alias("_known")).distinct()
    firsts = rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("state").alias("state")).join(known, "content_hash", "left")
    new = F.when(F.col("_known"), 0).otherwise(1)
    split = firsts.select(F.explode(F.array(
        F.struct(F.when(F.col("state") == UNREADABLE, "failed").otherwise("imported").alias("outcome"), new.cast("long").alias("n")),
        F.struct(F.lit("duplicate").alias("outcome"), (F.col("n") - new).alias("n")),
    )).alias("x")).select("x.*")
    return split.groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0")


def analysis_source(photos: DataFrame, derivatives: DataFrame) -> DataFrame:
    """id, path: the proxy where it is among the derivatives (key), else the original."""
    there = derivatives.select(F.col("key").alias("proxy_key"), F.lit(True).alias("_there"))
    return photos.join(there, "proxy_key", "left").select("id", F.when(F.col("_there"), F.col("proxy_key")).otherwise(F.col("original_path")).alias("path"))


def read_attribution(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated attribution list with # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{c} string" for c in columns))


def build_places(cities: DataFrame, countries: DataFrame, least: int = 1000) -> DataFrame:
    """Places from a gazetteer's city (name, lat, lon, code) and country (code, country) tables. Cities of
    unknown countries drop out; fewer places than the least is an error."""
    out = cities.join(countries, "code").select(F.col("name").alias("city"), "country", "code", F.col("lat").cast("float"), F.col("lon").cast("float"))
    if out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} places")
    return out


