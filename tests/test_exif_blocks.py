"""EXIF blocks are cut out where files are read, at any place among a JPEG's segments."""

import struct

from pyspark.sql import functions as F

from lumenlake.plans.catalog_more import as_jpeg, gps_tiff, tiff
from lumenlake.sources import ingest


def segments(*parts):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in parts) + b"\xff\xda\x00\x02" + b"\xff\xe1\x00\x08Exif\0\0" * 9


def test_blocks_as_the_parser_finds_them(spark):
    exif = b"Exif\0\0" + gps_tiff(3)
    other = [(0xE0, b"JFIF\0" + b"\0" * 9), (0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>")]
    contents = [
        b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00", b"GIF89a" + b"\0" * 99, tiff(2) + b"\0" * 100_000, as_jpeg(gps_tiff(4)), as_jpeg(gps_tiff(4))[:40], b"\xff\xd8\x00\x00" + exif,
        segments((0xE1, exif)), segments(*other, (0xE1, exif)), segments(*other), segments(*[(0xE2, b"p" * 60_000)] * 255, (0xE1, exif)), None,
    ]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content binary")
    blocks = rows.select("i", ingest.exif_block(F.col("content")).alias("block"))
    got = {r.i: ingest.parse_tiff(bytes(r.block) if r.block is not None else None) for r in blocks.collect()}
    assert got == {i: ingest.parse_exif(c or b"") for i, c in enumerate(contents)}
    assert sum(bool(x) for x in got.values()) >= 5
    assert blocks.where("i > 4").agg(F.max(F.length("block"))).first()[0] <= 65_536


def test_content_stays_out_of_python(spark):
    rows = spark.createDataFrame([("/a/b.jpg", as_jpeg(gps_tiff(1)))], "path string, content binary").selectExpr("path", "timestamp'2024-01-01' AS modificationTime", "length(content) AS length", "content")
    out = ingest.photo_rows(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    python = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "content#" not in python.split("[")[-1] and out.first().latitude is not None
