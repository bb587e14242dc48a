"""Driver objects, the command line, and the seam to models."""

from datetime import datetime, time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake import __main__ as cli
from lumenlake import schema
from lumenlake.functions.schedule import Schedule
from lumenlake.operators import jobs, models
from lumenlake.plans import fixtures, search
from lumenlake.plans.query import Catalog, Query
from lumenlake.plans.service import Library, QueueService, Settings
from lumenlake.sources.store import ObjectStore


def test_examine_keeps_failures_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "id long, text string")

    def work(model, text):
        if text == "boom":
            raise ValueError("no")
        return model + text if text else None

    got = {r.id: (r.payload, r.error) for r in models.examine(df, "id", ["text"], work, lambda: "m:").collect()}
    assert got == {1: ("m:a", None), 2: (None, None), 3: (None, "ValueError: no")}


def test_masks(spark):
    planes = np.stack([np.full((8, 8), 1.0), np.tile(np.r_[np.full(4, -1.0), np.full(4, 1.0)], (8, 1))])
    half, share = models.mask(planes, np.array([0.0, 1.0]), (0, 0, 1, 1))
    assert share == pytest.approx(0.5, abs=0.01) and half[:, -1].all() and not half[:, 0].any()
    s = spark.createDataFrame([(7, 1, 0.5, 0.0, 0.5, 1.0, [0.0, 1.0])], "id long, photo_id long, x double, y double, w double, h double, weights array<double>")
    p = spark.createDataFrame([(1, 2, 8, planes.ravel().tolist())], "photo_id long, channels int, side int, plane array<double>")
    assert models.masks(s, p).first().area == pytest.approx(0.5, abs=0.02)


def test_prompt_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("a red car",), ("word " * 200,), (None,)], "t string")
    rows = [r.ids for r in df.select(models.prompt_tokens(F.col("t"), public.path("word_bpe_49k.json")).alias("ids")).collect()]
    assert rows[0][0] == models.START and rows[0][-1] == models.END and len(rows[0]) == 5
    assert len(rows[1]) == models.LONGEST and rows[2] == [models.START, models.END]


def test_library_recalibrates(spark):
    photos = spark.createDataFrame([(i, datetime(2020, 1, 1), f"f{i}.jpg") for i in range(40)], "id long, captured_utc timestamp, file_name string")
    rows = [(i, [1.0 if i == 3 else 0.1 * (i % 5), 1.0]) for i in range(40)]
    lib = Library(Catalog(photos), spark.createDataFrame(rows, "photo_id long, vector array<float>"), bank=[[0.0, 1.0], [1.0, 0.0, 0.0]])
    found = lib.search(Query(text="zzz"), [1.0, 0.0])
    assert found.used_semantic and found.hits.first().id == 3 and found.hits.first().explanation == "similar meaning"
    first = lib.calibrated()
    assert lib.calibrated() is first and "hub" in first.columns
    lib.embeddings = spark.createDataFrame([*rows, (40, [0.5, 1.0])], "photo_id long, vector array<float>")
    assert lib.calibrated().count() == 41
    assert Library(Catalog(photos)).search(Query(text="f3")).hits.first().reasons == search.EXACT


def test_queue_service(spark):
    photos = spark.createDataFrame([(1, "h1", "seen")], "id long, content_hash string, ai_description string")
    none = lambda t: spark.createDataFrame([], schema.schema(t))
    made = lambda rows: rows.select("photo_id", F.lit("x").alias("payload"), F.lit(None).cast("string").alias("error"))
    q = QueueService(Catalog(photos, segments=none("segments")), none("jobs"), none("stage_cache"), none("sweeps"), {"segment": jobs.Handler("s1", made)}, Schedule("window", time(1), time(2)))
    q.start(datetime(2024, 1, 1))
    assert {r.stage: r.done for r in q.status().collect()}["describe"] == 1  # taken over
    assert not q.tick(datetime(2024, 1, 1, 12)) and q.tick(datetime(2024, 1, 1, 1, 30))
    assert {r.stage: (r.done, r.skipped) for r in q.status().collect()} == {"describe": (1, 0), "segment": (1, 0), "faces": (0, 1), "embed": (0, 1)}
    q.retry(datetime(2024, 1, 2))


def test_settings(spark, tmp_path):
    s = Settings(ObjectStore(spark, str(tmp_path)))
    assert s.get("a") is None and s.get("a", "x") == "x"
    s.set("a", "1")
    s.set("b", "2")
    assert (s.get("a"), s.get("b")) == ("1", "2")
    s.store.write("settings.json", b"{broken")
    assert s.get("a") is None


def test_command_line(spark, sf_dir, tmp_path, capsys):
    for name in ("photos", "tags", "segments", "members", "faces", "people", "jobs"):
        df = fixtures.table(spark, sf_dir, name)
        df = df.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embed_model", F.lit("m")) if name == "faces" else df
        df = df.withColumn("perceptual_hash", F.substring("content_hash", 1, 16)) if name == "photos" else df
        df.limit(400 if name == "faces" else 10**9).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "photo_id long, vector array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = {"search": ["boat"], "find": ["baot"], "vsearch": ["1"], "suggest": ["cli"]}
    for verb in (v for v in cli.VERBS if v != "import"):
        cli.main(["--catalog", str(tmp_path), verb, *asked.get(verb, []), "--limit", "5"])
        assert "+--" in capsys.readouterr().out, verb
