"""The stored vector index against a full scan."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import vectors
from lumenlake.operators.vector_index import VectorIndex
from lumenlake.plans.query import Catalog, Query
from lumenlake.plans.search import Calibrated, search
from lumenlake.sources.store import shared_dir


def clustered(n, width, clusters, seed, spread=0.15):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(clusters, width))[draw.integers(0, clusters, n)] + spread * draw.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "photo_id long, vector array<float>")


@pytest.fixture(scope="module")
def v():
    return clustered(3000, 24, 30, 5)


@pytest.fixture(scope="module")
def index(spark, v):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    out = VectorIndex.build(frame(spark, v[:2000]), root, 40)
    out.append(frame(spark, v[2000:], 2000))
    return VectorIndex(spark, root)  # opened anew


def rows(df):
    return [(r.photo_id, round(r.score, 5), round(r.z, 4)) for r in df.collect()]


@pytest.mark.parametrize("k", [1, 25, 400])
def test_same_as_a_full_scan(spark, v, index, k):
    whole = frame(spark, v)
    for q in (v[7], v[2500], -v[3]):
        q = [float(x) for x in q]
        assert rows(index.search(q, k)) == rows(vectors.search(whole, q, k))
        mean = vectors.bank_mean([[float(x) for x in r] for r in v[:20]], 24)
        assert rows(index.search(q, k, mean)) == rows(vectors.search(vectors.with_hub(whole, mean), q, k))


def test_files_are_pruned(spark, v, index):
    """A query near a cluster reads few cells, and still every row that counts."""
    found = index.search([float(x) for x in v[11]], 10)
    assert found.count() == 10 and 0 < index.read < 0.25


def test_a_lost_append_is_not_seen(spark, v, index):
    before = rows(index.search([float(x) for x in v[0]], 5))
    frame(spark, v[:3], 9000).withColumn("angle", F.lit(0.0)).withColumn("cell", F.lit(0).cast("long")).write.partitionBy("cell").parquet(f"{index.root}/rows/batch=blost")
    assert rows(VectorIndex(spark, index.root).search([float(x) for x in v[0]], 5)) == before


def test_ties_and_other_widths(spark):
    same = np.tile(np.eye(8, dtype=np.float32)[:2], (20, 1))
    index = VectorIndex.build(frame(spark, same), f"{shared_dir(spark)}/{uuid.uuid4().hex}", 5)
    assert [r[0] for r in rows(index.search([1.0] + [0.0] * 7, 7))] == [0, 2, 4, 6, 8, 10, 12]
    assert rows(index.search([1.0] * 3, 7)) == []
    assert index.exists() and not VectorIndex(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}").exists()
    assert not os.path.exists("rows")


def test_hybrid_search_over_the_index(spark, v, index):
    photos = spark.range(3000).select("id", F.lit("a boat").alias("ai_caption"), F.timestamp_seconds("id").alias("captured_utc"))
    mean = vectors.bank_mean([[float(x) for x in r] for r in v[:20]], 24)
    q = [float(x) for x in v[40]]
    a = search(Catalog(photos), Query(text="boat", limit=30), Calibrated(index, mean), q)
    b = search(Catalog(photos), Query(text="boat", limit=30), vectors.with_hub(frame(spark, v), mean), q)
    assert a.used_semantic and [tuple(r)[:3] for r in a.hits.select("id", "reasons", F.round("score", 6)).collect()] == [tuple(r)[:3] for r in b.hits.select("id", "reasons", F.round("score", 6)).collect()]
