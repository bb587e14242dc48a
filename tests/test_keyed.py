"""Stored tables changed by several writers, and the queue on one."""

import threading
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import facets, jobs
from lumenlake.operators.job_table import JobTable
from lumenlake.plans import catalog, fixtures
from lumenlake.sources.keyed import KeyedTable
from lumenlake.sources.store import shared_dir

NOW = datetime(2024, 5, 1, 12)


def fresh(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def at_once(*work):
    failed = []

    def run(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed


def test_a_change_rewrites_its_buckets_only(spark):
    table = KeyedTable.create(spark.range(500).selectExpr("id", "id * 2 AS v"), fresh(spark), ["id"], 32)
    old = table._state(0)["at"]
    assert table.upsert(spark.createDataFrame([(3, -1), (900, -2)], "id long, v long")) and table.rewritten <= 2
    assert table.delete(spark.createDataFrame([(4,)], "id long"))
    new = table._state(table.version())["at"]
    assert sum(old[b] != new.get(b) for b in old) <= 3
    assert rows(table.read()) == sorted([(i, i * 2) for i in range(500) if i not in (3, 4)] + [(3, -1), (900, -2)])
    assert rows(table.read(0)) == [(i, i * 2) for i in range(500)]  # a reader keeps its version
    assert not table.upsert(spark.createDataFrame([], "id long, v long"))
    assert table.vacuum() >= 1 and table.read().count() == 500
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark.range(1), table.root, ["id"], 1)
    with pytest.raises(ValueError, match="does not touch"):
        table.merge(spark.createDataFrame([(3,)], "id long"), lambda old: spark.range(1000).selectExpr("id", "id AS v"))


def test_buckets_may_become_empty(spark):
    table = KeyedTable.create(spark.range(3), fresh(spark), ["id"], 4)
    assert table.delete(spark.range(3)) and table.read().count() == 0
    assert table.upsert(spark.range(5)) and table.read().count() == 5


def test_no_change_is_lost(spark):
    """Writers of the same row and of others, at once: every addition is there."""
    root = fresh(spark)
    KeyedTable.create(spark.range(20).selectExpr("id", "0L AS v"), root, ["id"], 3)

    def add(k):
        table = KeyedTable(spark.newSession(), root)
        keys = table.spark.createDataFrame([(0,), (k,)], "id long")
        table.merge(keys, lambda old: old.withColumn("v", F.col("v") + F.when(F.col("id").isin(0, k), 1).otherwise(0)))

    at_once(*[lambda k=k: add(k) for k in (1, 2, 3, 4)])
    got = dict(rows(KeyedTable(spark, root).read()))
    assert got == {0: 4, 1: 1, 2: 1, 3: 1, 4: 1} | {i: 0 for i in range(5, 20)}


def queue(spark, n=40):
    data = [(i, s, k, "pending", None, 0, None, NOW) for i in range(n) for k, s in enumerate(jobs.STAGES)]
    return spark.createDataFrame(data, "photo_id long, stage string, ord int, state string, model string, attempts int, error string, updated_at timestamp")


def test_two_drivers_never_claim_one_job(spark):
    root, won = fresh(spark), {}
    JobTable.create(queue(spark), root, 4)

    def work(name):
        own = JobTable(spark.newSession(), root)
        won[name] = [(r.photo_id, r.stage) for _ in range(2) for r in own.claim(F.lit(NOW), 8).collect()]

    at_once(*[lambda n=n: work(n) for n in "ab"])
    taken = won["a"] + won["b"]
    assert len(taken) == 32 == len(set(taken))
    running = JobTable(spark, root).read().where("state = 'running'")
    assert {(r.photo_id, r.stage) for r in running.collect()} == set(taken)
    assert {p for p, _ in taken} == set(range(32))  # first in claim order first


def test_the_queue_by_versions(spark):
    table = JobTable.create(queue(spark, 6), fresh(spark), 3)
    first = [(r.photo_id, r.stage) for r in table.claim(F.lit(NOW), 3).collect()]
    assert sorted(first) == [(0, "describe"), (1, "describe"), (2, "describe")]
    told = spark.createDataFrame([(0, "describe", "done", "m", None), (1, "describe", "failed", None, "no")], "photo_id long, stage string, outcome string, model string, error string")
    assert table.finish(told, F.lit(NOW))
    assert table.release_stale(F.lit(NOW + timedelta(hours=1))) and not table.release_stale(F.lit(NOW + timedelta(hours=1)))
    assert not table.retry_stuck(F.lit(NOW))
    assert table.reconcile(spark.range(8), F.lit(NOW)) and table.read().count() == 8 * 4
    state = {(r.photo_id, r.stage): r.state for r in table.read().collect()}
    assert state[0, "describe"] == "done" and state[1, "describe"] == "failed" and state[2, "describe"] == "pending"


def test_facets_of_photos_in_one_scan(spark, sf_dir):
    c = fixtures.catalog(spark, sf_dir)
    plan = facets.photo_facets(c.photos)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan
    out = [tuple(r) for r in facets.all_facets(c.photos, c.tags, c.segments).collect()]
    for name, one in (("folder", facets.folders(c.photos)), ("camera", facets.cameras(c.photos)), ("year", facets.years(c.photos)), ("tag", facets.tag_facet(c.tags)), ("city", facets.cities(c.photos)), ("country", facets.countries(c.photos)), ("object", facets.objects(c.segments))):
        assert [r for r in out if r[0] == name] == [tuple(r) for r in one.collect()]
    assert catalog.QUERIES["facets_all"](spark, sf_dir).columns == ["facet", "value", "n"]
