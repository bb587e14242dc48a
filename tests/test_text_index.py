"""The stored text index against the search of all text."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import fulltext, text_index
from lumenlake.operators.text_index import TextIndex, index_photos
from lumenlake.plans import fixtures, query
from lumenlake.plans.query import Catalog, Query
from lumenlake.session import table
from lumenlake.sources.store import ObjectStore, shared_dir

ASKED = ["the", "the of", "licen", '"and(thea)" tion*', "license,version.2", "los ENTRÉ", "zzzznothing", " - ", "a b c d", "don't"]


def fresh(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def shaped(docs):
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), *[F.lit("").alias(c) for c in fulltext.COLUMNS if c != "description"])


def same(index, docs, asked=ASKED):
    for q in asked:
        found = [r.id for r in index.lookup(q).collect()]
        assert len(found) == len(set(found))
        assert sorted(found) == sorted(r.id for r in fulltext.matches(docs, q).collect()), q


def test_updates_and_merges(spark, sf_dir):
    """Batches, changed documents and deleted ones, through several merges; each state answers as a search of all text."""
    docs = shaped(table(spark, sf_dir, "documents").where("doc_id < 120")).cache()
    index = TextIndex(spark, fresh(spark))
    same(index, docs.limit(0), ["the"])
    for k in range(6):
        index.update(docs.where(F.col("id") % 6 == k))
    assert len(index.segments()) < 6
    same(index, docs)
    changed = docs.where("id % 10 = 0").withColumn("description", F.concat(F.lit("brandnew word and thea "), F.col("description"))).withColumn("title", F.lit("the Title"))
    index.update(changed, docs.where("id % 10 = 1").select("id"))
    now = docs.where("id % 10 > 1").unionByName(changed).cache()
    same(TextIndex(spark, index.root), now, [*ASKED, "brandnew word", "title", "brandnew title"])
    docs.unpersist()
    now.unpersist()


def test_a_lookup_reads_ranges_of_tokens(spark, sf_dir):
    index = TextIndex(spark, fresh(spark))
    index.update(shaped(table(spark, sf_dir, "documents")))
    plan = index.lookup("license vers")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(token,license)") == 1 and "GreaterThanOrEqual(token,vers)" in plan and "pos:" not in plan


def test_writers_do_not_lose_segments(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(text_index, "FAN", 99)
    root, docs = fresh(spark), shaped(table(spark, sf_dir, "documents").where("doc_id < 40"))
    writers = [threading.Thread(target=lambda k=k: TextIndex(spark, root).update(docs.where(F.col("id") % 4 == k))) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(TextIndex(spark, root).segments()) == 4
    same(TextIndex(spark, root), docs, ["the"])


def test_one_of_many_creates_a_file(spark):
    store, won = ObjectStore(spark, fresh(spark)), []
    for i in range(3):
        asked = [threading.Thread(target=lambda j=j, i=i: won.append((i, j, store.write(f"m/{i}.json", b"%d" % j, only_new=True)))) for j in range(6)]
        for t in asked:
            t.start()
        for t in asked:
            t.join()
    assert sorted(i for i, _, ok in won if ok) == [0, 1, 2]
    for i, j, ok in won:
        assert not ok or store.read(f"m/{i}.json") == b"%d" % j


@pytest.mark.parametrize("text", ["red BOAT, numero 1", "sunset over", "title", "canon eos"])
def test_browsing_through_the_index(spark, sf_dir, text):
    photos, tags = fixtures.table(spark, sf_dir, "photos"), fixtures.table(spark, sf_dir, "tags")
    index = index_photos(photos, tags, fresh(spark))
    q = Query(text=text, limit=5000)
    with_index = query.run(Catalog(photos, tags, text_index=index), q)
    assert [r.id for r in with_index.collect()] == [r.id for r in query.run(Catalog(photos, tags), q).collect()]
    assert query.count(Catalog(photos, tags, text_index=index), q) == with_index.count()
