"""Texts of several megabytes through every operator and every stage, whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.llm import decontaminate, langid, licences, packing, pii, quality, repeats, simhash, toxicity
from lumenlake.llm.common import read

DRAW = random.Random(11)
WORDS = ["".join(DRAW.choice("abcdefghijklmnoprstuvwyz") for _ in range(DRAW.randint(2, 10))) for _ in range(5000)]
LONG = " ".join(DRAW.choices(WORDS, k=450_000))
MARK = " ".join(DRAW.choices(WORDS, k=90))


@pytest.fixture(scope="module")
def long_docs(spark, sf_dir):
    item = read(spark, sf_dir, "benchmark").first()["text"]
    end = f"{LONG} {MARK} {item} Licensed under the Apache License, Version 2.0. write to a.b@c.example.com"
    rows = [(1, end), (2, LONG), (3, f"{MARK} and little else, but this is another text"), (4, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), end, item


def test_the_end_of_a_long_text_counts(spark, sf_dir, long_docs):
    docs, end, item = long_docs
    labels = read(spark, sf_dir, "labels")
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    pieces = packing.packed(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in pieces) and {r.doc_id for r in pieces} == {1, 2, 3, 4}
    found = by(licences.licences(licences.document_paths(docs), named=False))
    assert found[1]["licence"] == "Apache-2.0" and found[1]["origin"] == "own"
    benchmark = read(spark, sf_dir, "benchmark")
    assert {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()} == {1}
    counted = by(quality.quality(docs))
    assert counted[2].n_words == 450_000 and counted[1].n_words == len(end.split())
    assert len(by(toxicity.toxicity(docs, labels))) == 4
    removed = by(repeats.without_repeats(docs))
    body = LONG.encode()
    assert removed[2].n_removed == len(body) and removed[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    # the passage stands at the end of one text and the start of another
    assert removed[3].n_removed == len(MARK.encode()) + 1 and removed[1].n_removed >= len(body) + len(MARK.encode())
    assert by(langid.languages(docs))[4]["lang_pred"] == "und"
    prints = by(simhash.near_duplicates(docs))
    assert prints[1].component_id == prints[2].component_id == 1 and prints[3].component_id == 3
    private = by(pii.personal_data(docs))
    at = end.index("a.b@c")
    assert private[1].spans == f"email:{at}:{at + len('a.b@c.example.com')}"


def test_stages_take_a_long_text(spark, sf_dir, long_docs):
    import corpus_pipeline

    docs = long_docs[0].where("doc_id <> 1")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {2: LONG, 3: f"{MARK} and little else, but this is another text", 4: None}
