"""The stored vocabulary index against comparing with every term, and edit distances by definition."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import fuzzy
from lumenlake.operators import term_index
from lumenlake.operators.term_index import TermIndex
from lumenlake.plans.query import Catalog, Query
from lumenlake.plans.search import search
from lumenlake.sources.store import shared_dir


def edited(draw, word, n):
    for _ in range(n):
        at, c = draw.randrange(len(word) + 1), draw.choice("abcdé")
        kind = draw.randrange(4)
        word = word[:at] + c + word[at:] if kind == 0 else word[:at] + word[at + 1 :] if kind == 1 else word[:at] + c + word[at + 1 :] if kind == 2 else word[:at] + word[at : at + 2][::-1] + word[at + 2 :]
    return word


@pytest.fixture(scope="module")
def words():
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdé") for _ in range(draw.choice([1, 2, 3, 4, 6, 8, 11, 14, 15, 17, 19, 25, 40]))) for _ in range(160)]
    return sorted({*base, *(edited(draw, w, draw.randint(1, 3)) for w in base for _ in range(3)), "Red Boat", " padded ", "x", ""}), base, draw


@pytest.fixture(scope="module")
def index(spark, words):
    return TermIndex.build(spark.createDataFrame([(w,) for w in words[0] + words[0][:9]] + [(None,)], "term string"), f"{shared_dir(spark)}/{uuid.uuid4().hex}")


def osa(a, b):
    """Edits with swaps of neighbours, no part edited twice."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances(words):
    draw = random.Random(5)
    pairs = [(w, edited(draw, w, draw.randint(0, 4))) for w in words[1]] + [("", "ab"), ("ab", ""), ("", "")]
    got = fuzzy.distances([a for a, _ in pairs], [b for _, b in pairs], np.full(len(pairs), 99))
    assert got.tolist() == [osa(a, b) for a, b in pairs]


def test_near_words_share_a_key(words):
    draw = random.Random(6)
    for w in words[1]:
        for n in (1, 2):
            typed = edited(draw, w, n)
            if len(typed) >= 4 and osa(w, typed) <= 2:
                assert term_index.filed(w) & term_index.asked(typed), (w, typed)
    assert len(term_index.filed("a" * 400 + "b" * 400)) == term_index.PIECES  # long words have few keys


def test_corrections(spark, words, index):
    terms, base, draw = words
    typed = sorted({edited(draw, w, draw.randint(0, 3)) for w in base} | {"RED BAOT", "abc", "zzzzzzzz"})
    asked = spark.createDataFrame([(w,) for w in typed], "query string")
    got = sorted(map(tuple, index.correct(asked, 5).collect()))
    every = spark.createDataFrame([(w,) for w in terms], "term string")
    assert got and got == sorted(map(tuple, fuzzy.correct(asked, every, 5).collect()))


def test_suggestions(spark, words, index):
    every = spark.createDataFrame([(w,) for w in words[0]], "term string")
    for q in ("ab", "é", "abc", "red", "boat ", "baot", *words[1][::23], words[1][5][1:], "a" * 30, "a  b"):
        assert [tuple(r) for r in index.suggest(q, 12).collect()] == [tuple(r) for r in fuzzy.suggest(q, every, 12).collect()], q


def test_very_long_pairs_fit(spark):
    """Pairs of 2,000 letters beside short ones: the edit tables are rows, not squares."""
    long = "ab" * 1000
    rows = spark.createDataFrame([(long, long[:500] + "ba" + long[502:]), ("wigdet", "widget"), ("abcdefgh", "abdcefhg")] * 50, "q string, t string")
    assert rows.where(fuzzy.is_close(F.col("q"), F.col("t"))).count() == 150


def test_search_through_the_index(spark):
    index = TermIndex.build(spark.createDataFrame([("boat",), ("coat",), ("bottle",)], "term string"), f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    photos = spark.range(9).select("id", F.lit("a red boat").alias("ai_caption"), F.timestamp_seconds("id").alias("captured_utc"))
    found = search(Catalog(photos), Query(text="baot", limit=5), vocabulary=index)
    assert found.corrections == [("baot", "boat")] and found.hits.count() == 5
