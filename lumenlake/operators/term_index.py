"""A stored index of a vocabulary for typed words: correction within two edits and suggestion, by lookups.

Two words within d edits (a swap of neighbours is one) become equal when at most d letters are left out of each. So a
term of up to SHORT letters is filed under itself with up to two letters left out, and a typed word asks under its own such
keys. Longer ones would have too many: they are cut into five pieces, of which two edits leave one as it was (an edit
touches two at most, if it is a swap across a border), and filed under number, length and content of each; a typed
word asks with its pieces at shifts of up to two places. Both find all that is near; the edit distance decides.

For suggestions terms are filed under their trigrams, with how many they have. A typed word's shared trigrams are counted
per term, which gives the overlap of the two sets without looking at the term; a term that contains the word has all of the
word's own trigrams (a word of two letters begins one of the term's).

Each table lies sorted by its key, so a lookup reads the row groups of the asked keys.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions.fuzzy import CLOSE, CONTAINS, TRIGRAM_FLOOR, TRIGRAM_WEIGHT, is_close, similarity, trigrams

#: Letters up to which words are filed by deletions; edits at most; pieces of longer words.
SHORT, EDITS, PIECES = 16, 2, 5


def deletions(word: str, most: int = EDITS) -> set[str]:
    """The word with up to so many letters left out."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(min(most, len(word)) + 1) for gone in combinations(range(len(word)), k)}


def pieces(length: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of a word of this length."""
    at = [length * k // PIECES for k in range(PIECES + 1)]
    return list(zip(at, at[1:]))


def filed(term: str) -> set[str]:
    """Keys that a term is found under."""
    word = term.lower()
    out = {f"d{k}" for k in deletions(word)} if len(word) <= SHORT + EDITS else set()
    if len(word) > SHORT - EDITS:
        out |= {f"p{k},{len(word)},{word[a:b]}" for k, (a, b) in enumerate(pieces(len(word)))}
    return out


def asked(query: str) -> set[str]:
    """Keys that a typed word asks under."""
    word = query.lower()
    if len(word) <= SHORT:
        return {f"d{k}" for k in deletions(word)}
    out = set()
    for length in range(len(word) - EDITS, len(word) + EDITS + 1):
        for k, (a, b) in enumerate(pieces(length)):
            for shift in range(-EDITS, EDITS + 1):
                if 0 <= a + shift and b + shift <= len(word):
                    out.add(f"p{k},{length},{word[a + shift : b + shift]}")
    return out


def _keyed(name: str, keys):
    def rows(batches):
        for batch in batches:
            out = ([], [])
            for w in batch.column(0).to_pylist():
                for k in keys(w):
                    out[0].append(k)
                    out[1].append(w)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["key", name])
                    out = ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["key", name])

    return rows


class TermIndex:
    """The index of a vocabulary (column term) under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, vocabulary: DataFrame, root: str) -> TermIndex:
        index = cls(vocabulary.sparkSession, root)
        terms = vocabulary.select("term").where("term IS NOT NULL").distinct()
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{index.root}/terms")
        terms = index._table("terms", "term string")
        keys = terms.mapInArrow(_keyed("term", filed), "key string, term string")
        keys.repartitionByRange("key", "term").sortWithinPartitions("key", "term").write.parquet(f"{index.root}/keys")
        grams = terms.where(F.trim("term") != "").select("term", trigrams(F.col("term")).alias("g")).select(F.explode("g").alias("gram"), "term", F.size("g").alias("n"))
        grams.repartitionByRange("gram", "term").sortWithinPartitions("gram", "term").write.parquet(f"{index.root}/grams")
        return index

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def near(self, words: DataFrame) -> DataFrame:
        """query, term: the terms within the edit budget of each word (query)."""
        keys = words.select("query").where("query IS NOT NULL").distinct().mapInArrow(_keyed("query", asked), "key string, query string")
        found = self._table("keys", "key string, term string").join(keys, "key").select("query", "term").distinct()
        return found.where((F.lower("term") != F.lower("query")) & is_close(F.col("query"), F.col("term")))

    def correct(self, words: DataFrame, limit: int = 3) -> DataFrame:
        """As fuzzy.correct() over the whole vocabulary: query, term, score, rank."""
        pairs = self.near(words.where(F.char_length("query") >= 4))
        scored = pairs.select("query", "term", similarity(F.col("query"), F.col("term")).alias("score"))
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "term"))
        return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)

    def suggest(self, query: str, limit: int = 8) -> DataFrame:
        """As fuzzy.suggest() over the whole vocabulary: term, score."""
        q = query.strip().lower()
        none = self._table("terms", "term string").select("term", F.lit(0.0).alias("score")).limit(0)
        if len(q) < 2:
            return none
        grams = self._table("grams", "gram string, term string, n int")
        own = sorted({f"  {q} "[i : i + 3] for i in range(len(q) + 1)})
        inner = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        shared = grams.where(F.col("gram").isin(own)).groupBy("term", "n").agg(F.count("*").alias("both"))
        like = F.col("both") / (F.col("n") + len(own) - F.col("both"))
        alike = shared.where(like >= TRIGRAM_FLOOR).select("term", (like * TRIGRAM_WEIGHT).alias("score"))
        if inner:
            holding = grams.where(F.col("gram").isin(inner)).groupBy("term").agg(F.count("*").alias("k")).where(F.col("k") == len(inner)).select("term")
        else:
            holding = grams.where(F.col("gram").startswith(q)).select("term").distinct()
        term = F.lower("term")
        begins = F.when(term.startswith(q), 1 - 0.001 * F.least(F.char_length("term"), F.lit(100))).otherwise(F.lit(CONTAINS))
        holding = holding.where(term.contains(q)).select("term", begins.alias("score"))
        one = self.spark.range(1).select(F.lit(q).alias("query"))
        keys = one.mapInArrow(_keyed("query", asked), "key string, query string")
        near = self._table("keys", "key string, term string").join(keys, "key").select("query", "term").distinct()
        close = near.where(is_close(F.col("query"), F.col("term"))).select("term", F.lit(CLOSE).alias("score"))
        # the first rule that holds gives the score: begins, contains, close, alike
        ranked = holding.withColumn("rule", F.lit(0)).unionByName(close.withColumn("rule", F.lit(1))).unionByName(alike.withColumn("rule", F.lit(2)))
        best = ranked.groupBy("term").agg(F.min(F.struct("rule", "score"))["score"].alias("score"))
        return best.orderBy(F.desc("score"), "term").limit(limit)
