"""Edit distance with adjacent swaps, trigram overlap, correction and suggestion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Weights and bounds of suggestions.
CONTAINS, CLOSE, TRIGRAM_FLOOR, TRIGRAM_WEIGHT = 0.80, 0.70, 0.42, 0.65
#: Cells of a row of the edit tables that are held together.
CELLS = 1 << 18
SEPARATORS = r"[-_ .,/\\()]+"


def distances(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Edits between the words of each pair (insert, delete, replace, swap of neighbours; no part edited
    twice), ignoring case, for all pairs at once: cell (i, j) of the table is a vector over the pairs.
    most + 1 where the lengths differ by more than most, or where every cell of some row exceeds it. A last
    cell beyond most in a row that does not is returned as it is."""
    a, b = [x.lower() for x in left], [x.lower() for x in right]
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if not len(a):
        return m
    letters = lambda words, size: np.array([x.ljust(size, "\0") for x in words], f"<U{size}").view(np.uint32).reshape(len(words), size)
    rows, columns = max(int(m.max()), 1), max(int(n.max()), 1)
    x, y = letters(a, rows).T, letters(b, columns).T
    outside = np.arange(columns + 1)[:, None] > n  # columns that a pair's shorter word does not have
    far = np.iinfo(np.int32).max
    start = np.repeat(np.arange(columns + 1, dtype=np.int32)[:, None], len(a), axis=1)
    above, top = start, start  # the rows one and two above
    whole = start[n, np.arange(len(a))].astype(np.int64)
    beyond = np.zeros(len(a), bool)
    for i in range(1, rows + 1):
        row = np.empty_like(start)
        row[0] = i
        for j in range(1, columns + 1):
            best = np.minimum(above[j - 1] + (x[i - 1] != y[j - 1]), 1 + np.minimum(above[j], row[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                best = np.where(swapped, np.minimum(best, top[j - 2] + 1), best)
            row[j] = best
        beyond |= (i <= m) & (np.where(outside, far, row).min(axis=0) > most)
        done = np.flatnonzero(m == i)
        whole[done] = row[n[done], done]
        above, top = row, above
    cut = ((m > 0) & (n > 0) & beyond) | (np.abs(m - n) > most)
    return np.where(np.array([p == q for p, q in zip(a, b)]), 0, np.where(cut, most + 1, whole))


def distance(a: str, b: str, most: int = 3) -> int:
    """distances() of one pair."""
    return int(distances([a], [b], np.array([most]))[0])


def budget_of(query: Column) -> Column:
    """Edits allowed, by the length of the query."""
    n = F.char_length(query)
    return F.when(n <= 3, 0).when(n <= 7, 1).otherwise(2)


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    # pairs go shortest first, as many at a time as CELLS allows for the longest of them
    size = np.maximum(a.str.len().to_numpy(), b.str.len().to_numpy()) + 1
    order = np.argsort(size, kind="stable")
    out, at = np.zeros(len(a), np.int64), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * size[order[upto]] <= CELLS:
            upto += 1
        own = order[at:upto]
        out[own] = distances(a.iloc[own].tolist(), b.iloc[own].tolist(), most.iloc[own].to_numpy())
        at = upto
    return pd.Series(out)


def is_close(query: Column, candidate: Column) -> Column:
    """Within the budget. Plain edit distance bounds the other from above and below (a swap is at
    most two plain edits), so the JVM rejects nearly all pairs before Python sees them."""
    budget = budget_of(query)
    plain = F.levenshtein(F.lower(query), F.lower(candidate))
    near = (budget > 0) & (F.abs(F.char_length(query) - F.char_length(candidate)) <= budget) & (plain <= 2 * budget)
    # the function sees blanks where the bounds have decided
    left = F.when(near & (plain > budget), query).otherwise(F.lit(""))
    right = F.when(near & (plain > budget), candidate).otherwise(F.lit(""))
    return near & ((plain <= budget) | (_distance(left, right, budget) <= budget))


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(F.trim(c)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; blank words are alike only if equal."""
    x, y = trigrams(a), trigrams(b)
    blank = (F.trim(a) == "") | (F.trim(b) == "")
    return F.when(blank, (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def correct(words: DataFrame, vocabulary: DataFrame, limit: int = 3) -> DataFrame:
    """query, term, score, rank: the best close terms for each query word of four letters or more.
    words (query) are the few that were typed; their lengths bound the terms joined with them."""
    asked = words.where(F.char_length("query") >= 4)
    near = F.explode(F.sequence(F.char_length("query") - 2, F.char_length("query") + 2)).alias("n")
    pairs = asked.select("query", near).join(vocabulary.select("term", F.char_length("term").alias("n")), "n")
    pairs = pairs.where((F.lower("term") != F.lower("query")) & is_close(F.col("query"), F.col("term")))
    scored = pairs.select("query", "term", similarity(F.col("query"), F.col("term")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def suggest(query: str, vocabulary: DataFrame, limit: int = 8) -> DataFrame:
    """term, score: prefixes first (shorter ones before longer), then contained, close, alike."""
    q = query.strip().lower()
    if len(q) < 2:
        return vocabulary.select("term", F.lit(0.0).alias("score")).limit(0)
    term, like = F.lower("term"), similarity(F.lit(q), F.col("term"))
    score = (
        F.when(term.startswith(q), 1 - 0.001 * F.least(F.char_length("term"), F.lit(100)))
        .when(term.contains(q), F.lit(CONTAINS))
        .when(is_close(F.lit(q), F.col("term")), F.lit(CLOSE))
        .when(like >= TRIGRAM_FLOOR, like * TRIGRAM_WEIGHT)
    )
    return vocabulary.select("term", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "term").limit(limit)


def vocabulary(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """The distinct words of the given columns: three letters or more, not all digits, lower case."""
    out = None
    for df, c in sources:
        own = df.select(F.col(c).alias("text")).where("text IS NOT NULL")
        out = own if out is None else out.unionByName(own)
    words = out.select(F.explode(F.split("text", SEPARATORS)).alias("w")).select(F.lower("w").alias("term"))
    return words.where((F.char_length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$")).distinct()


def label_vocabulary(objects: DataFrame, words: DataFrame, limit: int = 400) -> DataFrame:
    """Object labels and vocabulary, distinct ignoring case, in order."""
    both = objects.select(F.col("value").alias("term")).unionByName(words.select("term"))
    return both.groupBy(F.lower("term").alias("_k")).agg(F.min("term").alias("term")).orderBy("_k").select("term").limit(limit)
