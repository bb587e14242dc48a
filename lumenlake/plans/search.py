"""Hybrid search: exact, semantic and fuzzy hits, each with a contribution, merged into one ranking.

Whether fuzzy hits are needed depends on two counts (fewer than five exact hits, no semantic
ones), the only actions before the result; both are of limited frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlake.functions import fuzzy
from lumenlake.operators import vectors
from lumenlake.operators.term_index import TermIndex
from lumenlake.operators.vector_index import VectorIndex
from lumenlake.plans.query import Catalog, Query, filtered, order_columns, page, row_predicates
from lumenlake.sources.store import kept

#: Reasons as bits, weights, and what counts as a hit.
FACET, EXACT, SEMANTIC, FUZZY = 0, 1, 2, 4
EXACT_WEIGHT, SEMANTIC_WEIGHT, FUZZY_WEIGHT, FALL = 1.00, 0.80, 0.55, 0.06
NEAREST, LEAST_Z, Z_RANGE, FEW_EXACT = 120, 2.0, 3.0, 5
EXACT_LIMIT, FUZZY_LIMIT = 200, 100


@dataclass(frozen=True)
class Result:
    """hits: id, score, reasons, explanation, position; total: hits before the limit."""

    hits: DataFrame
    total: int
    corrections: list[tuple[str, str]] = field(default_factory=list)
    used_semantic: bool = False


@dataclass(frozen=True)
class Calibrated:
    """A stored vector index with the mean of a reference bank, in place of a table of embeddings."""

    index: VectorIndex
    mean: list[float] | None = None

    def search(self, query: list[float], limit: int) -> DataFrame:
        return self.index.search(query, limit, self.mean)


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[ \t,;.\"']", text) if len(w) >= 2]


def _ranked(catalog: Catalog, q: Query, weight: float, reason: int, base: int) -> DataFrame:
    found = page(filtered(catalog, q), order_columns(q.order), q.limit, q.offset)
    i = F.row_number().over(W.orderBy(*order_columns(q.order))) - 1  # over one page
    return found.select("id", i.alias("i")).select("id", (weight / (1 + FALL * F.col("i"))).alias("score"), F.lit(reason).alias("reasons"), (F.col("i") + base).alias("seen"))


def semantic_hits(catalog: Catalog, q: Query, embeddings: DataFrame | Calibrated, vector: list[float], strict: bool = False) -> DataFrame:
    """The nearest rows of two deviations or more that pass the recheck. strict rechecks every
    predicate; else city, country, folder, object, tags and collection are let through."""
    near = embeddings.search(vector, NEAREST) if isinstance(embeddings, Calibrated) else vectors.search(embeddings, vector, NEAREST)
    near = near.where(F.col("z") >= LEAST_Z)
    if strict:
        photos = filtered(catalog, replace(q, text=None))
    else:
        photos = catalog.photos
        for p in row_predicates(q, semantic=True):
            photos = photos.where(p)
    hits = near.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    z = F.least(F.greatest((F.col("z") - LEAST_Z) / Z_RANGE, F.lit(0.0)), F.lit(1.0))
    seen = F.row_number().over(W.orderBy(F.desc("z"), "photo_id")) + 1_000_000  # of NEAREST rows
    return hits.select(F.col("photo_id").alias("id"), (SEMANTIC_WEIGHT * z).alias("score"), F.lit(SEMANTIC).alias("reasons"), seen.alias("seen"))


def search(catalog: Catalog, q: Query, embeddings: DataFrame | Calibrated | None = None, vector: list[float] | None = None, vocabulary: DataFrame | TermIndex | None = None, strict: bool = False) -> Result:
    if not (q.text and q.text.strip()):
        found = page(filtered(catalog, q), order_columns(q.order), q.limit, q.offset)
        position = F.row_number().over(W.orderBy(*order_columns(q.order)))
        hits = found.select("id", F.lit(0.0).alias("score"), F.lit(FACET).alias("reasons"), F.lit(None).cast("string").alias("explanation"), position.cast("long").alias("position"))
        return Result(hits, hits.count())
    parts = [_ranked(catalog, replace(q, limit=max(q.limit, EXACT_LIMIT)), EXACT_WEIGHT, EXACT, 0)]
    semantic = semantic_hits(catalog, q, embeddings, vector, strict) if vector and embeddings is not None else None
    corrections: list[tuple[str, str]] = []
    if semantic is not None:  # at most NEAREST rows, counted here and merged below
        semantic = kept(semantic, "semantic")
    some = bool(semantic is not None and semantic.limit(1).count())
    if some:
        parts.append(semantic)
    elif vocabulary is not None and parts[0].limit(FEW_EXACT).count() < FEW_EXACT:
        asked = catalog.photos.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in words(q.text)] or [F.lit("")])).alias("query")).distinct()
        found = (vocabulary.correct(asked) if isinstance(vocabulary, TermIndex) else fuzzy.correct(asked, vocabulary)).collect()  # three for each typed word
        order = {w: i for i, w in enumerate(words(q.text))}
        for n, r in enumerate(sorted(found, key=lambda r: (order[r["query"]], r["rank"]))):
            corrections.append((r["query"], r["term"]))
            own = _ranked(catalog, replace(q, text=r["term"], limit=FUZZY_LIMIT), FUZZY_WEIGHT, FUZZY, 2_000_000 + 1000 * n)
            parts.append(own.withColumn("score", F.col("score") * r["score"]))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    # a few hundred rows, counted and ranked below: kept, so that the text is not searched again
    merged = kept(merged.groupBy("id").agg(F.sum("score").alias("score"), F.bit_or("reasons").alias("reasons"), F.min("seen").alias("seen")), "merged")
    said = f"“{corrections[0][0]}” → {corrections[0][1]}" if corrections else None
    why = F.when(F.col("reasons").bitwiseAND(EXACT) != 0, F.lit(None)).when((F.col("reasons").bitwiseAND(FUZZY) != 0) & F.lit(said is not None), F.lit(said)).otherwise("similar meaning")
    whole = merged.join(catalog.photos.select("id", "captured_utc"), "id")
    order_by = [F.desc("score"), F.desc("captured_utc"), F.asc("seen"), F.asc("id")]
    top = whole.orderBy(*order_by).limit(max(q.limit, 1))
    hits = top.select("id", "score", "reasons", why.alias("explanation"), F.row_number().over(W.orderBy(*order_by)).cast("long").alias("position"))  # over one page
    return Result(hits, merged.count(), list(dict.fromkeys(corrections)), some)
