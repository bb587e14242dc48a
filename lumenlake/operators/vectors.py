"""Vector search: unit vectors, hub-corrected scores, z-scores, blends and codecs.

Scores are dot products in double precision, of blocks of vectors with the query or the queries, an
Arrow batch at a time. A search reads the vectors once: the scores, a number a row, are kept in
the shared folder for their mean and deviation and for the ranking.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenlake.sources.store import kept

FLOOR, DEVIATION = 0.18, 1e-6
#: Thresholds of face similarity, and the phrases that describe no photo in particular.
FACE_DEFAULT, FACE_STRICT, FACE_LOOSE = 0.40, 0.50, 0.30
IMAGE_WEIGHT, CAPTION_WEIGHT = 0.8, 0.2
BLEND_WEIGHTS = (0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
REFERENCE_PHRASES = (
    "a photo of a person", "a photo of a group of people", "a photo of a child", "a portrait of a face",
    "a photo of an animal", "a photo of a bird", "a photo of a plant", "a photo of a flower", "a photo of a tree",
    "a photo of food on a plate", "a photo of a drink", "a photo of a car", "a photo of a bicycle", "a photo of a boat",
    "a photo of a building", "a photo of a door", "a photo of a window", "a photo of a street", "a photo of a room indoors",
    "a photo of furniture", "a photo of a mountain", "a photo of the sea", "a photo of a field", "a photo of the sky",
    "a photo taken at night", "a photo taken in the snow", "a photo of a sign with writing on it", "a photo of a machine",
    "a photo of clothing", "a photo of a celebration", "a blurry photograph", "a black and white photograph",
)
#: What a query is put into before it is embedded; the vectors are averaged.
QUERY_TEMPLATES = ("{0}", "a photo of {0}", "a photo of a {0}", "a photograph of {0}", "a close-up photo of {0}")
MAX_QUERIES = 4096


def prompts(query: str) -> list[str]:
    """The texts whose vectors, by mean_unit, stand for a query; none for a blank one."""
    clean = query.strip()
    return [t.format(clean) for t in QUERY_TEMPLATES] if clean else []


def reference_bank(embed: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
    """The vectors of the reference phrases by a text embedder, for bank_mean; one without length drops out."""
    return [v for v in embed(list(REFERENCE_PHRASES)) if any(v)]


def dot(a: Column, b: Column) -> Column:
    """Null where the widths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length one in double, stored as float; a vector without length is an error."""
    size = magnitude(v)
    bad = F.raise_error("a vector without length cannot be normalised").cast("array<float>")
    return F.when(size < 1e-9, bad).otherwise(F.transform(v, lambda x: (x.cast("double") / size).cast("float")))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one width, as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def normalised(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """vector, the unit of the vectors in a column, and more columns; those of each width by themselves. A vector
    without length is an error."""

    def units(batches):
        for batch in batches:
            widths = pa.compute.list_value_length(batch.column(0))
            for w in pa.compute.unique(widths).to_pylist():
                part = batch.filter(pa.compute.equal(widths, w)) if w is not None else batch.slice(0, 0)
                if not part.num_rows:
                    continue
                v = matrix_of(part.column(0))
                size = np.sqrt((v * v).sum(axis=1, keepdims=True))
                if not w or (size < 1e-9).any():
                    raise ValueError("a vector without length cannot be normalised")
                flat = pa.array((v / size).astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * w, w, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([lists, *part.columns[1:]], ["vector", *more])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.select(name, *more).mapInArrow(units, f"vector array<float>{', ' if kinds else ''}{kinds}")


def dots(rows: DataFrame, vector: list[float], name: str) -> DataFrame:
    """rows with a column of the dot products of column vector with a given one; null where the widths differ."""
    wanted = np.array(vector, np.float64)

    def products(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            same = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), len(wanted)), False).to_numpy(zero_copy_only=False), bool)
            out = np.full(batch.num_rows, np.nan)
            out[same] = matrix_of(column.filter(pa.array(same))) @ wanted if same.any() else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~same)], [*batch.schema.names, name])

    return rows.mapInArrow(products, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def unit_of(vector: list[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in vector))
    if size < 1e-9:
        raise ValueError("a vector without length cannot be normalised")
    return [float(np.float32(x / size)) for x in vector]


def one_width(embeddings: DataFrame) -> DataFrame:
    """Only vectors of the smallest width present take part in a search."""
    return embeddings.where(F.size("vector") == embeddings.select(F.min(F.size("vector"))).scalar())


def bank_mean(bank: list[list[float]], width: int) -> list[float] | None:
    """The mean of the unit vectors of the phrases that have the width; null if none has."""
    units = [unit_of(b) for b in bank if len(b) == width]
    return [sum(x) / len(units) for x in zip(*units)] if units else None


def with_hub(embeddings: DataFrame, mean: list[float] | None) -> DataFrame:
    """Adds hub, the mean similarity to the reference bank: a dot with the bank's mean, dot being linear."""
    return dots(embeddings, mean, "hub") if mean else embeddings.withColumn("hub", F.lit(None).cast("double"))


def scored(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """photo_id, score (dot, less hub if calibrated), z over all rows; rows of another width drop out."""
    hub = F.coalesce("hub", F.lit(0.0)) if "hub" in embeddings.columns else F.lit(0.0)
    needed = embeddings.select("photo_id", "vector", *[c for c in ("hub",) if c in embeddings.columns])
    rows = kept(dots(needed, query, "raw").where("raw IS NOT NULL").select("photo_id", (F.col("raw") - hub).alias("score")), "scores")
    both = rows.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    z = F.when(F.col("dev") > DEVIATION, (F.col("score") - F.col("mean")) / F.col("dev")).otherwise(0.0)
    return rows.join(F.broadcast(both), how="cross").select("photo_id", "score", z.alias("z"))  # one row


def search(embeddings: DataFrame, query: list[float], limit: int = 60, floor: float = FLOOR) -> DataFrame:
    """The best rows. The floor holds only for scores that are not hub-corrected; ties by id."""
    out = scored(embeddings, query)
    if "hub" not in embeddings.columns:
        out = out.where(F.col("score") >= floor)
    return out.orderBy(F.desc("score"), "photo_id").limit(limit)


def similar_to(embeddings: DataFrame, photo_id: int, limit: int = 24) -> DataFrame:
    """The rows most like a photo; without a vector of its own, none."""
    own = embeddings.where(F.col("photo_id") == photo_id).select("vector").first()
    if own is None:
        return scored(embeddings.limit(0), [1.0])
    found = search(embeddings, [float(x) for x in own[0]], limit + 1, floor=0.0)
    return found.where(F.col("photo_id") != photo_id).orderBy(F.desc("score"), "photo_id").limit(limit)


def search_many(embeddings: DataFrame, queries: list[tuple[int, list[float]]], limit: int) -> DataFrame:
    """query_id, photo_id, score: the best rows for each query, MAX_QUERIES at a time. Each batch of
    rows keeps its own best, so what is shuffled is limit rows for a query and batch."""
    if len(queries) > MAX_QUERIES:
        first = search_many(embeddings, queries[:MAX_QUERIES], limit)
        return first.unionByName(search_many(embeddings, queries[MAX_QUERIES:], limit))
    ids, matrix = [q for q, _ in queries], np.array([v for _, v in queries], np.float64).T

    def best(batches):
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(1))
            batch = batch.filter(pa.compute.equal(size, matrix.shape[0]))
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column(0))
            scores = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) @ matrix
            for k, q in enumerate(ids):
                top = np.lexsort([rows, -scores[:, k]])[:limit]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(top), pa.int64()), pa.array(rows[top]), pa.array(scores[top, k])], ["query_id", "photo_id", "score"])

    parts = embeddings.select("photo_id", "vector").mapInArrow(best, "query_id long, photo_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "photo_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def coverage(embeddings: DataFrame, photos: DataFrame) -> DataFrame:
    n = photos.agg(F.count("*").alias("photos"))
    return embeddings.agg(F.count("*").alias("embedded")).join(F.broadcast(n), how="cross")  # one row each


def similar_faces(faces: DataFrame, face_id: int, threshold: float = FACE_DEFAULT) -> DataFrame:
    """id, score of faces of the same embedding model; the face itself is 1; none without a vector."""
    own = faces.where((F.col("id") == face_id) & F.col("embedding").isNotNull()).select("embedding", "embed_model").first()
    if own is None:
        return faces.select("id", F.lit(0.0).alias("score")).limit(0)
    same = faces.where((F.col("embed_model") == own[1]) & F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("vector"))
    score = F.when(F.col("id") == face_id, 1.0).otherwise(F.coalesce("dot", F.lit(0.0)))
    rows = dots(same, [float(x) for x in own[0]], "dot").select("id", score.alias("score"))
    return rows.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id")


def blend(image: Column, caption: Column, weight: float = IMAGE_WEIGHT) -> Column:
    """Unit of weight x image + (1 - weight) x caption, over the shorter width; no caption: the image."""
    n = F.least(F.size(image), F.size(caption))
    mixed = F.zip_with(F.slice(image, 1, n), F.slice(caption, 1, n), lambda a, b: a.cast("double") * weight + b.cast("double") * (1 - weight))
    return F.when(caption.isNull() | (F.size(caption) == 0), image).otherwise(unit(mixed))


def mean_unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the unit of the sum of each key's vectors (sentences of a caption, prompt variants)."""
    each = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    summed = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return summed.select(key, unit(F.col("v")).alias("vector"))


def to_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), " ")


def from_text(text: Column) -> Column:
    """Empty if any part is no number."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("float"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array().cast("array<float>")).otherwise(parts)


def precision_at(scored_rows: DataFrame, k: int = 5) -> DataFrame:
    """weight, precision: of (weight, query_id, photo_id, score, relevant), the share of relevant rows
    among the best k of each query, averaged by weight."""
    w = W.partitionBy("weight", "query_id").orderBy(F.desc("score"), "photo_id")
    top = scored_rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    each = top.groupBy("weight", "query_id").agg((F.count_if("relevant") / k).alias("p"))
    return each.groupBy("weight").agg(F.avg("p").alias("precision"))
