"""A stored index of unit vectors for exact nearest-neighbour search that reads only the cells that can matter.

Vectors lie in files by the cell of their nearest pivot. Of each cell the radius is known (the largest angle of its
vectors to the pivot), so for a query at angle t to the pivot no vector of the cell scores above
|q| cos(max(0, t - radius)). A search reads the most promising cells, takes the k-th score, and then only those further
cells whose bound reaches it; its answer is that of a full scan. A hub correction is a subtraction of the bank's mean
from the query, a product being linear. Mean and deviation of the scores over all rows, for z, come from stored moments
(the sum of the vectors and of their outer products), without a scan.

Rows are added in batches. A batch counts once its one `meta` file is there, which is renamed into place last; what a
lost job leaves behind is never read.

    root/pivots                       the pivots, written once
    root/rows/batch=B/cell=C/         photo_id, vector
    root/moments/batch=B              i, x: number, sums, products
    root/meta/batch=B                 cell, n, radius
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.neighbours import PIVOTS, SLACK, in_cells
from lumenlake.operators.vectors import DEVIATION, FLOOR, dots

#: Sampled rows a pivot, rounds that move the pivots, and rows a cell that are aimed at.
SAMPLE, ROUNDS, ROWS = 32, 4, 4096


def _moments(batches):
    """Of each task: the number of rows at -1, then sums, then outer products."""
    n, total, products = 0, None, None
    for batch in batches:
        if batch.num_rows:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            n += len(v)
            total = v.sum(axis=0) + (0 if total is None else total)
            products = v.T @ v + (0 if products is None else products)
    if n:
        x = np.concatenate([[n], total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(x) - 1)), pa.array(x)], ["i", "x"])


class VectorIndex:
    """Unit vectors (photo_id, vector), all of one width, under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: Share of the rows that the last search read.
        self.read = 0.0
        self._pivots: np.ndarray | None = None
        self._known: tuple = ()

    @classmethod
    def build(cls, rows: DataFrame, root: str, cells: int | None = None) -> VectorIndex:
        """A new index of rows. Pivots are moved over a sample of SAMPLE rows a cell, on the driver."""
        index = cls(rows.sparkSession, root)
        cells = min(PIVOTS, cells or max(1, rows.count() // ROWS))
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("photo_id"), "photo_id").limit(SAMPLE * cells).select("vector").collect()], np.float64)
        pivots = sample[:: max(1, len(sample) // cells)][:cells]
        for _ in range(ROUNDS if len(sample) else 0):
            own = (sample @ pivots.T).argmax(axis=1)
            moved = np.array([sample[own == k].sum(axis=0) if (own == k).any() else p for k, p in enumerate(pivots)])
            size = np.linalg.norm(moved, axis=1, keepdims=True)
            pivots = np.where(size > 1e-9, moved / np.maximum(size, 1e-9), pivots)
        index.spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(pivots)], "cell long, vector array<double>").coalesce(1).write.parquet(f"{index.root}/pivots")
        index.append(rows)
        return index

    @property
    def pivots(self) -> np.ndarray:
        if self._pivots is None:
            self._pivots = np.array([r.vector for r in self.spark.read.parquet(f"{self.root}/pivots").orderBy("cell").collect()], np.float64)  # PIVOTS at most
        return self._pivots

    def append(self, rows: DataFrame) -> None:
        """Adds a batch; searches see all of it or nothing."""
        batch = f"b{uuid.uuid4().hex}"  # never read as a number
        if not len(self.pivots):
            raise ValueError("an index built of no rows has no cells; build it anew")
        at = f"{self.root}/rows/batch={batch}"
        # cells stay together in files, large ones in several
        in_cells(rows, self.pivots, "photo_id").select("photo_id", "vector", "angle", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(at)
        schema = f"photo_id {rows.schema['photo_id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, angle double, cell long"
        done = self.spark.read.schema(schema).parquet(at)
        done.select("vector").mapInArrow(_moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).write.parquet(f"{self.root}/moments/batch={batch}")
        done.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).coalesce(1).write.parquet(f"{self.root}/meta/batch={batch}")

    def _state(self):
        """Batches that count, number and radius of each cell, and the moments."""
        meta = self.spark.read.parquet(f"{self.root}/meta").select("batch", "cell", "n", "radius").collect()  # a row a batch and cell
        batches = tuple(sorted({r.batch for r in meta}))
        if not self._known or self._known[0] != batches:
            n, radius = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), -np.inf)
            for r in meta:
                n[r.cell] += r.n
                radius[r.cell] = max(radius[r.cell], r.radius)
            sums = self.spark.read.parquet(f"{self.root}/moments").where(F.col("batch").isin(*batches)).groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # 1 + width + width^2 rows
            x = np.zeros(sums.num_rows)
            x[np.asarray(sums.column(0)) + 1] = np.asarray(sums.column(1))
            self._known = (batches, n, radius, x)
        return self._known

    def search(self, query: list[float], limit: int = 60, mean: list[float] | None = None, floor: float = FLOOR) -> DataFrame:
        """photo_id, score, z of the best rows, as vectors.search() has them; mean is that of a reference bank, and
        with it no floor holds."""
        batches, n, radius, x = self._state()
        schema = "photo_id long, score double, z double"
        width, total = self.pivots.shape[1], int(n.sum())
        if len(query) != width or not total:
            return self.spark.createDataFrame([], schema)
        q = np.array(query, np.float64) - (np.array(mean, np.float64) if mean else 0.0)
        size = float(np.linalg.norm(q))
        angle = np.arccos(np.clip(self.pivots @ q / max(size, 1e-300), -1.0, 1.0))
        bound = np.where(n > 0, size * np.cos(np.clip(angle - radius - SLACK, 0.0, math.pi)), -np.inf) + SLACK
        least = -np.inf if mean else floor
        order = [c for c in np.argsort(-bound, kind="stable").tolist() if n[c] and bound[c] >= least]
        first = order[: int(np.searchsorted(np.cumsum(n[order]), 2 * limit)) + 1] if order else []
        average, spread = x[1 : 1 + width] @ q / x[0], q @ x[1 + width :].reshape(width, width) @ q / x[0]
        deviation = math.sqrt(max(0.0, spread - average * average))

        def best(cells: list[int]) -> list:
            rows = self.spark.read.schema("photo_id long, vector array<float>, batch string, cell long").parquet(f"{self.root}/rows")
            rows = rows.where(F.col("batch").isin(*batches) & F.col("cell").isin(*cells)).select("photo_id", "vector")
            scored = dots(rows, [float(v) for v in q], "score").where(F.col("score") >= least)
            return [(r.photo_id, r.score) for r in scored.orderBy(F.desc("score"), "photo_id").limit(limit).select("photo_id", "score").collect()]

        found = best(first) if first else []
        reach = min((s for _, s in found), default=-np.inf) if len(found) >= limit else -np.inf
        rest = [c for c in order[len(first) :] if bound[c] >= reach]
        if rest:
            found = sorted(found + best(rest), key=lambda r: (-r[1], r[0]))[:limit]
        self.read = float(n[first + rest].sum() / total) if first else 0.0
        z = lambda s: (s - average) / deviation if deviation > DEVIATION else 0.0
        return self.spark.createDataFrame([(int(i), float(s), float(z(s))) for i, s in found], schema)

    def exists(self) -> bool:
        try:
            return self.spark.read.parquet(f"{self.root}/meta").limit(1).count() > 0
        except AnalysisException:
            return False
