"""Pairs of near things without comparing all: codes by blocks of bits, unit vectors by pivots.

Codes of 64 bits that differ in at most t. Cut into t + c blocks, c of them at least are equal; every choice of c
blocks makes a key, of 64 c / (t + c) bits. blocks_for() takes the c that costs least for the number of codes:
longer keys cost more keys, but fewer meet on each, so the codes that a key brings together do not grow with the
table. A pair that agrees on more blocks than c is kept under the first c only.

Unit vectors of a scalar product of at least t lie within the angle arccos t. Every vector lives in the cell of its
nearest pivot; it also visits a cell only if a partner could live there: if its angle to that pivot is at most the
cell's radius plus arccos t, and at most its angle to its own pivot plus 2 arccos t (both by the triangle inequality, so nothing
is lost). Of two cells the one of the lower number visits.

What meets on one key or in one cell is cut into parts when it is many, and each pair of parts is a place of its
own, so no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.store import kept, released

#: Codes of a key and vectors of a cell that meet in one place; comparisons, or products with pivots, that are made at a time.
CODES, VECTORS, STRIP = 8192, 4096, 1 << 20
#: Pivots at most; angles are compared with this slack, for rounding.
PIVOTS, SLACK = 4096, 1e-6


def blocks_for(n: int, bits: int) -> int:
    """The number c of equal blocks of a key that costs least for n codes: keys, and comparisons on each."""
    cost = lambda c: comb(bits + c, c) * (8 + n / 2 ** (64 * c // (bits + c)))
    return min(range(1, 65 - bits), key=cost) if bits < 64 else 0


def _masks(bits: int, c: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of the t + c blocks, and the choices of c of them."""
    ends = [round(64 * k / (bits + c)) for k in range(bits + c + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])], list(combinations(range(bits + c), c))


def _places(batches, width: int, found: Callable):
    """found(columns) for whole places: rows come sorted by their first `width` columns, which name the place."""
    kept_ = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept_ = now if kept_ is None else [np.concatenate(x) for x in zip(kept_, now)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in kept_[:width]], axis=0)) if len(kept_[0]) >= 4096 else []
        if len(change):
            yield from found([c[: change[-1] + 1] for c in kept_])
            kept_ = [c[change[-1] + 1 :] for c in kept_]
    if kept_ is not None and len(kept_[0]):
        yield from found(kept_)


def _starts(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return start, np.diff(np.r_[start, len(columns[0])])


def code_pairs(codes: DataFrame, bits: int) -> DataFrame:
    """x, y, bits: pairs of the distinct longs in column code that differ in at most so many bits, x below y as
    signed numbers, each pair once."""
    codes = kept(codes.select("code").where("code IS NOT NULL").distinct(), "codes")
    c = blocks_for(codes.count(), bits)
    masks, choices = _masks(bits, c)
    told = np.array(masks, np.uint64)
    held = np.array([np.bitwise_or.reduce(told[list(x)], initial=np.uint64(0)) for x in choices], np.uint64)
    last = np.array([x[-1] if x else -1 for x in choices])

    def keyed(batches):
        for batch in batches:
            own = np.asarray(batch.column(0))
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                keys = part.view(np.uint64)[:, None] & held
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(held)), len(part))), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(held)))], ["choice", "key", "code"])

    rows = codes.mapInArrow(keyed, "choice long, key long, code long")
    large = kept(rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > CODES).select("choice", "key", F.ceil(F.col("n") / CODES).cast("int").alias("parts")), "large")
    if large.limit(1).count():
        rows = rows.join(large, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        rows = rows.select("choice", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "code")
    else:
        rows = rows.select("choice", "key", *[F.lit(0).cast("long").alias(x) for x in ("p", "q", "part")], "code")

    def meet(batches):
        def found(columns):
            choice, _, p, q, part, code = columns
            u = code.view(np.uint64)
            start, size = _starts(columns[:4])
            out = []

            def near(i, j):
                """Of index arrays: pairs within bits that have no earlier choice of equal blocks."""
                differ = u[i] ^ u[j]
                good = np.bitwise_count(differ) <= bits
                i, j = np.broadcast_arrays(i, j)
                i, j, differ = i[good], j[good], differ[good]
                before = sum(((differ & m) == 0).astype(np.int64) & (b < last[choice[i]]) for b, m in enumerate(told))
                first = (before == c - 1) if c else np.ones(len(i), bool)
                a, b = code[i[first]], code[j[first]]
                out.append((np.minimum(a, b), np.maximum(a, b), np.bitwise_count(differ[first]).astype(np.int64)))

            two = start[(size == 2) & (p[start] == q[start])]
            near(two, two + 1)
            for s, m in zip(start.tolist(), size.tolist()):
                if m == 1 or m == 2 and p[s] == q[s]:
                    continue
                at = np.arange(s, s + m)
                left, right = (at, at) if p[s] == q[s] else (at[part[s : s + m] == p[s]], at[part[s : s + m] == q[s]])
                step = max(1, STRIP // max(1, len(right)))
                for k in range(0, len(left), step):
                    i, j = left[k : k + step, None], right[None, :]
                    if p[s] == q[s]:
                        i, j = np.broadcast_arrays(i, j)
                        i, j = i[i < j], j[i < j]
                    near(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["x", "y", "bits"])

        yield from _places(batches, 4, found)

    names = ["choice", "key", "p", "q"]
    out = kept(rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(meet, "x long, y long, bits long"), "pairs")
    released(codes, large)
    return out


def _angles(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def strips(n: int, pivots: np.ndarray) -> Iterator[slice]:
    """n rows, so many at a time that their products with all pivots are STRIP numbers at most."""
    step = max(1, STRIP // max(1, len(pivots)))
    return (slice(at, at + step) for at in range(0, n, step))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest pivot of each vector, and the angle to it."""
    cell, angle = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for own in strips(len(vectors), pivots):
        products = vectors[own] @ pivots.T
        cell[own] = products.argmax(axis=1)
        angle[own] = _angles(products[np.arange(len(products)), cell[own]])
    return cell, angle


def in_cells(rows: DataFrame, pivots: np.ndarray, *more: str) -> DataFrame:
    """rows (vector and more) with the cell of the nearest pivot and the angle to it."""

    def dealt(batches):
        for batch in batches:
            cell, angle = nearest(_matrix(batch.column(0)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("vector", *more))
    return rows.select("vector", *more).mapInArrow(dealt, f"{kinds}, cell long, angle double")


def chosen_pivots(rows: DataFrame, key: str, cells: int) -> np.ndarray:
    """So many distinct vectors as pivots: the first by a hash of the key."""
    some = rows.orderBy(F.xxhash64(key), key).limit(cells).select("vector").collect()  # PIVOTS at most
    return np.unique(np.array([r[0] for r in some], np.float64), axis=0)


def vector_pairs(rows: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    """a, b, score: pairs of unit vectors (seq, vector) with a product of at least the threshold, a before b."""
    return _vector_pairs(rows, threshold, cells)[0]


def compared_share(rows: DataFrame, threshold: float, cells: int | None = None) -> float:
    """The share of all pairs that vector_pairs() compares."""
    visits, n = _vector_pairs(rows, threshold, cells)[1:]
    size = visits.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    done = size.agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("g"))).first()[0]
    return (done or 0.0) / max(1.0, n * (n - 1) / 2)


def _vector_pairs(rows: DataFrame, threshold: float, cells: int | None):
    rows = rows.select("seq", "vector")
    n = rows.count()
    cells = min(PIVOTS, max(1, n // VECTORS)) if cells is None else min(PIVOTS, cells)
    reach = acos(max(-1.0, min(1.0, threshold))) + SLACK
    if cells == 1 or not n:
        visits = rows.select("seq", "vector", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"))
    else:
        pivots = chosen_pivots(rows, "seq", cells)
        lives = kept(in_cells(rows, pivots, "seq"), "cells")
        radius = np.full(len(pivots), -np.inf)
        for r in lives.groupBy("cell").agg(F.max("angle").alias("r")).collect():  # a row a cell
            radius[r.cell] = r.r

        def visiting(batches):
            for batch in batches:
                whole, home, angles = _matrix(batch.column(0)), np.asarray(batch.column(2)), np.asarray(batch.column(3))
                for some in strips(len(whole), pivots):
                    v, own, angle = whole[some], home[some], angles[some]
                    far = _angles(v @ pivots.T)
                    goes = (far <= radius + reach) & (far <= angle[:, None] + 2 * reach) & (np.arange(len(pivots)) > own[:, None])
                    goes[np.arange(len(v)), own] = True
                    row, cell = np.nonzero(goes)
                    for at in range(0, len(row), 2048):
                        i = row[at : at + 2048]
                        taken = pa.array(i + some.start)
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(taken), batch.column(0).take(taken), pa.array(cell[at : at + 2048]), pa.array(own[i] == cell[at : at + 2048])], ["seq", "vector", "cell", "home"])

        visits = lives.select("vector", "seq", "cell", "angle").mapInArrow(visiting, f"seq {rows.schema['seq'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, cell long, home boolean")
    size = visits.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    size = size.select("cell", F.greatest(F.ceil(F.col("h") / VECTORS), F.lit(1)).cast("int").alias("hs"), F.greatest(F.ceil(F.col("g") / VECTORS), F.lit(1)).cast("int").alias("gs"))
    told = visits.join(F.broadcast(size), "cell")  # a row a cell
    own = F.pmod(F.xxhash64("seq"), F.when(F.col("home"), F.col("hs")).otherwise(F.col("gs"))).cast("int")
    told = told.withColumn("part", own)
    # a home part meets itself, the home parts after it, and each guest part (numbered below zero)
    homes = told.where("home").withColumn("other", F.explode(F.concat(F.sequence(F.lit(0), F.col("hs") - 1), F.transform(F.sequence(F.lit(1), F.col("gs")), lambda g: -g))))
    homes = homes.select("cell", F.when(F.col("other") < 0, F.col("part")).otherwise(F.least("part", "other")).alias("p"), F.when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("part", "other")).alias("q"), "part", "home", "seq", "vector")
    guests = told.where("NOT home").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("hs") - 1))).select("cell", "p", (-F.col("part") - 1).alias("q"), "part", "home", "seq", "vector")

    def pairs(table: pa.Table) -> pa.Table:
        seq, part, home = (table.column(x).to_numpy() for x in ("seq", "part", "home"))
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(seq), -1)
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        x = np.flatnonzero(home & (part == p))
        y = np.flatnonzero(~home) if q < 0 else np.flatnonzero(part == q)
        found = [(np.zeros(0, seq.dtype), np.zeros(0, seq.dtype), np.zeros(0))]
        for at in range(0, len(x), 1024):
            some = x[at : at + 1024]
            scores = vectors[some] @ vectors[y].T
            i, j = np.nonzero(scores >= threshold)
            a, b, s = seq[some[i]], seq[y[j]], scores[i, j]
            good = a < b if p == q else a != b
            found.append((np.minimum(a, b)[good], np.maximum(a, b)[good], s[good]))
        low, high, s = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": low, "b": high, "score": s})

    return homes.unionByName(guests).groupBy("cell", "p", "q").applyInArrow(pairs, "a long, b long, score double"), visits, n
