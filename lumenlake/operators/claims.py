"""First-claim grouping of any number of items: in order, an item that no earlier anchor is linked to is an anchor, any
other belongs to its earliest linked anchor.

Where links are many, items that have no earlier links are told first, and what they claim, until few links are left to
decide on. Only linked items matter to each other, so the links are then parted into connected components, and each component is
folded in order by one task that reads its links sorted and remembers which of its items are no anchors. Few links in all
are one fold. A component of more than FOLD items is taken in ranges of FOLD numbers: what anchors of earlier
ranges claim is a join, the rest of a range is a fold, so there are as many rounds as ranges, whatever the chains are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.store import kept, released

#: Items of a component (and links in all) that one task folds; more links are thinned out first.
FOLD = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b), stored; root is the smallest of its component. Large-star and
    small-star rounds, each stored, until nothing changes."""
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        used, edges = edges, kept(small, "edges")
        released(used)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out = kept(out, "components")
            released(edges)
            return out
        before = now


def _folded(batches):
    """seq, anchor of the items that an earlier anchor claims. Links (root, a, b) come sorted by root, b, a."""
    root = item = None
    claimed = False
    members: set[int] = set()  # items of the component so far that are no anchors
    for batch in batches:
        out = ([], [])
        for r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if r != root:
                root, item, members = r, None, set()
            if b != item:
                item, claimed = b, False
            if not claimed and a not in members:
                claimed = True
                members.add(b)
                out[0].append(b)
                out[1].append(a)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["seq", "anchor"])


def _fold(links: DataFrame) -> DataFrame:
    dealt = links.select("root", "a", "b").repartition("root").sortWithinPartitions("root", "b", "a")
    return dealt.mapInArrow(_folded, "seq long, anchor long")


def _thinned(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The links that are still to be decided on, and the items (b) that are claimed, in stored tables; no tables if the first
    round decides on less than half of the links, as in chains. An item without earlier links is an anchor and what it is linked to
    is claimed, which takes the links of both away; where links are many, most go in a few rounds."""
    left, hits, n = edges, [], edges.count()
    while n > FOLD:
        later = left.select(F.col("b").alias("a")).distinct()
        hit = kept(left.join(later, "a", "left_anti").select("b").distinct(), "hit")
        more = kept(left.join(hit.select(F.col("b").alias("a")), "a", "left_anti").join(hit, "b", "left_anti").select("a", "b"), "left")
        m = more.count()
        if 2 * m > n:
            released(hit, more)
            break
        if hits:
            released(left)
        left, n = more, m
        hits.append(hit)
    return left, hits


def members(links: DataFrame) -> DataFrame:
    """seq, anchor of the claimed items by links (a, b), a before b in order; all others are anchors. Stored."""
    edges = kept(links.select("a", "b").distinct(), "links")
    if edges.limit(FOLD + 1).count() <= FOLD:
        out = kept(_fold(edges.withColumn("root", F.lit(0))), "members")
        released(edges)
        return out
    thin, hits = _thinned(edges)
    if hits:
        own = members(thin)
        claimed = reduce(DataFrame.unionByName, [*hits, own.select(F.col("seq").alias("b"))]).select(F.col("b").alias("a"))
        out = kept(edges.join(claimed, "a", "left_anti").groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("anchor")), "members")
        released(edges, thin, own, *hits)
        return out
    nodes = components(edges)
    rooted = kept(edges.join(nodes.withColumnRenamed("node", "a"), "a").select("root", "a", "b"), "rooted")
    giant = kept(nodes.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("root"), "giant")
    out = kept(_fold(rooted.join(giant, "root", "left_anti")), "members")
    if giant.limit(1).count():
        large = rooted.join(giant, "root", "left_semi").select("root", "a", "b", F.floor(F.col("a") / FOLD).alias("from"), F.floor(F.col("b") / FOLD).alias("range"))
        large = kept(large, "giant-links")
        done = out.limit(0)
        for r in sorted(x[0] for x in large.select("range").distinct().collect()):  # numbers of ranges
            own = large.where(F.col("range") == r)
            gone = done.select(F.col("seq").alias("a"))
            # an earlier range's anchor claims before any of the own range; what it claims is no anchor here
            early = own.where(F.col("from") < r).join(gone, "a", "left_anti").groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("anchor"))
            early = kept(early, "early")
            taken = early.select(F.col("seq").alias("x"))
            inside = own.where(F.col("from") == r).join(taken.withColumnRenamed("x", "a"), "a", "left_anti").join(taken.withColumnRenamed("x", "b"), "b", "left_anti")
            more = kept(early.unionByName(_fold(inside)), "range")
            used, done = done, kept(done.unionByName(more), "done")
            released(early, more, *([used] if hasattr(used, "_lies_at") else []))
        used, out = out, kept(out.unionByName(done), "members")
        released(used, large)
        if hasattr(done, "_lies_at"):
            released(done)
    released(edges, nodes, rooted, giant)
    return out


def anchors(items: DataFrame, links: DataFrame) -> DataFrame:
    """seq, anchor of every item (seq) by links (a, b), a before b in the claiming order, stored."""
    own = members(links)
    out = kept(items.select("seq").join(own, "seq", "left").select("seq", F.coalesce("anchor", "seq").alias("anchor")), "anchors")
    released(own)
    return out
