"""A stored full-text index: sorted segments that merge, found through a manifest.

A segment holds postings (token, id, col, pos: the positions of a token in one column of a document), sorted by token and
dealt to files by ranges of tokens, so a lookup of a token or of a prefix reads the row groups whose range covers it; and
the ids of the documents it was made of, which replace those of all earlier segments (a deleted document is an id without
postings). update() writes one more segment for the changed documents only. When FAN segments of a size class have
gathered they are merged into one of the next, so a document is rewritten a logarithmic number of times and a lookup meets
a logarithmic number of segments.

The manifest is a row of numbered files, each listing the segments in order. A new one is created only if its
number is free (else the writer reads the winner's and tries again), so writers never lose each other's segments and
readers see a whole state.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.text import tokens
from lumenlake.operators.fulltext import COLUMNS, Term, compile_query, documents
from lumenlake.sources.store import ObjectStore

#: Segments of a size class that are merged, and postings of a file's range that are aimed at.
FAN, ROWS = 4, 2_000_000
POSTINGS = "token string, id long, col string, pos array<int>"


def postings(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """token, id, col, pos of documents (id and text columns), made within each document."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns])).alias("x")
    words = docs.select("id", each).select("id", "x.col", F.explode(_by_token(F.col("x.t"))).alias("w"))
    return words.select("w.token", "id", "col", "w.pos")


def _by_token(found: Column) -> Column:
    """An array of tokens as one of each token with its positions, by sorting where any repeats; _once() keeps what a step before has made."""
    placed = F.sort_array(F.transform(found, lambda t, i: F.struct(t.alias("token"), i.alias("at"))))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["token"] != x["token"]), i)), lambda i: i.isNotNull())
    part = lambda s, b, i, k: F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i)
    told = lambda s, b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["token"].alias("token"), part(s, b, i, k)["at"].alias("pos")))
    single = F.transform(found, lambda t, i: F.struct(t.alias("token"), F.array(i).alias("pos")))
    return F.when(F.size(F.array_distinct(found)) == F.size(found), single).otherwise(_once(placed, lambda s: _once(begins(s), lambda b: told(s, b))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


class TextIndex:
    """Documents (id and text columns) indexed under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = COLUMNS):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self._files = ObjectStore(spark, self.root)

    # the manifest

    def _latest(self) -> tuple[int, list[dict]]:
        """Number and segments (name, rows) of the last manifest; -1 where there is none."""
        at = -1
        step = 1
        while self._files.stat(f"manifest/{at + step}.json"):  # doubling, then bisection
            at, step = at + step, step * 2
        while step > 1:
            step //= 2
            if self._files.stat(f"manifest/{at + step}.json"):
                at += step
        return at, json.loads(self._files.read(f"manifest/{at}.json")) if at >= 0 else []

    def segments(self) -> list[dict]:
        return self._latest()[1]

    def _commit(self, change) -> list[dict]:
        """Writes change(segments) as the next manifest, on top of whatever others have written meanwhile."""
        while True:
            at, now = self._latest()
            new = change(now)
            if self._files.write(f"manifest/{at + 1}.json", json.dumps(new).encode(), only_new=True):
                return new

    # segments

    def _write(self, rows: DataFrame, ids: DataFrame) -> dict:
        name = f"s{uuid.uuid4().hex}"
        at = f"{self.root}/segments/{name}"
        ids.select("id").distinct().write.parquet(f"{at}/ids")
        rows.select("token", "id", "col", "pos").write.parquet(f"{at}/raw")
        raw = self.spark.read.schema(POSTINGS).parquet(f"{at}/raw")
        n = raw.count()
        # ranges of token and id, so that a token of many documents goes to several files
        raw.repartitionByRange(max(1, math.ceil(n / ROWS)), "token", "id").sortWithinPartitions("token", "id").write.option("parquet.block.size", 16 << 20).parquet(f"{at}/postings")
        raw_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/raw")
        raw_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(raw_path, True)
        return {"name": name, "rows": n}

    def _postings(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.root}/segments/{segment['name']}/postings")

    def _ids(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("id long").parquet(f"{self.root}/segments/{segment['name']}/ids")

    def _live(self, segments: list[dict], where: Column | None = None) -> DataFrame:
        """Postings that no later segment replaces; where is a condition on the token."""
        parts = []
        for k, s in enumerate(segments):
            own = self._postings(s)
            own = own if where is None else own.where(where)
            later = [self._ids(x) for x in segments[k + 1 :]]
            parts.append(own.join(reduce(DataFrame.unionByName, later), "id", "left_anti") if later else own)
        return reduce(DataFrame.unionByName, parts)

    # changes

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Indexes new and changed documents; ids in gone are taken out. Documents must be given whole."""
        ids = docs.select("id") if gone is None else docs.select("id").unionByName(gone.select("id"))
        new = self._write(postings(docs.repartition("id"), self.columns), ids)  # few large files of rows make many words
        self._commit(lambda now: [*now, new])
        self._merge()

    @staticmethod
    def _class(segment: dict) -> int:
        return int(math.log(max(segment["rows"], 1), FAN))

    def _merge(self) -> None:
        """Merges runs of FAN neighbouring segments that are of one size class, or smaller, until there are none."""
        while True:
            now = self.segments()
            run = next((now[k:] for k in range(len(now) - FAN + 1) if len(now) - k >= FAN and max(map(self._class, now[k + 1 :])) >= self._class(now[k])), None)
            if run is None:
                return
            whole = self._write(self._live(run), reduce(DataFrame.unionByName, map(self._ids, run)))
            names = [s["name"] for s in run]

            def put(segments, names=names, whole=whole):
                have = [s["name"] for s in segments]
                at = have.index(names[0]) if names[0] in have else -1
                if at < 0 or have[at : at + len(names)] != names:  # another writer has merged them
                    return segments
                return [*segments[:at], whole, *segments[at + len(names) :]]

            self._commit(put)

    # lookups

    def _term(self, segments: list[dict], term: Term) -> DataFrame:
        """ids of the documents that hold a term: its tokens one after the other in one column."""
        found = None
        for k, t in enumerate(term.tokens):
            last = term.prefix and k == len(term.tokens) - 1
            token = F.col("token")
            where = (token >= t) & (token < t + chr(0x10FFFF)) if last else token == t
            own = self._live(segments, where)
            if len(term.tokens) == 1:
                return own.select("id").distinct()
            begins = own.select("id", "col", F.explode(F.transform("pos", lambda p: p - k)).alias("at")).distinct()  # noqa: B023
            found = begins if found is None else found.join(begins, ["id", "col", "at"], "left_semi")
        return found.select("id").distinct()

    def lookup(self, text: str) -> DataFrame:
        """ids of the documents that hold every term of the text; only files of the asked tokens are read."""
        terms, segments = compile_query(text), self.segments()
        if terms is None or not segments:
            return self.spark.createDataFrame([], "id long")
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), (self._term(segments, t) for t in terms))


def index_photos(photos: DataFrame, tags: DataFrame | None, root: str) -> TextIndex:
    """A new index of the photos' documents."""
    out = TextIndex(photos.sparkSession, root)
    out.update(documents(photos, tags))
    return out
