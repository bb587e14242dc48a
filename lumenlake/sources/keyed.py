"""Tables that are changed in place: rows in buckets of a key, a change rewrites the buckets it touches.

A version is a numbered manifest file that names the folder of each bucket. A writer reads a version, writes new folders
for the buckets that its change touches, and creates the next manifest only if its number is still free. If another
writer was first, its manifest tells which buckets it replaced: if none that this change read, the same folders go on top
of it; else the change is made again from the new version. So no change is lost, none is seen by half, and a reader keeps
the version it has opened. Folders of older versions stay until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlake.sources.store import ObjectStore

#: Rows of a bucket that are aimed at, when a table is made.
ROWS = 500_000


class KeyedTable:
    """Rows of one schema under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = ObjectStore(spark, self.root)
        #: Buckets that the last change rewrote, and how often it had to be made again.
        self.rewritten, self.again = 0, 0

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: list[str], buckets: int | None = None) -> KeyedTable:
        table = cls(rows.sparkSession, root)
        state = {"key": key, "buckets": buckets or max(1, -(-rows.count() // ROWS)), "schema": rows.schema.jsonValue(), "at": {}}
        state["at"] = table._written(rows, state)
        if not table._files.write("versions/0.json", json.dumps(state).encode(), only_new=True):
            raise FileExistsError(f"there is a table at {root}")
        return table

    # versions

    def version(self) -> int:
        """The last version: doubling, then bisection."""
        there = lambda n: self._files.stat(f"versions/{n}.json") is not None
        if not there(0):
            raise FileNotFoundError(f"no table at {self.root}")
        low, step = 0, 1
        while there(low + step):
            low, step = low + step, step * 2
        while step > 1:
            step //= 2
            if there(low + step):
                low += step
        return low

    def _state(self, version: int) -> dict:
        return json.loads(self._files.read(f"versions/{version}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        state = self._state(self.version() if version is None else version)
        return self._of(state, sorted(state["at"], key=int))

    def _of(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.root}/{state['at'][b]}" for b in buckets if b in state["at"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["key"]), F.lit(state["buckets"])).cast("int")

    def _written(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """The folders of the buckets that have rows."""
        schema = StructType.fromJson(state["schema"])
        at = f"data/{uuid.uuid4().hex}"
        told = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_bucket", self._bucket(state))
        told.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [s.getPath().getName() for s in listed]
        return {n.removeprefix("_bucket="): f"{at}/{n}" for n in names if n.startswith("_bucket=")}

    # changes

    def change(self, plan: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None], tries: int = 100) -> bool:
        """Commits a change. plan(table) says which keys it touches (a frame with the key's columns) and gives a function
        from the rows of their buckets to the rows in their place; None: nothing to do (returns false). It is called again
        with the new table where another writer came first."""
        self.again = 0
        for _ in range(tries):
            version = self.version()
            state = self._state(version)
            made = plan(self._of(state, sorted(state["at"], key=int)))
            if made is None:
                return False
            keys, after = made
            touched = sorted(str(r[0]) for r in keys.select(*state["key"]).select(self._bucket(state)).distinct().collect())  # as many as buckets at most
            if not touched:
                return False
            new = self._written(after(self._of(state, touched)), state)
            if stray := set(new) - set(touched):
                raise ValueError(f"the change made rows of keys that it does not touch: buckets {sorted(stray)}")
            self.rewritten = len(touched)
            before = {b: state["at"].get(b) for b in touched}
            while True:
                state["at"] = {b: p for b, p in state["at"].items() if b not in before} | new
                if self._files.write(f"versions/{version + 1}.json", json.dumps(state).encode(), only_new=True):
                    return True
                version += 1
                state = self._state(version)
                if any(state["at"].get(b) != p for b, p in before.items()):
                    break  # another writer replaced what this change was made from
            self.again += 1
        raise TimeoutError(f"{tries} changes by others came first")

    def merge(self, rows: DataFrame, after: Callable[[DataFrame], DataFrame]) -> bool:
        """A change that touches the keys of rows."""
        return self.change(lambda _: (rows, after))

    def upsert(self, rows: DataFrame) -> bool:
        """Rows in place of those of the same key (one row a key)."""

        def after(old: DataFrame) -> DataFrame:
            key = self._state(0)["key"]
            return old.join(rows.select(*key), key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))

        return self.merge(rows, after)

    def delete(self, keys: DataFrame) -> bool:
        key = self._state(0)["key"]
        return self.merge(keys, lambda old: old.join(keys.select(*key), key, "left_anti").select(*old.columns))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that only versions before the last `keep` name; readers of those must have ended."""
        last = self.version()
        live = {p for v in range(max(0, last - keep + 1), last + 1) for p in self._state(v)["at"].values()}
        dead = {p for v in range(max(0, last - keep + 1)) for p in self._state(v)["at"].values()} - live
        for p in dead:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(dead)
