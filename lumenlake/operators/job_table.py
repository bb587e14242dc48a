"""The work queue as a stored table that several drivers work on: every step is a versioned change.

A claim is worked out on one version and committed on the next only if nobody has changed the claimed photos' buckets
meanwhile; else it is worked out again. So no job is handed out twice, and no outcome is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import jobs
from lumenlake.sources.keyed import KeyedTable
from lumenlake.sources.store import kept, released


class JobTable:
    """Jobs by photo, all stages of a photo in one bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = KeyedTable(spark, root)

    @classmethod
    def create(cls, rows: DataFrame, root: str, buckets: int | None = None) -> JobTable:
        KeyedTable.create(rows, root, ["photo_id"], buckets)
        return cls(rows.sparkSession, root)

    def read(self) -> DataFrame:
        return self.table.read()

    def claim(self, now: Column, limit: int) -> DataFrame:
        """photo_id, stage of the first runnable jobs in claim order, now running and nobody else's."""
        mine: list[DataFrame] = []

        def plan(rows: DataFrame):
            released(*mine)
            mine[:] = [kept(jobs.runnable(rows).orderBy(*jobs.CLAIM_ORDER).limit(limit).select("photo_id", "stage"), "claimed")]
            own = mine[0].withColumn("_mine", F.lit(True))

            def after(old: DataFrame) -> DataFrame:
                out = old.join(F.broadcast(own), ["photo_id", "stage"], "left")  # limit rows
                return out.withColumns({"state": F.when(F.col("_mine"), "running").otherwise(F.col("state")), "updated_at": F.when(F.col("_mine"), now).otherwise(F.col("updated_at"))}).select(*old.columns)

            return mine[0], after

        self.table.change(plan)
        return mine[0]

    def finish(self, outcomes: DataFrame, now: Column) -> bool:
        """outcomes as jobs.apply_outcomes() takes them."""
        return self.table.merge(outcomes, lambda old: jobs.apply_outcomes(old, outcomes, now))

    def _all(self, which: Column, step) -> bool:
        """A step over all rows, of which only the buckets with such rows are rewritten."""
        return self.table.change(lambda rows: (rows.where(which), step))

    def release_stale(self, now: Column) -> bool:
        late = F.col("updated_at") < now - F.expr(f"INTERVAL {int(jobs.STALE.total_seconds())} SECONDS")
        return self._all((F.col("state") == "running") & late, lambda old: jobs.release_stale(old, now))

    def retry_stuck(self, now: Column) -> bool:
        return self._all((F.col("state") == "failed") & (F.col("attempts") >= jobs.MAX_ATTEMPTS), lambda old: jobs.retry_stuck(old, now))

    def reconcile(self, photos: DataFrame, now: Column) -> bool:
        """Pending rows for the photos and stages that have none."""

        def plan(rows: DataFrame):
            new = jobs.reconcile(rows, photos, now).join(rows.select("photo_id", "stage"), ["photo_id", "stage"], "left_anti").select(*rows.columns)
            new = kept(new, "new-jobs")
            return new, lambda old: old.unionByName(new)

        return self.table.change(plan)
