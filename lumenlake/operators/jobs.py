"""The staged work queue as a table: each function takes the jobs and gives the next state.

The runnable set is computed at once, stage by stage, rather than claimed row by row, so a stage's
work is one distributed pass; the order within it is kept for those who take only some of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.sources.store import cache_get, cache_put, kept, released

#: Stages in order, states, limits.
STAGES = ("describe", "segment", "faces", "embed")
STATES = ("pending", "running", "done", "failed", "skipped")
MAX_ATTEMPTS = 3
STALE = timedelta(minutes=15)
MAX_ERROR = 500


def stages(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, STAGES))).alias("ord", "stage"))


def known_stage(text: Column) -> Column:
    """Null for an unknown stage."""
    return F.when(text.isin(*STAGES), text)


def known_state(text: Column) -> Column:
    """Pending for an unknown state."""
    return F.when(text.isin(*STATES), text).otherwise("pending")


def reconcile(jobs: DataFrame, photos: DataFrame, now: Column) -> DataFrame:
    """Adds a pending row for each photo and stage without one."""
    wanted = photos.select(F.col("id").alias("photo_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])).alias("s")).select("photo_id", "s.stage", "s.ord")
    missing = wanted.join(jobs.select("photo_id", "stage"), ["photo_id", "stage"], "left_anti")
    none = F.lit(None).cast("string")
    new = missing.select("photo_id", "stage", "ord", F.lit("pending").alias("state"), none.alias("model"), F.lit(0).alias("attempts"), none.alias("error"), now.alias("updated_at"))
    return jobs.unionByName(new)


def adopt(jobs: DataFrame, photos: DataFrame, segments: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Untouched rows whose output is there are done: descriptions as 'legacy', segments and face
    sweeps with their latest model. Vectors are not adopted."""
    described = photos.where(F.trim("ai_description") != "").select(F.col("id").alias("photo_id"), F.lit("describe").alias("stage"), F.lit("legacy").alias("m"))
    segmented = segments.groupBy("photo_id").agg(F.max("model").alias("m")).select("photo_id", F.lit("segment").alias("stage"), "m")
    swept = sweeps.groupBy("photo_id").agg(F.max("model").alias("m")).select("photo_id", F.lit("faces").alias("stage"), "m")
    there = described.unionByName(segmented).unionByName(swept)
    out = jobs.join(there, ["photo_id", "stage"], "left")
    mine = F.col("m").isNotNull() & (F.col("state") == "pending") & (F.col("attempts") == 0)
    return out.withColumns({"model": F.when(mine, F.col("m")).otherwise(F.col("model")), "state": F.when(mine, "done").otherwise(F.col("state"))}).select(*jobs.columns)


def _waiting() -> Column:
    return (F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("attempts") < MAX_ATTEMPTS))


def runnable(jobs: DataFrame) -> DataFrame:
    """Rows that may run: waiting, and no earlier stage of the photo waiting or running. Claimed in the
    order of ord, attempts and photo_id."""
    blocking = jobs.where(_waiting() | (F.col("state") == "running")).groupBy("photo_id").agg(F.min("ord").alias("first"))
    return jobs.where(_waiting()).join(blocking, "photo_id").where(F.col("ord") <= F.col("first")).select(*jobs.columns)


CLAIM_ORDER = ("ord", "attempts", "photo_id")


def claim(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Sets the runnable rows running: all of them, or the first in claim order."""
    ready = runnable(jobs)
    ready = ready.orderBy(*CLAIM_ORDER).limit(limit) if limit else ready
    mine = ready.select("photo_id", "stage", F.lit(True).alias("_mine"))
    out = jobs.join(mine, ["photo_id", "stage"], "left")
    return out.withColumns({"state": F.when(F.col("_mine"), "running").otherwise(F.col("state")), "updated_at": F.when(F.col("_mine"), now).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """outcomes: photo_id, stage, outcome (done, failed, skipped, pending), model, error; one a job."""
    out = jobs.join(outcomes.select("photo_id", "stage", "outcome", F.col("model").alias("_model"), F.col("error").alias("_error")), ["photo_id", "stage"], "left")
    o = F.col("outcome")
    keep = lambda c, *cases: F.when(o.isNull(), F.col(c)).otherwise(F.coalesce(*cases))
    attempts = F.when(o == "done", 0).when(o == "failed", F.col("attempts") + 1).otherwise(F.col("attempts"))
    return out.select(
        "photo_id", "stage", "ord", F.coalesce(o, "state").alias("state"), F.when(o == "done", F.col("_model")).otherwise(F.col("model")).alias("model"), attempts.alias("attempts"),
        F.when(o.isNull(), F.col("error")).when(o.isin("failed", "skipped"), F.substring("_error", 1, MAX_ERROR)).alias("error"), keep("updated_at", now).alias("updated_at"),
    )


def _reset(jobs: DataFrame, which: Column, now: Column, attempts: bool = True) -> DataFrame:
    which = F.coalesce(which, F.lit(False))
    changed = {"state": F.when(which, "pending").otherwise(F.col("state")), "updated_at": F.when(which, now).otherwise(F.col("updated_at"))}
    if attempts:
        changed |= {"attempts": F.when(which, 0).otherwise(F.col("attempts")), "error": F.when(which, None).otherwise(F.col("error"))}
    return jobs.select("*").withColumns(changed).select(*jobs.columns)


def release_stale(jobs: DataFrame, now: Column) -> DataFrame:
    return _reset(jobs, (F.col("state") == "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(STALE.total_seconds())} SECONDS")), now, attempts=False)


def requeue(jobs: DataFrame, now: Column, stage: str | None = None, stale_for: str | None = None) -> DataFrame:
    """All rows, those of a stage, or those whose model is not the given one (none counts as another)."""
    which = F.lit(True)
    which = which & (F.col("stage") == stage) if stage else which
    which = which & ~F.col("model").eqNullSafe(F.lit(stale_for)) if stale_for else which
    return _reset(jobs, which, now)


def retry_stuck(jobs: DataFrame, now: Column) -> DataFrame:
    return _reset(jobs, (F.col("state") == "failed") & (F.col("attempts") >= MAX_ATTEMPTS), now)


def status(jobs: DataFrame) -> DataFrame:
    """Counts of every stage, also of those without rows, and the fraction finished (1 if none)."""
    is_ = lambda s: F.col("state") == s
    spent = F.col("attempts") >= MAX_ATTEMPTS
    count = jobs.groupBy("stage").agg(
        F.count_if(is_("done")).alias("done"), F.count_if(is_("pending") | is_("running")).alias("pending"), F.count_if(is_("failed") & ~spent).alias("failed"),
        F.count_if(is_("failed") & spent).alias("stuck"), F.count_if(is_("skipped")).alias("skipped"), F.count("*").alias("total"),
    )
    names = ["done", "pending", "failed", "stuck", "skipped", "total"]
    out = stages(jobs.sparkSession).join(count, "stage", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    fraction = F.when(F.col("total") > 0, (F.col("done") + F.col("skipped")) / F.col("total")).otherwise(1.0)
    return out.select("stage", "ord", *names, fraction.alias("fraction"))


def explain(jobs: DataFrame, photo_id: int) -> DataFrame:
    """A photo's stages in order; one that failed for good reads as skipped."""
    state = F.when((F.col("state") == "failed") & (F.col("attempts") >= MAX_ATTEMPTS), "skipped").otherwise(F.col("state"))
    return jobs.where(F.col("photo_id") == photo_id).select("stage", "ord", state.alias("state"), "model", "attempts", "error").orderBy("ord")


@dataclass(frozen=True)
class Handler:
    """A stage's work: the model's version, and a function from rows with photo_id and content_hash to
    photo_id, payload (null: nothing to do) and error (null: none)."""

    model: str | None
    execute: Callable[[DataFrame], DataFrame]


def run_stage(jobs: DataFrame, photos: DataFrame, cache: DataFrame, stage: str, handler: Handler | None, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over a stage's runnable rows: (jobs, cache, results). results: photo_id, payload,
    outcome (reused, computed, skipped, failed). Without a handler or model the rows are skipped; a
    cached payload is reused; what is computed goes into the cache."""
    ready = kept(runnable(jobs).where(F.col("stage") == stage).join(photos.select(F.col("id").alias("photo_id"), "content_hash"), "photo_id").select("photo_id", "content_hash"), "ready")
    used = [ready]
    text = lambda v: F.lit(v).cast("string")
    if handler is None or handler.model is None:
        results = ready.select("photo_id", "content_hash", text(None).alias("payload"), text("skipped").alias("outcome"), text("no model").alias("error"))
    else:
        asked = ready.withColumns({"stage": F.lit(stage), "model": F.lit(handler.model)})
        looked = kept(cache_get(asked, cache), "looked")
        used.append(looked)
        hits = looked.where("payload IS NOT NULL").select("photo_id", "content_hash", "payload", text("reused").alias("outcome"), text(None).alias("error"))
        made = handler.execute(looked.where("payload IS NULL").select("photo_id", "content_hash")).join(ready, "photo_id")
        outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("payload").isNull(), "skipped").otherwise("computed")
        results = hits.unionByName(made.select("photo_id", "content_hash", "payload", outcome.alias("outcome"), "error"))
    results = kept(results, "results")
    model = handler.model if handler else None
    done = F.when(F.col("outcome").isin("reused", "computed"), "done").otherwise(F.col("outcome"))
    outcomes = results.select("photo_id", F.lit(stage).alias("stage"), done.alias("outcome"), text(model).alias("model"), "error")
    new = results.where("outcome = 'computed'").dropDuplicates(["content_hash"]).select("content_hash", F.lit(stage).alias("stage"), text(model).alias("model"), "payload", now.alias("created_at"))
    out = kept(apply_outcomes(jobs, outcomes, now), "jobs"), kept(cache_put(cache, new), "cache")
    released(*used)
    told = results.select("photo_id", "payload", "outcome")
    told._lies_at = results._lies_at  # for released()
    return *out, told


def drain(jobs: DataFrame, photos: DataFrame, cache: DataFrame, handlers: dict[str, Handler], now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs the stages in order until nothing is runnable, or a pass has changed nothing."""
    before = None
    first = (jobs, cache)
    while True:
        seen = jobs.agg(F.count("*"), F.sum(F.xxhash64("photo_id", "stage", "state", "attempts", "model") % 1_000_000_007)).first()
        open_ = {r["stage"] for r in runnable(jobs).select("stage").distinct().collect()}  # at most four names
        if not open_ or seen == before:
            return jobs, cache
        before = seen
        for stage in (s for s in STAGES if s in open_):
            old = [t for t in (jobs, cache) if not any(t is f for f in first)]
            jobs, cache, results = run_stage(jobs, photos, cache, stage, handlers.get(stage), now)
            released(results, *old)


def utc(now: datetime) -> Column:
    return F.lit(now)
