"""Driver-side objects over the tables: a library that calibrates once, the queue's owner, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.schedule import Schedule
from lumenlake.operators import jobs, vectors
from lumenlake.plans import search
from lumenlake.plans.query import Catalog, Query
from lumenlake.sources.store import ObjectStore, kept


@dataclass
class Settings:
    """Named values in one JSON object of a store."""

    store: ObjectStore
    key: str = "settings.json"

    def _all(self) -> dict[str, str]:
        try:
            return dict(json.loads(self.store.read(self.key) or b"{}"))
        except (ValueError, TypeError):
            return {}

    def get(self, name: str, default: str | None = None) -> str | None:
        return self._all().get(name, default)

    def set(self, name: str, value: str) -> None:
        self.store.write(self.key, json.dumps(self._all() | {name: value}, sort_keys=True).encode())


@dataclass
class Library:
    """Search with the hub of a reference bank. The hub is made again whenever the number of vectors has
    changed, so vectors that come later are corrected too; without a bank scores stay raw."""

    catalog: Catalog
    embeddings: DataFrame | None = None
    bank: list[list[float]] = field(default_factory=list)
    vocabulary: DataFrame | None = None
    _rows: int = -1
    _calibrated: DataFrame | None = None

    def calibrated(self) -> DataFrame | None:
        if self.embeddings is None:
            return None
        rows = self.embeddings.count()
        if rows != self._rows:
            usable = vectors.one_width(self.embeddings)
            width = usable.select(F.size("vector")).first()
            mean = vectors.bank_mean(self.bank, width[0]) if width and self.bank else None
            self._calibrated = kept(vectors.with_hub(usable, mean), "hub") if mean else usable
            self._rows = rows
        return self._calibrated

    def search(self, q: Query, vector: list[float] | None = None, strict: bool = False) -> search.Result:
        return search.search(self.catalog, q, self.calibrated() if vector else None, vector, self.vocabulary, strict)


@dataclass
class QueueService:
    """The queue with its tables, schedule and handlers; each step replaces the tables it changes."""

    catalog: Catalog
    jobs: DataFrame
    cache: DataFrame
    sweeps: DataFrame
    handlers: dict[str, jobs.Handler] = field(default_factory=dict)
    schedule: Schedule = field(default_factory=Schedule)

    def start(self, now: datetime) -> None:
        """Adds missing rows, takes over finished work, frees stale claims."""
        at = F.lit(now)
        out = jobs.reconcile(self.jobs, self.catalog.photos, at)
        out = jobs.adopt(out, self.catalog.photos, self.catalog.segments, self.sweeps) if self.catalog.segments is not None else out
        self.jobs = kept(jobs.release_stale(out, at), "jobs")

    def tick(self, now: datetime) -> bool:
        """Runs what is runnable if the schedule is open; false if it is not."""
        if not self.schedule.is_open(now):
            return False
        self.run_now(now)
        return True

    def run_now(self, now: datetime) -> None:
        self.jobs, self.cache = jobs.drain(self.jobs, self.catalog.photos, self.cache, self.handlers, F.lit(now))

    def retry(self, now: datetime) -> None:
        self.jobs = kept(jobs.retry_stuck(self.jobs, F.lit(now)), "jobs")

    def status(self) -> DataFrame:
        return jobs.status(self.jobs)
