"""When the queue may run, as a Python value and as an expression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("off", "always", "window")


@dataclass(frozen=True)
class Schedule:
    mode: str = "always"
    start: time = time(22, 0)
    end: time = time(6, 0)
    gap_seconds: int = 20

    def is_open(self, now: datetime) -> bool:
        if self.mode != "window":
            return self.mode == "always"
        if self.start == self.end:
            return True
        after, before = now.time() >= self.start, now.time() < self.end
        return (after and before) if self.start < self.end else (after or before)

    def next_opening(self, now: datetime) -> datetime | None:
        """Null while it is open, or if it never opens."""
        if self.mode != "window" or self.is_open(now):
            return None
        today = datetime.combine(now.date(), self.start)
        return today if today > now else today + timedelta(days=1)

    def to_text(self) -> str:
        return f"{self.mode};{self.start:%H:%M};{self.end:%H:%M};{self.gap_seconds}"

    @classmethod
    def from_text(cls, text: str | None) -> Schedule:
        """The default, whole or for each part, where it cannot be read."""
        parts, default = (text or "").split(";"), cls()
        if len(parts) != 4:
            return default

        def clock(part: str, otherwise: time) -> time:
            m = re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)", part)
            return time(int(m[1]), int(m[2])) if m else otherwise

        gap = int(parts[3]) if re.fullmatch(r"\s*\+?\d{1,9}\s*", parts[3]) else default.gap_seconds
        return cls(parts[0] if parts[0] in MODES else default.mode, clock(parts[1], default.start), clock(parts[2], default.end), gap)

    def open_at(self, ts: Column) -> Column:
        """The same as is_open for a column of timestamps."""
        if self.mode != "window" or self.start == self.end:
            return F.lit(self.mode != "off")
        minute = F.hour(ts) * 60 + F.minute(ts)
        after, before = minute >= self.start.hour * 60 + self.start.minute, minute < self.end.hour * 60 + self.end.minute
        return (after & before) if self.start < self.end else (after | before)
