"""Search windows around an event and offsets from it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Plan:
    """An event and the days searched before and after. Without a known time the whole event day is left out."""

    event: dt.datetime
    before_days: int
    after_days: int
    time_known: bool = False

    def __post_init__(self) -> None:
        for days in (self.before_days, self.after_days):
            if not 1 <= days <= 365:
                raise ValueError("a window has 1 to 365 days")

    @property
    def split(self) -> dt.datetime:
        return self.event if self.time_known else dt.datetime.combine(self.event.date(), dt.time())

    @property
    def before(self) -> tuple[dt.datetime, dt.datetime]:
        return self.split - dt.timedelta(days=self.before_days), self.split

    @property
    def after(self) -> tuple[dt.datetime, dt.datetime]:
        start = self.split if self.time_known else self.split + dt.timedelta(days=1)
        return start, self.split + dt.timedelta(days=self.after_days)

    @property
    def extent(self) -> tuple[dt.datetime, dt.datetime]:
        """What one search over both windows spans."""
        return min(self.before[0], self.after[0]), max(self.before[1], self.after[1])

    def side(self, ts: Column) -> Column:
        """before, after or NULL by half-open windows."""
        within = lambda w: (ts >= instant(w[0])) & (ts < instant(w[1]))
        return F.when(within(self.before), "before").when(within(self.after), "after")

    def offset(self, ts: Column) -> Column:
        """Microseconds between ts and the split, unsigned."""
        return F.abs(F.timestamp_diff("MICROSECOND", instant(self.split), ts))


def parse_instant(text: Column, naive_is_utc: bool) -> Column:
    """An ISO-8601 text as a UTC instant; texts without a zone are NULL unless naive_is_utc; a day is its midnight."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.try_to_timestamp(text)).when(F.lit(naive_is_utc), F.try_to_timestamp(F.concat(text, F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), "T00:00:00Z").otherwise("Z"))))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_apart(a: Column, b: Column) -> Column:
    """Days between two instants in hundredths, halves up."""
    return F.floor(F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 864e6 + 0.5).cast("bigint")


def snapshot(event_day: Column, latest: Column) -> Column:
    """The day before the event, or the latest there is, if that is earlier."""
    return F.least(F.date_sub(event_day, 1), latest)


def resolved_snapshot(event_day: Column, latest: Column, requested: Column | None = None) -> Column:
    """The instant whose features are taken: midnight before the day before the event, capped at the latest there is; or
    the requested one, where there is one. One later than the latest, or not before the event day, is an error."""
    start = event_day.cast("date").cast("timestamp")
    usual = F.least(start - F.expr("INTERVAL 1 DAY"), latest)
    taken = usual if requested is None else F.coalesce(requested, usual)
    fails = lambda why: F.raise_error(F.concat(F.lit("snapshot "), iso(taken), F.lit(f" is {why}"))).cast("timestamp")
    return F.when(taken > latest, fails("later than the latest there is")).when(taken >= start, fails("not before the event day")).otherwise(taken)
