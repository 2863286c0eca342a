"""Schedules as tables: cron ticks, heartbeats and lifecycle events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names for whole schedules, and of months and weekdays.
ALIASES = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


@dataclass(frozen=True)
class Cron:
    """A five-field schedule. Day of month and day of week are alternatives where both are restricted."""

    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool

    @classmethod
    def parse(cls, text: str) -> Cron:
        fields = ALIASES.get(text.strip().lower(), text).split()
        if len(fields) != 5:
            raise ValueError(f"a schedule has five fields: {text!r}")
        sets = [cls._field(f, i) for i, f in enumerate(fields)]
        sets[4] = frozenset(d % 7 for d in sets[4])
        return cls(*sets, fields[2].startswith(("*", "?")), fields[4].startswith(("*", "?")))

    @staticmethod
    def _field(text: str, which: int) -> frozenset[int]:
        low, high = RANGES[which]
        names = {3: (MONTHS, 1), 4: (DAYS, 0)}.get(which)

        def one(x: str) -> int:
            if names and x.lower() in names[0]:
                return names[0].index(x.lower()) + names[1]
            n = int(x)
            if not low <= n <= high:
                raise ValueError(f"{x} is not within {low}-{high}")
            return n

        out: set[int] = set()
        for part in text.split(","):
            part, _, step = part.partition("/")
            if part in ("*", "?"):
                a, b = low, 6 if which == 4 else high
            elif "-" in part:
                a, b = map(one, part.split("-", 1))
            else:
                a = one(part)
                b = high if step else a
            out.update(range(a, b + 1, int(step or 1)))
        return frozenset(out)

    def matches(self, at: Column) -> Column:
        """Whether a local time is one of the schedule's minutes."""
        day, weekday = F.dayofmonth(at).isin(*self.days), (F.dayofweek(at) - 1).isin(*self.weekdays)
        either = day & weekday if self.any_day or self.any_weekday else day | weekday
        return F.minute(at).isin(*self.minutes) & F.hour(at).isin(*self.hours) & F.month(at).isin(*self.months) & either

    def hit(self, at: datetime) -> bool:
        return at.minute in self.minutes and at.hour in self.hours and self._day(at)

    def next_after(self, after: datetime, zone: str = "UTC") -> datetime | None:
        """The first tick strictly after a UTC time, in UTC; None where there is none within nine years."""
        there = ZoneInfo(zone)
        local = after.replace(tzinfo=UTC).astimezone(there).replace(tzinfo=None)
        day, least = local.replace(hour=0, minute=0, second=0, microsecond=0), after
        for _ in range(9 * 366):
            if self._day(day):
                for hour in sorted(self.hours):
                    for minute in sorted(self.minutes):
                        at = day.replace(hour=hour, minute=minute)
                        if at >= local - timedelta(hours=3):
                            at = at.replace(tzinfo=there).astimezone(UTC).replace(tzinfo=None)
                            if at > least:
                                return at
            day += timedelta(days=1)
        return None

    def _day(self, at: datetime) -> bool:
        day, weekday = at.day in self.days, at.isoweekday() % 7 in self.weekdays
        return at.month in self.months and (day and weekday if self.any_day or self.any_weekday else day or weekday)


def cron_ticks(bounds: DataFrame, schedule: str, zone: str = "UTC") -> DataFrame:
    """Every tick strictly after ``start`` and up to ``stop`` of a one-row table, as column tick (UTC)."""
    cron = Cron.parse(schedule)
    # Days first: only those that can match are cut into minutes.
    days = bounds.select("start", "stop", F.explode(F.sequence(F.date_trunc("day", "start"), F.col("stop"), F.expr("interval 1 day"))).alias("day"))
    minutes = F.sequence(F.col("day"), F.col("day") + F.expr("interval 1439 minutes"), F.expr("interval 1 minute"))
    ticks = days.select("start", "stop", F.explode(minutes).alias("tick"))
    return ticks.where(cron.matches(F.from_utc_timestamp("tick", zone)) & (F.col("tick") > F.col("start")) & (F.col("tick") <= F.col("stop"))).select("tick")


def heartbeats(bounds: DataFrame, seconds: int, delay: int = 0) -> DataFrame:
    """(datetime, seq, runtime_us): pulses every so many seconds after start and delay."""
    if seconds <= 0:
        raise ValueError("an interval is positive")
    first = F.col("start") + F.make_dt_interval(secs=F.lit(seconds + delay))
    pulses = F.when(first <= F.col("stop"), F.sequence(first, F.col("stop"), F.make_dt_interval(secs=F.lit(seconds))))
    made = bounds.select("start", F.posexplode(pulses).alias("seq", "datetime"))
    return made.select("datetime", F.col("seq").cast("long").alias("seq"), (F.unix_micros("datetime") - F.unix_micros("start")).alias("runtime_us"))


def with_lifecycle(events: DataFrame, restored: bool = False) -> DataFrame:
    """Events between the engine's start (or restoration) and stop, as (event, at)."""
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    marks = F.array(
        F.struct(F.lit("engine:restored" if restored else "engine:start").alias("event"), F.col("a").alias("at")),
        F.struct(F.lit("engine:stop").alias("event"), F.col("b").alias("at")),
    )
    control = ends.where("a is not null").select(F.inline(marks))
    return events.select(F.col("event_type").alias("event"), F.col("ts").alias("at")).unionByName(control)
