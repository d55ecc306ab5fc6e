"""Local time without the session zone: every conversion names its zone."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def local_time(ms: Column, tz: str) -> Column:
    """Epoch milliseconds as wall-clock time (TIMESTAMP_NTZ) in the zone."""
    utc = F.expr(EPOCH) + F.make_dt_interval(secs=ms.cast("decimal(18,3)") / F.lit(1000))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc.cast("timestamp_ntz"))


def wall_micros(local: Column) -> Column:
    """Microseconds on the wall clock since 1970.

    Put together from its parts: a difference of timestamps goes by the session zone, where an hour
    may be missing.
    """
    days = F.date_diff(F.to_date(local), F.lit(date(1970, 1, 1))).cast("bigint")
    minutes = (days * 24 + F.hour(local)) * 60 + F.minute(local)
    seconds = F.extract(F.lit("SECOND"), local)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def epoch_ms(local: Column, tz: str) -> Column:
    """Wall-clock time in the zone as epoch milliseconds."""
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), local.cast("timestamp_ntz"))
    # the zone is looked up once, not for each part of the time
    return F.get(F.transform(F.array(utc), lambda at: F.floor(wall_micros(at) / 1000).cast("bigint")), F.lit(0))


def iso_millis(local: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSS of a wall-clock time."""
    millis = F.floor(F.extract(F.lit("SECOND"), local) * 1000) / 1000
    second = F.lpad(millis.cast("decimal(5,3)").cast("string"), 6, "0")
    parts = [F.lpad(part(local).cast("string"), 2, "0") for part in (F.hour, F.minute)]
    return F.concat(F.to_date(local).cast("string"), F.lit("T"), F.concat_ws(":", *parts, second))


def ntz(moment: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{moment.strftime('%Y-%m-%d %H:%M:%S.%f')}'")


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """Year, month and day with overflow carried on: 31 February is 3 March."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.date_add(first, day - 1)


def four_digit_year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


@dataclass(frozen=True)
class Span:
    """A period with both ends included."""

    start: datetime
    end: datetime

    def covers(self, moment: Column) -> Column:
        return moment.between(ntz(self.start), ntz(self.end))


def _month_start(moment: datetime, back: int = 0) -> datetime:
    months = moment.year * 12 + moment.month - 1 - back
    return datetime(months // 12, months % 12 + 1, 1)


def period(name: str, now: datetime) -> Span:
    """this_month, last_month, last3, last30 or all, seen from ``now``."""
    if name == "this_month":
        return Span(_month_start(now), now)
    if name == "last_month":
        return Span(_month_start(now, 1), _month_start(now) - timedelta(milliseconds=1))
    if name == "last3":
        return Span(_month_start(now, 2), now)
    if name == "last30":
        return Span(now - timedelta(days=30), now)
    if name == "all":
        return Span(datetime(1970, 1, 1), now)
    raise ValueError(f"unknown period: {name}")


def days_in_month(moment: datetime) -> int:
    following = _month_start(moment, -1)
    return (following - timedelta(days=1)).day


def day_span(day: date) -> Span:
    start = datetime(day.year, day.month, day.day)
    return Span(start, start + timedelta(days=1) - timedelta(microseconds=1))
