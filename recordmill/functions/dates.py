"""Dates, zones, durations, timecodes."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col, round_half_up


def leading_date(text) -> Column:
    return F.nullif(F.regexp_extract(col(text), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")


def from_epoch(seconds) -> Column:
    return F.when(col(seconds) > 0, F.timestamp_seconds(col(seconds)))


def last_days(date, today: str, n: int) -> Column:
    """Inside the n days that end today, both ends included."""
    end = F.lit(today).cast("date")
    return col(date).between(F.date_sub(end, n - 1), end)


def add_fractional_months(date, months: float) -> Column:
    whole = int(months // 1)
    return F.date_add(F.add_months(col(date), whole), int((months - whole) * 30.44 + 0.5))


#: IANA names of time zones.
ZONES = sorted(available_timezones())


def _zoned(convert, at, zone) -> Column:
    """zone: a name, or a column of names; null where it is none."""
    if isinstance(zone, str):
        return convert(col(at), zone) if zone in ZONES else F.lit(None).cast("timestamp")
    return F.when(zone.isin(ZONES), convert(col(at), F.when(zone.isin(ZONES), zone).otherwise("UTC")))


def local_wall_clock(utc, zone) -> Column:
    return _zoned(F.from_utc_timestamp, utc, zone)


def local_to_utc(local, zone) -> Column:
    """Wall clock to UTC; a time that a change of clocks skips is taken as if it had not."""
    return _zoned(F.to_utc_timestamp, local, zone)


def days_between(start, end) -> Column:
    """Whole days from one date to another."""
    return F.datediff(col(end), col(start)).cast("long")


def add_days(date, n: int) -> Column:
    return F.date_add(col(date), n)


def epoch_millis(ms) -> Column:
    """Milliseconds since 1970 to a timestamp; null when not above 0."""
    return F.when(col(ms) > 0, F.timestamp_millis(col(ms).cast("long")))


def instant(value) -> Column:
    """Epoch seconds or an ISO text to a timestamp, else null."""
    text = col(value).cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{1,11}$"), from_epoch(text.try_cast("long"))), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")))


def english_date(text) -> Column:
    """A day, an English month (name or first three letters) and a year, such as '3 March 1998', to a date, else null."""
    shown = F.initcap(F.trim(col(text)))
    return F.coalesce(*[F.try_to_date(shown, form) for form in ("d MMM yyyy", "d MMMM yyyy")])


def descending_dates(latest: str, n: int) -> Column:
    """An array of the n dates that end at `latest`, newest first."""
    end = F.lit(latest).cast("date")
    return F.reverse(F.sequence(F.date_sub(end, n - 1), end))


def week_start(ts) -> Column:
    return F.date_trunc("week", col(ts)).cast("date")


def duration_seconds(text) -> Column:
    """'HH:MM:SS', 'MM:SS' or seconds."""
    parts = F.split(F.trim(col(text)), ":")
    good = col(text).rlike(r"^ *\d+(:\d{1,2}){0,2} *$")
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long")))


def timecode(seconds, mark: str = ",") -> Column:
    """Seconds to HH:MM:SS,mmm."""
    ms = round_half_up(F.greatest(col(seconds), F.lit(0.0)) * 1000).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(F.floor(ms / 3600000), 2), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(mark), pad(ms % 1000, 3))


def hours_and_minutes(minutes) -> Column:
    m = col(minutes).cast("long")
    h, rest = F.floor(m / 60), m % 60
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((rest > 0) | (h == 0), F.concat(rest.cast("string"), F.lit("m"))))


def season_code(text) -> Column:
    """'Summer 2025' to S25, others to null."""
    season = F.regexp_extract(F.lower(col(text)), r"^(winter|spring|summer|fall) (\d{4})$", 1)
    year = F.regexp_extract(F.lower(col(text)), r"^(winter|spring|summer|fall) (\d{4})$", 2)
    letter = F.when(season == "spring", "X").otherwise(F.upper(F.substring(season, 1, 1)))
    return F.when(season != "", F.concat(letter, F.substring(year, 3, 2)))


def relative_date(text, today: str) -> Column:
    """'30 days', '6 months', '+7' or a date."""
    n = F.nullif(F.regexp_extract(col(text), r"^\+?(\d+)", 1), F.lit("")).try_cast("int")
    now = F.lit(today).cast("date")
    return F.when(leading_date(text).isNotNull(), leading_date(text)).when(F.lower(col(text)).rlike(r"^\d+ months?$"), F.add_months(now, n)).when(F.lower(col(text)).rlike(r"^\+?\d+( days?)?$"), F.date_add(now, n))
