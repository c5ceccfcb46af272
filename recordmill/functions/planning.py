"""Small parsers and planners of searches: counts, ids, routes, searches, places, time zones' days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import col, round_half_up
from .text import slug, squash

#: What the longest product ids are moved by.
ID_OFFSET = 1 << 51


def sold_count(text) -> Column:
    """Whole number of a count as shops show it.

    With a unit ('7.5k bought', '3 mil') the sign inside is a decimal one; without ('12,345 bought') signs only part thousands.
    """
    shown = F.lower(col(text))
    unit = F.regexp_extract(shown, r"\d\s*(k|mil|m)\b", 1)
    amount = F.replace(F.regexp_extract(shown, r"(\d+(?:[.,]\d+)?)\s*(?:k|mil|m)\b", 1), F.lit(","), F.lit(".")).try_cast("double")
    whole = F.regexp_replace(F.regexp_extract(shown, r"\d+(?:[.,\s]\d+)*", 0), r"\D", "").try_cast("long")
    return F.when(unit == "", whole).otherwise(round_half_up(amount * F.when(unit == "m", 1_000_000).otherwise(1_000)).cast("long"))


def plain_product_id(product) -> Column:
    """Ids of 16 or 17 digits without the offset, others as they are."""
    return F.when(col(product).rlike(r"^\d{16,17}$") & (col(product).try_cast("long") > ID_OFFSET), (col(product).try_cast("long") - ID_OFFSET).cast("string")).otherwise(col(product))


def fit_width(width, height, most) -> Column:
    """struct(width, height, scaled): at most so wide, sides even, never larger than before."""
    scaled = col(width) > most
    even = lambda x: F.greatest(round_half_up(x / 2) * 2, F.lit(2)).cast("long")
    return F.struct(
        F.when(scaled, even(F.lit(most) * 1.0)).otherwise(col(width).cast("long")).alias("width"),
        F.when(scaled, even(col(height) * most / col(width))).otherwise(col(height).cast("long")).alias("height"),
        scaled.alias("scaled"),
    )


def route(text) -> Column:
    """'JFK-LHR 2026-11-15 [2026-11-20]' to struct(origin, destination, date, back); null unless both airports are codes."""
    part = lambda i: F.nullif(F.upper(F.regexp_extract(F.trim(col(text)), r"^([A-Za-z]{3})\s*(?:-|–|>|to|\s)\s*([A-Za-z]{3})(?:\s+(\d{4}-\d{2}-\d{2}))?(?:\s+(\d{4}-\d{2}-\d{2}))?$", i)), F.lit(""))
    day = lambda i: F.try_to_date(part(i), "yyyy-MM-dd")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("origin"), part(2).alias("destination"), day(3).alias("date"), day(4).alias("back")))


def searches(spark: SparkSession, what: list[str], where: list[str]) -> DataFrame:
    """Every pair of two short parameter lists, blanks and repeats left out: what, where and the search's key."""
    tidy = lambda items: list(dict.fromkeys(x.strip() for x in items if x and x.strip()))
    pairs = [(a, b) for a in tidy(what) for b in tidy(where) or [""]]
    df = spark.createDataFrame(pairs, "what string, where string")
    return df.withColumn("key", F.concat_ws("--", slug("what"), slug("where")))


def dated_searches(df: DataFrame, start: str, end: str, step_days: int = 1) -> DataFrame:
    """A row for each day of the range of dates of each row."""
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr(f"INTERVAL {step_days} DAY"))
    return df.withColumn("date", F.explode(F.when(F.col(start) <= F.col(end), days)))


def place_slug(place) -> Column:
    """'ca--los Angeles' keeps its '--' between region and city."""
    return F.array_join(F.transform(F.split(col(place), "--"), lambda x: F.coalesce(slug(x), F.lit(""))), "--")


def places(text) -> Column:
    """'A / B / a' to a list, each once."""
    items = F.filter(F.transform(F.split(col(text), " / "), lambda x: squash(x)), lambda x: x.isNotNull())
    return F.array_distinct(items)


def zone_day(utc, zone: str) -> Column:
    """Calendar date in a zone."""
    return F.from_utc_timestamp(col(utc), zone).cast("date")


def zone_midnight(day, zone: str) -> Column:
    """The instant (UTC) at which a date begins in a zone."""
    return F.to_utc_timestamp(col(day).cast("timestamp"), zone)


def time_of_parts(date, time) -> Column:
    """[2026, 11, 5] and [7, null] to '2026-11-05T07:00'; null without a whole date."""
    d, t = col(date), F.coalesce(col(time), F.array().cast("array<int>"))
    two = lambda x: F.lpad(F.coalesce(x, F.lit(0)).cast("string"), 2, "0")
    return F.when(F.size(d) >= 3, F.concat(F.lpad(F.get(d, F.lit(0)).cast("string"), 4, "0"), F.lit("-"), two(F.get(d, F.lit(1))), F.lit("-"), two(F.get(d, F.lit(2))), F.lit("T"), two(F.get(t, F.lit(0))), F.lit(":"), two(F.get(t, F.lit(1)))))


def geo_code(text) -> Column:
    """Upper-case code; UK is GB, world and worldwide are blank."""
    code = F.upper(F.trim(col(text)))
    return F.when(code.isin("WORLD", "WORLDWIDE"), "").when(code == "UK", "GB").when(code.startswith("UK-"), F.concat(F.lit("GB"), F.substring(code, 3, 100))).otherwise(code)


def uploads_list(channel, tab: str = "videos") -> Column:
    """Id of the list of a channel's uploads: the channel id's UC becomes the tab's letters."""
    lead = {"videos": "UULF", "shorts": "UUSH", "streams": "UULV"}.get(tab, "UU")
    return F.when(col(channel).startswith("UC"), F.concat(F.lit(lead), F.substring(col(channel), 3, 100)))


def star_filters(wanted: list[int], expected: int, ceiling: int) -> list[list[int]]:
    """One filter of all wanted stars, or one for each when more rows are expected than a filter can page through."""
    return [[s] for s in wanted] if expected > ceiling else [wanted]


def mostly_stamped(stamps, share: float = 0.8, least: int = 2) -> Column:
    """Whether enough paragraphs (an array of their time stamps) carry one."""
    held = F.size(F.array_compact(col(stamps)))
    return (held >= least) & (held >= share * F.size(col(stamps)))
