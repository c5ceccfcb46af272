"""Numbers in text, money, ranges, billing arithmetic and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col, number, round_half_up

MILLIONTHS = 1_000_000


def money(text) -> Column:
    """'$1,234.50' to 1234.5."""
    return number(F.regexp_replace(col(text), r"[$€£, ]", ""))


def compact(text) -> Column:
    """'10.6M', '6.43K', '24 240' to a whole number."""
    t = F.upper(F.regexp_replace(col(text), "[ ,]", ""))
    n = number(F.nullif(F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 1), F.lit("")))
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 2)
    return round_half_up(n * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)).cast("long")


def pay_range(text) -> Column:
    """'$80K - $120K' to struct(low, high, currency)."""
    t = F.upper(F.regexp_replace(col(text), "[, ]", ""))
    part = lambda i: compact(F.regexp_extract(t, r"^[$€£]?([0-9.]+[KMB]?)-[$€£]?([0-9.]+[KMB]?)", i))
    currency = F.when(F.contains(t, F.lit("$")), "USD").when(F.contains(t, F.lit("€")), "EUR").when(F.contains(t, F.lit("£")), "GBP")
    return F.struct(part(1).alias("low"), part(2).alias("high"), currency.alias("currency"))


def pay_period(text) -> Column:
    """hour, day, week, month or year of 'per hour', '/ month', 'a year', 'p.a.', 'annually', 'weekly'; else null."""
    t = F.lower(col(text))
    unit = F.regexp_extract(t, r"(?:\bper|/|\ban?)\s*(hour|hr|day|week|wk|month|mo|year|yr|annum)\b", 1)
    adverb = F.regexp_extract(t, r"\b(hourly|daily|weekly|monthly|yearly|annually|annual|p\.\s?a)\b", 1)
    found = F.coalesce(F.nullif(unit, F.lit("")), F.nullif(adverb, F.lit("")))
    out = F.when(found.rlike("^h"), "hour").when(found.rlike("^d"), "day").when(found.rlike("^w"), "week").when(found.rlike("^m"), "month")
    return out.when(found.rlike("^(y|a|p)"), "year")


def affordable(wanted, price, budget) -> Column:
    """How many of the wanted rows a budget pays for, in whole units; a price of nothing sets no bound."""
    return F.when(col(price) > 0, F.least(col(wanted).cast("long"), F.greatest(F.floor(col(budget) / col(price)), F.lit(0)).cast("long"))).otherwise(col(wanted).cast("long"))


def experience_years(text) -> Column:
    """'3-5 years' to 3; 'any' and 'fresher' to 0."""
    t = F.lower(col(text))
    return F.when(t.rlike("any|fresher|new grad"), 0).otherwise(F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).try_cast("int")).cast("long")


def fallback_at_least(bound: float, *columns) -> Column:
    """The first known amount (0 if none) reaches the bound."""
    return F.coalesce(*[col(c) for c in columns], F.lit(0)) >= bound


def cost_millionths(counts_and_prices: list[tuple[str, float]]) -> Column:
    """Whole millionths: each price is rounded before it is multiplied."""
    return sum((col(c).cast("long") * F.lit(int(p * MILLIONTHS + 0.5)) for c, p in counts_and_prices), F.lit(0)).cast("long")


def fit_inside(width, height, most_w: int, most_h: int, even: bool = True) -> Column:
    """Size inside a box, never larger than before, even numbers if asked."""
    scale = F.least(F.lit(1.0), F.lit(most_w) / col(width), F.lit(most_h) / col(height))
    step = 2 if even else 1
    side = lambda x: F.greatest(F.floor(col(x) * scale / step + 0.5) * step, F.lit(step)).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def billed_minutes(seconds, grace: float = 1.0) -> Column:
    return F.greatest(F.lit(1), F.ceil((col(seconds) - grace) / 60 - 1e-9)).cast("long")


def percent_saved(before, after) -> Column:
    return round_half_up((1 - col(after) / col(before)) * 100, 1)


def ratio_text(text) -> Column:
    """'30000/1001' to 29.97."""
    n, d = F.split_part(col(text), F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(col(text), F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(d > 0, round_half_up(n / d, 2))


def stars(score_100) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(col(score_100) / 20 + 0.5))).cast("long")


def discount_percent(price, original) -> Column:
    return F.when(col(original) > col(price), F.floor((1 - col(price) / col(original)) * 100 + 0.5)).cast("long")


def fingerprint(*columns, size: int = 12) -> Column:
    """Hash prefix over columns in the given order, nulls told from blanks."""
    parts = [F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("~")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)
