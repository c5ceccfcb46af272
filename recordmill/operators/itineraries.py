"""Itineraries: legs put together with their layovers, priced listings, and re-emission when a price changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import col, join_keys

#: Columns that a leg has, besides the keys of its itinerary.
LEG = ("departs", "arrives", "number", "carrier", "origin", "destination")


def _minutes(start: Column, end: Column) -> Column:
    """Whole minutes; of times without a zone those of the clock."""
    return (end - start).cast("interval minute").cast("long")


def join_legs(legs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per itinerary from its legs (columns LEG, times as timestamps), in order of departure.

    layovers holds struct(place, minutes) between consecutive legs; connected is false where a leg
    starts elsewhere than the one before it ended, or before that had arrived.  A leg without a
    departure comes first and leaves the times next to it null, and connected with them.  An itinerary is one row, so its legs are
    gathered; a null key is a key like others.
    """
    all_ = F.sort_array(F.collect_list(F.struct(*LEG))).alias("legs")
    rows = legs.groupBy(*keys).agg(all_)
    first, last = F.get("legs", F.lit(0)), F.element_at("legs", -1)
    at = lambda i: F.get(F.col("legs"), i)
    between = F.transform(
        F.slice("legs", 2, F.size("legs")),
        lambda leg, i: F.struct(at(i)["destination"].alias("place"), _minutes(at(i)["arrives"], leg["departs"]).alias("minutes"), at(i)["destination"].eqNullSafe(leg["origin"]).alias("same")),
    )
    rows = rows.withColumn("__between", between)
    return rows.select(
        *keys,
        first["origin"].alias("origin"),
        last["destination"].alias("destination"),
        first["departs"].alias("departs"),
        last["arrives"].alias("arrives"),
        _minutes(first["departs"], last["arrives"]).alias("minutes"),
        F.size("__between").cast("long").alias("stops"),
        F.transform("__between", lambda b: F.struct(b["place"].alias("place"), b["minutes"].alias("minutes"))).alias("layovers"),
        F.transform("legs", lambda leg: leg["number"]).alias("numbers"),
        F.array_distinct(F.array_compact(F.transform("legs", lambda leg: leg["carrier"]))).alias("carriers"),
        F.forall("__between", lambda b: b["same"] & (b["minutes"] >= 0)).alias("connected"),
    )


def itinerary_key(search: list[str], numbers: str = "numbers", departs: str = "departs") -> Column:
    """Identity across runs: what was searched, the numbers of the legs, and the departure; a missing part is blank."""
    parts = [*[F.col(c).cast("string") for c in search], F.array_join(numbers, ",", ""), F.date_format(departs, "yyyy-MM-dd HH:mm")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def price_mark(amount, currency) -> Column:
    """The fingerprint of a price."""
    return F.concat_ws(" ", col(amount).cast("string"), col(currency))


def priced(df: DataFrame, search: list[str], order: list, price: str, most: int) -> DataFrame:
    """The first `most` rows of each search that have a price, with rank and is_cheapest (of all priced ones, shown or not).

    The least price is aggregated before it is shuffled and the rank is cut by Spark's group
    limit on the map side, so that a search of very many rows is never in one task.
    """
    some = df.where(F.col(price) > 0)
    least = some.groupBy(*search).agg(F.min(price).alias("__least"))
    ranked = some.withColumn("__rank", F.row_number().over(Window.partitionBy(*search).orderBy(*order))).where(F.col("__rank") <= most)
    out = join_keys(ranked, least, search)
    return out.withColumns({"rank": F.col("__rank").cast("long"), "is_cheapest": F.col(price) == F.col("__least")}).drop("__rank", "__least")


def latest_marks(seen: DataFrame, current: DataFrame, key: str, mark: str) -> DataFrame:
    """State after a run: every key known or listed now, with its price of now, else the one known."""
    now = current.groupBy(key).agg(F.max(mark).alias(mark))
    return join_keys(seen.select(key, mark), now.select(key), [key], "left_anti").unionByName(now)
