"""Whole pipelines of the record feeds, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import discount_percent
from ..functions.predicates import scan_cap
from ..operators import enrich, ordered, series, state
from ..sources.adapters import Adapter, read_adapters
from ..types import join_keys


def registrations(adapters: list[Adapter], wanted: dict, key: list[str], order: list, category: Column, keep: list[str], most: int) -> DataFrame:
    """Several sources in one shape, filtered by category, one of each in turn up to a cap."""
    rows = read_adapters(adapters, wanted).withColumn("category", category).where(F.col("category").isin(keep))
    turns = ordered.with_rank(ordered.first_wins(rows, ["source", *key], order), ["source"], order, "turn")
    return turns.orderBy("turn", "source").limit(most)


def monitored_reviews(current: DataFrame, previous: DataFrame, group: list[str], key: str, when: str, rating: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(new reviews newest first, watermarks after the run)."""
    fresh = state.watermark_monitor(current.where(rating), previous, group, key, when)
    emitted = ordered.top_per_group(fresh, group, [F.col(when).desc(), key], most)
    marks = previous.groupBy(*group).agg(F.max(when).alias("watermark"))
    latest = emitted.groupBy(*group).agg(F.max(when).alias("latest"), (F.count(F.lit(1)) < most).alias("complete"))
    return emitted, state.next_watermarks(marks, latest, group, "complete")


def tracked_ranks(current: DataFrame, previous: DataFrame, wanted: DataFrame, lists: list[str], item: str, visible: int, least: int) -> DataFrame:
    """Rank changes and rows for wanted items that are in no list."""
    changes = state.rank_changes(current, previous, lists, item, "rank", visible, least)
    absent = state.missing_wanted(wanted, current, [*lists, item]).withColumn("change", F.lit("notRanked"))
    return changes.unionByName(absent, allowMissingColumns=True)


def explore(points: DataFrame, term: str, at: str, value: str, anchor: str) -> DataFrame:
    """Series of all batches on one 0..100 scale."""
    return series.rescale(points, "batch", term, at, value, anchor)


def radar(listing: DataFrame, detail: DataFrame, key: str, end: str, window: tuple[str, str], floor: float, amounts: list[str], fields: list[str], seen: DataFrame) -> DataFrame:
    """Rows whose end lies in a window, enriched, above a value floor, only new ones, soonest first."""
    rows = enrich.detail_over_listing(listing.where(F.col(end).between(*window)), detail, key, fields)
    worth = rows.where(F.coalesce(*[F.col(a) for a in amounts], F.lit(0.0)) >= floor)
    return state.only_new(worth, seen, [key]).orderBy(end, key)


def hot_boards(boards: list[DataFrame], most: int) -> DataFrame:
    """Rows of several boards in one shape, capped per board; a missing rank is the place in the board."""
    rows = enrich.union_of(boards)
    ranked = ordered.with_rank(rows, ["board"], ["seq"], "__at").withColumn("rank", F.coalesce("rank", "__at")).drop("__at")
    return ordered.top_per_group(ranked, ["board"], ["rank", "seq"], most)


def best_page(pages: DataFrame, site: str, score: Column, order: list) -> DataFrame:
    """The page of highest score of each site."""
    return ordered.first_wins(pages.withColumn("score", score), [site], [F.col("score").desc(), *order])


def listing_changes(current: DataFrame, previous: DataFrame, key: list[str], mark: str, seen_at: str, most_removed: int, complete: bool = True) -> DataFrame:
    """Rows of new and updated listings and, after a complete crawl, those gone longest, each with its `change`."""
    told = state.change_feed(current, previous, key, mark, complete=False).where("change <> 'unchanged'")
    changed = join_keys(current, told, key)
    if not complete:
        return changed
    gone = state.removed(previous, current, key, seen_at, most_removed).withColumn("change", F.lit("removed"))
    return changed.unionByName(gone, allowMissingColumns=True)


def job_sites(sites: list[Adapter], wanted: Column, key: list[str], order: list, most: int) -> DataFrame:
    """Several sites in one shape, filtered, each key once per site, under one cap that they share fairly."""
    rows = ordered.first_wins(read_adapters(sites, {}).where(wanted), ["source", *key], order)
    return ordered.fair_share(rows, "source", order, most)


def archive(posts: DataFrame, seen: DataFrame, by: list[str], key: str, at: str, since: str, known_in_a_row: int) -> DataFrame:
    """New posts of each archive, newest first, up to so many in a row that are too old or known."""
    known = posts.join(seen.select(F.col(key), F.lit(True).alias("__known")).distinct(), key, "left")
    old = (F.col(at) < F.lit(since).cast("timestamp_ntz")) | F.coalesce("__known", F.lit(False))
    return ordered.stop_after_streak(known, by, [F.col(at).desc(), key], old, known_in_a_row).drop("__known")


def capped_reviews(reviews: DataFrame, by: list[str], order: list, wanted: Column, most: int) -> DataFrame:
    """The first `most` wanted reviews of each app among those that are read for so many."""
    scanned = ordered.top_per_group(reviews, by, order, scan_cap(most))
    return ordered.top_per_group(scanned.where(wanted), by, order, most)


def product_search(current: DataFrame, seen: DataFrame, key: list[str], order: list, price: str, original: str) -> DataFrame:
    """Products of a search, each once and only new ones, with the per cent that is taken off."""
    fresh = state.only_new(ordered.first_wins(current, key, order), seen, key)
    return fresh.withColumn("percent", discount_percent(price, original))
