"""Operators across runs: (state, current rows) to (rows to emit, next state), in batch."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import join_keys


def only_new(current: DataFrame, seen: DataFrame, key: list[str], mark: str | None = None) -> DataFrame:
    """Rows whose key is unknown, or known with another mark (fingerprint); a null key is a key like others."""
    on = [*key, mark] if mark else key
    return join_keys(current, seen.select(*on).distinct(), on, "left_anti")


def next_seen(current: DataFrame, seen: DataFrame, key: list[str], when: str, most: int, refresh: bool = True, mark: str | None = None) -> DataFrame:
    """The seen set after a run, the most recent `most` keys; with refresh a key seen again becomes recent.

    `mark` (a fingerprint) is kept with each key, as its latest row has it.
    """
    columns = [*key, when, *([mark] if mark else [])]
    both = seen.select(*columns).unionByName(current.select(*columns))
    marks = [F.max_by(mark, when).alias(mark)] if mark else []
    last = both.groupBy(*key).agg((F.max if refresh else F.min)(when).alias(when), *marks)
    return last.orderBy(F.col(when).desc(), *key).limit(most)


def state_key(params: dict, limits: tuple[str, ...] = (), digits: int = 16) -> str:
    """Name of a query's state: a hash of the parameters that define it, in key order, lists as sets, without its limits."""
    plain = lambda v: sorted(map(plain, v), key=json.dumps) if isinstance(v, (list, tuple, set)) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    own = {k: plain(v) for k, v in params.items() if k not in limits and v is not None}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]


def with_baseline(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with `baseline`: true for every row of a first run (there is no earlier state)."""
    first = previous.limit(1).agg((F.count(F.lit(1)) == 0).alias("baseline"))
    return current.crossJoin(first)  # one row


def removed(previous: DataFrame, current: DataFrame, key: list[str], seen_at: str, most: int) -> DataFrame:
    """Known rows that are not listed any more, longest unseen first, at most `most`."""
    return join_keys(previous, current.select(*key).distinct(), key, "left_anti").orderBy(seen_at, *key).limit(most)


def prune_dated(seen: DataFrame, when: str, days: int) -> DataFrame:
    """Keys no older than `days` before the newest."""
    newest = seen.agg(F.max(when).alias("__newest"))
    return seen.crossJoin(F.broadcast(newest)).where(F.col(when) >= F.date_sub(F.col("__newest"), days)).drop("__newest")


def watermark_monitor(current: DataFrame, previous: DataFrame, group: list[str], key: str, when: str, grace_days: int = 7) -> DataFrame:
    """Rows not seen before and not older than the group's watermark (latest date emitted) less the grace."""
    marks = previous.groupBy(*group).agg(F.max(when).alias("__mark"))
    since = F.col("__mark") - F.expr(f"INTERVAL {grace_days} DAYS")
    fresh = join_keys(current, marks, group, "left").where(F.col("__mark").isNull() | (F.col(when) >= since))
    return join_keys(fresh, previous.select(*group, key).distinct(), [*group, key], "left_anti").drop("__mark")


def next_watermarks(previous: DataFrame, emitted: DataFrame, group: list[str], complete: str) -> DataFrame:
    """previous(group, watermark) and emitted(group, latest, complete): it moves only after a complete scan or a first run."""
    both = join_keys(previous, emitted, group, "full")
    moved = F.when(F.col(complete) | F.col("watermark").isNull(), F.greatest("watermark", "latest")).otherwise(F.col("watermark"))
    return both.select(*group, moved.alias("watermark"))


def change_feed(current: DataFrame, previous: DataFrame, key: list[str], mark: str, complete: bool = True) -> DataFrame:
    """key, change (new, updated, unchanged, and removed after a complete crawl)."""
    a = current.select(*key, F.col(mark).alias("__now"), F.lit(True).alias("__here"))
    b = previous.select(*key, F.col(mark).alias("__then"), F.lit(True).alias("__there"))
    change = (
        F.when(F.col("__there").isNull(), "new").when(F.col("__here").isNull(), "removed").when(F.col("__now").eqNullSafe(F.col("__then")), "unchanged").otherwise("updated")
    )
    out = join_keys(a, b, key, "full").select(*key, change.alias("change"))
    return out if complete else out.where("change <> 'removed'")


def rank_changes(current: DataFrame, previous: DataFrame, lists: list[str], item: str, rank: str, visible: int, least: int = 1) -> DataFrame:
    """Change of place between two ranked lists that are deeper than what is shown.

    same when the place moved by less than `least`; new and dropped refer to the visible
    part; a drop that slid by less than `least` is not told.
    """
    both = current.select(*lists, item, F.col(rank).alias("now")).join(previous.select(*lists, item, F.col(rank).alias("then")), [*lists, item], "full")
    here, there, moved = F.coalesce(F.col("now") <= visible, F.lit(False)), F.coalesce(F.col("then") <= visible, F.lit(False)), F.abs(F.col("now") - F.col("then"))
    change = (
        F.when(here & moved.isNotNull() & (moved < least), "same")
        .when(here & ~there, "new")
        .when(here & (F.col("now") < F.col("then")), "up")
        .when(here & (F.col("now") > F.col("then")), "down")
        .when(there & ~here & (moved.isNull() | (moved >= least)), "dropped")
    )
    return both.withColumn("change", change).where("change is not null")


def missing_wanted(wanted: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    return join_keys(wanted, found.select(*key).distinct(), key, "left_anti")


def statistics(df: DataFrame, group: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counters per group."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(f).alias(n) for n, f in flags.items()])


def all_failed(stats: DataFrame, ok: str) -> DataFrame:
    """Whether a run failed: only if every group did and nothing was emitted."""
    return stats.agg((F.max(ok) == 0).alias("failed"))


def vote(votes: DataFrame, by: list[str], choice: str, weight: str, order: str, least: float = 1.0) -> DataFrame:
    """The choice of the highest summed weight, the first proposed one of ties, if it reaches `least`."""
    sums = votes.groupBy(*by, choice).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("w").desc(), "first", choice))
    return sums.withColumn("__best", best).where((F.col("__best") == 1) & (F.col("w") >= least)).select(*by, choice, "w")
