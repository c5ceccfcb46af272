"""Operators over an explicit order: ranks, caps, streak stops, interleaving, fills, budgets.

None relies on the order of partitions: every one takes the columns that order rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import col, join_keys, round_half_up


def _w(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def with_rank(df: DataFrame, by: list[str], order: list, out: str = "rank") -> DataFrame:
    """1-based place in a list."""
    return df.withColumn(out, F.row_number().over(_w(by, order)).cast("long"))


def placed(df: DataFrame, by: list[str], coarse: list[tuple[Column, bool]], fine: list, out: str) -> DataFrame:
    """1-based place of every row within `by`, ordered by the coarse columns (with True: descending), then the fine ones.

    Rows are numbered within groups of equal coarse columns and moved on by the sizes of
    the groups before, so that no task holds more than one group's rows.  Nulls are last.
    """
    names = [f"__c{i}" for i in range(len(coarse))]
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, (_, down) in zip(names, coarse, strict=True)]
    rows = df.withColumns({c: column for c, (column, _) in zip(names, coarse, strict=True)})
    before = F.sum("__n").over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    keys = [*by, *names]
    sizes = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = with_rank(rows, keys, fine, "__place").join(sizes, same)
    return numbered.withColumn(out, F.col("__before") + F.col("__place")).select(*[c for c in df.columns if c != out], out)


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    return with_rank(df, key, order, "__rank").where("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return with_rank(df, by, order, "__rank").where(F.col("__rank") <= n).drop("__rank")


def strongest_in_time_order(df: DataFrame, by: list[str], strength: str, order: list, n: int) -> DataFrame:
    """The n strongest rows of each group, the first row in order always among them."""
    numbered = with_rank(df, by, order, "__at")
    ranked = numbered.withColumn("__rank", F.row_number().over(_w(by, [(F.col("__at") == 1).desc(), F.col(strength).desc(), *order])))
    return ranked.where(F.col("__rank") <= n).drop("__rank", "__at")


def even_sample(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """n evenly spaced rows of each group, first and last included (with n = 1 the first)."""
    placed = with_rank(df, by, order, "__at").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (round_half_up(i * (F.col("__n") - 1) / max(1, n - 1)) + 1).cast("long"))
    return placed.where((F.col("__n") <= n) | F.array_contains(wanted, F.col("__at"))).drop("__at", "__n")


def newest_first(at: str, order: list) -> list:
    """Ordering by time, latest first; rows without one keep the feed's order behind the dated ones."""
    return [F.col(at).isNull().asc(), F.col(at).desc(), *order]


def most_votes(votes: str, order: list) -> list:
    """Ordering by votes, unknown ones last of all."""
    return [F.coalesce(F.col(votes), F.lit(-1)).desc(), *order]


def season_order(year: str, season: str, order: list) -> list:
    """Latest year, and within it fall, summer, spring, winter; unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, ("winter", "spring", "summer", "fall"))), F.lower(F.col(season)))
    return [F.col(year).desc_nulls_last(), F.nullif(place, F.lit(0)).desc_nulls_last(), *order]


def best_links(df: DataFrame, by: list[str], link: str, score: str, order: list, n: int) -> DataFrame:
    """The n best links of each group, one row of each link; ties stay in the page's order."""
    once = first_wins(df.where(F.col(score) > 0), [*by, link], [F.col(score).desc(), *order])
    return top_per_group(once, by, [F.col(score).desc(), *order], n)


def fair_share(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """A cap over all groups: each in turn gets ceil(left / groups left), what it does not use rolls on.

    Works on one row per group; the number of groups is that of the sources of a run.  A null group comes first.
    """
    kind = df.schema[group].dataType.simpleString()
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "size"))).alias("all"))
    start = F.struct(F.lit(cap).cast("long").alias("left"), F.array().cast(f"array<struct<g:{kind},quota:bigint>>").alias("out"))

    def share(a: Column, x: Column) -> Column:
        groups_left = F.size("all") - F.size(a["out"])
        quota = F.least(x["size"], F.ceil(a["left"] / groups_left)).cast("long")
        return F.struct((a["left"] - quota).alias("left"), F.concat(a["out"], F.array(F.struct(x["g"].alias("g"), quota.alias("quota")))).alias("out"))

    quotas = sizes.select(F.explode(F.aggregate("all", start, share)["out"]).alias("q")).select(F.col("q.g").alias("__g"), F.col("q.quota").alias("__quota"))
    ranked = with_rank(df, [group], order, "__rank").where(F.col("__rank") <= cap)  # no quota is larger: tasks drop the rest before the shuffle
    return ranked.join(quotas, F.col(group).eqNullSafe(F.col("__g"))).where("__rank <= __quota").drop("__g", "__quota", "__rank")


def round_robin(df: DataFrame, source: str, order: list, out: str = "position") -> DataFrame:
    """Places of an interleaving that takes one row of each source in turn (a total order of distinct keys; sort by it)."""
    ranked = with_rank(df, [source], order, "__turn")
    return ranked.withColumn(out, F.struct(F.col("__turn").alias("turn"), F.col(source).alias("source"))).drop("__turn")


def forward_fill(df: DataFrame, by: list[str], order: list, columns: list[str]) -> DataFrame:
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def clip_to_next(df: DataFrame, by: list[str], order: list, start: str, end: str, least: float = 0.001) -> DataFrame:
    """An end that overlaps the next start is cut there; nothing gets shorter than `least`."""
    following = F.lead(start).over(_w(by, order))
    cut = F.when(following < F.col(end), following).otherwise(F.col(end))
    return df.withColumn(end, F.greatest(cut, F.col(start) + least))


def stop_after_streak(df: DataFrame, by: list[str], order: list, old: Column, n: int) -> DataFrame:
    """Rows that are not old, up to the first run of n old ones in a row."""
    w = _w(by, order)
    a = df.withColumn("__old", F.coalesce(old, F.lit(False)))
    a = a.withColumn("__island", F.sum(F.when(F.col("__old"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("__run", F.sum(F.when(F.col("__old"), 1).otherwise(0)).over(Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("__stopped", F.max(F.col("__run") >= n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return a.where("not __stopped and not __old").drop("__old", "__island", "__run", "__stopped")


def stop_after_stale_pages(df: DataFrame, by: list[str], page: str, new: Column, n: int = 2) -> DataFrame:
    """Rows of pages up to the n-th page in a row without anything new."""
    pages = df.groupBy(*by, page).agg(F.max(F.coalesce(new, F.lit(False)).cast("int")).alias("__new"))
    w = Window.partitionBy(*by).orderBy(page)
    a = pages.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("__run", F.sum(1 - F.col("__new")).over(Window.partitionBy(*by, "__island").orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("__before", F.coalesce(F.max(F.col("__run") >= n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    return join_keys(df, a.where("not __before").select(*by, page), [*by, page], "left_semi")


def cut_at_page(df: DataFrame, by: list[str], page: str, beyond: Column) -> DataFrame:
    """The page that crosses the bound is finished, later pages are not read."""
    first = df.groupBy(*by).agg(F.min(F.when(beyond, F.col(page))).alias("__last"))
    return join_keys(df, first, by).where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")


def within_budget(df: DataFrame, by: list[str], order: list, price: Column, cap: int) -> DataFrame:
    """Rows whose running price (whole units) stays within the cap; a null price costs nothing."""
    spent = F.sum(F.coalesce(price.cast("long"), F.lit(0))).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", spent).where(F.col("spent") <= cap)


def until_exhausted(df: DataFrame, by: list[str], order: list, price: Column, cap: int) -> DataFrame:
    """As within_budget, but the row that uses the budget up is still emitted."""
    before = F.coalesce(F.sum(price.cast("long")).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("spent_before", before).where(F.col("spent_before") < cap)


def thinned(df: DataFrame, by: list[str], at: str, gap: float) -> DataFrame:
    """Greedy thinning: a row stays if it is at least `gap` after the last one of its group that stayed.

    Rows stream through a task in order, with the last kept time as the only state; null times are left out.
    """
    rows = df.select(*by, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull())
    in_order = rows.repartition(*by).sortWithinPartitions(*by, at) if by else rows.coalesce(1).sortWithinPartitions(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, 0.0
        for batch in batches:
            keep = []
            for i, (t, *own) in enumerate(zip(batch.column(at).to_pylist(), *[batch.column(c).to_pylist() for c in by], strict=True)):
                if own != group or t - last >= gap:
                    group, last = own, t
                    keep.append(i)
            yield batch.take(pa.array(keep, type=pa.int64()))

    return in_order.mapInArrow(run, rows.schema)


def batches_of(df: DataFrame, order: list, size: int, by: list[str] | None = None, out: str = "batch") -> DataFrame:
    """Number of the group of `size` rows."""
    n = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))
    return df.withColumn(out, F.floor((n - 1) / size).cast("long"))


def rank_in_group(value: Column, by: list[str]) -> Column:
    """Is it the least of its group."""
    return value == F.min(value).over(Window.partitionBy(*by))


def nearest_before(df: DataFrame, by: list[str], order: list, mark: Column, out: str) -> DataFrame:
    """The last mark at or before a row (the heading over a block, the speaker of a line)."""
    return df.withColumn(out, F.last(mark, ignorenulls=True).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def rows_on_page(position, size: int) -> Column:
    return (F.floor((col(position) - 1) / size) + 1).cast("long")
