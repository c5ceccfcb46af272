"""Time series: calendar windows, rolling windows, batches with an anchor and their rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar_windows(spark, start: str, end: str, period: str) -> DataFrame:
    """period_start and period_end (exclusive) of the days, weeks or months that cover start..end."""
    step = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH"}[period]
    first = F.trunc(F.lit(start).cast("date"), period) if period != "day" else F.lit(start).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr(f"INTERVAL {step}"))).alias("period_start"))
    return days.withColumn("period_end", (F.col("period_start") + F.expr(f"INTERVAL {step}")).cast("date"))


def leaderboard(df: DataFrame, at: str, period: str, item: str, score: Column, n: int) -> DataFrame:
    """The n best items of each calendar period."""
    own = df.groupBy(F.date_trunc(period, F.col(at)).cast("date").alias("period"), item).agg(score.alias("score"))
    w = Window.partitionBy("period").orderBy(F.col("score").desc(), item)
    return own.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def rolling(df: DataFrame, by: list[str], at: str, hours: int, value: Column, out: str) -> DataFrame:
    """Sum over the last hours up to each row.

    Rows are dealt out by group and bucket of that many hours, so that a group with many rows is worked on by many tasks.
    A window is the start of its bucket, up to the row, and the end of the bucket before: running sums from either side, of which
    the second goes over copies moved on by that many hours.  So a row costs the same however many rows its window has.
    A null time has a null sum.
    """
    length = hours * 3_600_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    a = df.withColumn("__at", micros).withColumn("__value", value)
    kind = a.select(F.sum("__value").alias("s")).schema["s"].dataType
    a = a.withColumn("__moved", F.explode_outer(F.when(F.col("__at").isNotNull(), F.array(F.lit(False), F.lit(True)))))
    a = a.withColumn("__at", F.when(F.col("__moved"), F.col("__at") + length).otherwise(F.col("__at")))
    a = a.withColumn("__bucket", F.floor(F.col("__at") / length))
    w = Window.partitionBy(*by, "__bucket")
    up_to, from_on = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("__at").asc(), F.col("__at").desc()))
    own, moved = F.sum(F.when(~F.col("__moved"), F.col("__value"))).over(up_to), F.sum(F.when(F.col("__moved"), F.col("__value"))).over(from_on)
    both = a.withColumn("__first", own).withColumn("__second", moved).where(~F.coalesce("__moved", F.lit(False)))
    total = F.coalesce(F.col("__first") + F.col("__second"), "__first", "__second").cast(kind)
    return both.withColumn(out, F.when(F.col("__at").isNotNull(), total)).drop("__at", "__value", "__moved", "__bucket", "__first", "__second")


def anchored_batches(terms: DataFrame, term: str, order: str, size: int = 5) -> DataFrame:
    """Batches of `size` terms of which the first is the first term of all; a single term is a batch of its own."""
    placed = terms.withColumn("__at", F.row_number().over(Window.orderBy(order)))  # terms are the few keywords of one request
    rest = placed.where("__at > 1").withColumn("batch", F.floor((F.col("__at") - 2) / (size - 1)).cast("long"))
    numbers = rest.select("batch").unionByName(placed.where("__at = 1").select(F.lit(0).cast("long").alias("batch"))).distinct()
    anchor = numbers.crossJoin(F.broadcast(placed.where("__at = 1").drop("__at", "batch")))
    return rest.drop("__at").unionByName(anchor.select(*[c for c in rest.columns if c != "__at"]))


def rescale(points: DataFrame, batch: str, term: str, at: str, value: str, anchor: str | Column) -> DataFrame:
    """Batches on one scale by their anchor's sums, then 0..100 by the highest point, rounded to 2 digits.

    points has the anchor's series in every batch; batch 0 is the measure.  The anchor is a term, or a column that holds it.
    """
    sums = points.where(F.col(term) == anchor).groupBy(batch).agg(F.sum(value).alias("__sum"))
    first = sums.where(F.col(batch) == 0).select(F.col("__sum").alias("__first"))
    factors = sums.crossJoin(F.broadcast(first)).select(batch, F.when((F.col("__sum") > 0) & (F.col("__first") > 0), F.col("__first") / F.col("__sum")).alias("__f"))
    scaled = points.where((F.col(term) != anchor) | (F.col(batch) == 0)).join(factors, batch).withColumn("__v", F.col(value) * F.col("__f"))
    top = scaled.agg(F.max("__v").alias("__top"))
    return scaled.crossJoin(F.broadcast(top)).select(term, at, F.round(F.when(F.col("__top") > 0, F.col("__v") * 100 / F.col("__top")).otherwise(F.lit(0.0)), 2).alias("scaled"))


def sessions(df: DataFrame, by: list[str], at: str, gap_seconds: int) -> DataFrame:
    """Number of the session of each row: a new one after a gap."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(t)
    new = F.when(t - F.lag(t).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")
