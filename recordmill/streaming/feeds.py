"""The state operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, at: str = "ts") -> DataFrame:
    """Parquet files of a folder as a stream, the event time as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def unseen(stream: DataFrame, key: list[str], at: str, grace: str = "7 days") -> DataFrame:
    """Each key once within the grace; later rows of the past are dropped."""
    return stream.withWatermark(at, grace).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, at: str, length: str, by: list[str], late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(at, late).groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("period"), *by, "n")


def changes(stream: DataFrame, key: str, mark: str, at: str, forget_days: int = 90) -> DataFrame:
    """key, mark and change (new, updated) whenever a key's fingerprint differs from the last one, by event time within a batch.

    Keys that are not heard of for `forget_days` leave the state and count as new again; rows later than that are dropped.
    """
    shape = {f.name: f.dataType.simpleString() for f in stream.schema}
    keep_ms = forget_days * 86_400_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, mark, "change"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        last, newest = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([at, mark], kind="stable")
        out = []
        for value in rows[mark]:
            if value is not None and value != last:
                out.append((k[0], value, "new" if last is None else "updated"))
                last = value
        newest = max(newest, int(pd.Timestamp(rows[at].max()).timestamp() * 1000))
        if last is not None:
            state.update((last, newest))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=columns)

    schema = f"`{key}` {shape[key]}, `{mark}` {shape[mark]}, change string"
    grouped = stream.select(key, mark, at).withWatermark(at, f"{forget_days} days").groupBy(key)
    return grouped.applyInPandasWithState(step, schema, f"last {shape[mark]}, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def run_now(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, into a memory table (tests and small runs)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
