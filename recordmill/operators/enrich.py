"""Joins that enrich: detail over listing, role pivots, lookups with a second source, unions to one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detail_over_listing(listing: DataFrame, detail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field from the detail where it is known, else from the listing."""
    d = detail.select(key, *[F.col(f).alias(f"__d_{f}") for f in fields])
    out = listing.join(d, key, "left")
    return out.select(*[F.coalesce(f"__d_{c}", c).alias(c) if c in fields else F.col(c) for c in listing.columns])


def role_pivot(rows: DataFrame, key: str, role: str, roles: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """One row per key with the first row of each role."""
    first = {f"{r}_{f}": F.min(F.when(F.col(role) == r, F.struct(*order, f)))[f] for r in roles for f in fields}
    return rows.groupBy(key).agg(*[c.alias(n) for n, c in first.items()])


def lookup(df: DataFrame, key: str, dimension: DataFrame, value: str, second: DataFrame | None = None) -> DataFrame:
    """value by key, from the second source where the first has none."""
    out = df.join(dimension.select(key, F.col(value).alias("__a")), key, "left")
    if second is None:
        return out.withColumnRenamed("__a", value)
    return out.join(second.select(key, F.col(value).alias("__b")), key, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def learned_name(df: DataFrame, key: str, name: str, order: list) -> DataFrame:
    """A name that any row of the key carries, applied to all."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.first(name, ignorenulls=True).over(w))


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def latest_at(rows: DataFrame, versions: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """As-of lookup: the last version at or before each row, by one sort of both sides together."""
    both = rows.withColumns({"__v": F.lit(None).cast(versions.schema[value].dataType), "__row": F.lit(1), "__at": F.col(at)})
    marks = versions.select(*by, F.col(value).alias("__v"), F.lit(0).alias("__row"), F.col(since).alias("__at"))
    joined = both.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__row = 1").drop("__v", "__row", "__at")


def facet_counts(df: DataFrame, facet: str) -> DataFrame:
    return df.groupBy(facet).agg(F.count(F.lit(1)).alias("n"))


def resolve_facets(wanted: DataFrame, values: DataFrame, wanted_col: str, value_col: str, key) -> DataFrame:
    """wanted, value: the facet value of equal key (null: unknown)."""
    v = values.select(F.col(value_col).alias("value"), key(F.col(value_col)).alias("__k")).distinct()
    return wanted.withColumn("__k", key(F.col(wanted_col))).join(v, "__k", "left").drop("__k")


def overlap_share(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def dereferenced(df: DataFrame, references: str, cache: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """Array of references to an array of structs of what they point at, in order; unknown ones go.  The row needs an id: all its
    other columns are its key."""
    own = [c for c in df.columns if c != references]
    parts = df.select(*own, F.posexplode_outer(references).alias("__i", key))
    found = parts.join(cache.select(key, F.struct(key, *fields).alias("__x")), key, "left")
    lists = found.groupBy(*own).agg(F.sort_array(F.collect_list(F.when(F.col("__x").isNotNull(), F.struct("__i", "__x")))).alias("__all"))
    return lists.select(*own, F.transform("__all", lambda x: x["__x"]).alias(out))


def best_candidate(wanted: DataFrame, candidates: DataFrame, by: str, name: str, weight: str) -> DataFrame:
    """For each wanted name the candidate found for it: the same name first, then one that begins with it, then the largest."""
    norm = lambda c: F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", ""))
    rank = F.when(norm(name) == norm(by), 0).when(norm(name).startswith(norm(by)), 1).otherwise(2)
    w = Window.partitionBy(by).orderBy(rank, F.col(weight).desc_nulls_last(), name)
    best = candidates.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return wanted.join(best, by, "left")


def first_alias(inputs: DataFrame, resolved: str, order: list) -> DataFrame:
    """Inputs with `duplicate_of`: the resolved id where an earlier input resolves to it too; unresolved ones are no duplicates."""
    k = F.row_number().over(Window.partitionBy(resolved).orderBy(*order))
    return inputs.withColumn("duplicate_of", F.when(F.col(resolved).isNotNull() & (k > 1), F.col(resolved)))


def crawl_delay(groups: DataFrame, agent: str) -> DataFrame:
    """host and the largest delay of the groups that name the agent, or, where none does, of those for all agents."""
    own = F.max(F.when(F.lower("agent") == agent.lower(), F.col("delay")))
    named = F.max(F.lower("agent") == agent.lower())
    return groups.groupBy("host").agg(F.when(named, own).otherwise(F.max(F.when(F.col("agent") == "*", F.col("delay")))).alias("delay"))
