"""Coercions that give null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """Finite double or null."""
    v = col(x).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)  # NaN is beyond all others


def whole(x) -> Column:
    return col(x).try_cast("long")


def round_half_up(x, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    scale = 10**digits
    return F.floor(col(x) * scale + 0.5) / scale


def join_keys(left, right, keys: list[str], how: str = "inner"):
    """A join on keys where null equals null; each key comes once."""
    names = {k: f"__right_{k}" for k in keys}
    same = F.lit(True)
    for k, r in names.items():
        same = same & F.col(k).eqNullSafe(F.col(r))
    out = left.join(right.withColumnsRenamed(names), same, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "right"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(r)) for k, r in names.items()})
    return out.drop(*names.values())


def shaped(df, schema: list[tuple[str, str]]):
    """Fixed column order and types; columns that are missing become null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema])
