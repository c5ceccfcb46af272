"""Predicates of searches, built from parameters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def facets(wanted: dict[str, list], flags: Iterable[str] = (), bounds: dict[str, tuple] | None = None, lists: Iterable[str] = ()) -> Column:
    """AND over facets of OR over their values (an empty list asks nothing); flags that must be true; (least, most) bounds, None open.

    `lists` names the facets whose columns are arrays.  A null never fits.
    """
    lists = set(lists)
    parts = [F.arrays_overlap(name, F.array(*map(F.lit, values))) if name in lists else F.col(name).isin(list(values)) for name, values in wanted.items() if values]
    parts += [F.col(f) for f in flags]
    for name, (least, most) in (bounds or {}).items():
        parts += [F.col(name) >= least] if least is not None else []
        parts += [F.col(name) <= most] if most is not None else []
    return all_of(F.coalesce(p, F.lit(False)) for p in parts)


def in_places(places, wanted: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Any of the places is wanted, names compared without case and by alias; nothing wanted: all fit."""
    if not wanted:
        return F.lit(True)
    aliases = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
    canon = lambda name: aliases.get(name.strip().lower(), name.strip().lower())
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    low = F.transform(col(places), lambda x: F.lower(F.trim(x)))
    own = F.transform(low, lambda x: F.coalesce(F.try_element_at(named, x), x)) if aliases else low
    return F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(canon(w)) for w in wanted])), F.lit(False))


def scan_cap(wanted: int) -> int:
    """Rows that are read at most to find so many."""
    return max(2000, 20 * wanted)


#: Marks of pages that ask for proof of a human.
CHALLENGES = r"just a moment\.\.\.|cf-challenge|cf_chl_|attention required! \| cloudflare|captcha-delivery|px-captcha|verify you are human|/punish\?|_____tmd_____"


def is_challenge(html) -> Column:
    return F.coalesce(F.lower(col(html)).rlike(CHALLENGES), F.lit(False))


def page_kind(html, rules: list[tuple[str, str]], other: str = "unknown") -> Column:
    """Label of the first (label, pattern) that the page shows."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(col(html).rlike(pattern), label).otherwise(out)
    return out


def allowed_url(url, hosts: list[str], reserved: Iterable[str] = ()) -> Column:
    """The host is one of these or below one, and the first name of the path is not reserved."""
    from .urls import path, site_key

    own = site_key(url)
    fits = reduce(lambda a, b: a | b, [(own == h) | own.endswith(f".{h}") for h in hosts], F.lit(False))
    return F.coalesce(fits & ~F.lower(F.regexp_extract(path(url), "^/([^/]*)", 1)).isin(list(reserved)), F.lit(False))
