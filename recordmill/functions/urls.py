"""URL parts, tracking parameters, site keys, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col

TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid"


def host(url) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def site_key(url) -> Column:
    return F.regexp_replace(host(url), "^www[.]", "")


def path(url) -> Column:
    return F.regexp_extract(col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def query(url) -> Column:
    return F.nullif(F.regexp_extract(col(url), "[?]([^#]*)", 1), F.lit(""))


def without_tracking(url) -> Column:
    """Tracking parameters and the fragment are taken off; a lone '?' too."""
    t = F.regexp_replace(col(url), "#.*$", "")
    t = F.regexp_replace(t, f"([?&])(?:(?:{TRACKING})=[^&]*&)*(?:{TRACKING})=[^&]*(?:&|$)", "$1")
    return F.regexp_replace(t, "[?&]$", "")


def absolute(url) -> Column:
    return F.regexp_replace(F.regexp_replace(col(url), "^//", "https://"), "^http://", "https://")


def same_site(a, b) -> Column:
    x, y = site_key(a), site_key(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def number_in_path(url) -> Column:
    return F.nullif(F.regexp_extract(path(url), "/([0-9]+)(?:[./]|$)", 1), F.lit("")).try_cast("long")


def language_in_path(url) -> Column:
    return F.nullif(F.regexp_extract(path(url), "^/([a-z]{2})(?:/|$)", 1), F.lit(""))
