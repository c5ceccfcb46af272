"""Tagged references in URLs and short forms: struct(kind, id) by the first pattern that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col
from .urls import path

#: Fixed values: (kind, pattern with the id as its group) of each family of references.
SHAPES = {
    "video": [
        ("playlist", r"youtube\.com/(?:playlist|watch)\?(?:[^#]*&)?list=([A-Za-z0-9_-]{10,})"),
        ("video", r"youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#]|$)"),
        ("video", r"youtu\.be/([A-Za-z0-9_-]{11})(?:[?#/]|$)"),
        ("video", r"youtube\.com/(?:shorts|live|embed)/([A-Za-z0-9_-]{11})(?:[?#/]|$)"),
        ("channel", r"youtube\.com/channel/(UC[A-Za-z0-9_-]{22})(?:[?#/]|$)"),
        ("handle", r"youtube\.com/(@[A-Za-z0-9._-]+)"),
        ("handle", r"^(@[A-Za-z0-9._-]+)$"),
        ("video", r"^([A-Za-z0-9_-]{11})$"),
    ],
    "app": [
        ("apple", r"apps\.apple\.com/.*?/id(\d+)"),
        ("apple", r"^(?:id)?(\d{6,})$"),
        ("google", r"play\.google\.com/store/apps/details\?(?:[^#]*&)?id=([A-Za-z0-9_.]+)"),
        ("google", r"^([A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)+)$"),
    ],
    "event": [("event", r"/e/(?:[^/?#]*-)?(\d{6,})(?:[/?#]|$)")],
    "launch": [("post", r"/posts/([a-z0-9-]+)"), ("product", r"/products/([a-z0-9-]+)"), ("post", r"^([a-z0-9-]+)$")],
    "message": [("message", r"t\.me/(?:s/)?([A-Za-z0-9_]+/\d+)(?:[?#]|$)"), ("channel", r"t\.me/(?:s/)?([A-Za-z0-9_]+)/?$")],
    "deviation": [("deviation", r"/([A-Za-z0-9-]+/art/[A-Za-z0-9-]*?-?\d+)(?:[/?#]|$)"), ("user", r"deviantart\.com/([A-Za-z0-9-]+)/?$")],
}


def tagged(reference, family: str | list[tuple[str, str]]) -> Column:
    """struct(kind, id), null where no shape fits."""
    text, out = F.trim(col(reference)), F.lit(None).cast("struct<kind:string,id:string>")
    for kind, pattern in reversed(SHAPES[family] if isinstance(family, str) else family):
        hit = F.regexp_extract(text, pattern, 1)
        out = F.when(hit != "", F.struct(F.lit(kind).alias("kind"), hit.alias("id"))).otherwise(out)
    return out


def short_id(url) -> Column:
    """The last part of a slug, behind its last '-'."""
    return F.nullif(F.regexp_extract(path(url), r"-([A-Za-z0-9]+)/?$", 1), F.lit(""))


def last_slug(url) -> Column:
    """The last name of the path, or a bare slug."""
    return F.coalesce(F.nullif(F.regexp_extract(path(url), r"/([A-Za-z0-9_-]+)/?$", 1), F.lit("")), F.nullif(F.regexp_extract(col(url), r"^([A-Za-z0-9_-]+)$", 1), F.lit("")))


def listing_search(url) -> Column:
    """struct(role, place, page) of a listing URL /role/<role>, /role/r/<role> (remote) or /role/l/<role>/<place>, page from 1."""
    role = F.regexp_extract(path(url), r"^/role/(?:[rl]/)?([a-z0-9-]+)", 1)
    place = F.when(path(url).rlike("^/role/r/"), F.lit("remote")).otherwise(F.nullif(F.regexp_extract(path(url), r"^/role/l/[a-z0-9-]+/([a-z0-9-]+)", 1), F.lit("")))
    page = F.coalesce(F.nullif(F.regexp_extract(col(url), r"[?&]page=(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1))
    return F.when(role != "", F.struct(role.alias("role"), place.alias("place"), page.cast("long").alias("page")))


def listing_url(role, place, page, origin: str) -> Column:
    """The URL that listing_search reads back."""
    base = F.when(col(place) == "remote", F.concat(F.lit("/role/r/"), col(role))).when(col(place).isNotNull(), F.concat(F.lit("/role/l/"), col(role), F.lit("/"), col(place))).otherwise(F.concat(F.lit("/role/"), col(role)))
    return F.concat(F.lit(origin), base, F.when(col(page) > 1, F.concat(F.lit("?page="), col(page).cast("string"))).otherwise(""))


def file_name(disposition, url) -> Column:
    """Name of a download: filename*, else filename, of the header, else the last part of the URL's path; decoded."""
    extended = F.regexp_extract(col(disposition), r"(?i)filename\*\s*=\s*[A-Za-z0-9-]*''([^;]+)", 1)
    quoted = F.regexp_extract(col(disposition), r'(?i)filename\s*=\s*"([^"]+)"', 1)
    bare = F.regexp_extract(col(disposition), r'(?i)filename\s*=\s*([^";\s]+)', 1)
    first = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(first(F.try_url_decode(extended)), first(quoted), first(bare), first(F.try_url_decode(F.regexp_extract(path(url), r"/([^/]+)$", 1))))
