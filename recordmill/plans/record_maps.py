"""Field maps: how the raw JSON of a family of records becomes a flat, typed record.

A map is a dictionary from column to a getter; a getter takes the parsed JSON (a variant)
and gives a column.  mapped() applies a map to a column of JSON text; a row without the
map's key is dropped.  Names and paths are those of the public response formats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.urls import absolute
from ..types import round_half_up

Getter = Callable[[Column], Column]


def _at(kind: str, *paths: str) -> Getter:
    return lambda v: F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def text(*paths: str) -> Getter:
    """The first non-blank text."""
    return lambda v: T.first_filled(*[F.try_variant_get(v, p, "string") for p in paths])


def amount(*paths: str) -> Getter:
    return _at("double", *paths)


def whole(*paths: str) -> Getter:
    return _at("long", *paths)


def above_zero(*paths: str) -> Getter:
    return lambda v: F.when(whole(*paths)(v) > 0, whole(*paths)(v))


def flag(path: str) -> Getter:
    """True only where the value is true."""
    return lambda v: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def texts(*paths: str) -> Getter:
    """Non-blank items of the first list that has any."""
    own = lambda v, p: F.filter(F.transform(F.try_variant_get(v, p, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return lambda v: F.coalesce(*[F.when(F.size(own(v, p)) > 0, own(v, p)) for p in paths], F.array().cast("array<string>"))


def names(path: str, field: str = "$.name") -> Getter:
    """A field of each object of a list, blanks left out, each once."""

    def get(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: T.squash(F.try_variant_get(x, field, "string")))
        return F.coalesce(F.array_distinct(F.array_compact(items)), F.array().cast("array<string>"))

    return get


def epoch(path: str) -> Getter:
    return lambda v: D.from_epoch(F.try_variant_get(v, path, "long"))


def instant(*paths: str) -> Getter:
    return lambda v: F.coalesce(*[D.instant(F.try_variant_get(v, p, "string")) for p in paths])


def day(*paths: str) -> Getter:
    return lambda v: F.coalesce(*[D.leading_date(F.try_variant_get(v, p, "string")) for p in paths])


def web(*paths: str) -> Getter:
    return lambda v: absolute(text(*paths)(v))


def hidden_if(path: str, getter: Getter) -> Getter:
    return lambda v: F.when(~flag(path)(v), getter(v))


def unknown(kind: str = "string") -> Getter:
    """A column of the common shape that this source does not have."""
    return lambda v: F.lit(None).cast(kind)


def _list_when(test: Getter, getter: Getter) -> Getter:
    return lambda v: F.when(test(v), getter(v))


def _prefixed(start: str, getter: Getter, end: str = "") -> Getter:
    return lambda v: F.concat(F.lit(start), getter(v), F.lit(end))


@dataclass(frozen=True)
class RecordMap:
    key: str
    fields: dict[str, Getter]
    keep: Callable[[Column], Column] | None = None


def mapped(df: DataFrame, source: str, record: RecordMap, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and the record's fields; rows whose key is missing, or that the map does not keep, are dropped."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(source)))
    rows = parsed if record.keep is None else parsed.where(record.keep(F.col("__v")))
    return rows.select(*(keep or []), *[get(F.col("__v")).alias(name) for name, get in record.fields.items()]).where(F.col(record.key).isNotNull())


APP = RecordMap(
    "app_id",
    {
        "app_id": lambda v: F.nullif(whole("$.trackId")(v), F.lit(0)).cast("string"),
        "name": text("$.trackName"),
        "developer": text("$.artistName"),
        "category": text("$.primaryGenreName"),
        "genres": texts("$.genres"),
        "price": amount("$.price"),
        "free": lambda v: amount("$.price")(v) == 0,
        "rating": amount("$.averageUserRating"),
        "rating_count": whole("$.userRatingCount"),
        "size_bytes": lambda v: F.when(text("$.fileSizeBytes")(v).try_cast("long") > 0, text("$.fileSizeBytes")(v).try_cast("long")),
        "released": day("$.releaseDate"),
        "screenshots": texts("$.screenshotUrls", "$.ipadScreenshotUrls"),
        "content_rating": text("$.trackContentRating", "$.contentAdvisoryRating"),
    },
    keep=lambda v: F.coalesce(F.try_variant_get(v, "$.wrapperType", "string"), F.lit("software")) == "software",
)
COMPANY = RecordMap(
    "company_id",
    {
        "company_id": text("$.objectID", "$.id"),
        "name": text("$.name"),
        "slug": text("$.slug"),
        "batch": text("$.batch"),
        "batch_code": lambda v: D.season_code(text("$.batch")(v)),
        "industry": text("$.industry"),
        "subindustry": lambda v: F.when(F.contains(text("$.subindustry")(v), F.lit("->")), T.squash(F.substring_index(text("$.subindustry")(v), "->", -1))),
        "regions": texts("$.regions"),
        "team_size": whole("$.team_size"),
        "launched_at": epoch("$.launched_at"),
        "hiring": flag("$.isHiring"),
        "jobs_url": _list_when(flag("$.isHiring"), _prefixed("/companies/", text("$.slug"), "/jobs")),
    },
)
VIDEO = RecordMap(
    "video_id",
    {
        "video_id": text("$.View.bvid"),
        "title": text("$.View.title"),
        "author": text("$.View.owner.name"),
        "published": epoch("$.View.pubdate"),
        "seconds": whole("$.View.duration"),
        "views": whole("$.View.stat.view"),
        "likes": whole("$.View.stat.like"),
        "tags": names("$.Tags", "$.tag_name"),
        "cover": web("$.View.pic"),
        "parts": lambda v: F.coalesce(above_zero("$.View.videos")(v), F.lit(1)).cast("long"),
    },
)
LAUNCH = RecordMap(
    "id",
    {
        "id": text("$.id"),
        "name": text("$.name"),
        "tagline": text("$.tagline"),
        "topics": names("$.topics.edges", "$.node.name"),
        "votes": whole("$.votesCount"),
        "launched_on": lambda v: D.local_wall_clock(instant("$.featuredAt", "$.createdAt")(v), "America/Los_Angeles").cast("date"),
        "featured": lambda v: F.try_variant_get(v, "$.featuredAt", "string").isNotNull(),
        "makers": names("$.makers"),
    },
)
JOB = {
    "job_id": text("$.jobId", "$.id"),
    "title": text("$.headline", "$.title"),
    "skills": lambda v: T.unique_any_case(F.concat(texts("$.keySkills")(v), texts("$.allSkills", "$.skills")(v))),
    "years": lambda v: F.coalesce(whole("$.expRange.min", "$.minimumExperience.years")(v), F.lit(0)),
    "low": amount("$.salaryRange.min", "$.minimumSalary.absoluteValue"),
    "high": amount("$.salaryRange.max", "$.maximumSalary.absoluteValue"),
    "posted": day("$.jobFactSummary.postedDate", "$.postedAt"),
}
#: A job of a listing: the work mode says whether it is remote.
LISTED_JOB = RecordMap("job_id", {**JOB, "company": text("$.companyDetails.name", "$.company"), "remote": lambda v: F.lower(text("$.remoteType")(v)) != "onsite", "locations": texts("$.locations")})
#: A job of a board that may hide the company.
BOARD_JOB = RecordMap("job_id", {**JOB, "company": hidden_if("$.hideCompanyName", text("$.companyName", "$.company.name")), "remote": unknown("boolean"), "locations": names("$.locations", "$.city")})
POST = RecordMap(
    "post_id",
    {
        "post_id": whole("$.id"),
        "title": text("$.title"),
        "slug": text("$.slug"),
        "posted_at": instant("$.post_date"),
        "audience": lambda v: F.when(F.coalesce(text("$.audience")(v), F.lit("everyone")) == "everyone", "free").otherwise("paid"),
        "kind": lambda v: F.coalesce(text("$.type")(v), F.lit("newsletter")),
        "authors": names("$.publishedBylines"),
        "words": whole("$.wordcount"),
        "preview": lambda v: (F.coalesce(text("$.audience")(v), F.lit("everyone")) != "everyone") & F.coalesce(T.excess_words(F.try_variant_get(v, "$.body", "string"), whole("$.wordcount")(v)), F.lit(False)),
    },
)
REVIEW = RecordMap(
    "review_id",
    {
        "review_id": text("$.id"),
        "rating": whole("$.rating"),
        "author": text("$.consumer.displayName"),
        "written": instant("$.dates.publishedDate"),
        "experienced": day("$.dates.experiencedDate"),
        "verified": flag("$.labels.verification.isVerified"),
        "reply": text("$.reply.message"),
        "language": lambda v: T.base_language(text("$.language")(v)),
    },
)
AD = RecordMap(
    "ad_id",
    {
        "ad_id": text("$.creativeId"),
        "advertiser": text("$.advertiser.name", "$.advertiserName"),
        "format": text("$.format"),
        "first_shown": epoch("$.firstShown"),
        "last_shown": epoch("$.lastShown"),
        "headline": text("$.preview.headline"),
    },
)
#: Comments with their answers: author, message and, nested, the same of the answers.
COMMENT = RecordMap(
    "comment_id",
    {
        "comment_id": text("$.rpid_str", "$.rpid"),
        "author": text("$.member.uname"),
        "message": text("$.content.message"),
        "likes": whole("$.like"),
        "answers": lambda v: F.coalesce(
            F.transform(
                F.try_variant_get(v, "$.replies", "array<variant>"),
                lambda r: F.struct(F.try_variant_get(r, "$.rpid", "string").alias("comment_id"), F.try_variant_get(r, "$.member.uname", "string").alias("author"), F.try_variant_get(r, "$.content.message", "string").alias("message")),
            ),
            F.array().cast("array<struct<comment_id:string,author:string,message:string>>"),
        ),
    },
)
#: One point of a trend series: values of all terms, whether there was data, whether the period is not over yet.
TREND_POINT = RecordMap(
    "at",
    {
        "at": lambda v: D.from_epoch(text("$.time")(v).try_cast("long")),
        "value": whole("$.value[0]"),
        "has_data": flag("$.hasData[0]"),
        "partial": flag("$.isPartial"),
    },
)


def registration(fields: dict[str, tuple[str, ...]], state: str, categories: list[tuple[str, str]]) -> RecordMap:
    """The common record of business registrations from a state's own column names; `fields` by role."""
    get = {role: text(*[f"$.{p}" for p in paths]) for role, paths in fields.items()}
    own = lambda role: get.get(role, unknown())
    return RecordMap(
        "entity_id",
        {
            "state": lambda v: F.lit(state),
            "entity_id": own("id"),
            "name": own("name"),
            "entity_type": own("type"),
            "category": lambda v: T.category_of(F.coalesce(own("type")(v), F.lit("")), categories, "other"),
            "formed": lambda v: D.leading_date(own("formed")(v)),
            "city": own("city"),
            "postal_code": lambda v: F.nullif(F.substring(own("zip")(v), 1, 5), F.lit("")),
            "agent": own("agent"),
        },
        keep=lambda v: own("name")(v).isNotNull(),
    )


#: Column names of the registers, by role.
REGISTERS = {
    "OR": {"id": ("registry_number",), "name": ("business_name",), "type": ("entity_type",), "formed": ("registry_date",), "city": ("city",), "zip": ("zip",)},
    "CO": {"id": ("entityid",), "name": ("entityname",), "type": ("entitytype",), "formed": ("entityformdate",), "city": ("principalcity",), "zip": ("principalzipcode",), "agent": ("agentorganizationname", "agentlastname")},
    "NY": {"id": ("dos_id",), "name": ("current_entity_name", "corp_name"), "type": ("entity_type",), "formed": ("initial_dos_filing_date", "filing_date"), "city": ("dos_process_city",), "zip": ("dos_process_zip",), "agent": ("registered_agent_name",)},
    "TX": {"id": ("taxpayer_number",), "name": ("taxpayer_name",), "type": ("taxpayer_organizational_type",), "formed": ("responsibility_beginning_date",), "city": ("taxpayer_city",), "zip": ("taxpayer_zip_code",)},
    "CT": {"id": ("accountnumber",), "name": ("name",), "type": ("business_type",), "formed": ("date_registration",), "city": ("billingcity",), "zip": ("billingpostalcode",)},
}


def discount(price: Column, original: Column) -> Column:
    """Per cent off, only when the original price is higher."""
    return F.when(original > price, round_half_up((1 - price / original) * 100).cast("long"))
