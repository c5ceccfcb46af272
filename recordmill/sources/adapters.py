"""Sources: tables, adapters to one shape, feeds, page data and the fetch policy that is data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.enrich import union_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over the session's shuffle partitions: narrow rows ahead of a step that costs much for each, as a small file is read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Adapter:
    """How one source is read: its columns by role, a base filter and the way to the common record."""

    name: str
    read: Callable[[], DataFrame]
    columns: dict[str, str]
    to_record: Callable[[DataFrame], DataFrame]
    base: Column | None = None
    notes: dict = field(default_factory=dict)

    def where(self, wanted: dict[str, Column | list]) -> DataFrame | None:
        """Rows under the filters by role; None when the source lacks a role that is asked for."""
        df = self.read() if self.base is None else self.read().where(self.base)
        for role, values in wanted.items():
            if role not in self.columns:
                return None
            c = F.col(self.columns[role])
            df = df.where(c.between(*values) if isinstance(values, tuple) else c.isin(list(values)))
        return df


def read_adapters(adapters: list[Adapter], wanted: dict) -> DataFrame:
    """All adapters' records in one shape, sources that cannot apply a filter left out."""
    parts = [a.to_record(df).withColumn("source", F.lit(a.name)) for a in adapters if (df := a.where(wanted)) is not None]
    return union_of(parts)


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", schema: str | None = None) -> DataFrame:
    """RSS items or Atom entries of XML files."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def feed_items(text: Column, row_tag: str, schema: str) -> Column:
    """Array of items of feed texts held in a column."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(<{row_tag}[ >].*?</{row_tag}>)"), 1)
    return F.transform(found, lambda x: F.from_xml(x, schema))


def page_json(html: Column, marker_id: str) -> Column:
    """JSON of the script element with this id, as a variant."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf'(?s)<script id="{marker_id}"[^>]*>(.*?)</script>', 1), F.lit("")))


def guarded_json(text: Column) -> Column:
    """JSON behind an anti-hijacking prefix, as a variant."""
    return F.try_parse_json(F.regexp_replace(text, r"^\)\]\}',?\s*", ""))


def at(variant: Column, path: str, kind: str = "string") -> Column:
    """Positional path into nested JSON, null where it leads nowhere."""
    return F.try_variant_get(variant, path, kind)


def sitemap_entries(xml: Column) -> Column:
    """Array of struct(url, lastmod), one per url."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), 1)
    return F.array_distinct(F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"(?s)<loc>(.*?)</loc>", 1)).alias("url"), F.regexp_extract(b, "<lastmod>(.*?)</lastmod>", 1).alias("lastmod"))))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, n: int) -> DataFrame:
    """The next n rows behind a cursor of the ordering columns."""
    if after is not None:
        cursor = [F.lit(x).cast(df.schema[c].dataType).alias(c) for c, x in zip(order, after, strict=True)]
        df = df.where(F.struct(*order) > F.struct(*cursor))
    return df.orderBy(*order).limit(n)


def facet_passes(df: DataFrame, key: str, facets: list[str]) -> DataFrame:
    """Rows once each, from the first pass (facet value) that returns them."""
    w = Window.partitionBy(key).orderBy(*facets)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def robots_pattern(rule: Column) -> Column:
    """A robots path rule as a regular expression: '*' any run, '$' at the end is the end."""
    quoted = F.regexp_replace(rule, r"([.+?^(){}|\[\]\\])", r"\\$1")
    ended = F.when(quoted.endswith("$"), quoted).otherwise(F.concat(F.replace(quoted, F.lit("$"), F.lit(r"\$")), F.lit("")))
    return F.concat(F.lit("^"), F.replace(ended, F.lit("*"), F.lit(".*")))


def robots_decision(paths: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """allowed for each (host, path): the longest rule of the host that fits wins, allow wins ties, no rule allows.

    rules: host, rule, allow.
    """
    own = rules.select(F.col("host").alias(host), "rule", "allow", robots_pattern(F.col("rule")).alias("__re"))
    fits = paths.select(host, path).distinct().join(own, host, "left").where(F.expr(f"`{path}` rlike __re"))
    best = fits.groupBy(host, path).agg(F.max(F.struct(F.length("rule").alias("n"), "allow"))["allow"].alias("allowed"))
    return paths.join(best, [host, path], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def private_ip(ip: Column) -> Column:
    """Addresses of private, loopback, link-local and unspecified ranges; IPv6 too, and IPv4 ones written in it."""
    shown = F.lower(F.trim(ip))
    four = F.coalesce(F.nullif(F.regexp_extract(shown, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1), F.lit("")), shown)
    n = F.aggregate(F.split(four, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))
    blocks = [(0, 8), (10 << 24, 8), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12), ((192 << 24) + (168 << 16), 16), ((100 << 24) + (64 << 16), 10)]

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for start, bits in blocks:
            out = out | n.between(start, start + (1 << (32 - bits)) - 1)
        return out

    six = shown.rlike(r"^(::1?|(0+:){7}0*[01]|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return F.when(shown.contains(":") & ~shown.contains("."), six).otherwise(four.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.exists(F.array(n), inside))  # the number is worked out once for all ranges
