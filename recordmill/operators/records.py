"""Projection of semi-structured sources to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from ..types import col


def project(df: DataFrame, source: str, fields: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Typed fields by JSON path from a JSON text column; a path that leads nowhere, or to another type, is null."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(source)))
    return parsed.select(*(keep or []), *[F.try_variant_get("__v", path, kind).alias(name) for name, (path, kind) in fields.items()])


def project_first(df: DataFrame, source: str, fields: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    """Text fields by the first path that has a non-blank value."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(source)))
    return parsed.select(*(keep or []), *[F.coalesce(*[squash(F.try_variant_get("__v", p, "string")) for p in paths]).alias(name) for name, paths in fields.items()])


def filing_record(xml) -> Column:
    """Nested record of an XML filing: issuer, people with their roles, offering with labels of set flags."""
    schema = (
        "primaryIssuer struct<entityName:string,issuerAddress:struct<street1:string,city:string,stateOrCountry:string,zipCode:string>>,"
        "relatedPersonsList struct<relatedPersonInfo:array<struct<relatedPersonName:struct<firstName:string,lastName:string>,relatedPersonRelationshipList:struct<relationship:array<string>>>>>,"
        "offeringData struct<offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string>,typesOfSecuritiesOffered:struct<isEquityType:boolean,isDebtType:boolean,isPooledInvestmentFundType:boolean>>"
    )
    x = F.from_xml(col(xml), schema, {"rowTag": "edgarSubmission", "ignoreNamespace": "true"})
    kinds = x["offeringData"]["typesOfSecuritiesOffered"]
    total = x["offeringData"]["offeringSalesAmounts"]["totalOfferingAmount"]
    return F.struct(
        squash(x["primaryIssuer"]["entityName"]).alias("issuer"),
        address(x["primaryIssuer"]["issuerAddress"]["street1"], x["primaryIssuer"]["issuerAddress"]["city"], x["primaryIssuer"]["issuerAddress"]["stateOrCountry"], x["primaryIssuer"]["issuerAddress"]["zipCode"]).alias("address"),
        F.transform(
            x["relatedPersonsList"]["relatedPersonInfo"],
            lambda p: F.struct(F.concat_ws(" ", p["relatedPersonName"]["firstName"], p["relatedPersonName"]["lastName"]).alias("name"), p["relatedPersonRelationshipList"]["relationship"].alias("roles")),
        ).alias("people"),
        flags_to_labels({"equity": kinds["isEquityType"], "debt": kinds["isDebtType"], "fund": kinds["isPooledInvestmentFundType"]}).alias("securities"),
        total.try_cast("double").alias("amount"),
        (F.lower(total) == "indefinite").alias("indefinite"),
        x["offeringData"]["offeringSalesAmounts"]["totalAmountSold"].try_cast("double").alias("sold"),
    )


def flags_to_labels(flags: dict[str, Column]) -> Column:
    """Labels of the flags that are true."""
    return F.array_compact(F.array(*[F.when(f, label) for label, f in flags.items()]))


def address(street, city, state, code) -> Column:
    """An address, or null when all its parts are blank."""
    parts = [squash(x) for x in (street, city, state, code)]
    return F.when(F.coalesce(*parts).isNotNull(), F.struct(*[p.alias(n) for p, n in zip(parts, ("street", "city", "state", "code"), strict=True)]))


def tagged_union(df: DataFrame, kind: str, shapes: dict[str, dict[str, Column]]) -> DataFrame:
    """Rows of several kinds in one wide shape; unknown kinds go."""
    names = list(dict.fromkeys(n for shape in shapes.values() for n in shape))

    def field(name: str) -> Column:
        out = F.lit(None)
        for k, shape in shapes.items():
            if name in shape:
                out = F.when(F.col(kind) == k, shape[name]).otherwise(out)
        return out.alias(name)

    return df.where(F.col(kind).isin(list(shapes))).select(kind, *[field(n) for n in names])


def masked(value, hidden) -> Column:
    return F.when(~F.coalesce(col(hidden), F.lit(False)), col(value))


def rating_map(counts: Column, names: tuple[str, ...] = ("one", "two", "three", "four", "five")) -> Column:
    """Named star counts to 1..5."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(i).alias("k"), F.element_at(counts, n).alias("v")) for i, n in enumerate(names, 1)]), lambda x: x["v"].isNotNull()))


def related_rows(lists: Column) -> Column:
    """Ranked lists (first top, then rising) to struct(kind, rank, query, value, breakout)."""
    kinds = F.array(F.lit("top"), F.lit("rising"))
    one = lambda xs, i: F.transform(xs, lambda x, j: F.struct(F.get(kinds, i).alias("kind"), (j + 1).cast("long").alias("rank"), x["query"].alias("query"), x["value"].cast("long").alias("value"), (F.lower(x["formattedValue"]) == "breakout").alias("breakout")))
    return F.flatten(F.transform(lists, one))


def with_error_rows(good: DataFrame, failed: DataFrame, reason: str = "error") -> DataFrame:
    """Failed inputs as rows of the same shape, the reason in a column of its own."""
    return good.withColumn(reason, F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def inline_limit(content: str, most: int = 5 * 1024 * 1024, keep: int = 1_000_000) -> list[Column]:
    """Content for the row, cut when it is too large, and the flag that says so."""
    large = F.octet_length(content) > most
    return [F.when(large, F.substring(content, 1, keep)).otherwise(F.col(content)).alias(content), large.alias(f"{content}_cut")]


def record_key(position, name, longest: int = 60) -> Column:
    """Zero-padded position and a slug."""
    from ..functions.text import slug

    return F.concat_ws("-", F.lpad(col(position).cast("string"), 4, "0"), slug(name, longest))
