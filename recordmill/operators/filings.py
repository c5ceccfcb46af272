"""Notices of private offerings: records from their XML, the filters of a feed, and a run of it with the outcome of every filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.text import squash
from ..storage import Steps
from ..types import col
from .ordered import first_wins, placed
from .records import address, flags_to_labels

#: Names of the form's elements, the labels of its flags, and its industry groups by category.
SECURITIES = {
    "isEquityType": "Equity",
    "isDebtType": "Debt",
    "isOptionToAcquireType": "Option, warrant or other right to acquire",
    "isSecurityToBeAcquiredType": "Security to be acquired on exercise",
    "isPooledInvestmentFundType": "Pooled investment fund interests",
    "isTenantInCommonType": "Tenant-in-common securities",
    "isMineralPropertyType": "Mineral property securities",
}
INDUSTRIES = {
    "Agriculture": ["Agriculture"],
    "Banking & Financial Services": ["Commercial Banking", "Insurance", "Investing", "Investment Banking", "Pooled Investment Fund", "Other Banking and Financial Services"],
    "Business Services": ["Business Services"],
    "Energy": ["Coal Mining", "Electric Utilities", "Energy Conservation", "Environmental Services", "Oil and Gas", "Other Energy"],
    "Health Care": ["Biotechnology", "Health Insurance", "Hospitals and Physicians", "Pharmaceuticals", "Other Health Care"],
    "Manufacturing": ["Manufacturing"],
    "Real Estate": ["Commercial", "Construction", "REITS and Finance", "Residential", "Other Real Estate"],
    "Retailing": ["Retailing"],
    "Restaurants": ["Restaurants"],
    "Technology": ["Computers", "Telecommunications", "Other Technology"],
    "Travel": ["Airlines and Airports", "Lodging and Conventions", "Tourism and Travel Services", "Other Travel"],
    "Other": ["Other"],
}
_PERSON = "relatedPersonName struct<firstName:string,middleName:string,lastName:string>,relatedPersonAddress struct<city:string,stateOrCountry:string>,relatedPersonRelationshipList struct<relationship:array<string>>,relationshipClarification string"
_SECURITIES = ",".join(f"{name}:string" for name in (*SECURITIES, "isOtherType", "descriptionOfOtherType"))
FORM = (
    "submissionType string,"
    "primaryIssuer struct<cik:string,entityName:string,issuerAddress:struct<street1:string,city:string,stateOrCountry:string,zipCode:string>,issuerPhoneNumber:string,jurisdictionOfInc:string,entityType:string,entityTypeOtherDesc:string,yearOfInc:struct<withinFiveYears:string,overFiveYears:string,value:string>>,"
    "issuerList struct<issuer:array<struct<entityName:string>>>,"
    f"relatedPersonsList struct<relatedPersonInfo:array<struct<{_PERSON.replace(' struct', ':struct').replace(' string', ':string')}>>>,"
    "offeringData struct<industryGroup:struct<industryGroupType:string,investmentFundInfo:struct<investmentFundType:string>>,issuerSize:struct<revenueRange:string,aggregateNetAssetValueRange:string>,federalExemptionsExclusions:struct<item:array<string>>,"
    f"typeOfFiling:struct<newOrAmendment:struct<isAmendment:string,previousAccessionNumber:string>,dateOfFirstSale:struct<value:string,yetToOccur:string>>,typesOfSecuritiesOffered:struct<{_SECURITIES}>,minimumInvestmentAccepted:string,"
    "salesCompensationList:struct<recipient:array<struct<recipientName:string,recipientCRDNumber:string,associatedBDName:string,associatedBDCRDNumber:string>>>,"
    "offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string,totalRemaining:string,isIndefinite:string>,investors:struct<hasNonAccreditedInvestors:string,numberNonAccreditedInvestors:string,totalNumberAlreadyInvested:string>,"
    "salesCommissionsFindersFees:struct<salesCommissions:struct<dollarAmount:string>,findersFees:struct<dollarAmount:string>>>,"
    "_corrupt string"
)


def told(text) -> Column:
    """true, false, or null where nothing is said."""
    return F.lower(squash(text)) == "true"


def said(text) -> Column:
    """Text that says something: 'none' and 'N/A' do not."""
    t = squash(text)
    return F.when(~F.lower(t).isin("none", "n/a"), t)


def category_of_industry(group) -> Column:
    """The category that has the industry group, in whatever case."""
    of = {g.lower(): c for c, groups in INDUSTRIES.items() for g in groups}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.lower(col(group)))


def read_filings(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """filings (accession, form_type and others) with the fields of their form; `failed` where there is none, or another document, or broken XML.

    form_type and whether it is an amendment are the document's where it tells them.  An amount that is said to be indefinite has `indefinite` set.
    """
    root = F.regexp_extract(F.col(xml), r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    d = filings.withColumns({"__root": root, "__x": F.from_xml(F.col(xml), FORM, {"rowTag": "edgarSubmission", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})})
    x = F.col("__x")
    issuer, offer = x["primaryIssuer"], x["offeringData"]
    filing, amounts, kinds, investors, fees = offer["typeOfFiling"], offer["offeringSalesAmounts"], offer["typesOfSecuritiesOffered"], offer["investors"], offer["salesCommissionsFindersFees"]
    form = F.coalesce(squash(x["submissionType"]), F.col("form_type"))
    other = F.when(told(kinds["isOtherType"]), F.concat(F.lit("Other"), F.coalesce(F.concat(F.lit(": "), squash(kinds["descriptionOfOtherType"])), F.lit(""))))
    securities = F.array_compact(F.concat(flags_to_labels({label: told(kinds[name]) for name, label in SECURITIES.items()}), F.array(other)))
    part = lambda v: F.when(~F.lower(squash(v)).isin("-", "n/a"), squash(v))
    listed = lambda xs, f, kind: F.coalesce(F.transform(xs, f), F.array().cast(kind))
    filled = lambda xs: F.filter(F.coalesce(F.transform(xs, lambda i: F.trim(i)), F.array().cast("array<string>")), lambda i: i != "")
    person = lambda p: F.struct(F.concat_ws(" ", *[part(p["relatedPersonName"][n]) for n in ("firstName", "middleName", "lastName")]).alias("name"), filled(p["relatedPersonRelationshipList"]["relationship"]).alias("roles"), said(p["relationshipClarification"]).alias("title"), squash(p["relatedPersonAddress"]["city"]).alias("city"), squash(p["relatedPersonAddress"]["stateOrCountry"]).alias("state"))
    sellers = F.filter(F.coalesce(offer["salesCompensationList"]["recipient"], F.array()), lambda r: said(r["recipientName"]).isNotNull() | said(r["associatedBDName"]).isNotNull())
    people = "array<struct<name:string,roles:array<string>,title:string,city:string,state:string>>"
    total = squash(amounts["totalOfferingAmount"])
    fields = {
        "failed": ~F.coalesce((F.col("__root") == "edgarSubmission") & x["_corrupt"].isNull(), F.lit(False)),
        "issuer": squash(issuer["entityName"]),
        "cik": F.regexp_replace(squash(issuer["cik"]), "^0+(?=.)", ""),
        "form_type": form,
        "amendment": F.coalesce(told(filing["newOrAmendment"]["isAmendment"]), F.endswith(form, F.lit("/A"))),
        "previous": squash(filing["newOrAmendment"]["previousAccessionNumber"]),
        "entity_type": F.when(squash(issuer["entityType"]) == "Other", F.coalesce(squash(issuer["entityTypeOtherDesc"]), F.lit("Other"))).otherwise(squash(issuer["entityType"])),
        "year_of_incorporation": money(issuer["yearOfInc"]["value"]).cast("int"),
        "within_five_years": F.coalesce(told(issuer["yearOfInc"]["withinFiveYears"]), F.when(told(issuer["yearOfInc"]["overFiveYears"]), F.lit(False))),
        "state_of_incorporation": squash(issuer["jurisdictionOfInc"]),
        "address": address(*[issuer["issuerAddress"][n] for n in ("street1", "city", "stateOrCountry", "zipCode")]),
        "phone": squash(issuer["issuerPhoneNumber"]),
        "industry": squash(offer["industryGroup"]["industryGroupType"]),
        "industry_category": category_of_industry(squash(offer["industryGroup"]["industryGroupType"])),
        "fund_type": squash(offer["industryGroup"]["investmentFundInfo"]["investmentFundType"]),
        "size_range": F.coalesce(squash(offer["issuerSize"]["revenueRange"]), squash(offer["issuerSize"]["aggregateNetAssetValueRange"])),
        "securities": securities,
        "first_sale": F.when(~F.coalesce(told(filing["dateOfFirstSale"]["yetToOccur"]), F.lit(False)), squash(filing["dateOfFirstSale"]["value"])).try_cast("date"),
        "amount": money(total),
        "indefinite": F.coalesce(F.contains(F.lower(total), F.lit("indefinite")), F.lit(False)) | F.coalesce(told(amounts["isIndefinite"]), F.lit(False)),
        "sold": money(amounts["totalAmountSold"]),
        "remaining": money(amounts["totalRemaining"]),
        "minimum": money(offer["minimumInvestmentAccepted"]),
        "investors": money(investors["totalNumberAlreadyInvested"]).cast("long"),
        "not_accredited": F.when(told(investors["hasNonAccreditedInvestors"]), money(investors["numberNonAccreditedInvestors"]).cast("long")).when(~told(investors["hasNonAccreditedInvestors"]), F.lit(0).cast("long")),
        "commissions": money(fees["salesCommissions"]["dollarAmount"]),
        "finders_fees": money(fees["findersFees"]["dollarAmount"]),
        "exemptions": filled(offer["federalExemptionsExclusions"]["item"]),
        "people": listed(x["relatedPersonsList"]["relatedPersonInfo"], person, people),
        "sellers": F.transform(sellers, lambda r: F.struct(said(r["recipientName"]).alias("name"), said(r["recipientCRDNumber"]).alias("number"), said(r["associatedBDName"]).alias("dealer"), said(r["associatedBDCRDNumber"]).alias("dealer_number"))),
        "other_issuers": filled(F.transform(x["issuerList"]["issuer"], lambda i: F.coalesce(i["entityName"], F.lit("")))),
    }
    return d.withColumns(fields).drop("__root", "__x", xml)


def wanted_filing(kind: str = "all", industries: list[str] | None = None, funds: bool = True, least: float | None = None, most: float | None = None) -> Column:
    """The filter of a feed over read_filings' columns.

    kind: all, new or amendment.  industries: groups or categories, in whatever case.  An indefinite amount is beyond every
    bound; one that is not told lies in no range.
    """
    keep = F.lit(True)
    if kind != "all":
        keep = keep & (F.col("amendment") if kind == "amendment" else ~F.col("amendment"))
    group = F.lower(F.coalesce("industry", F.lit("")))
    if not funds:
        keep = keep & (group != "pooled investment fund")
    if industries:
        names = [i.lower() for i in industries]
        keep = keep & (group.isin(names) | F.coalesce(F.lower("industry_category").isin(names), F.lit(False)))
    amount = F.when(F.col("indefinite"), float("inf")).otherwise(F.col("amount"))
    for bound in ([] if least is None else [amount >= least]) + ([] if most is None else [amount <= most]):
        keep = keep & F.coalesce(bound, F.lit(False))
    return keep


def filings_run(listed: DataFrame, documents: DataFrame, seen: DataFrame, window: tuple[str, str], keep: Column, most: int) -> DataFrame:
    """Every filing of a listing (accession, form_type, filed, place) with its fields, `outcome` and, when emitted, its `nth`.

    Filings of the window's days come latest day first and in the order of the listing, each accession once.  outcome:
    skippedSeen (accession in `seen`), failed, skippedFilter, emitted, or notReached (behind the `most`-th emitted one).
    documents: accession and xml, read only for filings not seen.  The emitted and the seen ones that were reached make the next state.
    """
    inside = listed.where(F.col("filed").between(*[F.lit(day).cast("date") for day in window]))
    once = first_wins(inside, ["accession"], [F.col("filed").desc(), "place"])
    known = seen.select(F.col("accession").alias("__a")).distinct()
    marked = once.join(known, F.col("accession") == F.col("__a"), "left").withColumn("__seen", F.col("__a").isNotNull()).drop("__a")
    fresh = read_filings(marked.where("not __seen").join(documents.groupBy("accession").agg(F.max("xml").alias("xml")), "accession", "left"))
    fresh = fresh.withColumn("outcome", F.when(F.col("failed"), "failed").when(keep, "emitted").otherwise("skippedFilter"))
    rows = fresh.unionByName(marked.where("__seen").withColumn("outcome", F.lit("skippedSeen")), allowMissingColumns=True).drop("__seen")
    rows = Steps(listed.sparkSession, "filings-run").put(rows)  # each document is read once; the table stays for the rows that are read from it
    # places of all rows by day, then the number of those to be emitted up to each: days hold the windows
    numbered = placed(rows.where("outcome = 'emitted'"), [], [(F.col("filed"), True)], [F.col("place")], "nth").select("accession", "nth")
    rows = rows.join(numbered, "accession", "left")
    last = rows.where(F.col("nth") == most).select(F.struct((-F.unix_date("filed")).alias("d"), F.col("place").alias("p")).alias("__last"))  # one row at most
    rows = rows.join(F.broadcast(last.agg(F.max("__last").alias("__last"))), F.lit(True))
    behind = F.coalesce(F.struct((-F.unix_date("filed")).alias("d"), F.col("place").alias("p")) > F.col("__last"), F.lit(False))
    return rows.withColumn("outcome", F.when(behind, "notReached").otherwise(F.col("outcome"))).withColumn("nth", F.when(~behind, F.col("nth"))).drop("__last")
