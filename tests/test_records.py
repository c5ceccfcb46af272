"""Records, contacts and listing fields on small values."""

from pyspark.sql import functions as F

from recordmill.functions import contacts as C
from recordmill.functions import listings as L
from recordmill.operators import records as R

NOTE = "Impressum\nAcme GmbH\nHauptstraße 5a\n80331 München\nTel.: +49 (89) 123-456\nHRB 12345\nUSt-IdNr. DE 123456789\nMail: max.m (at) acme.de, info [at] acme [dot] de"
XML = """<edgarSubmission><primaryIssuer><entityName> Acme  Fund </entityName><issuerAddress><street1>1 A St</street1><city>B</city><stateOrCountry>NY</stateOrCountry></issuerAddress></primaryIssuer>
<relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>A</firstName><lastName>B</lastName></relatedPersonName><relatedPersonRelationshipList><relationship>Director</relationship><relationship>Officer</relationship></relatedPersonRelationshipList></relatedPersonInfo></relatedPersonsList>
<offeringData><typesOfSecuritiesOffered><isEquityType>true</isEquityType><isDebtType>false</isDebtType></typesOfSecuritiesOffered><offeringSalesAmounts><totalOfferingAmount>Indefinite</totalOfferingAmount><totalAmountSold>500</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"""


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x").alias("r")).first()["r"]


def test_contacts(spark):
    assert one(spark, NOTE, C.vat_id) == "DE123456789"
    assert tuple(one(spark, NOTE, C.register_number)) == ("HRB", "12345")
    assert one(spark, NOTE, C.legal_form) == "GmbH"
    assert tuple(one(spark, NOTE, C.postal_address)) == ("Hauptstraße 5a", "80331", "München")
    assert one(spark, NOTE, C.phone) == "+49 (89) 123-456"
    assert one(spark, NOTE, lambda x: C.company_email(x, F.lit("acme.de"))) == "info@acme.de"
    assert one(spark, NOTE, C.looks_like_imprint) and not one(spark, "hello", C.looks_like_imprint)
    assert one(spark, "Max Mustermann", C.placeholder)
    assert one(spark, None, C.vat_id) is None and one(spark, None, C.emails) is None


def test_listings(spark):
    assert tuple(one(spark, "₹5L - ₹8L", L.indian_pay)) == (500000, 800000)
    assert tuple(one(spark, "Up to 12 lakh", L.indian_pay)) == (None, 1200000)
    assert tuple(one(spark, "0.1% – 1.5%", L.equity)) == (0.1, 1.5)
    assert tuple(one(spark, "48.1, 11.5", L.coordinates)) == (48.1, 11.5) and one(spark, "98, 1", L.coordinates) is None
    assert one(spark, "6-3, 4-6, 7-6(4)", lambda x: L.match_winner(L.set_scores(x))) == 1
    assert one(spark, "6-3, 2-1", lambda x: L.match_winner(L.set_scores(x))) == 1 and one(spark, "5-3", lambda x: L.match_winner(L.set_scores(x))) is None
    assert [one(spark, x, L.round_code) for x in ("Semifinals", "Round of 16", "Qualification Final", "x")] == ["SF", "R16", "Q-F", None]
    assert one(spark, 'edm "deep house" live', L.quoted_tags) == ["edm", "deep house", "live"]
    assert one(spark, 10.0, lambda x: L.frame_times(x, 4), "double") == [2.0, 4.0, 6.0, 8.0]
    assert one(spark, 10.0, lambda x: L.interval_times(x, 4.0, 9), "double") == [0.0, 4.0, 8.0]
    assert tuple(one(spark, 7, lambda x: L.contact_sheet(x, 4, 100, 50), "int")) == (4, 2, 400, 100)
    png = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000280000001E0")
    assert one(spark, png, L.file_kind, "binary") == "png" and tuple(one(spark, png, L.png_size, "binary")) == (640, 480)
    probe = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 8, "height": 6}]}'
    assert tuple(one(spark, probe, L.media_streams)) == (12.5, 8, 6, "h264", "aac")
    assert one(spark, 1999, L.kilograms, "int") == 2 and str(one(spark, 1999, L.from_cents, "int")) == "19.99"


def test_records(spark):
    r = one(spark, XML, R.filing_record)
    assert (r["issuer"], r["securities"], r["amount"], r["indefinite"], r["sold"]) == ("Acme Fund", ["equity"], None, True, 500.0)
    assert r["people"][0]["name"] == "A B" and r["people"][0]["roles"] == ["Director", "Officer"] and r["address"]["state"] == "NY"
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "n": " ", "m": "y"}'), (2, "broken")], "k int, j string")
    rows = R.project(df, "j", {"x": ("$.a.b[1]", "string"), "n": ("$.a.b[0]", "long")}, ["k"]).orderBy("k").collect()
    assert [tuple(x) for x in rows] == [(1, "x", 1), (2, None, None)]
    assert R.project_first(df, "j", {"t": ["$.n", "$.m"]}, ["k"]).orderBy("k").first()["t"] == "y"
    kinds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "kind string, v int")
    rows = R.tagged_union(kinds, "kind", {"a": {"x": F.col("v")}, "b": {"y": F.col("v") * 10}}).orderBy("kind").collect()
    assert [tuple(x) for x in rows] == [("a", 1, None), ("b", None, 20)]
    assert one(spark, "Some Page!", lambda x: R.record_key(F.lit(7), x)) == "0007-some-page"
    good, bad = spark.createDataFrame([(1, "t")], "k int, t string"), spark.createDataFrame([(2, "gone")], "k int, error string")
    assert sorted((x["k"], x["t"], x["error"]) for x in R.with_error_rows(good, bad).collect()) == [(1, "t", None), (2, None, "gone")]
    lists = spark.createDataFrame([([[("q", 100, "100")], [("r", 5, "Breakout")]],)], "l array<array<struct<query:string,value:int,formattedValue:string>>>")
    assert [tuple(x) for x in lists.select(R.related_rows(F.col("l")).alias("r")).first()["r"]] == [("top", 1, "q", 100, False), ("rising", 1, "r", 5, True)]
