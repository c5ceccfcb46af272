"""Queries of itineraries, legal notices, metered transcripts and recorded pages on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import itineraries as IT
from ..operators import notices as NO
from ..operators import ordered as O
from ..operators import state as ST
from ..operators import transcripts as TR
from ..sources import recorded as RP
from ..sources.adapters import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


_ITINERARIES = """legs AS (SELECT o_custkey AS route, o_orderkey AS trip, o_orderdate AS placed, CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END AS currency, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS dep, l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) + to_minutes(CAST(l_quantity AS BIGINT) * 3) AS arr, l_partkey AS number, l_returnflag AS carrier, l_suppkey % 3 AS src, l_partkey % 3 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
chain AS (SELECT *, lead(dep) OVER w AS next_dep, lead(src) OVER w AS next_src, row_number() OVER w AS nth FROM legs WINDOW w AS (PARTITION BY trip ORDER BY dep, arr, number, carrier, src, dst)),
trips AS (SELECT route, trip, placed, currency, cents, min(dep) AS dep, CAST(date_diff('minute', min(dep), arg_max(arr, nth)) AS BIGINT) AS minutes, count(*) - 1 AS stops, coalesce(CAST(sum(date_diff('minute', arr, next_dep)) AS BIGINT), 0) AS waiting,
  coalesce(string_agg(dst, ',' ORDER BY nth) FILTER (WHERE next_dep IS NOT NULL), '') AS places, string_agg(number, ',' ORDER BY nth) AS numbers, bool_and(next_dep IS NULL OR (next_src = dst AND next_dep >= arr)) AS connected FROM chain GROUP BY ALL),
keyed AS (SELECT *, route || '|' || numbers || '|' || strftime(dep, '%Y-%m-%d %H:%M') AS key FROM trips),
now AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY dep, trip) AS rank, cents = min(cents) OVER (PARTITION BY route) AS is_cheapest FROM keyed),
then_ AS (SELECT key, cents - CASE WHEN trip % 10 < 3 THEN 100 ELSE 0 END AS cents, currency, row_number() OVER (PARTITION BY route ORDER BY dep, trip) AS rank FROM keyed WHERE placed < TIMESTAMP '1998-01-01')"""


def _trips(spark: SparkSession, d: str) -> DataFrame:
    """An itinerary for each order, its lines being the legs."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    departs = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))
    legs = li.select(
        F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("trip"), F.col("o_orderdate").alias("placed"), F.when(F.col("o_orderstatus") == "F", "EUR").otherwise("USD").alias("currency"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        departs.alias("departs"), (departs + F.make_dt_interval(mins=(F.col("l_quantity").cast("int") * 3))).alias("arrives"), F.col("l_partkey").alias("number"), F.col("l_returnflag").alias("carrier"), (F.col("l_suppkey") % 3).alias("origin"), (F.col("l_partkey") % 3).alias("destination"),
    )
    trips = IT.join_legs(legs, ["route", "trip", "placed", "currency", "cents"])
    return trips.withColumn("key", IT.itinerary_key(["route"]))


@query(f"""WITH {_ITINERARIES} SELECT route, trip, key, cents, currency, rank, is_cheapest, minutes, stops, waiting, places, connected FROM now
WHERE rank <= 5 AND cents > 0 AND NOT EXISTS (SELECT 1 FROM then_ WHERE then_.rank <= 5 AND then_.key = now.key AND then_.cents = now.cents AND then_.currency = now.currency)""")
def itinerary_prices(spark: SparkSession, d: str) -> DataFrame:
    """Priced itineraries of every search that an earlier run did not list, or listed at another price."""
    trips, search, order = _trips(spark, d), ["route"], [F.col("departs"), F.col("trip")]
    before = trips.where(F.col("placed") < F.lit("1998-01-01").cast("timestamp")).withColumn("cents", F.col("cents") - F.when(F.col("trip") % 10 < 3, 100).otherwise(0))
    mark = IT.price_mark("cents", "currency")
    seen = IT.priced(before, search, order, "cents", 5).select("key", mark.alias("mark"))
    now = IT.priced(trips, search, order, "cents", 5).withColumn("mark", mark)
    waiting = F.coalesce(F.aggregate(F.transform("layovers", lambda x: x["minutes"]), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    out = ST.only_new(now, seen, ["key"], mark="mark")
    return out.select("route", "trip", "key", "cents", "currency", "rank", "is_cheapest", "minutes", "stops", waiting.alias("waiting"), F.array_join(F.transform("layovers", lambda x: x["place"].cast("string")), ",").alias("places"), "connected")


@query(f"""WITH {_ITINERARIES}, old AS (SELECT key, max(cents || ' ' || currency) AS mark FROM then_ GROUP BY key), new AS (SELECT key, max(cents || ' ' || currency) AS mark FROM now GROUP BY key)
SELECT key, coalesce(new.mark, old.mark) AS mark FROM old FULL JOIN new USING (key)""")
def itinerary_state(spark: SparkSession, d: str) -> DataFrame:
    """The prices that a run leaves for the next one."""
    trips, mark = _trips(spark, d), IT.price_mark("cents", "currency").alias("mark")
    before = trips.where(F.col("placed") < F.lit("1998-01-01").cast("timestamp")).withColumn("cents", F.col("cents") - F.when(F.col("trip") % 10 < 3, 100).otherwise(0))
    return IT.latest_marks(before.select("key", mark).groupBy("key").agg(F.max("mark").alias("mark")), trips.select("key", mark), "key", "mark")


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """A legal notice for each customer, in one of eight layouts."""
    key = F.col("c_custkey")
    n, name = key.cast("string"), F.replace("c_name", F.lit("#"), F.lit(" "))
    d9 = F.lpad(n, 9, "0")
    three = lambda sep: F.concat_ws(sep, F.substring(d9, 1, 3), F.substring(d9, 4, 3), F.substring(d9, 7, 3))
    street, post, small = F.concat(F.lit("Weg "), (1 + key % 90).cast("string")), (10000 + key % 80000).cast("string"), (1000 + key % 8000).cast("string")
    call = (1000000 + key).cast("string")

    def lines(*parts: Column | str) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    layouts = [
        lines("Start", "Kontakt", "Impressum", c(name, " GmbH"), street, c(post, " Berlin"), c("Tel.: +49 30 ", call), c("Fax: +49 30 ", call, "9"), c("E-Mail: info@haus", n, ".de"), c("Amtsgericht Charlottenburg, HRB ", n), c("USt-IdNr.: DE", d9)),
        lines("Impressum", "Firma:", c(name, " GmbH & Co KG"), "Anschrift:", street, c(post, " Bad Homburg"), "Telefon", c("089 / ", call), "Registergericht: Amtsgericht München", "Registernummer:", c("HRA ", n), "USt-ID", c("DE ", three(" "))),
        lines(c("Impressum | ", name, " AG | ", street, " | A-", small, " Wien | FN ", n, "k | Handelsgericht Wien | ATU", F.substring(d9, 2, 8))),
        lines(c(name, " AG"), c("Bahnhofstrasse ", (1 + key % 90).cast("string")), c("CH-", small, " Zürich"), c("Tél. +41 44 ", call), c("UID: CHE-", three("."), " MWST")),
        lines("Mentions légales", c(name, " SAS au capital de 1 000 euros"), c((1 + key % 90).cast("string"), " rue de la Paix"), c("75", F.lpad((key % 20).cast("string"), 3, "0"), " Paris"), c("RCS Paris ", three(" ")), c("TVA intracommunautaire : FR12", d9)),
        lines("Andere KG", "HRB 1", "Impressum", "Webdesign: Maler GmbH", c("© 2020-2024 ", name, " e.V."), "Registergericht Amtsgericht Hamburg unter", c("VR ", n), "Wir sind eine GmbH"),
        lines("Legal notice", c("Company name: ", name, " S.r.l."), "PR 12", "Partita IVA", c("IT00", d9), "Copyright 2020 Other Ltd"),
        lines("Impressum", "Gerne sind wir bei Fragen da", "DE12345", c("Fragen an kontakt@haus", n, ".at oder chef.meier@haus", n, ".at")),
    ]
    text = F.lit(None).cast("array<string>")
    for i, layout in enumerate(layouts):
        text = F.when(key % 8 == i, layout).otherwise(text)
    return spread(table(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", text.alias("lines"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 8 AS k, c_custkey::VARCHAR AS n, lpad(c_custkey::VARCHAR, 9, '0') AS d9, replace(c_name, '#', ' ') AS name, 'Weg ' || (1 + c_custkey % 90) AS weg, (10000 + c_custkey % 80000)::VARCHAR AS post, (1000 + c_custkey % 8000)::VARCHAR AS small, (1000000 + c_custkey)::VARCHAR AS tel FROM customer),
x AS (SELECT *, d9[1:3] || ' ' || d9[4:6] || ' ' || d9[7:9] AS spaced, d9[1:3] || '.' || d9[4:6] || '.' || d9[7:9] AS dotted FROM c)
SELECT c_custkey, CASE WHEN k < 7 THEN name || ' ' || list_extract(['GmbH', 'GmbH & Co KG', 'AG', 'AG', 'SAS', 'e.V.', 'S.r.l.'], k + 1) END AS company_name, list_extract(['GmbH', 'GmbH & Co. KG', 'AG', 'AG', 'SAS', 'e.V.', 'S.r.l.'], k + 1) AS legal_form,
  CASE WHEN k < 3 THEN weg WHEN k = 3 THEN 'Bahnhofstrasse ' || (1 + c_custkey % 90) WHEN k = 4 THEN (1 + c_custkey % 90) || ' rue de la Paix' END AS street, CASE WHEN k < 2 THEN post WHEN k < 4 THEN small WHEN k = 4 THEN '75' || lpad((c_custkey % 20)::VARCHAR, 3, '0') END AS postal_code, list_extract(['Berlin', 'Bad Homburg', 'Wien', 'Zürich', 'Paris'], k + 1) AS city,
  CASE k WHEN 0 THEN '+49 30 ' || tel WHEN 1 THEN '089 / ' || tel WHEN 3 THEN '+41 44 ' || tel END AS phone, CASE k WHEN 0 THEN '+49 30 ' || tel || '9' END AS fax, CASE k WHEN 0 THEN 'info@haus' || n || '.de' WHEN 7 THEN 'kontakt@haus' || n || '.at' END AS email,
  list_extract(['HRB', 'HRA', 'FN', 'CHE', 'RCS', 'VR', NULL, NULL], k + 1) AS register_kind, CASE k WHEN 0 THEN 'HRB ' || n WHEN 1 THEN 'HRA ' || n WHEN 2 THEN 'FN ' || n || ' k' WHEN 3 THEN 'CHE-' || dotted WHEN 4 THEN 'RCS Paris ' || spaced WHEN 5 THEN 'VR ' || n END AS register_number,
  list_extract(['Amtsgericht Charlottenburg', 'Amtsgericht München', 'Handelsgericht Wien', NULL, 'RCS Paris', 'Amtsgericht Hamburg', NULL, NULL], k + 1) AS register_court, CASE k WHEN 0 THEN 'DE' || d9 WHEN 1 THEN 'DE' || d9 WHEN 2 THEN 'ATU' || d9[2:9] WHEN 3 THEN 'CHE-' || dotted || ' MWST' WHEN 4 THEN 'FR12' || d9 WHEN 6 THEN 'IT00' || d9 END AS vat_id,
  list_extract(['DE', 'DE', 'AT', 'CH', 'FR', 'DE', 'IT', 'AT'], k + 1) AS country FROM x""")
def company_notices(spark: SparkSession, d: str) -> DataFrame:
    """Company fields out of the lines of legal notices in eight layouts."""
    made = _notices(spark, d).withColumn("site", F.when(F.col("c_custkey") % 8 == 7, F.concat(F.lit("haus"), F.col("c_custkey").cast("string"), F.lit(".at"))))
    return NO.company_fields(made, "lines", "site").drop("lines", "site")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as recordings of 30 seconds a turn, with own segments and with links to published transcripts, some unusable."""
    said = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", ""), r"[\x09-\x0D\x20]+", " "))
    turns = table(spark, d, "conversations").select("conv_id", F.struct((F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 30.0).alias("end"), said.alias("text")).alias("s"))
    items = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.filter(F.sort_array(F.collect_list("s")), lambda s: s["text"] != "").alias("own"))
    texts = F.transform("own", lambda s: s["text"])
    page = F.lit("<!DOCTYPE html><html><body>Sign in</body></html>")
    kind = F.col("conv_id") % 6
    link = lambda when, name, body: F.when(when, F.struct(F.lit(name).alias("kind"), body.alias("body")))
    stamped = F.transform("own", lambda s: F.concat(F.lit("00:00:01.000 --> 00:00:02.000\n"), s["text"]))
    links = F.array_compact(
        F.array(
            link(kind == 1, "vtt", F.concat(F.lit("WEBVTT\n\n"), F.array_join(stamped, "\n\n"))),
            link(kind.isin(2, 5), "vtt", page),
            link(kind.isin(2, 3), "text", F.array_join(texts, "\r\n\r\n")),
            link(kind.isin(3, 4), "html", F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.array_join(texts, "</p>\n<p class=a>"), F.lit("</p></body></html>"))),
            link(kind == 5, "json", F.lit('{"segments": []}')),
        )
    )
    return items.withColumn("links", links)


def _metered(spark: SparkSession, d: str) -> DataFrame:
    made = _transcripts(spark, d)
    links = made.select("conv_id", F.explode("links").alias("x")).select("conv_id", "x.*")
    chosen = TR.choose_transcripts(made.drop("links"), links, ["conv_id"], "own").where("source is not null")
    cost = chosen.withColumns({"minutes": TR.billed_minutes(F.col("source"), F.col("n_turns") * 30), "account": F.col("conv_id") % 3, "day": F.floor(F.col("conv_id") / 50)})
    return TR.metered(cost, ["account"], "day", ["conv_id"], "minutes", F.when(F.col("account") < 2, 200))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&]', '', 'g'), '[\x09-\x0D\x20]+', ' ', 'g')) AS said FROM conversations),
i AS (SELECT conv_id, conv_id % 6 AS k, count(*) AS n, count(*) FILTER (WHERE said <> '') AS n_segments, string_agg(said, chr(10) ORDER BY turn, said) FILTER (WHERE said <> '') AS said FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n_segments, said, CASE WHEN k BETWEEN 1 AND 4 THEN 'published' ELSE 'own' END AS source, CASE k WHEN 1 THEN 'vtt' WHEN 2 THEN 'text' WHEN 3 THEN 'text' WHEN 4 THEN 'html' END AS kind, CASE WHEN k = 5 THEN 'unusable: json, vtt' END AS note,
  CASE WHEN k BETWEEN 1 AND 4 THEN 0 ELSE greatest(1, CAST(ceil(n / 2) AS BIGINT)) END AS minutes FROM i WHERE n_segments > 0),
m AS (SELECT *, CAST(sum(minutes) OVER (PARTITION BY conv_id % 3 ORDER BY conv_id) AS BIGINT) AS spent FROM c)
SELECT conv_id, source, kind, note, n_segments, minutes, spent, sha256(said) AS said_sha256 FROM m WHERE coalesce(conv_id % 3, 2) = 2 OR spent <= 200""")
def metered_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The transcript of each conversation, published or its own, as far as its account's minutes go."""
    said = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    return _metered(spark, d).select("conv_id", "source", "kind", "note", F.size("segments").cast("long").alias("n_segments"), "minutes", "spent", F.sha2(said, 256).alias("said_sha256"))


@query()
def transcript_bills(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of those transcripts, each item billed on its first chunk."""
    return TR.billed_chunks(_metered(spark, d), "conv_id", "segments", "minutes", 400, 80).select("conv_id", "chunk_no", "chunk_count", "start", "end", "billed", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT event_type AS feed, ceil(row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), event_id) / 500)::BIGINT AS page, event_id, value, user_id FROM events""")
def recorded_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Events recorded as pages of 500 rows of each type, read back by page ranges."""
    e = table(spark, d, "events").select("event_type", "event_id", "value", "user_id", F.to_date("ts").alias("day"))
    e = O.placed(e, ["event_type"], [(F.col("day"), False)], [F.col("event_id")], "place")
    pages = e.withColumn("page", O.rows_on_page("place", 500)).drop("place")
    path = RP.record_pages(pages, "event_type", "page", ["day", "event_id"])
    row = F.from_json("row", "event_id long, value double, user_id long")
    return RP.read_pages(spark, path, pages_per_task=20).select("feed", "page", row.alias("r")).select("feed", "page", "r.*")
