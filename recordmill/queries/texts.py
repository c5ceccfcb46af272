"""Queries of the column functions and of document operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import dates as D
from ..functions import markdown as MD
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import documents as DOC
from ..operators import enrich as E
from ..sources import adapters as A
from ..sources.adapters import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_SQUASH = "nullif(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')"


@query(f"""SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(CASE WHEN length(regexp_replace(substr(t, 1, 300), ' [^ ]*$', '')) > 180 THEN regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') ELSE substr(t, 1, 300) END, '[ ,.;:!?-]+$', '') || ' ...' END AS snippet
FROM (SELECT doc_id, {_SQUASH} AS t FROM documents)""")
def snippet_300(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*')) AS BIGINT) AS letter_words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), T.letter_word_count("text").alias("letter_words"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') AS site,
 regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query,
 TRY_CAST(nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/([0-9]+)(?:[./]|$)', 1), '') AS BIGINT) AS number, nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '^/([a-z]{2})(?:/|$)', 1), '') AS lang FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.host("url").alias("host"), U.site_key("url").alias("site"), U.path("url").alias("path"), U.query("url").alias("query"), U.number_in_path("url").alias("number"), U.language_in_path("url").alias("lang"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)=[^&]*&)*(?:utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)=[^&]*(?:&|$)', '\1', 'g'), '[?&]$', '') AS url FROM pages""")
def tracking_free_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.without_tracking("url").alias("url"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || lang || ' ' || text), 'token') OR contains(lower(source || ' ' || lang || ' ' || text), 'license')""")
def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.any_keyword(["token", "License"], "source", "lang", "text")).select("doc_id")


_SLUG = "nullif(regexp_replace(regexp_replace(lower(replace(replace(replace(x, '&', ' '), '+', ' plus '), '#', ' sharp ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


@query(f"""WITH v AS (SELECT DISTINCT p_type AS x FROM part), w(x) AS (VALUES ('large anodized STEEL'), ('Small  Plated-Copper'), ('C++ & C#'), ('promo burnished tin')), k AS (SELECT x, {_SLUG} AS s FROM v)
SELECT w.x AS wanted, k.x AS value FROM w LEFT JOIN k ON k.s = (SELECT {_SLUG.replace('x,', 'w.x,')})""")
def facet_resolve(spark: SparkSession, d: str) -> DataFrame:
    wanted = values(spark, [("large anodized STEEL",), ("Small  Plated-Copper",), ("C++ & C#",), ("promo burnished tin",)], "wanted string")
    return E.resolve_facets(wanted, table(spark, d, "part").select("p_type"), "wanted", "p_type", T.slug)


@query(f"SELECT p_partkey, {_SLUG.replace('x,', 'p_name,')} AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("""SELECT c_custkey, '$' || printf('%.2f', c_acctbal) AS shown, c_acctbal AS amount, CAST(floor((1 - c_acctbal / 10000) * 1000 + 0.5) / 10 AS DOUBLE) AS saved FROM customer""")
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.format_string("%.2f", "c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", shown.alias("shown"), N.money(shown).alias("amount"), ((F.floor((1 - F.col("c_acctbal") / 10000) * 1000 + 0.5)) / 10).alias("saved"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey * 10 WHEN 1 THEN o_custkey * 10000 WHEN 2 THEN 24000 + o_custkey END AS n FROM orders""")
def compact_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Customer numbers written with K, with M, with blanks, and as words."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    shown = F.when(k == 0, F.concat((c / 100).cast("decimal(12,2)").cast("string"), F.lit("K"))).when(k == 1, F.concat((c / 100).cast("decimal(12,2)").cast("string"), F.lit("m"))).when(k == 2, F.concat(F.format_number(24000 + c, 0))).otherwise("many")
    return table(spark, d, "orders").select("o_orderkey", N.compact(shown).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size <> 9 THEN CAST(p_size AS BIGINT) * 1000 END AS low, CASE WHEN p_size <> 9 THEN 50000 + CAST(p_size AS BIGINT) * 1000 END AS high, CASE WHEN p_size = 9 THEN NULL WHEN p_size % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM part""")
def pay_ranges(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    dollars = F.concat(F.lit("$"), size.cast("string"), F.lit("K - $"), (50 + size).cast("string"), F.lit("K"))
    euros = F.concat(F.lit("€"), F.format_number(size * 1000, 0), F.lit("-€"), F.format_number(50_000 + size * 1000, 0))
    p = N.pay_range(F.when(size == 9, "competitive").when(size % 2 == 0, dollars).otherwise(euros))
    return table(spark, d, "part").select("p_partkey", p["low"].alias("low"), p["high"].alias("high"), p["currency"].alias("currency"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN s % 3600 WHEN 2 THEN s END AS seconds FROM (SELECT event_id, user_id * 61 + event_id % 7000 AS s FROM events)""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds as HH:MM:SS, as MM:SS, as a number and as words."""
    s, k = F.col("user_id") * 61 + F.col("event_id") % 7000, F.col("event_id") % 4
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = F.when(k == 0, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))).when(k == 1, F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))).when(k == 2, F.concat(F.lit(" "), s.cast("string"))).otherwise("1:2:3:4")
    return table(spark, d, "events").select("event_id", D.duration_seconds(shown).alias("seconds"))


@query("""SELECT event_id, printf('%02d:%02d:%02d,%03d', m // 3600000, (m // 60000) % 60, (m // 1000) % 60, m % 1000) AS code, CASE WHEN m // 3600000 = 0 THEN (m // 60000) || 'm' WHEN (m // 60000) % 60 = 0 THEN (m // 3600000) || 'h' ELSE (m // 3600000) || 'h ' || ((m // 60000) % 60) || 'm' END AS spoken
FROM (SELECT event_id, CAST(floor(value * 100 * 1000 + 0.5) AS BIGINT) AS m FROM events)""")
def timecodes(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("value") * 100
    return table(spark, d, "events").select("event_id", D.timecode(seconds).alias("code"), D.hours_and_minutes(F.floor(F.floor(F.col("value") * 100 * 1000 + 0.5) / 60000)).alias("spoken"))


@query("""SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, CAST(CAST(o_orderdate AS DATE) + 15 AS VARCHAR) AS due, CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' - 29 AND DATE '1996-01-01' AS recent FROM orders""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", D.week_start("o_orderdate").cast("string").alias("week"), F.trunc(day, "month").cast("string").alias("month"), D.add_fractional_months(day, 0.5).cast("string").alias("due"), D.last_days(day, "1996-01-01", 30).alias("recent"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CASE (month(o_orderdate) - 1) // 3 WHEN 0 THEN 'W' WHEN 1 THEN 'X' WHEN 2 THEN 'S' ELSE 'F' END || strftime(o_orderdate, '%y') END AS code FROM orders""")
def season_codes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("winter", "Spring", "SUMMER", "Fall")))
    shown = F.when(F.col("o_orderkey") % 9 != 0, F.concat_ws(" ", F.get(names, F.quarter("o_orderdate") - 1), F.year("o_orderdate").cast("string"))).otherwise(F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", D.season_code(shown).alias("code"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR source = '' THEN NULL ELSE source || ' x' END AS tidy, lang AS base FROM documents""")
def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 15
    shown = F.when(k == 0, " N/A ").when(k == 5, "[Redacted]").when(k == 10, " \n\t").otherwise(F.concat(F.lit("  "), "source", F.lit(" \n\t x ")))
    return table(spark, d, "documents").select("doc_id", T.none_to_null(shown).alias("tidy"), T.base_language(F.concat(F.upper("lang"), F.lit("-US"))).alias("base"))


@query("""SELECT p_partkey, p_brand || '|' || p_type || CASE WHEN lower(p_type) = lower(p_brand) THEN '' ELSE '' END || '|' || p_size AS items FROM part""")
def comma_lists(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat_ws(",", "p_brand", F.concat(F.lit(" "), F.upper("p_brand")), F.concat(F.lit("  "), "p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.comma_list(shown), "|").alias("items"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey || '-' || c_custkey ELSE lower(c_mktsegment) || 'OrRemote' END AS label FROM customer""")
def enum_labels(spark: SparkSession, d: str) -> DataFrame:
    size = F.concat_ws("_", F.lit("SIZE"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    shown = F.when(F.col("c_custkey") % 2 == 0, size).otherwise(F.concat("c_mktsegment", F.lit("_OR_REMOTE")))
    return table(spark, d, "customer").select("c_custkey", T.pretty_enum(shown).alias("label"))


@query("""SELECT c_custkey, 'sales' || c_custkey || '@shop.n' || c_nationkey || '.org' AS address FROM customer""")
def clear_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses hidden with (at) and [dot], and plain ones."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    hidden = F.concat(F.lit("sales"), k, F.lit(" (AT) shop [dot] n"), n, F.lit("{.}org"))
    plain = F.concat(F.lit("sales"), k, F.lit("@shop.n"), n, F.lit(".org"))
    return table(spark, d, "customer").select("c_custkey", T.clear_email(F.when(F.col("c_custkey") % 3 == 0, plain).otherwise(hidden)).alias("address"))


_RULES = [("limited|llc", "company"), ("foundation|non.?profit", "non-profit"), ("partnership|llp", "partnership")]


@query("""SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'non-profit' WHEN 2 THEN 'company' ELSE 'other' END AS category FROM supplier""")
def entity_categories(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fits: a limited partnership is a company."""
    kinds = F.array(*map(F.lit, ("Domestic LLC", "Non-Profit corporation", "Limited Partnership", "Trust")))
    return table(spark, d, "supplier").select("s_suppkey", T.category_of(F.get(kinds, F.col("s_nationkey") % 4), _RULES, "other").alias("category"))


@query("""SELECT p_partkey, CAST(greatest(floor(p_size * 40 * s / 2 + 0.5) * 2, 2) AS BIGINT) AS width, CAST(greatest(floor(p_retailprice * s / 2 + 0.5) * 2, 2) AS BIGINT) AS height, CAST(greatest(1, ceil((p_retailprice - 1.0) / 60 - 1e-9)) AS BIGINT) AS minutes, CAST(least(5, greatest(1, floor(p_size * 2 / 20.0 + 0.5))) AS BIGINT) AS stars
FROM (SELECT *, least(1.0, 640.0 / (p_size * 40), 480.0 / p_retailprice) AS s FROM part)""")
def planner_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    box = N.fit_inside(F.col("p_size") * 40, "p_retailprice", 640, 480)
    return table(spark, d, "part").select("p_partkey", box["width"].alias("width"), box["height"].alias("height"), N.billed_minutes("p_retailprice").alias("minutes"), N.stars(F.col("p_size") * 2).alias("stars"))


@query("""SELECT l_orderkey, l_linenumber, CAST(floor((1 - (l_extendedprice * (1 - l_discount)) / l_extendedprice) * 100 + 0.5) AS BIGINT) AS percent FROM lineitem WHERE l_discount > 0""")
def discounts(spark: SparkSession, d: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").where("l_discount > 0").select("l_orderkey", "l_linenumber", N.discount_percent(net, "l_extendedprice").alias("percent"))


@query("""SELECT event_type, CAST(sum(2000) + 1500 * count(*) FILTER (value > 50) AS BIGINT) AS cost FROM events GROUP BY event_type""")
def run_cost(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") > 50).alias("details"))
    return counts.select("event_type", N.cost_millionths([("rows", 0.002), ("details", 0.0015)]).alias("cost"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", A.at(A.guarded_json(F.concat(F.lit(")]}'\n"), "props")), "$.k", "long").alias("k"))


_ROBOTS = [("/", True), ("/en/", False), ("/en/*5$", True), ("/de/*7", False), ("/fr/", False), ("/fr/", True), ("/x?y", False)]
_PATH = "nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '')"


@query(f"""SELECT page_id, CASE WHEN host IS NULL OR p IS NULL THEN NULL WHEN p LIKE '/en/%5' THEN true WHEN p LIKE '/en/%' THEN false WHEN p LIKE '/de/%7%' THEN false ELSE true END AS allowed
FROM (SELECT page_id, {_PATH} AS p, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), '') AS host FROM pages)""")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every page under one set of rules of its host."""
    pages = table(spark, d, "pages").select("page_id", U.host("url").alias("host"), F.nullif(U.path("url"), F.lit("")).alias("path"))
    rules = pages.select("host").where("host is not null").distinct().crossJoin(F.broadcast(values(spark, _ROBOTS, "rule string, allow boolean")))
    decided = A.robots_decision(pages.where("host is not null and path is not null").select("host", "path").distinct(), rules, "host", "path")
    return pages.join(decided, ["host", "path"], "left").select("page_id", "allowed")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN false ELSE a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) END AS private
FROM (SELECT *, CASE l_partkey % 8 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 100 WHEN 4 THEN 169 WHEN 5 THEN 127 ELSE l_partkey % 223 END AS a, CASE l_partkey % 8 WHEN 2 THEN 167 + l_suppkey % 3 WHEN 4 THEN 253 + l_suppkey % 3 ELSE l_orderkey % 256 END AS b FROM lineitem)""")
def private_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of the keys of line items, near and in the private ranges; some are names."""
    k, s, o = F.col("l_partkey") % 8, F.col("l_suppkey"), F.col("l_orderkey")
    a = F.when(k == 0, 10).when(k == 1, 172).when(k == 2, 192).when(k == 3, 100).when(k == 4, 169).when(k == 5, 127).otherwise(F.col("l_partkey") % 223)
    b = F.when(k == 2, 167 + s % 3).when(k == 4, 253 + s % 3).otherwise(o % 256)
    ip = F.when(o % 11 == 0, "host.example").otherwise(F.concat_ws(".", a.cast("string"), b.cast("string"), (s % 256).cast("string"), F.lit("7")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.private_ip(ip).alias("private"))


@query()
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return DOC.page_lines(table(spark, d, "pages"), "page_id", "html").select("page_id", F.size("lines").cast("long").alias("n_lines"), F.size("links").cast("long").alias("n_links"), F.array_join("lines", "\n").alias("text"))


@query()
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return DOC.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query()
def transcript_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as timed words, merged to sentences and written as captions."""
    words = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[ \n]+")).alias("i", "w"))
    begin = F.col("turn") * 1000 + F.col("i") * 0.4
    timed = words.where("w <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(begin.cast("double").alias("start"), (begin + 0.4).cast("double").alias("end"), F.col("w").alias("text"), F.col("role").alias("speaker")))).alias("words"))
    return timed.select("conv_id", DOC.sentences_of(F.col("words")).alias("s")).select("conv_id", F.size("s").cast("long").alias("n"), DOC.cues(F.col("s")).alias("srt"))


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000 AND (source LIKE 'src1%' OR source = 'src0')""")
def compound_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("lang").isin("en", "de") & F.col("n_chars").between(100, 5000) & (F.col("source").startswith("src1") | (F.col("source") == "src0"))).select("doc_id", "lang", "source", "n_chars")


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT a.user_id, len(list_intersect(a.s, b.s)) >= 0.8 * greatest(least(len(a.s), len(b.s)), 1) AS same FROM a JOIN b USING (user_id)""")
def soft_404(spark: SparkSession, d: str) -> DataFrame:
    e, cut = table(spark, d, "events"), F.lit("2024-01-10").cast("timestamp_ntz")
    sets = lambda df, n: df.groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    both = sets(e.where(F.col("ts") < cut), "a").join(sets(e.where(F.col("ts") >= cut), "b"), "user_id")
    return both.select("user_id", (E.overlap_share(F.col("a"), F.col("b")) >= 0.8).alias("same"))


@query("""SELECT p_partkey, 'name' || chr(9) || 'size' || chr(10) || p_name || chr(9) || p_size || chr(10) || chr(10) || 'a ' || p_brand || ' line' || chr(10) || 'item' AS plain FROM part""")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose header row is empty, bullets, rules, fences, emphasis and comments, to plain text."""
    rows = F.concat(F.lit("|  |  |\n| --- | --- |\n| name | size |\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n\n<!-- no -->***\n```sql\na *"), "p_brand", F.lit("* **line**\n```\n- [item](http://x)"))
    return table(spark, d, "part").select("p_partkey", MD.to_plain(MD.promote_header(rows)).alias("plain"))


@query("""SELECT event_id, 2 AS n, CAST(user_id + 0.5 AS DOUBLE) AS start, CAST(user_id + 2.75 AS DOUBLE) AS finish, event_type || ' & <b>' AS text, CAST(event_id % 1000 AS DOUBLE) / 1000 AS second FROM events""")
def timed_text(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), (F.col("event_id") % 1000).cast("string")
    xml = F.concat(F.lit('<transcript><text start="'), u, F.lit('.5" dur="2.25"><i>'), "event_type", F.lit(' &amp;amp;\n &amp;lt;b&amp;gt;</i></text><text start="1"> </text><p t="'), k, F.lit('" d="10">x</p></transcript>'))
    own = table(spark, d, "events").select("event_id", DOC.timed_segments(xml).alias("s"))
    one = lambda i, f: F.get("s", F.lit(i))[f]
    return own.select("event_id", F.size("s").alias("n"), one(0, "start").alias("start"), one(0, "end").alias("finish"), one(0, "text").alias("text"), one(1, "start").alias("second"))


@query("""SELECT c_custkey, 'Phone: ' || c_custkey || '|Name: x|Mail:|Fax: ' || c_nationkey || '|end' AS lines, c_name || ' GmbH' AS company, 'Bad ' || c_mktsegment AS court FROM customer""")
def legal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of legal notices: labels with their values, the company's name, the register court."""
    lines = F.array(F.lit("Phone: "), F.col("c_custkey").cast("string"), F.lit("Name: x"), F.lit("Mail:"), F.lit("Fax:"), F.col("c_nationkey").cast("string"), F.lit("end"))
    name = F.concat(F.lit("Company: "), "c_name", F.lit(" GmbH | all rights reserved"))
    court = F.concat(F.lit("Registergericht: Amtsgericht Bad "), "c_mktsegment", F.lit(", HRB 1"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(DOC.with_values(lines), "|").alias("lines"), C.company_name(name).alias("company"), C.register_court(court).alias("court"))
