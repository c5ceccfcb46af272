"""Queries of whole pipelines on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import urls as U
from ..operators import state as ST
from ..plans import pipelines as P
from ..plans.jobs import Job
from ..sources.adapters import Adapter, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, cents FROM (
  SELECT o_orderkey, o_orderdate, o_orderstatus, coalesce(d.cents, CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS cents FROM orders
  LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1) d ON l_orderkey = o_orderkey
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31') WHERE coalesce(cents, 0) >= 10000000 AND NOT (o_orderdate < TIMESTAMP '1996-02-01' AND o_orderstatus = 'F')""")
def expiring_radar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    listing = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    detail = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    seen = o.where("o_orderdate < '1996-02-01' and o_orderstatus = 'F'").select("o_orderkey")
    return P.radar(listing, detail, "o_orderkey", "day", ("1996-01-01", "1996-03-31"), 10_000_000, ["cents"], ["cents"], seen)


@query("""WITH r AS (SELECT event_type AS board, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos FROM events),
s AS (SELECT board, event_id, CASE WHEN event_id % 2 = 0 THEN event_id // 10 ELSE pos END AS rank FROM r)
SELECT board, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY rank, event_id) AS k FROM s) WHERE k <= 20""")
def hot_boards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("board"), "event_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 10)).cast("long").alias("rank"))
    kinds = ["click", "purchase", "view"]
    return P.hot_boards([e.where(F.col("board") == kinds[0]), e.where(F.col("board") == kinds[1]), e.where(F.col("board") == kinds[2]), e.where(~F.col("board").isin(kinds))], 20).select("board", "event_id", "rank")


@query("""WITH u AS (SELECT 'customer' AS source, c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'trade' ELSE 'other' END AS category FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, 'trade' FROM supplier), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS turn FROM u WHERE category = 'trade')
SELECT source, id, name, turn FROM t ORDER BY turn, source LIMIT 60""")
def registrations_feed(spark: SparkSession, d: str) -> DataFrame:
    shape = lambda df, p, k, kind: df.select(F.col(k).alias("id"), F.col(f"{p}_name").alias("name"), kind.alias("kind"))
    sources = [
        Adapter("customer", lambda: table(spark, d, "customer"), {}, lambda df: shape(df, "c", "c_custkey", F.col("c_mktsegment"))),
        Adapter("supplier", lambda: table(spark, d, "supplier"), {}, lambda df: shape(df, "s", "s_suppkey", F.lit("MACHINERY"))),
    ]
    category = F.when(F.col("kind").isin("BUILDING", "MACHINERY"), "trade").otherwise("other")
    return P.registrations(sources, {}, ["id"], ["id"], category, ["trade"], 60).select("source", "id", "name", F.col("turn").cast("long").alias("turn"))


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') AS site, length(html) % 97 AS score FROM pages)
SELECT site, page_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS k FROM p) WHERE k = 1""")
def best_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", U.site_key("url").alias("site"), "html")
    return P.best_page(pages, "site", (F.length("html") % 97).cast("long"), ["page_id"]).select("site", "page_id", "score")


@query("""WITH prev AS (SELECT event_type AS g, event_id, ts FROM events WHERE value >= 40 AND ts < TIMESTAMP '2024-01-20'), marks AS (SELECT g, max(ts) AS m FROM prev GROUP BY g)
SELECT g, event_id FROM (SELECT e.event_type AS g, event_id, row_number() OVER (PARTITION BY e.event_type ORDER BY e.ts DESC, event_id) AS k FROM events e JOIN marks ON g = e.event_type
  WHERE value >= 20 AND e.ts >= m - INTERVAL 7 DAY AND event_id NOT IN (SELECT event_id FROM prev)) WHERE k <= 40""")
def monitored_reviews(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "g")
    previous = e.where((F.col("value") >= 40) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return P.monitored_reviews(e, previous, ["g"], "event_id", "ts", F.col("value") >= 20, 40)[0].select("g", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03' AND value >= 90) ORDER BY ts, event_id LIMIT 30""")
def declared_job(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seen = e.where("ts < '2024-01-03' and value >= 90").select("user_id", "ts", "event_id")
    job = Job(key=["user_id"], order=["ts", "event_id"], keep=F.col("event_type") == "purchase", most=30)
    return job.run(e, seen)[0].select("user_id", "event_id")


_MARKS = """, substr(sha256('=' || o_orderstatus || '|=' || o_orderpriority), 1, 12) AS mark"""
_FIRST = f"""listed AS (SELECT * FROM (SELECT o_custkey, o_orderdate, o_orderkey{_MARKS}, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01') WHERE r = 1),
seen AS (SELECT o_custkey, o_orderdate, mark FROM listed ORDER BY o_orderdate DESC, o_custkey LIMIT 300),
later AS (SELECT * FROM (SELECT o_custkey, o_orderdate, o_orderkey{_MARKS}, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') WHERE r = 1),
fresh AS (SELECT * FROM later l WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.o_custkey = l.o_custkey AND s.mark = l.mark))
"""


def _cycles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs of one job that knows rows by fingerprint: (rows of the second, state after it)."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", N.fingerprint("o_orderstatus", "o_orderpriority").alias("mark"))
    job = Job(key=["o_custkey"], order=["o_orderdate", "o_orderkey"], mark="mark", remembered=300)
    nothing = o.limit(0).select("o_custkey", "o_orderdate", "mark")
    _, state = job.run(o.where("o_orderdate < '1996-06-01'"), nothing)
    return job.run(o.where("o_orderdate >= '1996-01-01'"), state)


@query(f"WITH {_FIRST} SELECT o_custkey, o_orderkey, mark FROM fresh")
def job_second_cycle(spark: SparkSession, d: str) -> DataFrame:
    return _cycles(spark, d)[0].select("o_custkey", "o_orderkey", "mark")


@query(f"""WITH {_FIRST}, known AS (SELECT o_custkey, o_orderdate, mark FROM seen UNION ALL SELECT o_custkey, o_orderdate, mark FROM later),
latest AS (SELECT o_custkey, max(o_orderdate) AS seen_at, arg_max(mark, o_orderdate) AS mark FROM known GROUP BY o_custkey)
SELECT o_custkey, CAST(CAST(seen_at AS DATE) AS VARCHAR) AS seen_at, mark FROM latest ORDER BY latest.seen_at DESC, o_custkey LIMIT 300""")
def job_second_state(spark: SparkSession, d: str) -> DataFrame:
    """The seen set after the second run: what is listed again stays recent, its mark is kept."""
    return _cycles(spark, d)[1].select("o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("seen_at"), "mark")


@query("""SELECT o_orderkey, true AS first_run, false AS later_run FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def baseline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a run without an earlier state are the baseline, rows of a later run are not."""
    o = table(spark, d, "orders")
    current = o.where("o_orderdate >= '1998-01-01'").select("o_orderkey")
    first = ST.with_baseline(current, o.limit(0)).withColumnRenamed("baseline", "first_run")
    return first.join(ST.with_baseline(current, o).withColumnRenamed("baseline", "later_run"), "o_orderkey")


_LISTINGS = """cur AS (SELECT l_partkey AS id, max(l_shipdate) AS seen_at, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY 1),
prev AS (SELECT l_partkey AS id, max(l_shipdate) AS seen_at, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY 1)"""


@query(f"""WITH {_LISTINGS} SELECT id, CASE WHEN p.id IS NULL THEN 'new' ELSE 'updated' END AS change, n FROM (SELECT c.id, c.n, p.id AS pid, p.n AS pn FROM cur c LEFT JOIN prev p ON c.id = p.id) x LEFT JOIN (SELECT id FROM prev) p USING (id) WHERE pid IS NULL OR pn <> x.n
UNION ALL SELECT id, 'removed', n FROM (SELECT * FROM prev WHERE id NOT IN (SELECT id FROM cur) ORDER BY seen_at, id LIMIT 50)""")
def listing_changes(spark: SparkSession, d: str) -> DataFrame:
    """New and updated listings, and the removed ones that have been gone longest."""
    rows = lambda df: df.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("at"), F.count(F.lit(1)).alias("n"))
    li = table(spark, d, "lineitem")
    current, previous = rows(li.where("l_shipdate >= '1997-01-01'")), rows(li.where("l_shipdate < '1997-01-01'"))
    return P.listing_changes(current, previous, ["id"], "n", "at", 50).select("id", "change", "n")


@query("""WITH RECURSIVE u AS (SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS pay FROM customer UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS i FROM u WHERE pay >= 905 GROUP BY source),
q AS (SELECT i, source, least(n, 100) AS quota, 300 - least(n, 100) AS remaining FROM s WHERE i = 1 UNION ALL SELECT s.i, s.source, least(s.n, CAST(ceil(remaining * 1.0 / (4 - s.i)) AS BIGINT)), remaining - least(s.n, CAST(ceil(remaining * 1.0 / (4 - s.i)) AS BIGINT)) FROM q JOIN s ON s.i = q.i + 1)
SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pay DESC, id) AS k FROM u WHERE pay >= 905) JOIN q USING (source) WHERE k <= quota""")
def job_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites in one shape under one cap, shared fairly."""
    one = lambda name, k, pay: Adapter(name, lambda: table(spark, d, name), {}, lambda df: df.select(F.col(k).alias("id"), F.col(pay).alias("pay")))
    sites = [one("customer", "c_custkey", "c_acctbal"), one("part", "p_partkey", "p_retailprice"), one("supplier", "s_suppkey", "s_acctbal")]
    return P.job_sites(sites, F.col("pay") >= 905, ["id"], [F.col("pay").desc(), "id"], 300).select("source", "id")


@query("""WITH a AS (SELECT *, ts < TIMESTAMP '2024-01-25' OR (value >= 30 AND ts < TIMESTAMP '2024-01-28') AS old FROM events),
b AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS island FROM a), c AS (SELECT *, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts DESC, event_id) AS run FROM b),
e AS (SELECT *, max(run >= 3) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS stopped FROM c) SELECT user_id, event_id FROM e WHERE NOT stopped AND NOT old""")
def newsletter_archive(spark: SparkSession, d: str) -> DataFrame:
    """Archives read newest first: posts since a date that no earlier run emitted, up to three known ones in a row."""
    e = table(spark, d, "events")
    seen = e.where("value >= 30 and ts < '2024-01-28'").select("event_id")
    return P.archive(e, seen, ["user_id"], "event_id", "ts", "2024-01-25", 3).select("user_id", "event_id")


@query("""WITH scanned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS s FROM events) WHERE s <= 2000),
fit AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k FROM scanned WHERE value BETWEEN 10 AND 60 AND ts >= TIMESTAMP '2024-01-10')
SELECT event_type, event_id FROM fit WHERE k <= 100""")
def capped_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Newest reviews of each app in a rating range since a date, with a cap on what is emitted and on what is read for it."""
    return P.capped_reviews(table(spark, d, "events"), ["event_type"], [F.col("ts").desc(), "event_id"], F.col("value").between(10, 60) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")), 100).select("event_type", "event_id")


@query("""SELECT l_partkey AS product, l_orderkey, CAST(floor((1 - price / l_extendedprice) * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT *, l_extendedprice * (1 - l_discount) AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_discount > 0 AND l_shipdate >= TIMESTAMP '1996-01-01') WHERE k = 1
AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R')""")
def product_search(spark: SparkSession, d: str) -> DataFrame:
    """Discounted products of a search, each once, that no earlier run emitted."""
    li = table(spark, d, "lineitem").withColumn("product", F.col("l_partkey"))
    current = li.where((F.col("l_discount") > 0) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).withColumn("price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    seen = li.where("l_shipdate < '1996-01-01' and l_returnflag = 'R'").select("product")
    return P.product_search(current, seen, ["product"], ["l_shipdate", "l_orderkey", "l_linenumber"], "price", "l_extendedprice").select("product", "l_orderkey", "percent")
