"""Queries over ordered feeds and runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import enrich as E
from ..operators import ordered as O
from ..operators import series as S
from ..operators import state as ST
from ..sources.adapters import Adapter, facet_passes, keyset_page, read_adapters, table

CUT, CUT2 = "2024-01-20", "2024-01-13"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query(f"""SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events
  WHERE ts >= TIMESTAMP '{CUT}' AND event_type IN ('purchase', 'click', 'view') AND value >= 1) e
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events p WHERE p.ts < TIMESTAMP '{CUT2}' AND p.user_id = e.user_id AND p.event_type = e.event_type AND p.value >= 90)
ORDER BY ts DESC, event_id LIMIT 100""")
def only_new_feed(spark: SparkSession, d: str) -> DataFrame:
    """Window filter, predicate, first-wins dedupe, only-new against the earlier run, newest first, capped."""
    e = events(spark, d)
    current = O.first_wins(e.where((F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")) & F.col("event_type").isin("purchase", "click", "view") & (F.col("value") >= 1)), ["user_id", "event_type"], ["ts", "event_id"])
    seen = e.where((F.col("ts") < F.lit(CUT2).cast("timestamp_ntz")) & (F.col("value") >= 90))
    fresh = ST.only_new(current, seen, ["user_id", "event_type"])
    return fresh.orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id", "event_type", "value")


@query("""WITH prev AS (SELECT DISTINCT o_custkey AS id, substr(sha256('=' || o_orderstatus || '|=' || o_orderpriority), 1, 12) AS fp FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
cur AS (SELECT o_orderkey, o_custkey AS id, substr(sha256('=' || o_orderstatus || '|=' || o_orderpriority), 1, 12) AS fp FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT o_orderkey, id, fp FROM cur WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.id = cur.id AND prev.fp = cur.fp)""")
def only_new_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), N.fingerprint("o_orderstatus", "o_orderpriority").alias("fp"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return ST.only_new(o.where(F.col("o_orderdate") >= cut), o.where(F.col("o_orderdate") < cut), ["id"], "fp").select("o_orderkey", "id", "fp")


@query(f"""WITH prev AS (SELECT event_type, event_id, ts FROM events WHERE ts < TIMESTAMP '{CUT}' AND value >= 20), marks AS (SELECT event_type, max(ts) AS mark FROM prev GROUP BY event_type)
SELECT c.event_id, c.event_type, c.user_id FROM events c LEFT JOIN marks m USING (event_type)
WHERE c.ts >= TIMESTAMP '{CUT2}' AND (mark IS NULL OR c.ts >= mark - INTERVAL 7 DAY)
  AND NOT EXISTS (SELECT 1 FROM prev p WHERE p.event_type = c.event_type AND p.event_id = c.event_id)""")
def watermark_monitor(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    previous, current = e.where((F.col("ts") < F.lit(CUT).cast("timestamp_ntz")) & (F.col("value") >= 20)), e.where(F.col("ts") >= F.lit(CUT2).cast("timestamp_ntz"))
    return ST.watermark_monitor(current, previous, ["event_type"], "event_id", "ts").select("event_id", "event_type", "user_id")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    last = lambda df: O.first_wins(df, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", N.fingerprint("o_orderstatus", "o_orderpriority").alias("fp"))
    return last(o.where("o_orderdate >= '1996-01-01'")), last(o.where("o_orderdate < '1997-06-01'"))


_SNAPS = """WITH base AS (SELECT *, '=' || o_orderstatus || '|=' || o_orderpriority AS mark FROM orders),
cur AS (SELECT o_custkey, substr(sha256(mark), 1, 12) AS fp FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM base WHERE o_orderdate >= TIMESTAMP '1996-01-01') WHERE r = 1),
prev AS (SELECT o_custkey, substr(sha256(mark), 1, 12) AS fp FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM base WHERE o_orderdate < TIMESTAMP '1997-06-01') WHERE r = 1)
"""


@query(_SNAPS + """SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey, CASE WHEN p.o_custkey IS NULL THEN 'new' WHEN c.o_custkey IS NULL THEN 'removed' WHEN c.fp = p.fp THEN 'unchanged' ELSE 'updated' END AS change
FROM cur c FULL JOIN prev p ON c.o_custkey = p.o_custkey""")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _snapshots(spark, d)
    return ST.change_feed(current, previous, ["o_custkey"], "fp")


@query("""WITH rev AS (SELECT p_brand, l_partkey AS item, year(l_shipdate) AS y, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1995, 1996) GROUP BY ALL),
ranked AS (SELECT p_brand, item, y, row_number() OVER (PARTITION BY p_brand, y ORDER BY cents DESC, item) AS r FROM rev),
b AS (SELECT coalesce(c.p_brand, p.p_brand) AS p_brand, coalesce(c.item, p.item) AS item, c.r AS "now", p.r AS "then" FROM (SELECT * FROM ranked WHERE y = 1996 AND r <= 30) c FULL JOIN (SELECT * FROM ranked WHERE y = 1995 AND r <= 30) p ON c.p_brand = p.p_brand AND c.item = p.item)
SELECT * FROM (SELECT *, CASE WHEN coalesce("now" <= 10, false) AND abs("now" - "then") < 2 THEN 'same' WHEN coalesce("now" <= 10, false) AND NOT coalesce("then" <= 10, false) THEN 'new'
 WHEN coalesce("now" <= 10, false) AND "now" < "then" THEN 'up' WHEN coalesce("now" <= 10, false) AND "now" > "then" THEN 'down' WHEN coalesce("then" <= 10, false) AND NOT coalesce("now" <= 10, false) AND ("now" IS NULL OR abs("now" - "then") >= 2) THEN 'dropped' END AS change FROM b) WHERE change IS NOT NULL""")
def rank_changes(spark: SparkSession, d: str) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    rev = li.where(F.year("l_shipdate").isin(1995, 1996)).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("y")).agg(cents)
    ranked = O.with_rank(rev, ["p_brand", "y"], [F.col("cents").desc(), "item"]).where("rank <= 30")
    return ST.rank_changes(ranked.where("y = 1996"), ranked.where("y = 1995"), ["p_brand"], "item", "rank", visible=10, least=2)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)")
def not_found_rows(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select("c_custkey", "c_name")
    return ST.missing_wanted(wanted, table(spark, d, "orders").where("o_totalprice >= 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH a AS (SELECT *, value < 60 AS old, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS island FROM events),
b AS (SELECT *, sum(CASE WHEN old THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts DESC, event_id) AS run FROM a),
c AS (SELECT *, max(run >= 5) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS stopped FROM b)
SELECT event_id, user_id, value FROM c WHERE NOT stopped AND NOT old""")
def streak_stop(spark: SparkSession, d: str) -> DataFrame:
    return O.stop_after_streak(events(spark, d), ["user_id"], [F.col("ts").desc(), "event_id"], F.col("value") < 60, 5).select("event_id", "user_id", "value")


@query("""WITH p AS (SELECT event_type, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 4 AS page FROM events),
g AS (SELECT event_type, page, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS new FROM p GROUP BY ALL),
h AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY page) AS island FROM g),
i AS (SELECT *, sum(1 - new) OVER (PARTITION BY event_type, island ORDER BY page) AS run FROM h),
j AS (SELECT *, coalesce(max(run >= 2) OVER (PARTITION BY event_type ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM i)
SELECT p.event_type, p.event_id, CAST(p.page AS BIGINT) AS page FROM p JOIN j ON p.event_type = j.event_type AND p.page = j.page WHERE NOT gone""")
def stale_pages_stop(spark: SparkSession, d: str) -> DataFrame:
    numbered = O.placed(events(spark, d), ["event_type"], [(F.floor(F.col("event_id") / 1000), False)], ["event_id"], "place")
    paged = numbered.withColumn("page", O.rows_on_page("place", 4) - 1)
    return O.stop_after_stale_pages(paged, ["event_type"], "page", F.col("value") > 100).select("event_type", "event_id", "page")


@query("""WITH p AS (SELECT event_type, event_id, ts, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) - 1) // 50 AS page FROM events),
c AS (SELECT event_type, min(CASE WHEN ts < TIMESTAMP '2024-01-25' THEN page END) AS last FROM p GROUP BY event_type)
SELECT p.event_id, p.event_type, CAST(page AS BIGINT) AS page FROM p JOIN c USING (event_type) WHERE last IS NULL OR page <= last""")
def page_cutoff(spark: SparkSession, d: str) -> DataFrame:
    numbered = O.placed(events(spark, d), ["event_type"], [(F.to_date("ts"), True)], [F.col("ts").desc(), "event_id"], "place")
    paged = numbered.withColumn("page", O.rows_on_page("place", 50) - 1)
    return O.cut_at_page(paged, ["event_type"], "page", F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id", "event_type", "page")


@query("""SELECT event_id, event_type, turn, row_number() OVER (PARTITION BY turn ORDER BY event_type) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events) WHERE turn <= 200""")
def round_robin_feed(spark: SparkSession, d: str) -> DataFrame:
    turns = O.round_robin(O.top_per_group(events(spark, d), ["event_type"], ["ts", "event_id"], 200), "event_type", ["ts", "event_id"])
    return O.with_rank(turns.select("event_id", "event_type", F.col("position.turn").cast("long").alias("turn")), ["turn"], ["event_type"], "place")


@query("""SELECT event_id, event_type FROM events ORDER BY CAST(ts AS DATE) DESC, event_type, event_id LIMIT 500""")
def kway_merge(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.col("ts").cast("date").desc(), "event_type", "event_id").limit(500).select("event_id", "event_type")


@query("""SELECT event_id, event_type, turn, row_number() OVER (PARTITION BY turn ORDER BY event_type) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events)""")
def round_robin_all(spark: SparkSession, d: str) -> DataFrame:
    """As round_robin_feed, over whole streams: the turn and the place in it of every row."""
    turns = O.placed(events(spark, d), ["event_type"], [(F.col("ts").cast("date"), False)], ["ts", "event_id"], "turn")
    return O.with_rank(turns.select("event_id", "event_type", "turn"), ["turn"], ["event_type"], "place")


@query("""SELECT event_id, event_type, row_number() OVER (ORDER BY CAST(ts AS DATE) DESC, event_type, event_id) AS place FROM events""")
def kway_merge_all(spark: SparkSession, d: str) -> DataFrame:
    """As kway_merge, over whole streams: the merged place of every row."""
    return O.placed(events(spark, d), [], [(F.col("ts").cast("date"), True), (F.col("event_type"), False)], ["event_id"], "place").select("event_id", "event_type", "place")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return O.with_rank(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"]).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("""WITH RECURSIVE s AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type) AS i, count(*) OVER () AS k FROM events GROUP BY event_type),
q AS (SELECT i, event_type, least(n, CAST(ceil(1000.0 / k) AS BIGINT)) AS quota, 1000 - least(n, CAST(ceil(1000.0 / k) AS BIGINT)) AS remaining FROM s WHERE i = 1
 UNION ALL SELECT s.i, s.event_type, least(s.n, CAST(ceil(q.remaining * 1.0 / (s.k - s.i + 1)) AS BIGINT)), q.remaining - least(s.n, CAST(ceil(q.remaining * 1.0 / (s.k - s.i + 1)) AS BIGINT)) FROM q JOIN s ON s.i = q.i + 1)
SELECT e.event_id, e.event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) e JOIN q USING (event_type) WHERE r <= quota""")
def fair_share_cap(spark: SparkSession, d: str) -> DataFrame:
    return O.fair_share(events(spark, d), "event_type", ["ts", "event_id"], 1000).select("event_id", "event_type")


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT DISTINCT user_id, event_id FROM p, (SELECT unnest(range(0, 5)) AS i) WHERE n <= 5 OR r = CAST(floor(i * (n - 1) / 4.0 + 0.5) AS BIGINT) + 1""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.even_sample(events(spark, d), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("""SELECT event_id, user_id, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(CAST(round(value * 1000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 500000000""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    return O.within_budget(events(spark, d), ["user_id"], ["ts", "event_id"], F.round(F.col("value") * 1_000_000), 500_000_000).select("event_id", "user_id", "spent")


@query("""SELECT event_id, user_id, CAST(spent_before AS BIGINT) AS spent_before FROM (SELECT *, coalesce(sum(CAST(round(value * 1000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM events) WHERE spent_before < 500000000""")
def emit_until_exhausted(spark: SparkSession, d: str) -> DataFrame:
    return O.until_exhausted(events(spark, d), ["user_id"], ["ts", "event_id"], F.round(F.col("value") * 1_000_000), 500_000_000).select("event_id", "user_id", "spent_before")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size > 25 THEN p_retailprice END, l_extendedprice) AS price, coalesce(CASE WHEN p_size > 25 THEN p_name END, l_returnflag) AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def detail_coalesce(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("label"))
    detail = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("label"))
    return E.detail_over_listing(listing, detail, "id", ["price", "label"]).drop("id")


@query("""SELECT user_id, (min(CASE WHEN event_type = 'view' THEN struct_pack(ts := ts, e := event_id) END)).e AS view_event_id, (min(CASE WHEN event_type = 'purchase' THEN struct_pack(ts := ts, e := event_id) END)).e AS purchase_event_id FROM events GROUP BY user_id""")
def role_pivot_enrich(spark: SparkSession, d: str) -> DataFrame:
    return E.role_pivot(events(spark, d), "user_id", "event_type", ["view", "purchase"], ["event_id"], ["ts"])


@query("""SELECT 'customer' AS source, c_custkey AS id, c_name AS name, n_name AS nation, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2, 3)
UNION ALL SELECT 'supplier', s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey IN (1, 2, 3)""")
def party_union(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))

    def adapter(name: str, key: str, p: str) -> Adapter:
        to = lambda df: df.join(nation, F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(F.col(key).alias("id"), F.col(f"{p}_name").alias("name"), "nation", F.col(f"{p}_acctbal").alias("balance"))
        return Adapter(name, lambda: table(spark, d, name), {"nation": f"{p}_nationkey"}, to)

    return read_adapters([adapter("customer", "c_custkey", "c"), adapter("supplier", "s_suppkey", "s"), Adapter("region", lambda: table(spark, d, "region"), {}, lambda df: df)], {"nation": [1, 2, 3]})


@query("""WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS mark FROM events)
SELECT user_id, event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mark FROM p""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    marked = events(spark, d).withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("value")))
    return O.forward_fill(marked, ["user_id"], ["ts", "event_id"], ["mark"]).select("user_id", "event_id", "mark")


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + value * 100 AS b FROM events)
SELECT user_id, event_id, round(greatest(CASE WHEN lead(a) OVER w < b THEN lead(a) OVER w ELSE b END, a + 0.001) - a, 2) AS length FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)""")
def lead_clip(spark: SparkSession, d: str) -> DataFrame:
    a = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timed = events(spark, d).select("user_id", "event_id", a.alias("a"), (a + F.col("value") * 100).alias("b"))
    return O.clip_to_next(timed, ["user_id"], ["a", "event_id"], "a", "b").select("user_id", "event_id", F.round(F.col("b") - F.col("a"), 2).alias("length"))


@query("""WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, user_id, count(*) AS score FROM events GROUP BY ALL)
SELECT CAST(period AS VARCHAR) AS period, user_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, user_id) AS rank FROM w) WHERE rank <= 10""")
def calendar_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return S.leaderboard(events(spark, d), "ts", "week", "user_id", F.count(F.lit(1)), 10).withColumn("period", F.col("period").cast("string"))


@query("""SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS period_start, CAST(CAST(d + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS period_end, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-06-15', INTERVAL 1 MONTH)) AS d) LEFT JOIN orders ON o_orderdate >= d AND o_orderdate < d + INTERVAL 1 MONTH GROUP BY d""")
def calendar_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = S.calendar_windows(spark, "1995-01-10", "1996-06-15", "month")
    counts = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("period_start")).agg(F.count(F.lit(1)).alias("k"))
    return windows.join(counts, "period_start", "left").select(F.col("period_start").cast("string"), F.col("period_end").cast("string"), F.coalesce("k", F.lit(0)).cast("long").alias("n"))


@query("""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS cents FROM events""")
def rolling_window(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling(events(spark, d), ["event_type"], "ts", 24, F.round(F.col("value") * 100).cast("long"), "cents").select("event_id", "cents")


@query("""WITH t AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS i, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)),
pts AS (SELECT (i - 1) // 2 AS batch, event_type, day, n FROM t WHERE i > 0 UNION ALL SELECT b.batch, event_type, day, n + b.batch FROM t, (SELECT DISTINCT (i - 1) // 2 AS batch FROM t WHERE i > 0) b WHERE i = 0),
f AS (SELECT batch, sum(n) AS s FROM pts WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY batch),
sc AS (SELECT p.event_type, p.day, p.n * ((SELECT s FROM f WHERE batch = 0) / f.s) AS v FROM pts p JOIN f USING (batch) WHERE p.event_type <> (SELECT min(event_type) FROM events) OR p.batch = 0)
SELECT event_type, CAST(day AS VARCHAR) AS day, round(v * 100 / (SELECT max(v) FROM sc), 2) AS scaled FROM sc""")
def anchored_rescale(spark: SparkSession, d: str) -> DataFrame:
    daily = events(spark, d).groupBy("event_type", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    terms = daily.select("event_type").distinct()
    batches = S.anchored_batches(terms, "event_type", "event_type", 3)
    first = F.broadcast(terms.agg(F.min("event_type").alias("__anchor")))  # one row
    points = daily.join(batches, "event_type").crossJoin(first).withColumn("n", F.col("n") + F.when(F.col("event_type") == F.col("__anchor"), F.col("batch")).otherwise(0))
    return S.rescale(points, "batch", "event_type", "day", "n", F.col("__anchor"))


@query("""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000 THEN 1 ELSE 0 END AS new FROM events)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(events(spark, d), ["user_id"], "ts", 6 * 3600).select("event_id", "session")


@query("""SELECT event_type, count(*) AS scanned, count(*) FILTER (value > 50) AS emitted, count(*) FILTER (value <= 50) AS skipped FROM events GROUP BY event_type""")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return ST.statistics(events(spark, d), ["event_type"], {"emitted": F.col("value") > 50, "skipped": F.col("value") <= 50})


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS w, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, CAST(w AS BIGINT) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, f) AS r FROM v) WHERE r = 1""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    return ST.vote(events(spark, d).withColumn("one", F.lit(1)), ["user_id"], "event_type", "one", "event_id")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (100000.0, 50) ORDER BY o_totalprice, o_orderkey LIMIT 100""")
def keyset_scan(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(table(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_custkey"), ["o_totalprice", "o_orderkey"], (100000.0, 50), 100)


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS r FROM events) WHERE r = 1""")
def faceted_scan(spark: SparkSession, d: str) -> DataFrame:
    return facet_passes(events(spark, d), "user_id", ["event_type", "ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT o_orderkey, (SELECT max(s.event_id) FROM events s WHERE s.user_id = o_custkey % 150 AND s.event_id <= o_orderkey) AS version FROM orders""")
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"))
    versions = events(spark, d).select("user_id", F.col("event_id").alias("since"), F.col("event_id").alias("version"))
    return E.latest_at(rows, versions, ["user_id"], "o_orderkey", "since", "version").select("o_orderkey", "version")


@query("""WITH RECURSIVE d AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t FROM events), k AS (SELECT user_id, min(t) AS t FROM d GROUP BY user_id
 UNION ALL SELECT k.user_id, (SELECT min(d.t) FROM d WHERE d.user_id = k.user_id AND d.t - k.t >= 86400) FROM k WHERE k.t IS NOT NULL)
SELECT user_id, CAST(floor(t) AS BIGINT) AS at FROM k WHERE t IS NOT NULL""")
def minimum_gap(spark: SparkSession, d: str) -> DataFrame:
    timed = events(spark, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return O.thinned(timed, ["user_id"], "t", 86400.0).select("user_id", F.floor("t").cast("long").alias("at"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (a = 1) DESC, value DESC, ts, event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events)) WHERE r <= 4""")
def strongest_moments(spark: SparkSession, d: str) -> DataFrame:
    return O.strongest_in_time_order(events(spark, d), ["user_id"], "value", ["ts", "event_id"], 4).select("user_id", "event_id", "value")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.facet_counts(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT o_orderkey, o_custkey, o_totalprice = min(o_totalprice) OVER (PARTITION BY o_custkey) AS cheapest FROM orders""")
def cheapest_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", O.rank_in_group(F.col("o_totalprice"), ["o_custkey"]).alias("cheapest"))


@query("""SELECT user_id, CAST(max(CASE WHEN ts < TIMESTAMP '2024-01-27' OR user_id % 2 = 0 OR p IS NULL THEN ts ELSE p END) AS VARCHAR) AS watermark FROM (SELECT user_id, ts, max(CASE WHEN ts < TIMESTAMP '2024-01-27' THEN ts END) OVER (PARTITION BY user_id) AS p FROM events) GROUP BY user_id""")
def next_watermarks(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    cut = F.lit("2024-01-27").cast("timestamp_ntz")
    previous = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.max("ts").alias("watermark"))
    emitted = e.where(F.col("ts") >= cut).groupBy("user_id").agg(F.max("ts").alias("latest")).withColumn("complete", F.col("user_id") % 2 == 0)
    return ST.next_watermarks(previous, emitted, ["user_id"], "complete").withColumn("watermark", F.col("watermark").cast("string"))


@query(f"""SELECT user_id, CAST(max(ts) AS VARCHAR) AS ts FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 50""")
def seen_set_next(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    cut = F.lit(CUT).cast("timestamp_ntz")
    return ST.next_seen(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut), ["user_id"], "ts", 50).withColumn("ts", F.col("ts").cast("string"))
