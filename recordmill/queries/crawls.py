"""Queries of searches, versioned state, tables and trees on the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import trees as TR
from ..functions import urls as U
from ..functions import wire as W
from ..operators import documents as DOC
from ..operators import enrich as E
from ..operators import ordered as O
from ..operators import search as SE
from ..operators import tables as TB
from ..operators import versions as V
from ..sources.adapters import table
from ..storage import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


# the sites of `pages`: a page's address is the first word of its title, which links of the same site name

_PAGES = r"""raw AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www[.]', '') AS site, '/' || split_part(regexp_extract(html, '<title>([^<]*)', 1), ' ', 1) AS url, html FROM pages),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY page_id) AS k, row_number() OVER (PARTITION BY site ORDER BY page_id) AS nth FROM raw) WHERE k = 1),
p AS (SELECT site, url, page_id, nth, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS score, list_distinct(list_filter(string_split_regex(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]+>', ' ', 'g'), '[ \t\n]+'), lambda x: x <> '')) AS words,
  regexp_matches(html, '[a-z0-9.]+@[a-z0-9]+[.]') AS mail, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM one),
links AS (SELECT site, url, target, CAST(length(target) - 1 AS DOUBLE) AS weight, min(pos) AS pos FROM (SELECT site, url, unnest(hrefs) AS target, generate_subscripts(hrefs, 1) AS pos FROM p) WHERE length(target) > 1 GROUP BY site, url, target),
going AS (SELECT site, url, list({'w': -weight, 'r': 0, 'a': pos, 'u': target}) AS out FROM links GROUP BY site, url),
home AS (SELECT site, url, words FROM p WHERE nth = 1)"""

_VISITS = f"""WITH RECURSIVE {_PAGES},
s AS (SELECT site, 0 AS n, [{{'w': CAST(-100 AS DOUBLE), 'r': 0, 'a': CAST(0 AS BIGINT), 'u': url}}] AS front, [url] AS known, CAST(NULL AS VARCHAR) AS visited_url, CAST(0 AS BIGINT) AS score, false AS found, false AS certain, false AS same FROM home
UNION ALL
SELECT x.site, x.n + 1, CASE WHEN g.out IS NULL THEN list_sort(x.front)[2:] ELSE list_concat(list_sort(x.front)[2:], list_transform(list_filter(g.out, lambda o: NOT list_contains(x.known, o.u)), lambda o: {{'w': o.w, 'r': x.n + 1, 'a': o.a, 'u': o.u}})) END,
  CASE WHEN g.out IS NULL THEN x.known ELSE list_distinct(list_concat(x.known, list_transform(g.out, lambda o: o.u))) END, list_sort(x.front)[1].u, coalesce(p.score, 0), p.site IS NOT NULL,
  coalesce(p.mail OR len(p.words) >= 450, false), coalesce(len(list_intersect(p.words, h.words)) >= 0.8 * least(len(p.words), len(h.words)), false)
FROM s x JOIN home h ON h.site = x.site LEFT JOIN p ON p.site = x.site AND p.url = list_sort(x.front)[1].u LEFT JOIN going g ON g.site = x.site AND g.url = list_sort(x.front)[1].u
WHERE NOT x.certain AND x.n < 12 AND len(x.front) > 0)"""


def _site_search(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "pages").select("page_id", U.site_key("url").alias("site"), F.concat(F.lit("/"), F.split_part(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" "), F.lit(1))).alias("url"), "html")
    one = O.first_wins(raw, ["site", "url"], ["page_id"])
    text = F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]+>", " ")
    words = F.array_distinct(F.filter(F.split(text, "[ \t\n]+"), lambda x: x != ""))
    pages = one.select("site", "url", "page_id", F.size(F.regexp_extract_all("html", F.lit("(<p>)"), 1)).cast("long").alias("score"), words.alias("words"), F.col("html").rlike(r"[a-z0-9.]+@[a-z0-9]+[.]").alias("mail"))
    pages = pages.withColumn("certain", F.col("mail") | (F.size("words") >= 450))
    links = one.select("site", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("at", "target")).withColumn("weight", (F.length("target") - 1).cast("double"))
    starts = O.first_wins(raw, ["site"], ["page_id"]).select("site", "url", F.lit(100.0).alias("weight"))
    return SE.visit_sites(starts, pages, links, 12)


@query(f"""{_VISITS} SELECT site, CAST(n AS BIGINT) AS nth, visited_url AS url, found, score, certain, same AS home FROM s WHERE n > 0""")
def site_visits(spark: SparkSession, d: str) -> DataFrame:
    """Every site of `pages`, from its first page along links to pages of its own, best link first, until a page has an address to write to or is long enough."""
    return _site_search(spark, d).select("site", "nth", "url", "found", "score", "certain", "home")


@query(f"""{_VISITS}, v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY found AND score > 0 AND (certain OR NOT same) DESC, score DESC, n) AS k, count(*) OVER (PARTITION BY site) AS visited, bool_or(found) OVER (PARTITION BY site) AS reached FROM s WHERE n > 0),
t AS (SELECT *, found AND score > 0 AND (certain OR NOT same) AS ok FROM v WHERE k = 1)
SELECT site, CASE WHEN ok THEN 'found' WHEN reached THEN 'notFound' ELSE 'unreachable' END AS status, CASE WHEN ok THEN visited_url END AS url, CASE WHEN ok THEN score END AS score, CASE WHEN ok THEN certain END AS certain, visited FROM t""")
def site_search(spark: SparkSession, d: str) -> DataFrame:
    """The best page of each site among those visited."""
    return SE.best_pages(_site_search(spark, d)).select("site", "status", "url", "score", "certain", "visited")


@query("""WITH c AS (SELECT *, count(*) OVER () AS n0, count(*) OVER (PARTITION BY p_type) AS n1, count(*) OVER (PARTITION BY p_type, p_brand) AS n2, count(*) OVER (PARTITION BY p_type, p_brand, p_size) AS n3 FROM part),
k AS (SELECT *, CASE WHEN n0 <= 25 THEN 0 WHEN n1 <= 25 THEN 1 WHEN n2 <= 25 THEN 2 ELSE 3 END AS depth FROM c)
SELECT p_partkey, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 3 AND n3 > 25 THEN (row_number() OVER (PARTITION BY p_type, p_brand, p_size ORDER BY p_partkey) - 1) // 25 ELSE 0 END AS part FROM k""")
def ceiling_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every part with the search, of at most 25 hits, that returns it."""
    return SE.searched_rows(table(spark, d, "part"), ["p_type", "p_brand", "p_size"], ["p_partkey"], 25).select("p_partkey", "depth", "part")


@query("""WITH c AS (SELECT *, count(*) OVER () AS n0, count(*) OVER (PARTITION BY o_orderpriority) AS n1, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n2, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus, year(o_orderdate)) AS n3 FROM orders),
k AS (SELECT *, CASE WHEN n0 <= 300 THEN 0 WHEN n1 <= 300 THEN 1 WHEN n2 <= 300 THEN 2 ELSE 3 END AS depth, year(o_orderdate) AS y FROM c)
SELECT CAST(depth AS INTEGER) AS depth, CASE WHEN depth > 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN depth > 1 THEN o_orderstatus END AS o_orderstatus, CAST(CASE WHEN depth > 2 THEN y END AS INTEGER) AS y, count(*) AS hits, CAST(ceil(count(*) / 300.0) AS INTEGER) AS parts FROM k GROUP BY ALL""")
def ceiling_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches over all orders that stay within 300 hits each."""
    return SE.covering_searches(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_orderpriority", "o_orderstatus", "y"], 300)


_RANKS = "SELECT event_type, user_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY sum(CAST(round(value * 100) AS BIGINT)) DESC, user_id) AS BIGINT) AS rank FROM events WHERE ts {} TIMESTAMP '2024-01-16' GROUP BY event_type, user_id"


@query(f"""WITH a AS ({_RANKS.format("<")}), b AS ({_RANKS.format(">=")}), done AS (SELECT event_type FROM (SELECT DISTINCT event_type FROM a) ORDER BY 1 LIMIT 2),
t AS (SELECT event_type, user_id, b.rank AS now, a.rank AS "then", event_type IN (FROM done) AS known FROM b FULL JOIN (SELECT * FROM a WHERE event_type IN (FROM done)) a USING (event_type, user_id)),
c AS (SELECT *, coalesce(now <= 20, false) AS here, coalesce("then" <= 20, false) AS there, abs(now - "then") AS moved FROM t)
SELECT event_type, user_id, now, "then", change FROM (SELECT *, CASE WHEN NOT known THEN CASE WHEN here THEN 'baseline' END WHEN here AND moved < 3 THEN 'same' WHEN here AND NOT there THEN 'new' WHEN here AND now < "then" THEN 'up' WHEN here AND now > "then" THEN 'down'
  WHEN there AND NOT here AND (moved IS NULL OR moved >= 3) THEN 'dropped' END AS change FROM c) WHERE change IS NOT NULL""")
def tracked_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over ranked lists of which the first breaks off after two lists: those are compared, all others start anew."""
    e = table(spark, d, "events")
    scores = lambda rows: O.with_rank(rows.groupBy("event_type", "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")), ["event_type"], [F.col("cents").desc(), "user_id"])
    before, now = scores(e.where("ts < '2024-01-16'")).drop("cents"), scores(e.where("ts >= '2024-01-16'")).drop("cents")
    state = V.VersionedState(spark, f"{shared_folder(spark)}/tracked-{uuid.uuid4().hex}", "event_type string, user_id long, rank long", ["event_type"])
    names = sorted(r["event_type"] for r in before.select("event_type").distinct().collect())

    def emit(name: str, rows: DataFrame) -> None:
        if name == names[2]:
            raise ConnectionError(name)

    try:
        V.track_lists(state, "first", [(n, before.where(F.col("event_type") == n)) for n in names], emit)
    except ConnectionError:
        pass  # lists before the break are committed, this one and those after it are not
    return V.compare_lists(state, now, "user_id", "rank", 20, 3).select("event_type", "user_id", "now", "then", "change")


_MATCHES = """m AS (SELECT o_orderkey, o_orderdate, l_returnflag, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS dc, CAST(round(l_tax * 100) AS BIGINT) AS tx
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _result_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order, with a table: a header row for each return flag, and a pair of rows, one time cell over both, for each line."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = lambda x: F.col(x).cast("string")
    whole = lambda x: F.round(x).cast("long").cast("string")
    li = O.with_rank(li, ["o_orderkey"], ["l_returnflag", "l_linenumber", "l_partkey", "l_suppkey"], "place")
    place = c("place")
    rows = F.concat(
        F.lit("<tr id=r"), place, F.lit('><td rowspan="2" class="time">'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('</td><td class="t-name"><a href="/part/'), c("l_partkey"), F.lit('">Part '), c("l_partkey"),
        F.lit('</a><td class="score">'), whole(F.col("l_quantity")), F.lit("<sup>"), whole(F.col("l_discount") * 100), F.lit('</sup></td><td class="score">'), whole(F.col("l_tax") * 100), F.lit("</td></tr><tr id=r"), place,
        F.lit('b><td class="t-name">Supp &amp; '), c("l_suppkey"), F.lit('</td><td class="score">7</td><td class="score">'), whole(F.col("l_discount") * 100), F.lit("<td>odds</tr>"),
    )
    groups = li.groupBy("o_orderkey", "l_returnflag").agg(F.concat(F.lit('<tr class="head"><td class="t-name" colspan="3">Flag <b>'), F.col("l_returnflag"), F.lit("</b></td></tr>"), F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", rows.alias("row")))).row, "")).alias("rows"))
    return groups.groupBy("o_orderkey").agg(F.concat(F.lit("<p>Results<table class=result>"), F.array_join(F.sort_array(F.collect_list(F.struct("l_returnflag", "rows"))).rows, "\n"), F.lit("</table>")).alias("html"))


@query(f"""WITH {_MATCHES} SELECT DISTINCT o_orderkey, 'Flag ' || l_returnflag AS header, strftime(o_orderdate, '%Y-%m-%d') AS day, 'Part ' || l_partkey AS player1, '/part/' || l_partkey AS href, 'Supp & ' || l_suppkey AS player2,
  q || '-7(' || dc || ') ' || tx || '-' || dc AS score, CASE WHEN (q > 7) = (tx > dc) AND q <> 7 AND tx <> dc THEN CASE WHEN q > 7 THEN 1 ELSE 2 END END AS winner FROM m""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows out of grouped tables: carried headers, cells over two rows, scores with tie-breaks set high."""
    of = lambda cells, name: F.filter(cells, lambda x: x["cell_class"] == name)
    first = lambda cells, name: F.get(of(cells, name), F.lit(0))
    read = _result_pages(spark, d).select("o_orderkey", TB.page_rows(F.col("html")).alias("rows"))
    headed = read.select("o_orderkey", TB.headed_rows(F.col("rows"), lambda r: r["row_class"] == "head", lambda r: first(r["cells"], "t-name")["text"]).alias("headed"))
    rows = headed.select("o_orderkey", F.explode(TB.paired_rows(F.col("headed"))).alias("r")).select("o_orderkey", "r.header", F.col("r.row.cells").alias("cells"), "r.other")
    rows = rows.withColumn("sets", TB.scored(of("cells", "score"), of("other", "score")))
    sets = F.col("sets")
    shown = F.array_join(F.transform(sets, lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"), F.when(s["tiebreak"].isNotNull(), F.concat(F.lit("("), s["tiebreak"].cast("string"), F.lit(")"))).otherwise(""))), " ")
    won = lambda f: F.size(F.filter(sets, f))
    winner = F.when(won(lambda s: s["a"] > s["b"]) == F.size(sets), 1).when(won(lambda s: s["a"] < s["b"]) == F.size(sets), 2)
    out = rows.select("o_orderkey", "header", first("cells", "time")["text"].alias("day"), first("cells", "t-name")["text"].alias("player1"), first("cells", "t-name")["href"].alias("href"), first("other", "t-name")["text"].alias("player2"), shown.alias("score"), winner.alias("winner"))
    return out.distinct()


@query("""WITH s AS (SELECT l_orderkey, l_partkey AS a, l_suppkey AS b, CAST(min(l_quantity) AS BIGINT) AS x, CAST(max(l_quantity) AS BIGINT) AS y FROM lineitem GROUP BY ALL)
SELECT l_orderkey, a, b, x AS won_a, y AS won_b FROM s""")
def oriented_details(spark: SparkSession, d: str) -> DataFrame:
    """Details that list a pair either way round, joined to the pairs and turned where needed."""
    pairs = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min("l_quantity").cast("long").alias("won_a"), F.max("l_quantity").cast("long").alias("won_b"))
    turn = F.col("a") > F.col("b")
    details = pairs.select("l_orderkey", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("won_b")).otherwise(F.col("won_a")).alias("won_a"), F.when(turn, F.col("won_a")).otherwise(F.col("won_b")).alias("won_b"))
    return TB.join_oriented(pairs.select("l_orderkey", "a", "b"), details, ["l_orderkey"], ("a", "b"), [("won_a", "won_b")])


@query("""SELECT p_partkey, p_brand || chr(10) || p_type || list_aggregate(list_transform(range(1, 2 + p_size % 6), lambda i: chr(10) || chr(10) || CASE WHEN i % 2 = 1 THEN '- ' ELSE '1. ' END || p_name || ' ' || i), 'string_agg', '') || chr(10) || chr(10) || '---' AS text FROM part""")
def rich_trees(spark: SparkSession, d: str) -> DataFrame:
    """Document trees of one to six nested lists to plain text."""
    paragraph = lambda *inner: F.struct(F.lit("paragraph").alias("type"), F.array(*inner).alias("content"))
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    node = F.lit("")
    for i in range(6, 0, -1):
        own = F.concat(F.lit('{"type": "%s", "content": [{"type": "list_item", "content": [' % ("bullet_list" if i % 2 else "ordered_list")), F.to_json(paragraph(text(F.concat("p_name", F.lit(f" {i}"))))), node, F.lit("]}]}"))
        node = F.when(F.col("p_size") % 6 >= i - 1, F.concat(F.lit(", "), own)).otherwise("")
    top = F.concat(F.lit('{"type": "paragraph", "content": ['), F.to_json(text(F.col("p_brand"))), F.lit(', {"type": "hard_break"}, '), F.to_json(text(F.col("p_type"))), F.lit("]}"))
    return table(spark, d, "part").select("p_partkey", TR.rich_text(F.concat(F.lit('{"type": "doc", "content": ['), top, node, F.lit(', {"type": "horizontal_rule"}]}'))).alias("text"))


@query("""WITH c AS (SELECT *, c_nationkey % 6 AS k FROM customer)
SELECT c_custkey, 0 AS at, CAST(NULL AS INTEGER) AS parent, 0 AS depth, 'record' AS name, CAST(NULL AS VARCHAR) AS text FROM c
UNION ALL SELECT c_custkey, 1, 0, 1, 'name', c_name || ' & <co>' FROM c
UNION ALL SELECT c_custkey, 2 + i, CASE WHEN i = 0 THEN 0 ELSE 1 + i END, 1 + i, 'n' || i, 'v' || (c_custkey + i) FROM (SELECT *, unnest(range(0, k)) AS i FROM c)
UNION ALL SELECT c_custkey, 2 + k, 0, 1, 'segment', c_mktsegment FROM c""")
def xml_trees(spark: SparkSession, d: str) -> DataFrame:
    """XML of any depth, with prefixes, stray end tags and missing ones, to rows in document order."""
    k, key = F.col("c_nationkey") % 6, F.col("c_custkey")
    inner = F.lit("")
    for i in range(5, -1, -1):  # every other one lacks its end tag
        inner = F.when(k > i, F.concat(F.lit(f'<x:n{i} a="1>0">v'), (key + i).cast("string"), inner, F.lit(f"</x:n{i}>" if i % 2 == 0 else "</stray>"))).otherwise("")
    xml = F.concat(F.lit('<?xml version="1.0"?><!-- c --><x:record xmlns:x="u"><name>'), F.col("c_name"), F.lit(" &amp; <![CDATA[<co>]]></x:name>\n"), inner, F.lit("</none><segment >"), F.col("c_mktsegment"), F.lit("</segment></x:record>"))
    return table(spark, d, "customer").select("c_custkey", F.explode(TR.xml_nodes(xml)).alias("n")).select("c_custkey", "n.*")


@query("""SELECT o_orderkey, o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'EUR' WHEN 'O' THEN 'USD' ELSE 'JPY' END AS currency, -o_custkey AS customer, CAST(NULL AS VARCHAR) AS none FROM orders""")
def wire_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Keys and currency codes out of base64 tokens of numbered fields, nested ones too."""
    currency = F.when(F.col("o_orderstatus") == "F", "EUR").when(F.col("o_orderstatus") == "O", "USD").otherwise("JPY")
    inner = W.wire_message((3, currency), (5, -F.col("o_custkey")))
    token = F.base64(W.wire_message((1, F.col("o_orderkey")), (2, inner), (16, F.col("o_orderpriority"))))
    data = F.unbase64("token")
    return table(spark, d, "orders").select("o_orderkey", token.alias("token")).select("o_orderkey", W.wire_number(data, 1).alias("key"), W.wire_text(data, 2, 3).alias("currency"), W.wire_number(data, 2, 5).alias("customer"), W.wire_text(data, 2, 9).alias("none"))


@query()
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents read as pages of 25 lines under a heading each: every chunk with its pages and its heading."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    numbers = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 25).cast("int"))
    pages = F.transform(numbers, lambda i: F.struct((i + 1).alias("page"), F.concat(F.lit("# Part "), (i + 1).cast("string"), F.lit("\n\n"), F.array_join(F.slice(lines, i * 25 + 1, 25), "\n")).alias("markdown")))
    made = DOC.chunk_segments(table(spark, d, "documents").select("doc_id", pages.alias("pages")), "doc_id", "pages")
    return made.select("doc_id", "chunk_no", "start", "end", "first_page", "last_page", "heading", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("""SELECT o_orderpriority AS host, CASE WHEN bool_or(o_orderstatus = 'P') THEN max(o_custkey) FILTER (WHERE o_orderstatus = 'P') ELSE max(o_custkey) FILTER (WHERE o_orderstatus = 'O') END AS delay FROM orders GROUP BY o_orderpriority""")
def crawl_delays(spark: SparkSession, d: str) -> DataFrame:
    """The delay of each host: of the groups that name the agent, else of those for all agents."""
    agent = F.when(F.col("o_orderstatus") == "P", "Records").when(F.col("o_orderstatus") == "O", "*").otherwise("other")
    return E.crawl_delay(table(spark, d, "orders").select(F.col("o_orderpriority").alias("host"), agent.alias("agent"), F.col("o_custkey").alias("delay")), "records")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hour' WHEN '2-HIGH' THEN 'week' WHEN '3-MEDIUM' THEN 'month' WHEN '5-LOW' THEN 'year' END AS period,
  least(o_custkey, CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / (1000 + o_custkey)) AS BIGINT)) AS rows_paid FROM orders""")
def pay_periods(spark: SparkSession, d: str) -> DataFrame:
    """The period of a pay text, and how many of the wanted rows a budget pays for."""
    p, amount = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    shown = F.when(p == "1-URGENT", F.concat(F.lit("$"), amount, F.lit(" an hour"))).when(p == "2-HIGH", F.concat(amount, F.lit(" EUR weekly"))).when(p == "3-MEDIUM", F.concat(amount, F.lit("K/Month"))).when(p == "5-LOW", F.concat(F.lit("\u20b9"), amount, F.lit("L per annum"))).otherwise(F.concat(amount, F.lit(" once")))
    return table(spark, d, "orders").select("o_orderkey", N.pay_period(shown).alias("period"), N.affordable("o_custkey", F.lit(1000) + F.col("o_custkey"), F.round(F.col("o_totalprice") * 100).cast("long")).alias("rows_paid"))
