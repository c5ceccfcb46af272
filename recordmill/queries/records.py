"""Queries of the record maps, embedded data, references and predicates, each over JSON or pages made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import planning as PL
from ..functions import predicates as P
from ..functions import references as R
from ..functions import trees as TR
from ..operators import enrich as E
from ..operators import ordered as O
from ..plans import record_maps as M
from ..sources import embedded as EM
from ..sources.adapters import Adapter, read_adapters, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return note


def raw(df: DataFrame, **fields: Column) -> DataFrame:
    """A row of JSON text per row."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("raw"))


def struct(**fields) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()])


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS app_id, p_name AS name, p_brand AS developer, p_type || '|Tools' AS genres, p_retailprice - 900 AS price, p_retailprice - 900 = 0 AS free, CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) * 1000 END AS size_bytes,
 '1999-0' || (1 + p_size % 9) || '-05' AS released, 'b' || p_size AS screenshots, CASE WHEN p_size % 2 = 0 THEN '4+' ELSE '9+' END AS content_rating FROM part WHERE p_partkey <> 0 AND p_size <> 7""")
def record_apps(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = raw(
        table(spark, d, "part"), trackId=F.col("p_partkey"), wrapperType=F.when(size == 7, "artist").when(size % 3 == 0, "software"), trackName=F.col("p_name"), artistName=F.concat(F.lit("  "), "p_brand"),
        genres=F.array("p_type", F.lit(" "), F.lit("Tools")), price=F.col("p_retailprice") - 900, fileSizeBytes=F.when(size > 10, size * 1000).otherwise(0).cast("string"),
        releaseDate=F.concat(F.lit("1999-0"), (1 + size % 9).cast("string"), F.lit("-05T07:00:00Z")), screenshotUrls=F.array().cast("array<string>"), ipadScreenshotUrls=F.array(F.concat(F.lit("b"), size.cast("string"))),
        trackContentRating=F.when(size % 2 == 0, "4+"), contentAdvisoryRating=F.lit("9+"),
    )
    return M.mapped(rows, "raw", M.APP).select("app_id", "name", "developer", joined("genres"), "price", "free", "size_bytes", F.col("released").cast("string").alias("released"), joined("screenshots"), "content_rating")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS name, 'x-' || s_suppkey AS slug, CASE s_suppkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'W' ELSE 'X' END || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS batch_code,
 CASE WHEN s_nationkey > 5 THEN 'N' || s_nationkey END AS subindustry, strftime(make_timestamp(1000000 * (1000000000 + 86400 * CAST(s_nationkey AS BIGINT))), '%Y-%m-%d %H:%M:%S') AS launched_at, s_acctbal > 0 AS hiring, CASE WHEN s_acctbal > 0 THEN '/companies/x-' || s_suppkey || '/jobs' END AS jobs_url FROM supplier""")
def record_companies(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    season = F.when(k % 3 == 0, "Summer").when(k % 3 == 1, "winter").otherwise("Spring")
    rows = raw(
        table(spark, d, "supplier"), objectID=F.when(k % 2 == 0, k.cast("string")), id=k, name=F.col("s_name"), slug=F.concat(F.lit("x-"), k.cast("string")), batch=F.concat(season, F.lit(" 20"), F.lpad(n.cast("string"), 2, "0")),
        subindustry=F.when(n > 5, F.concat(F.lit("Trade -> N"), n.cast("string"))).otherwise("Trade"), launched_at=1_000_000_000 + 86_400 * n, isHiring=F.when(F.col("s_acctbal") > 0, True),
    )
    return M.mapped(rows, "raw", M.COMPANY).select("company_id", "name", "slug", "batch_code", "subindustry", stamp("launched_at"), "hiring", "jobs_url")


@query("""SELECT 'v' || event_id AS video_id, event_type AS title, 'u' || user_id AS author, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published, CAST(floor(value) AS BIGINT) AS seconds, event_id * 3 AS views, event_type || '|t' || (user_id % 5) AS tags, 'https://i/' || event_id AS cover, greatest(event_id % 4, 1) AS parts FROM events""")
def record_videos(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    view = struct(
        bvid=F.concat(F.lit("v"), i.cast("string")), title=F.col("event_type"), owner=struct(mid=u, name=F.concat(F.lit("u"), u.cast("string"))), pubdate=F.unix_seconds(F.col("ts").cast("timestamp")),
        duration=F.floor("value"), stat=struct(view=i * 3, like=0), pic=F.concat(F.lit("//i/"), i.cast("string")), videos=i % 4,
    )
    tag = lambda c: struct(tag_name=c)
    rows = raw(table(spark, d, "events"), View=view, Tags=F.array(tag(F.col("event_type")), tag(F.lit(" ")), tag(F.concat(F.lit("t"), (u % 5).cast("string"))), tag(F.col("event_type"))))
    return M.mapped(rows, "raw", M.VIDEO).select("video_id", "title", "author", stamp("published"), "seconds", "views", joined("tags"), "cover", "parts")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS tagline, o_orderstatus || '|x' AS topics, o_custkey AS votes, CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) AS launched_on, o_orderkey % 5 <> 0 AS featured FROM orders""")
def record_launches(spark: SparkSession, d: str) -> DataFrame:
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T05:00:00Z"))
    node = lambda c: struct(node=struct(name=c))
    rows = raw(
        table(spark, d, "orders"), id=F.col("o_orderkey"), name=F.lit("n"), tagline=F.concat("o_orderpriority", F.lit("\n")), topics=struct(edges=F.array(node(F.col("o_orderstatus")), node(F.lit("x")))),
        votesCount=F.col("o_custkey"), featuredAt=F.when(F.col("o_orderkey") % 5 != 0, at), createdAt=at,
    )
    return M.mapped(rows, "raw", M.LAUNCH).select("id", "tagline", joined("topics"), "votes", F.col("launched_on").cast("string").alias("launched_on"), "featured")


@query("""SELECT 'listing' AS source, 'c' || c_custkey AS job_id, c_name AS title, c_mktsegment || '|sql' AS skills, CAST(c_nationkey AS BIGINT) AS years, c_acctbal AS low, c_acctbal + 10 AS high, 'n' || c_nationkey AS company, c_nationkey % 2 = 0 AS remote, 'p' || c_nationkey AS locations FROM customer
UNION ALL SELECT 'board', 's' || s_suppkey, s_name, 'Spark|sql', CAST(0 AS BIGINT), NULL, s_acctbal, CASE WHEN s_nationkey % 2 = 1 THEN 'n' || s_nationkey END, NULL, 'p' || s_nationkey FROM supplier""")
def record_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Two job sites with formats of their own in one shape."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = raw(
        table(spark, d, "customer"), jobId=tag("c", "c_custkey"), headline=F.col("c_name"), allSkills=F.array("c_mktsegment", F.lit("sql"), F.lit("SQL")), expRange=struct(min=F.col("c_nationkey")),
        salaryRange=struct(min=F.col("c_acctbal"), max=F.col("c_acctbal") + 10), companyDetails=struct(name=tag("n", "c_nationkey")), remoteType=F.when(F.col("c_nationkey") % 2 == 0, "remote").otherwise("ONSITE"), locations=F.array(tag("p", "c_nationkey")),
    )
    s = raw(
        table(spark, d, "supplier"), id=tag("s", "s_suppkey"), title=F.col("s_name"), keySkills=F.array(F.lit("Spark")), skills=F.array(F.lit("spark"), F.lit("sql")), maximumSalary=struct(absoluteValue=F.col("s_acctbal")),
        hideCompanyName=F.col("s_nationkey") % 2 == 0, company=struct(name=tag("n", "s_nationkey")), locations=F.array(struct(city=tag("p", "s_nationkey"))),
    )
    sources = [Adapter("listing", lambda: c, {}, lambda df: M.mapped(df, "raw", M.LISTED_JOB)), Adapter("board", lambda: s, {}, lambda df: M.mapped(df, "raw", M.BOARD_JOB))]
    return read_adapters(sources, {}).select("source", "job_id", "title", joined("skills"), "years", "low", "high", "company", "remote", joined("locations"))


@query("""SELECT doc_id AS post_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN 'paid' ELSE 'free' END AS audience, CASE WHEN lang = 'en' THEN 'podcast' ELSE 'newsletter' END AS kind, w AS words, doc_id % 3 = 0 AND len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) < 0.95 * w AS preview
FROM (SELECT *, CAST(1 + length(text) // 6 AS BIGINT) AS w FROM documents WHERE text IS NOT NULL)""")
def record_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(
        table(spark, d, "documents").where("text is not null"), id=F.col("doc_id"), title=F.col("source"), audience=F.when(F.col("doc_id") % 3 == 0, "only_paid").when(F.col("doc_id") % 3 == 1, "everyone"),
        type=F.when(F.col("lang") == "en", "podcast"), wordcount=1 + F.floor(F.char_length("text") / 6), body=F.col("text"),
    )
    return M.mapped(rows, "raw", M.POST).select("post_id", "title", "audience", "kind", "words", "preview")


@query("""SELECT 'r' || event_id AS review_id, 1 + event_id % 5 AS rating, 'u' || user_id AS author, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS written, strftime(ts, '%Y-%m-%d') AS experienced, event_type = 'purchase' AS verified, CASE WHEN value > 50 THEN event_type END AS reply, 'en' AS language FROM events""")
def record_reviews(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = raw(
        table(spark, d, "events"), id=F.concat(F.lit("r"), F.col("event_id").cast("string")), rating=1 + F.col("event_id") % 5, consumer=struct(displayName=F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        dates=struct(publishedDate=iso, experiencedDate=iso), labels=struct(verification=struct(isVerified=F.when(F.col("event_type") == "purchase", True))), reply=F.when(F.col("value") > 50, struct(message=F.col("event_type"))), language=F.lit("en-GB"),
    )
    return M.mapped(rows, "raw", M.REVIEW).select("review_id", "rating", "author", stamp("written"), F.col("experienced").cast("string").alias("experienced"), "verified", "reply", "language")


_CATEGORIES = [("limited liability|llc|machinery|building", "company"), ("non.?profit|household", "non-profit")]


@query("""SELECT 'OR' AS state, CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'company' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'non-profit' ELSE 'other' END AS category, '2020-01-02' AS formed, 'N' || c_nationkey AS city, '12345' AS postal_code, NULL AS agent FROM customer
UNION ALL SELECT 'NY', 's' || s_suppkey, s_name, 'company', '2021-03-04', 'N' || s_nationkey, NULL, 'A' || s_nationkey FROM supplier
UNION ALL SELECT 'TX', 'p' || p_partkey, p_name, 'other', NULL, p_brand, CAST(10000 + p_size AS VARCHAR), NULL FROM part""")
def state_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Registers of three states, each with its own column names, in one shape."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    oregon = raw(table(spark, d, "customer"), registry_number=F.col("c_custkey"), business_name=F.col("c_name"), entity_type=F.col("c_mktsegment"), registry_date=F.lit("2020-01-02T00:00:00.000"), city=tag("N", "c_nationkey"), zip=F.lit("12345-6789"))
    york = raw(table(spark, d, "supplier"), dos_id=tag("s", "s_suppkey"), current_entity_name=F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), corp_name=F.col("s_name"), entity_type=F.lit("DOMESTIC LIMITED LIABILITY COMPANY"), filing_date=F.lit("2021-03-04"), dos_process_city=tag("N", "s_nationkey"), registered_agent_name=tag("A", "s_nationkey"))
    texas = raw(table(spark, d, "part"), taxpayer_number=tag("p", "p_partkey"), taxpayer_name=F.col("p_name"), taxpayer_organizational_type=F.col("p_brand"), responsibility_beginning_date=F.lit("no date"), taxpayer_city=F.col("p_brand"), taxpayer_zip_code=(10000 + F.col("p_size")).cast("string"))
    own = lambda state, df: Adapter(state, lambda: df, {}, lambda x: M.mapped(x, "raw", M.registration(M.REGISTERS[state], state, _CATEGORIES)))
    rows = read_adapters([own("OR", oregon), own("NY", york), own("TX", texas)], {})
    return rows.select("state", "entity_id", "name", "category", F.col("formed").cast("string").alias("formed"), "city", "postal_code", "agent")


@query("""SELECT event_type AS term, CAST(CAST(ts AS DATE) AS VARCHAR) || ' 00:00:00' AS at, CAST(count(*) AS BIGINT) AS value, count(*) > 10 AS has_data, CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) AS partial FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def trend_points(spark: SparkSession, d: str) -> DataFrame:
    """Series responses, one text per term, to a row per point."""
    daily = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = daily.agg(F.max("day").alias("last"))
    point = struct(time=F.unix_seconds(F.col("day").cast("timestamp")).cast("string"), value=F.array("n"), hasData=F.array(F.col("n") > 10), isPartial=F.when(F.col("day") == F.col("last"), True))
    body = daily.crossJoin(last).groupBy("event_type").agg(F.to_json(struct(timelineData=F.collect_list(point))).alias("raw"))
    points = body.select("event_type", F.explode(F.try_variant_get(F.try_parse_json("raw"), "$.timelineData", "array<variant>")).alias("p"))
    return M.mapped(points.select("event_type", F.to_json("p").alias("raw")), "raw", M.TREND_POINT, ["event_type"]).select(F.col("event_type").alias("term"), stamp("at"), "value", "has_data", "partial")


def _pages(spark: SparkSession, d: str, html: Column) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", html.alias("html"))


def _object() -> Column:
    """JSON of a part, with braces and quotes inside its strings."""
    return F.to_json(struct(id=F.col("p_partkey"), name=F.concat("p_name", F.lit(' } "{ ')), list=F.array(struct(v=F.col("p_size")))))


@query("SELECT p_partkey, p_partkey AS id, p_name || ' } \"{ ' AS name, CAST(p_size AS BIGINT) AS size FROM part")
def window_objects(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, F.concat(F.lit("<script>var a = {}; window.__DATA__ = "), _object(), F.lit("; window.b = {1: 2};</script>")))
    v = F.col("v")
    return pages.select("p_partkey", EM.window_object(F.col("html"), "__DATA__").alias("v")).select("p_partkey", F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.list[0].v", "long").alias("size"))


@query("SELECT p_partkey, p_name || ' } \"{ ' AS first, p_brand AS second, 2 AS n FROM part")
def keyed_blobs(spark: SparkSession, d: str) -> DataFrame:
    blob = lambda k, c: F.concat(F.lit(f"AF_initDataCallback({{key: '{k}', hash: '1', data:"), c, F.lit(", sideChannel: {}});"))
    pages = _pages(spark, d, F.concat(blob("ds:1", _object()), blob("ds:2", F.to_json(F.array("p_brand", F.lit("]")))), blob("ds:3", F.lit("function() {}"))))
    blobs = pages.select("p_partkey", EM.keyed_blobs(F.col("html")).alias("m"))
    part = lambda k, p: F.try_variant_get(F.try_parse_json(F.try_element_at("m", F.lit(k))), p, "string")
    return blobs.select("p_partkey", part("ds:1", "$.name").alias("first"), part("ds:2", "$[0]").alias("second"), F.size("m").alias("n"))


@query("SELECT p_partkey, p_name || ' } \"{ ' AS attribute, p_name || ' } \"{ ' AS linked, CAST(p_size AS BIGINT) AS marked, p_partkey AS called, p_brand AS state FROM part")
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """An attribute, linked data, data between marks, a batch response and an escaped state, one of each per part."""
    quoted = F.replace(_object(), F.lit('"'), F.lit("&quot;"))
    linked = F.concat(F.lit('<script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">'), F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.concat("p_name", F.lit(' } "{ ')).alias("name"))), F.lit("</script>"))
    inner = F.to_json(F.array(F.col("p_partkey")))
    envelope = F.concat(F.lit(")]}'\n\n12\n"), F.to_json(F.array(F.array(F.lit("wrb.fr"), F.lit("other"), F.lit("[]")), F.array(F.lit("wrb.fr"), F.lit("call"), inner))), F.lit("\n"))
    state = F.concat(F.lit('window.__STATE__ = JSON.parse("'), F.replace(F.replace(F.to_json(struct(b=F.col("p_brand"))), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('");'))
    html = F.concat(F.lit('<div id="app" data-page="'), quoted, F.lit('"></div>'), linked, F.lit("<!-- init-start -->"), F.to_json(struct(s=F.col("p_size"))), F.lit(" <!-- init-end -->"), state)
    pages = table(spark, d, "part").select("p_partkey", html.alias("html"), envelope.alias("response"))
    get = lambda v, p, kind="string": F.try_variant_get(v, p, kind)
    return pages.select(
        "p_partkey",
        get(EM.attribute_json(F.col("html")), "$.name").alias("attribute"),
        get(EM.linked_data(F.col("html")), "$.name").alias("linked"),
        get(EM.between(F.col("html"), "<!-- init-start -->", "<!-- init-end -->"), "$.s", "long").alias("marked"),
        get(EM.rpc_payload(F.col("response"), "call"), "$[0]", "long").alias("called"),
        get(EM.escaped_state(F.col("html"), "__STATE__"), "$.b").alias("state"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'channel' WHEN 3 THEN 'playlist' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 'UC' || v || v WHEN 3 THEN 'PL' || v END AS id, CASE WHEN o_custkey % 2 = 0 THEN 'apple' ELSE 'google' END AS store, CASE WHEN o_custkey % 2 = 0 THEN CAST(1000000 + o_custkey AS VARCHAR) ELSE 'com.x' || o_custkey END AS app
FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 11, 'a') AS v FROM orders)""")
def tagged_references(spark: SparkSession, d: str) -> DataFrame:
    k, v, c = F.col("o_orderkey"), F.lpad(F.col("o_orderkey").cast("string"), 11, "a"), F.col("o_custkey")
    url = F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), v, F.lit("&x=1"))).when(k % 5 == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?si=q"))).when(k % 5 == 2, F.concat(F.lit("http://youtube.com/channel/UC"), v, v, F.lit("/videos"))).when(k % 5 == 3, F.concat(F.lit("https://youtube.com/playlist?list=PL"), v)).otherwise("https://example.org/watch")
    app = F.when(c % 2 == 0, F.concat(F.lit("https://apps.apple.com/us/app/some-name/id"), (1_000_000 + c).cast("string"), F.lit("?mt=8"))).otherwise(F.concat(F.lit("https://play.google.com/store/apps/details?hl=en&id=com.x"), c.cast("string")))
    video, store = R.tagged(url, "video"), R.tagged(app, "app")
    return table(spark, d, "orders").select("o_orderkey", video["kind"].alias("kind"), video["id"].alias("id"), store["kind"].alias("store"), store["id"].alias("app"))


@query("""SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_size BETWEEN 5 AND 40 AND p_partkey % 2 = 0 AND (p_name LIKE '% ring' OR p_name LIKE 'red %')""")
def facet_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("long").alias("size"), F.split("p_name", " ").alias("words"), (F.col("p_partkey") % 2 == 0).alias("even"))
    rows = rows.withColumn("words", F.array(F.concat(F.lit("a:"), F.get("words", F.lit(0))), F.concat(F.lit("z:"), F.element_at("words", -1))))
    return rows.where(P.facets({"p_brand": ["Brand#1", "Brand#2", "Brand#17"], "words": ["a:red", "z:ring"], "p_type": []}, ["even"], {"size": (5, 40)}, ["words"])).select("p_partkey", "p_brand", "p_type", "size")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3, 7) OR c_mktsegment = 'BUILDING'""")
def place_filter(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(F.concat(F.lit(" Nation_"), F.col("c_nationkey").cast("string")), F.when(F.col("c_mktsegment") == "BUILDING", "Work From Home").otherwise("Office"))
    rows = table(spark, d, "customer").select("c_custkey", places.alias("places"))
    return rows.where(P.in_places("places", ["NATION_1", "nation_2", "First", "Seven", "remote"], {"nation_3": "first", "nation_7": "seven", "work from home": "remote"})).select("c_custkey")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS days, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later, strftime(o_orderdate, '%Y-%m-%d') AS english, strftime(o_orderdate, '%Y-%m-%d') AS epoch, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS tokyo, CAST(NULL AS VARCHAR) AS nowhere FROM orders""")
def date_forms(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    zone = F.when(F.col("o_orderkey") >= 0, "Asia/Tokyo")
    return table(spark, d, "orders").select(
        "o_orderkey",
        D.days_between(F.lit("1996-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("days"),
        D.add_days(F.col("o_orderdate").cast("date"), 10).cast("string").alias("later"),
        day(D.english_date(F.date_format("o_orderdate", "d MMMM yyyy")), "english"),
        day(D.epoch_millis(F.unix_millis(at)), "epoch"),
        day(D.instant(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "iso"),
        F.date_format(D.local_wall_clock(at, zone), "yyyy-MM-dd HH").alias("tokyo"),
        F.date_format(D.local_wall_clock(at, F.concat(zone, F.lit("?"))), "yyyy").alias("nowhere"),
    )


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, CASE WHEN event_type = 'error' THEN NULL ELSE ts END DESC, event_id) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 20 THEN -1 ELSE value END DESC, event_id) AS votes FROM events""")
def feed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Places by newest first with undated rows after dated ones, and by votes with unknown ones last."""
    e = table(spark, d, "events").withColumn("dated", F.when(F.col("event_type") != "error", F.col("ts"))).withColumn("liked", F.when(F.col("value") >= 20, F.col("value")))
    return O.with_rank(O.with_rank(e, ["user_id"], O.newest_first("dated", ["event_id"]), "newest"), ["user_id"], O.most_votes("liked", ["event_id"]), "votes").select("user_id", "event_id", "newest", "votes")


@query("""SELECT c_custkey, 'Deutsch' || c_custkey AS plain, 'a' || c_nationkey || 'b' AS runs, lower(c_mktsegment) || '|sql' AS list, 'x' || c_nationkey AS tags, '1.' || c_nationkey AS version, c_name AS deep, CASE WHEN c_nationkey < 10 THEN 'low' WHEN c_nationkey < 20 THEN 'mid' END AS grouped FROM customer""")
def json_helpers(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    simple, runs = F.to_variant_object(struct(simpleText=F.concat(F.lit("Deutsch"), k))), F.to_variant_object(struct(runs=F.array(struct(text=F.concat(F.lit("a"), n)), struct(text=F.lit("b")))))
    tree = F.to_json(struct(a=F.array(struct(q=F.array(F.lit(1), F.lit(2)))), c=struct(videoRenderer=struct(title=F.col("c_name")))))
    pair = F.concat(F.lit('{"x": [[1, "no"], [null, [2, "1.'), n, F.lit('"]], [3, "9.9"]]}'))
    found = F.get(TR.values_under(tree, "videoRenderer"), F.lit(0))
    return table(spark, d, "customer").select(
        "c_custkey",
        TR.runs_text(simple).alias("plain"),
        TR.runs_text(runs).alias("runs"),
        F.array_join(TR.joined_lists(F.array(F.lower("c_mktsegment"), F.lit(" ")), F.array(F.lit("sql"), F.col("c_mktsegment")), F.lit(None).cast("array<string>")), "|").alias("list"),
        F.array_join(TR.prefixed_tags(F.array(F.concat(F.lit("Organizer/x"), n), F.lit("Other/y"), F.concat(F.lit("Organizer/x"), n)), "Organizer/"), "|").alias("tags"),
        TR.version_pair(pair).alias("version"),
        TR.text_at(F.try_parse_json(found), "title").alias("deep"),
        TR.group_of(n, {"low": [str(i) for i in range(10)], "mid": [str(i) for i in range(10, 20)]}).alias("grouped"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 10000 + o_custkey WHEN 1 THEN (10 + o_custkey % 90) * 1000 WHEN 2 THEN 10000 + o_custkey WHEN 3 THEN 1200 + 100 * (o_custkey % 8) END AS sold,
 CAST(1000 + o_custkey AS VARCHAR) AS product, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS pacific, strftime(o_orderdate, '%Y-%m-%d') || 'T07:05' AS parts, CASE WHEN o_custkey % 2 = 0 THEN 'GB' ELSE 'US-CA' END AS geo FROM orders""")
def small_parsers(spark: SparkSession, d: str) -> DataFrame:
    """Sold counts with the separators of several languages, product ids, a zone's day, times of parts, region codes."""
    k, c, at = F.col("o_orderkey") % 4, F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    comma = F.format_number(10_000 + c, 0)
    shown = F.when(k == 0, F.concat(comma, F.lit(" bought"))).when(k == 1, F.concat((10 + c % 90).cast("string"), F.lit("k bought"))).when(k == 2, F.concat(F.lit("Bought "), F.replace(comma, F.lit(","), F.lit(" ")))).otherwise(F.concat(F.lit("over 1."), (2 + c % 8).cast("string"), F.lit("K")))
    product = F.when(k < 2, (1000 + c).cast("string")).otherwise((PL.ID_OFFSET + 1000 + c).cast("string"))
    parts = F.array(F.year(at), F.month(at), F.dayofmonth(at))
    return table(spark, d, "orders").select(
        "o_orderkey",
        PL.sold_count(shown).alias("sold"),
        PL.plain_product_id(product).alias("product"),
        PL.zone_day(at, "America/Los_Angeles").cast("string").alias("pacific"),
        PL.time_of_parts(parts, F.array(F.lit(7), F.lit(5))).alias("parts"),
        PL.geo_code(F.when(c % 2 == 0, " uk").otherwise("us-ca")).alias("geo"),
    )


@query("""SELECT o_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY o_orderkey""")
def dereferenced_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders hold references to parts; those that the cache knows are resolved, in order."""
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    orders = table(spark, d, "orders").select("o_orderkey").join(refs, "o_orderkey")
    cache = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("ref"), "p_name")
    found = E.dereferenced(orders, "refs", cache, "ref", ["p_name"], "parts")
    return found.select("o_orderkey", F.nullif(F.array_join(F.transform("parts", lambda x: x["p_name"]), "|"), F.lit("")).alias("names"))


@query("""WITH c AS (SELECT n_name AS wanted, CASE WHEN c_custkey % 3 = 0 THEN n_name || ' Ltd' WHEN c_custkey % 3 = 1 THEN lower(replace(n_name, '_', ' ')) ELSE c_name END AS name, c_acctbal AS weight, c_custkey % 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS wanted, (SELECT name FROM c WHERE c.wanted = n_name ORDER BY CASE k WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, weight DESC NULLS LAST, name LIMIT 1) AS name FROM nation""")
def best_advertisers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("wanted"))
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat("wanted", F.lit(" Ltd"))).when(k == 1, F.lower(F.replace("wanted", F.lit("_"), F.lit(" ")))).otherwise(F.col("c_name"))
    candidates = table(spark, d, "customer").join(nation, "c_nationkey").select("wanted", name.alias("name"), F.col("c_acctbal").alias("weight"))
    return E.best_candidate(nation.select("wanted"), candidates, "wanted", "name", "weight").select("wanted", "name")


@query("""SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1 THEN c_nationkey || c_mktsegment END AS duplicate_of FROM customer""")
def alias_duplicates(spark: SparkSession, d: str) -> DataFrame:
    inputs = table(spark, d, "customer").withColumn("resolved", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return E.first_alias(inputs, "resolved", ["c_custkey"]).select("c_custkey", "duplicate_of")


@query("""SELECT what, place, CAST(d AS DATE)::VARCHAR AS date FROM (VALUES ('Data Eng', 'Pune'), ('Data Eng', 'Bad Ems'), ('QA', 'Pune'), ('QA', 'Bad Ems')) t(what, place), (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01')
UNION ALL SELECT what, place, CAST(unnest(generate_series(DATE '1996-04-01', DATE '1996-04-03', INTERVAL 1 DAY)) AS DATE)::VARCHAR FROM (VALUES ('Data Eng', 'Pune'), ('Data Eng', 'Bad Ems'), ('QA', 'Pune'), ('QA', 'Bad Ems')) t(what, place)""")
def planned_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches of two lists on the days of a month that have orders, and on the days of a range."""
    pairs = PL.searches(spark, ["Data Eng", " QA ", "QA", ""], ["Pune", "Bad Ems"]).select("what", F.col("where").alias("place"))
    o = table(spark, d, "orders").where("o_orderdate >= '1996-03-01' and o_orderdate < '1996-04-01'").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    ranged = PL.dated_searches(pairs.withColumns({"a": F.lit("1996-04-01").cast("date"), "b": F.lit("1996-04-03").cast("date")}), "a", "b").select("what", "place", "date")
    return pairs.crossJoin(o).unionByName(ranged).withColumn("date", F.col("date").cast("string"))
