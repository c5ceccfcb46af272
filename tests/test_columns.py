"""Column functions on small values."""

import pytest
from pyspark.sql import functions as F

from recordmill.functions import dates as D
from recordmill.functions import listings as LI
from recordmill.functions import numbers as N
from recordmill.functions import planning as PL
from recordmill.functions import predicates as P
from recordmill.functions import references as R
from recordmill.functions import text as T
from recordmill.functions import urls as U
from recordmill.sources import adapters as A
from recordmill.sources import embedded as EM
from recordmill.types import number, round_half_up, shaped

CASES = [
    (lambda c: T.squash(c), " a \n b ", "a b"),
    (lambda c: T.squash(c), "  ", None),
    (lambda c: T.slug(c), "C++ & C# – Café!", "c-plus-plus-c-sharp-cafe"),
    (lambda c: T.slug(c, 5), "abcd efgh", "abcd"),
    (lambda c: T.snippet(c, 20), "one two three, four five six", "one two three, four ..."),
    (lambda c: T.html_to_text(c), "<p>a &amp; b</p><ul><li>x<li>y</ul><script>no</script>", "a & b\n\n- x\n- y"),
    (lambda c: T.first_heading(c), "text\n## Head  line\n# next", "Head line"),
    (lambda c: T.name_key(c), "Acme, Inc.", "acme"),
    (lambda c: T.letter_word_count(c), "don't re-do 3x", 3),
    (lambda c: T.decode_entities(c), "&lt;a&gt; &quot;x&quot; &amp;amp;", '<a> "x" &amp;'),
    (lambda c: N.money(c), "$1,234.50", 1234.5),
    (lambda c: N.money(c), "free", None),
    (lambda c: N.experience_years(c), "3-5 years", 3),
    (lambda c: N.experience_years(c), "Any", 0),
    (lambda c: N.ratio_text(c), "30000/1001", 29.97),
    (lambda c: N.ratio_text(c), "1/0", None),
    (lambda c: D.leading_date(c).cast("string"), "2024-02-03T04", "2024-02-03"),
    (lambda c: D.leading_date(c).cast("string"), "2024-02-33", None),
    (lambda c: D.relative_date(c, "2024-01-31").cast("string"), "1 month", "2024-02-29"),
    (lambda c: D.relative_date(c, "2024-01-31").cast("string"), "+7", "2024-02-07"),
    (lambda c: D.timecode(c.try_cast("double")), "3723.0045", "01:02:03,005"),
    (lambda c: U.without_tracking(c), "https://a.b/c?utm_source=x&q=1&ref=z#f", "https://a.b/c?q=1"),
    (lambda c: U.without_tracking(c), "https://a.b/c?ref=z", "https://a.b/c"),
    (lambda c: U.absolute(c), "//a.b", "https://a.b"),
    (lambda c: number(c), "NaN", None),
    (lambda c: round_half_up(c.try_cast("double")), "-2.5", -2.0),
    (lambda c: A.private_ip(c), "10.0.0.1", True),
    (lambda c: A.at(A.guarded_json(c), "$[1].a", "long"), ")]}'\n[0, {\"a\": 5}]", 5),
    (lambda c: A.at(A.page_json(c, "__DATA__"), "$.x"), '<script id="__DATA__" type="j">{"x": "y"}</script>', "y"),
    (lambda c: F.size(A.sitemap_entries(c)), "<url><loc>a</loc></url><url><loc>b</loc><lastmod>1</lastmod></url><url><loc>a</loc></url>", 2),
    (lambda c: N.compact(c), "10.6M", 10600000),
    (lambda c: N.compact(c), "24 240", 24240),
    (lambda c: N.compact(c), "x", None),
    (lambda c: N.compact(c), "2B", 2000000000),
    (lambda c: N.pay_range(c)["low"], "$80K - $120K", 80000),
    (lambda c: N.pay_range(c)["currency"], "€50,000-€70,000", "EUR"),
    (lambda c: N.pay_range(c)["low"], "competitive", None),
    (lambda c: D.duration_seconds(c), "1:02:03", 3723),
    (lambda c: D.duration_seconds(c), "1:2:3:4", None),
    (lambda c: D.season_code(c), "Spring 2026", "X26"),
    (lambda c: D.season_code(c), "2025", None),
    (lambda c: T.none_to_null(c), "N/A", None),
    (lambda c: T.none_to_null(c), "[redacted]", None),
    (lambda c: T.base_language(c), "PT", "pt"),
    (lambda c: F.array_join(T.comma_list(c), "|"), "a, B,b ,, A,c", "a|B|c"),
    (lambda c: T.pretty_enum(c), "SIZE_51_200", "51-200"),
    (lambda c: T.pretty_enum(c), "FULL", "full"),
    (lambda c: T.clear_email(c), "sales {AT} x (dot) y (dot) z", "sales@x.y.z"),
    (lambda c: T.slug(c), "Šibenik Łódź Ⅳ ﬁ", "sibenik-odz"),
    (lambda c: T.slug(c), "Cafe\u0301", "cafe"),
    (lambda c: T.decode_entities(c), "5 &#8364; &#x20AC; &#128512; &#0; &#55296; &amp;#65;", "5 € € 😀 &#0; &#55296; &#65;"),
    (lambda c: D.local_wall_clock(c.try_cast("timestamp"), "Asia/Tokyo").cast("string"), "2024-01-01 00:00:00", "2024-01-01 09:00:00"),
    (lambda c: D.local_wall_clock(c.try_cast("timestamp"), "Mars/Base").cast("string"), "2024-01-01 00:00:00", None),
    (lambda c: D.local_to_utc(F.lit("2024-01-01 09:00:00").cast("timestamp"), c).cast("string"), "Nowhere", None),
    (lambda c: D.english_date(c).cast("string"), "3 March 1998", "1998-03-03"),
    (lambda c: D.english_date(c).cast("string"), "42 Mar 1998", None),
    (lambda c: D.instant(c).cast("string"), "1700000000", "2023-11-14 22:13:20"),
    (lambda c: F.size(D.descending_dates("2024-03-01", 3)), "", 3),
    (lambda c: R.tagged(c, "app")["id"], "com.example.app", "com.example.app"),
    (lambda c: R.tagged(c, "message")["id"], "https://t.me/s/chan/12?x", "chan/12"),
    (lambda c: R.tagged(c, "deviation")["kind"], "https://www.deviantart.com/someone", "user"),
    (lambda c: R.short_id(c), "https://a.b/job/Engineer-Pune-x7Ya", "x7Ya"),
    (lambda c: R.listing_url(R.listing_search(c)["role"], R.listing_search(c)["place"], R.listing_search(c)["page"], "https://w.com"), "https://w.com/role/l/dev/rome?page=3", "https://w.com/role/l/dev/rome?page=3"),
    (lambda c: R.listing_search(c)["place"], "https://w.com/role/r/dev", "remote"),
    (lambda c: R.file_name(c, F.lit("https://a.b/x/y.pdf")), "attachment; filename*=UTF-8''na%20me.pdf", "na me.pdf"),
    (lambda c: R.file_name(c, F.lit("https://a.b/x/y%20z.pdf")), "inline", "y z.pdf"),
    (lambda c: PL.sold_count(c), "31k bought", 31000),
    (lambda c: PL.sold_count(c), "Bought 12 345", 12345),
    (lambda c: PL.sold_count(c), "over 7.5 mil", 7500),
    (lambda c: PL.sold_count(c), "none", None),
    (lambda c: PL.route(c)["destination"], "jfk-LHR 2026-11-15", "LHR"),
    (lambda c: PL.route(c)["date"].cast("string"), "JFK-LHR 2026-11-15 2026-11-20", "2026-11-15"),
    (lambda c: PL.route(c), "New York", None),
    (lambda c: PL.place_slug(c), "ca--Los Angeles", "ca--los-angeles"),
    (lambda c: F.array_join(PL.places(c), "|"), "Rome / Remote /  Rome", "Rome|Remote"),
    (lambda c: PL.zone_midnight(F.lit("2024-07-01").cast("date"), "America/Los_Angeles").cast("string"), "", "2024-07-01 07:00:00"),
    (lambda c: PL.geo_code(c), "uk-eng", "GB-ENG"),
    (lambda c: PL.uploads_list(c, "shorts"), "UCabc", "UUSHabc"),
    (lambda c: PL.fit_width(F.lit(1920), F.lit(1081), 640)["height"], "", 360),
    (lambda c: PL.mostly_stamped(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.lit(None))), "", True),
    (lambda c: LI.image_size(F.unhex(c))["width"], "89504E470D0A1A0A0000000D49484452000000200000001008", 32),
    (lambda c: LI.image_size(F.unhex(c))["height"], "FFD8FFE000040000FFC0001108001000200300", 16),
    (lambda c: LI.image_size(F.unhex(c))["width"], "474946383961200010000000", 32),
    (lambda c: LI.image_size(F.unhex(c))["height"], "524946460000000057454250565038580A000000000000001F00000F0000", 16),
    (lambda c: LI.image_size(F.unhex(c)), "0102", None),
    (lambda c: P.is_challenge(c), "<title>Just a moment...</title>", True),
    (lambda c: P.page_kind(c, [("group", "members"), ("channel", "subscribers")]), "12 subscribers", "channel"),
    (lambda c: P.allowed_url(c, ["a.org"], ["login"]), "https://x.a.org/login?x", False),
    (lambda c: P.allowed_url(c, ["a.org"], ["login"]), "https://x.a.org/p/1", True),
    (lambda c: EM.decoded_body(F.encode(c, "UTF-8"), F.lit("text/html")), "naïve", "naïve"),
    (lambda c: EM.decoded_body(F.unhex(c), F.lit("text/html; charset=latin1")), "E4", "ä"),
    (lambda c: EM.decoded_body(F.unhex(c), F.lit(None).cast("string")), "E4", "ä"),
    (lambda c: F.size(A.feed_items(c, "item", "title string")), "<rss><item><title>a</title></item><item><title>b</title></item></rss>", 2),
]


def test_columns(spark):
    row = spark.createDataFrame([[x for _, x, _ in CASES]], ", ".join(f"c{i} string" for i in range(len(CASES))))
    got = row.select(*[f(F.col(f"c{i}")).alias(f"r{i}") for i, (f, _, _) in enumerate(CASES)]).first()
    for i, (_, x, want) in enumerate(CASES):
        assert got[i] == want, (x, got[i], want)


def test_same_site_and_languages(spark):
    df = spark.createDataFrame([("https://www.a.org/x", "http://blog.a.org", "en-US", "EN"), ("https://a.org", "https://b.org", "pt", "en")], "a string, b string, l string, m string")
    rows = df.select(U.same_site("a", "b").alias("s"), T.same_language("l", "m").alias("l")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False)]


def test_fixed_shape(spark):
    df = shaped(spark.createDataFrame([(1, "x")], "b int, a string"), [("a", "string"), ("b", "long"), ("c", "double")])
    assert df.columns == ["a", "b", "c"] and df.first()["c"] is None


def test_fingerprint_tells_null_from_blank(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "~")], "x string, y string")
    assert df.select(N.fingerprint("x", "y").alias("f")).distinct().count() == 3


@pytest.mark.parametrize("w,h,want", [(1920, 1080, (640, 360)), (100, 50, (100, 50)), (1, 1000, (2, 480))])
def test_fit_inside(spark, w, h, want):
    r = spark.createDataFrame([(w, h)], "w int, h int").select(N.fit_inside("w", "h", 640, 480).alias("f")).first()["f"]
    assert tuple(r) == want
