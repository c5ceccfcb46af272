"""Itineraries, legal notices, metered transcripts and recorded pages on small tables, against plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from recordmill.operators import itineraries as IT
from recordmill.operators import notices as NO
from recordmill.operators import transcripts as TR
from recordmill.sources import recorded as RP

SF = "/root/testdata/sf0.001"
LEGS = "trip int, departs timestamp, arrives timestamp, number string, carrier string, origin string, destination string"
T = lambda h, m=0: dt.datetime(2024, 5, 1 + h // 24, h % 24, m)


def test_legs_are_joined_in_order_with_their_layovers(spark):
    legs = [
        (1, T(12), T(15), "B2", "Bee", "FRA", "OSL"),
        (1, T(8), T(10, 30), "A1", "Ant", "JFK", "FRA"),
        (1, T(30), T(31), "A3", "Ant", "OSL", "BGO"),
        (2, T(5), T(9), "C1", None, "A", "B"),
        (2, T(8), T(11), "C2", None, "B", "C"),
        (3, T(5), T(6), "D1", "Dee", "A", "B"),
        (3, T(7), T(8), None, "Dee", "X", "C"),
        (None, None, None, None, None, None, None),
    ]
    rows = {r["trip"]: r for r in IT.join_legs(spark.createDataFrame(legs, LEGS), ["trip"]).withColumn("key", IT.itinerary_key(["trip"])).collect()}
    a = rows[1]
    assert (a.origin, a.destination, a.minutes, a.stops, a.numbers, a.carriers, a.connected) == ("JFK", "BGO", 23 * 60, 2, ["A1", "B2", "A3"], ["Ant", "Bee"], True)
    assert [tuple(x) for x in a.layovers] == [("FRA", 90), ("OSL", 15 * 60)]
    assert a.key == "1|A1,B2,A3|2024-05-01 08:00"
    assert not rows[2].connected and rows[2].layovers[0].minutes == -60  # the next leg leaves before this one is there
    assert not rows[3].connected and rows[3].key == "3|D1,|2024-05-01 05:00"
    assert (rows[None].stops, rows[None].minutes, rows[None].key, rows[None].connected) == (0, None, "||", True)
    assert IT.join_legs(spark.createDataFrame([], LEGS), ["trip"]).count() == 0


def test_prices_rank_and_change(spark):
    rows = [("a", 1, 50), ("a", 2, None), ("a", 3, 0), ("a", 4, 70), ("a", 5, 30), ("b", 1, None), (None, 1, 9), (None, 2, 9)]
    df = spark.createDataFrame(rows, "search string, at int, price long")
    got = {(r.search, r["at"]): (r["rank"], r.is_cheapest) for r in IT.priced(df, ["search"], [F.col("at")], "price", 2).collect()}
    assert got == {("a", 1): (1, False), ("a", 4): (2, False), (None, 1): (1, True), (None, 2): (2, True)}  # the cheapest is not shown
    seen = spark.createDataFrame([("x", "5 EUR"), ("y", "6 EUR")], "key string, mark string")
    now = spark.createDataFrame([("x", "4 EUR"), ("z", "1 EUR"), ("z", "1 EUR"), (None, "2 EUR")], "key string, mark string")
    assert sorted(map(tuple, IT.latest_marks(seen, now, "key", "mark").collect()), key=str) == sorted([("x", "4 EUR"), ("y", "6 EUR"), ("z", "1 EUR"), (None, "2 EUR")], key=str)


NOTICES = {
    "court above the label of the number": (["Impressum", "Sonne KG", "Amtsgericht Bad Homburg v.d.H.", "Registernummer:", "HRA 5"], {"register_number": "HRA 5", "register_kind": "HRA"}),
    "genitive of a court": (["Mond GmbH", "eingetragen im Register des Amtsgerichts Köln unter HRB 77"], {"register_court": "Amtsgericht Köln", "register_number": "HRB 77"}),
    "short kinds need the word register": (["Stern AG", "VR 12"], {"register_number": None, "country": None}),
    "after the heading first": (["Alt GmbH", "HRB 1", "Impressum", "Neu GmbH", "HRB 2"], {"company_name": "Neu GmbH", "register_number": "HRB 2"}),
    "before it where nothing else is": (["Alt GmbH", "HRB 1", "Impressum", "Kontakt"], {"company_name": "Alt GmbH", "register_number": "HRB 1"}),
    "makers are not the company": (["Impressum", "Design: Pixel GmbH", "Geschäftsführer: Eva AG", "Wald OHG"], {"company_name": "Wald OHG", "legal_form": "OHG"}),
    "copyright only where no other": (["© 2021 Fuß UG", "Impressum", "Hand UG"], {"company_name": "Hand UG"}),
    "sentences are no names": (["Impressum", "Wir sind eine GmbH", "Das ist die Baum GmbH"], {"company_name": None}),
    "labelled VAT only": (["Nord B.V.", "BTW: PL1234567890", "IT12345678901"], {"vat_id": "PL1234567890", "country": "PL"}),
    "unlabelled VAT of these lands is none": (["Nord B.V.", "PL1234567890"], {"vat_id": None}),
    "too few digits": (["Süd AG", "Tel: 110", "Fax: 030 123456"], {"phone": None, "fax": "030 123456"}),
    "French": (["Mentions légales", "Éditeur : Lune SARL", "5 avenue Foch, 69001 Lyon", "SIRET : 123 456 789 00011"], {"company_name": "Lune SARL", "street": "5 avenue Foch", "postal_code": "69001", "city": "Lyon", "register_number": "123 456 789", "country": "FR"}),
    "nothing": ([], {"company_name": None, "register_kind": None, "vat_id": None, "country": None}),
    "null": (None, {"company_name": None, "register_number": None}),
    "null lines": ([None, "", "  ", "See AG"], {"company_name": "See AG"}),
    "very long": (["Impressum", "wort " * 50_000, "Ende AG"], {"company_name": "Ende AG"}),
}


def test_notices(spark):
    df = spark.createDataFrame([(k, v[0], "clash") for k, v in NOTICES.items()], "name string, lines array<string>, city string")
    got = {r["name"]: r.asDict() for r in NO.company_fields(df, "lines").collect()}
    wrong = {k: {f: got[k][f] for f in want} for k, (_, want) in NOTICES.items() if any(got[k][f] != x for f, x in want.items())}
    assert not wrong
    assert got["nothing"]["city"] is None  # a column of the same name is replaced
    assert NO.company_fields(df.where("false"), "lines").count() == 0


BODIES = [
    ("vtt", "WEBVTT\n\n00:01.000 --> 00:02.500\n<v Ann>Hello\n\n00:00:03.000 --> 00:00:04.000\nyou", [(1.0, 2.5, "Hello"), (3.0, 4.0, "you")]),
    ("srt", "1\r\n00:00:01,000 --> 00:00:02,000\r\nA\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\n ", [(1.0, 2.0, "A")]),
    ("json", '{"version": "1", "segments": [{"startTime": 0.5, "endTime": 1, "body": " x "}, {"startTime": 2, "body": "y"}, {"body": "z"}]}', [(0.5, 1.0, "x"), (2.0, 2.0, "y")]),
    ("json", "{broken", None),
    ("text", "One  two\nthree\n\n\n four", [(None, None, "One two three"), (None, None, "four")]),
    ("html", "<html><head><title>T</title></head><nav>menu</nav><body><p>One<br>two &amp; three</p><div>four<script>x()</script></div></body>", [(None, None, "One two & three"), (None, None, "four")]),
    ("vtt", "  <!doctype html><p>Sign in</p>", None),
    ("text", "<HTML lang=en>no", None),
    ("text", " \n ", None),
    ("docx", "some text", None),
    ("vtt", None, None),
    (None, "text", None),
]


def test_published_transcripts_of_every_kind(spark):
    df = spark.createDataFrame([(i, k, b) for i, (k, b, _) in enumerate(BODIES)], "i int, kind string, body string")
    got = {r.i: None if r.s is None else [tuple(x) for x in r.s] for r in df.select("i", TR.published_segments(F.col("kind"), F.col("body")).alias("s")).collect()}
    assert [got[i] for i in range(len(BODIES))] == [x for _, _, x in BODIES]


def test_choice_of_a_transcript(spark):
    own = [(0.0, 1.0, "mine")]
    items = spark.createDataFrame([(1, own), (2, own), (3, own), (4, []), (5, None), (None, own)], f"id int, own {TR.SEGMENTS}")
    links = [(1, "html", "<p>b</p>"), (1, "text", "a"), (1, "vtt", "<html>"), (2, "srt", "<html>"), (2, "json", "{}"), (4, "text", ""), (None, "text", "n"), (9, "text", "of no item")]
    published = spark.createDataFrame(links, "id int, kind string, body string")
    got = {r.id: (r.source, r.kind, r.segments and r.segments[0].text, r.note) for r in TR.choose_transcripts(items, published, ["id"], "own").collect()}
    assert got == {1: ("published", "text", "a", None), 2: ("own", None, "mine", "unusable: json, srt"), 3: ("own", None, "mine", None), 4: (None, None, None, "unusable: text"), 5: (None, None, None, None), None: ("published", "text", "n", None)}
    only = {r.id: r.source for r in TR.choose_transcripts(items, published, ["id"], "own", only_published=True).collect()}
    assert only == {1: "published", 2: None, 3: None, 4: None, 5: None, None: "published"}
    assert TR.choose_transcripts(items, published.where("false"), ["id"], "own").where("source = 'own'").count() == 4


def test_a_budget_pays_in_order_over_days(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2, 3, None]), i, draw.choice([0, 1, 2, 5, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "account string, day int, i int, minutes long")
    got = {(r.i, r.spent) for r in TR.metered(df, ["account"], "day", ["i"], "minutes", F.when(F.col("account") == "a", 60).when(F.col("account") == "b", 30)).collect()}
    want = set()
    for account, budget in (("a", 60), ("b", 30), (None, None)):
        spent = 0
        for _, _, i, m in sorted((r for r in rows if r[0] == account), key=lambda r: (r[1] or 0, r[2])):
            spent += m or 0
            if budget is None or spent <= budget:
                want.add((i, spent))
    assert got == want


def test_an_item_is_billed_on_its_first_chunk(spark):
    timed = [(2.0, 3.0, "c" * 30), (0.0, 1.0, "a" * 30), (1.0, 2.0, "b" * 30)]
    rows = [(1, timed, 7), (2, [(None, None, "z" * 50), (None, None, "a" * 30)], 4), (3, [], 5), (4, None, 5), (None, [(0.0, 1.0, "x")], None)]
    df = spark.createDataFrame(rows, f"id int, segments {TR.SEGMENTS}, minutes long")
    got = sorted((tuple(r) for r in TR.billed_chunks(df, "id", "segments", "minutes", 61, 0).collect()), key=str)
    assert got == sorted(
        [(1, 0, 2, 0.0, 2.0, "a" * 30 + " " + "b" * 30, 7), (1, 1, 2, 2.0, 3.0, "c" * 30, 0), (2, 0, 2, None, None, "z" * 50, 4), (2, 1, 2, None, None, "a" * 30, 0), (None, 0, 1, 0.0, 1.0, "x", 0)], key=str
    )


def test_bills_of_the_query_add_up(spark):
    from recordmill.queries import services as Q

    chunks = Q.transcript_bills(spark, SF).groupBy("conv_id").agg(F.sum("billed").alias("billed"), F.count("*").alias("n"), F.max("chunk_count").alias("told"), F.min("chunk_no").alias("first")).collect()
    items = {r.conv_id: r.minutes for r in Q.metered_transcripts(spark, SF).collect()}
    assert {r.conv_id: r.billed for r in chunks} == items and all(r.n == r.told and r.first == 0 for r in chunks)


def put(root, feed, cursor, rows, following=None):
    folder = root / f"feed={feed}" / f"page={cursor}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(json.dumps({"rows": rows, "next": following}) + "\n")


def read(df):
    return sorted((r.feed, r.page, r.cursor, r.row) for r in df.collect())


def test_numbered_pages_end_at_the_first_gap(spark, tmp_path):
    for n in (1, 2, 3, 5):
        put(tmp_path, "a", n, [{"n": n}, {"n": -n}])
    put(tmp_path, "b", 1, [])
    put(tmp_path, "c", 2, [{"n": 9}])  # has no first page
    got = read(RP.read_pages(spark, str(tmp_path), pages_per_task=2))
    assert got == sorted(("a", n, str(n), json.dumps({"n": x}, separators=(",", ":"))) for n in (1, 2, 3) for x in (n, -n))
    assert read(RP.read_pages(spark, f"file://{tmp_path}", most_pages=1)) == [r for r in got if r[1] == 1]
    assert read(RP.read_pages(spark, str(tmp_path / "none"))) == []


def test_cursors_end_at_a_repeat_a_missing_page_or_the_cap(spark, tmp_path):
    put(tmp_path, "loop", "s", [1], "x")
    put(tmp_path, "loop", "x", [2], "y")
    put(tmp_path, "loop", "y", [3], "x")
    put(tmp_path, "end", "s", [4], "e")
    put(tmp_path, "end", "e", [5])
    put(tmp_path, "missing", "s", [6], "gone")
    got = read(RP.read_pages(spark, str(tmp_path), mode="cursor", first="s"))
    assert [r[3] for r in sorted(got, key=lambda r: int(r[3]))] == list("123456")
    assert sorted(r[3] for r in read(RP.read_pages(spark, str(tmp_path), mode="cursor", first="s", most_pages=1))) == list("146")


@pytest.mark.parametrize("mode", ["numbered", "cursor"])
def test_a_stream_reads_the_same_rows_and_a_restart_repeats_none(spark, tmp_path, mode):
    pages, out, log = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        stream = RP.stream_pages(spark, str(pages), mode=mode, pages_per_task=2).writeStream.format("parquet").option("checkpointLocation", log).start(out)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    for n in (1, 2, 3):
        put(pages, "a", n, [{"n": n}], str(n + 1))
    run()
    assert spark.read.parquet(out).count() == 3
    for n in (4, 5):
        put(pages, "a", n, [{"n": n}], str(n + 1) if n == 4 else "2")  # the last cursor comes again
    put(pages, "b", 1, [{"n": 1}])
    run()
    assert read(spark.read.parquet(out)) == read(RP.read_pages(spark, str(pages), mode=mode)) and spark.read.parquet(out).count() == 6
    run()
    assert spark.read.parquet(out).count() == 6


def test_notices_are_dealt_out_and_patterns_looked_for_once(spark):
    from pyspark.sql import functions as F

    from recordmill.functions import contacts as C
    from recordmill.operators import notices as NO
    from recordmill.queries import services as Q

    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert Q.company_notices(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = spark.createDataFrame([("HRB 7, info@a.de, post@b.de", "b.de"), ("x", "b.de"), (None, None), ("info@a.de", None)], "t string, site string")
    for c in (NO._part(F.col("t"), r"(HRB \d+)"), C.company_email("t", "site")):
        plan = df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract(") + plan.count("regexp_extract_all(") == 1
    got = df.select(NO._part(F.col("t"), r"(HRB \d+)").alias("p"), C.company_email("t", "site").alias("e")).collect()
    assert [(r.p, r.e) for r in got] == [("HRB 7", "post@b.de"), (None, None), (None, None), (None, "info@a.de")]
