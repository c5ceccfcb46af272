"""Page items, channel feeds, match pages and filings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordmill.functions import page_items as PI
from recordmill.operators import channels as CH
from recordmill.operators import filings as FI
from recordmill.operators import matches as MA


def test_page_items_places():
    html = '<ul id=a><li class="x y">one<li class=x>t<b>w</b>o<ul><li>in</ul><br>end</ul><p>p<script>no</script></p></b><table><tr><td>1<td title=t>2<tr><td>3</table>'
    items = PI.Items("", {"x": PI.Pick("#a .x", which="all"), "own": PI.Pick(".x", own=True, which="last"), "cells": PI.Items("tr", {"t": PI.Pick("td", which="all"), "title": PI.Pick("td[title]", attr="title")}), "none": PI.Pick("i"), "apart": PI.Pick("li", which="all", outside="ul ul"), "p": PI.Pick("p")})
    (got,) = PI.items_of(html, items)
    assert got["x"] == ["one", "twoin\nend"] and got["own"] == "to\nend" and got["none"] is None and got["p"] == "p"
    assert got["cells"] == [{"t": ["1", "2"], "title": "t"}, {"t": ["3"], "title": None}]
    assert got["apart"] == ["one", "twoin\nend"]
    assert PI.items_of(None, PI.Items("li", {"t": PI.Pick()})) == []
    assert PI.items_of("<div>" * 20000 + "x", PI.Items("", {"t": PI.Pick("p")})) == [{"t": None}]


def _searched(posts, returned, seen, since, most, streak):
    """One search told post by post."""
    out, olds, knowns, found, once = [], 0, 0, 0, set()
    for post_id, at in posts:
        if post_id in once or post_id in returned:
            continue
        once.add(post_id)
        if at < since:
            olds += 1
            if olds >= streak:
                return out, "reachedSinceDate"
            continue
        olds = 0
        if post_id in seen:
            knowns += 1
            if knowns >= streak:
                return out, "reachedSeen"
            continue
        knowns = 0
        out.append(post_id)
        found += 1
        if found >= most:
            return out, "maxPosts"
    return out, None


@pytest.mark.parametrize("seed", range(3))
def test_search_posts_as_told_post_by_post(spark, seed):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    rows, want = [], {}
    seen, returned = set(), set()
    for c in range(40):
        ids = rng.sample(range(1000), rng.randrange(0, 40))
        ids.sort(reverse=True)
        listed, pages = [(i, day + dt.timedelta(days=i // 25 + rng.randrange(-5, 5))) for i in ids], []
        for k in range(0, len(listed), 5):
            page = listed[k : k + 5]
            if k and rng.random() < 0.5:
                page = [listed[k - 1], *page]  # a post that the page before had as well
            pages.append(page)
        seen |= {(str(c), i) for i in ids if rng.random() < 0.3}
        returned |= {(str(c), i) for i in ids if rng.random() < 0.1}
        rows += [(str(c), n, p, i, at) for n, page in enumerate(pages, 1) for p, (i, at) in enumerate(page)]
        want[str(c)] = _searched([x for page in pages for x in page], {i for k, i in returned if k == str(c)}, {i for k, i in seen if k == str(c)}, day + dt.timedelta(days=12), 8, 3)
    known = lambda s: spark.createDataFrame(sorted(s), "channel string, post_id long")
    got = CH.search_posts(spark.createDataFrame(rows, "channel string, page_no long, place int, post_id long, at timestamp"), known(returned), known(seen), F.lit("2024-01-13").cast("timestamp"), 8, 3).collect()
    for c, (fresh, ended) in want.items():
        mine = [r for r in got if r["channel"] == c]
        assert sorted((r["post_id"] for r in mine if r["fresh"]), reverse=True) == fresh
        assert next((r["ended"] for r in mine if r["ended"]), None) == ended


def test_closed_channels_and_messages(spark):
    message = lambda n, body, more="": f'<div class="tgme_widget_message {more}" data-post="Chan/{n}">{body}<a class="tgme_widget_message_date"><time datetime="2024-01-0{n}T00:00:00+00:00"></time></a></div>'
    preview = '<section class="tgme_channel_history">' + message(1, '<div class="tgme_widget_message_poll"><div class="tgme_widget_message_poll_question">Why?</div></div><a class="tgme_widget_message_forwarded_from_name" href="https://t.me/c/5">x</a>') + message(2, "", "service_message") + '<div class="tgme_widget_message" data-post="Chan/3">no time</div></section>'
    pages = [("a", None, 1, preview), ("b", None, 1, '<div class="tgme_page_title">B</div><div class="tgme_page_extra">9 subscribers</div>'), ("c", None, 1, None)]
    pages = spark.createDataFrame(pages, "channel string, keyword string, page_no long, html string")
    asked = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), (None, "?")], "channel string, input string")
    none = spark.createDataFrame([], "channel string, post_id long")
    rows, status, seen = CH.channel_feed(asked, pages, [], none, None, 10)
    got = {(r["type"], r["channel"]): r for r in rows.collect()}
    assert {c: r["error"] for (t, c), r in got.items() if t == "error"} == {"b": "previewDisabled", "c": "notFound", "d": "notFound", "?": "invalidInput"}
    assert got["post", "a"]["media"][0]["type"] == "poll" and got["post", "a"]["media"][0]["title"] == "Why?" and got["post", "a"]["forwarded_from"]["channel"] is None
    assert [tuple(r) for r in status.collect()] == [("a", 0, "exhausted")] and [tuple(r) for r in seen.collect()] == [("a", 1)]
    again = CH.channel_feed(asked, pages, [], seen, None, 10)[0]
    assert again.where("type = 'post'").count() == 0


def test_sets_and_summaries(spark):
    rows = [("7<sup>7</sup>-6, 6-3", 1, "completed", "7-6(7) 6-3"), ("6-6<sup> 5 </sup>, x, 3-6", 2, "completed", "6-6(5) 3-6"), ("2-1", 1, "retired", "2-1"), ("", None, "walkover", ""), (None, None, "walkover", ""), ("<b>10-8</b>", 1, "completed", "10-8"), ("1-6, 6-1", None, "completed", "1-6 6-1")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").withColumn("sets", MA.markup_sets("t")).withColumn("s", MA.summary(F.col("sets")))
    for r in df.collect():
        assert tuple(r["s"]) == rows[r["i"]][1:], r
    given = df.where("i = 3").select(MA.summary(F.col("sets"), F.lit(None).cast("int"), F.lit(1)).alias("s")).first()["s"]
    assert given["winner"] == 2 and given["status"] == "walkover"


def test_tours(spark):
    rows = [("Rome Challenger", False, None, "CHALLENGER"), ("Lyon", True, "/lyon-challenger/", "CHALLENGER"), ("ITF W15", True, None, "ITF_WOMEN"), ("Futures 2", False, None, "ITF_MEN"), ("Laver Cup", False, None, "OTHER_MEN"), ("Youthful", True, None, "WTA"), (None, False, None, "ATP"), ("Twitfield", False, None, "ATP")]
    df = spark.createDataFrame(rows, "name string, women boolean, url string, want string")
    assert df.where(MA.tour_of("name", "women", "url") != F.col("want")).count() == 0


def test_details_turned_broken_and_absent(spark):
    page = '<div id="center"><div class="boxBasic">01.02.2024, 9:05, Town, qualification, final, grass</div><table class="gDetail"><thead><tr><th class="plName"><a href="/player/bb/">Bo B</a></th><th class="plName"><a href="/player/aa/">Al A</a></th></tr></thead></table><div id="oddsMenu-1-data"><table class="result"><tr><td class="first">One</td><td class="k1"><div class="odds-in">1.20</div></td><td class="k2"><div class="odds-in">-<div class="odds-change-div"><table><tr><td class="bold">4.0</td></tr><tr><td class="bold">5.5</td></tr></table></div></div></td></tr><tr><td class="first">Two</td><td class="k1"></td><td class="k2"></td></tr></table></div></div>'
    details = MA.read_details(spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "k int, html string"))
    read = {r["k"]: r for r in details.collect()}
    assert read[2]["broken"] and read[3]["broken"] and not read[1]["broken"]
    assert str(read[1]["date"]) == "2024-02-01" and read[1]["time"] == "9:05" and read[1]["surface"] == "grass"
    matches = spark.createDataFrame([(1, "aa", "bb", "A.", "B.", 1, None), (2, "cc", "dd", "C.", "D.", 2, "clay"), (4, "ee", None, "E.", None, None, None)], "k int, slug_a string, slug_b string, name_a string, name_b string, winner int, surface string")
    got = {r["k"]: r for r in MA.with_details(matches, details, "k").collect()}
    assert (got[1]["name_a"], got[1]["name_b"], got[1]["winner_name"], got[1]["surface"]) == ("Al A", "Bo B", "Al A", "grass")
    assert [tuple(o) for o in got[1]["odds"]] == [("One", None, 1.2, 5.5, None)]
    assert got[2]["winner_name"] == "D." and got[2]["odds"] == [] and got[2]["surface"] == "clay" and got[4]["winner_name"] is None


def test_filing_fields_and_run(spark):
    xml = "<x:edgarSubmission xmlns:x='u'><submissionType>D/A</submissionType><primaryIssuer><yearOfInc><overFiveYears>true</overFiveYears></yearOfInc></primaryIssuer><offeringData><offeringSalesAmounts><isIndefinite>TRUE</isIndefinite></offeringSalesAmounts><investors><hasNonAccreditedInvestors>false</hasNonAccreditedInvestors></investors><salesCompensationList><recipient><recipientName>None</recipientName></recipient><recipient><associatedBDName>Deal</associatedBDName></recipient></salesCompensationList></offeringData></x:edgarSubmission>"
    day = dt.date(2024, 1, 1)
    listed = spark.createDataFrame([("a", "D", day, 1), ("b", "D", day, 0), ("c", "D", day + dt.timedelta(1), 5), ("c", "D", day + dt.timedelta(1), 7), ("d", "D", day, 3), ("e", "D", dt.date(2020, 1, 1), 0), ("f", "D", day, 2), ("g", "D", day, 4)], "accession string, form_type string, filed date, place long")
    documents = spark.createDataFrame([("a", xml), ("b", "<edgarSubmission><a>"), ("c", xml), ("d", xml), ("g", xml)], "accession string, xml string")
    seen = spark.createDataFrame([("g",)], "accession string")
    run = {r["accession"]: r for r in FI.filings_run(listed, documents, seen, ("2024-01-01", "2024-12-31"), FI.wanted_filing("amendment", least=1e12), 2).collect()}
    assert {k: (r["outcome"], r["nth"]) for k, r in run.items()} == {"c": ("emitted", 1), "a": ("emitted", 2), "b": ("failed", None), "f": ("notReached", None), "d": ("notReached", None), "g": ("notReached", None)}
    a = run["a"]
    assert a["amendment"] and a["within_five_years"] is False and a["indefinite"] and a["not_accredited"] == 0 and a["amount"] is None and [s["dealer"] for s in a["sellers"]] == ["Deal"] and a["people"] == [] and a["address"] is None
    amounts = spark.createDataFrame([(False, None), (False, 5.0), (True, None)], "indefinite boolean, amount double").withColumns({"amendment": F.lit(False), "industry": F.lit("REITs and finance"), "industry_category": FI.category_of_industry(F.lit("REITs and finance"))})
    assert amounts.where(FI.wanted_filing("new", ["REAL estate"], least=1, most=9)).count() == 1 and amounts.where(FI.wanted_filing()).count() == 3
    none = FI.filings_run(listed.limit(0), documents.limit(0), seen.limit(0), ("2024-01-01", "2024-12-31"), FI.wanted_filing(), 2)
    assert none.count() == 0


def test_pages_are_read_once_by_all_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    from recordmill.functions.page_items import Items, Pick, items_of, page_items
    from recordmill.operators import matches as MA
    from recordmill.queries import pages as Q

    # a filter on what was read stays behind the reading; before, it took each page apart a second time
    read = spark.createDataFrame([("<p>a</p>",), ("<b>c</b>",)], "html string").withColumn("x", page_items(F.col("html"), Items("", {"p": Pick("p")})))
    kept = read.where(F.col("x")[0]["p"].isNotNull())
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("found(") == 1 and [r.html for r in kept.collect()] == ["<p>a</p>"]
    # narrow rows are dealt out ahead of the reading, whatever files they come from
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        _, details = Q._match_pages(spark, "/root/testdata/sf0.001")
        assert MA.read_details(details).rdd.getNumPartitions() == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # plain markup by one pattern, the rest by the parser: the same rows
    items = Items("li", {"text": Pick(), "ref": Pick("a", attr="href"), "last": Pick(".k, b", which="last"), "all": Pick("b", which="all", outside="i")})
    plain = "<ul><li class='k'>a &amp; <a href=\"x?a=1&amp;b=2\">y</a><br/><b>1</b><i><b>2</b></i><li>z<b class=k>3</b></ul>"
    assert items_of(plain, items) == items_of("<!-- no plain markup -->" + plain, items) == [
        {"text": "a & y\n12", "ref": "x?a=1&b=2", "last": "2", "all": ["1"]},
        {"text": "z3", "ref": None, "last": "3", "all": ["3"]},
    ]
    for odd in ("<li><a href=x/>1</li>", "<li>a < b<script><b>x</b></script>", "<li a='1'b=2>x", "<LI>x</LI >"):
        assert items_of(odd, items) == items_of("<!---->" + odd, items)


def test_posts_and_filings_are_dealt_out(spark, monkeypatch):
    from recordmill.queries import pages as Q

    spark.conf.set("spark.sql.shuffle.partitions", "5")
    given = {}
    monkeypatch.setattr(Q.CH, "channel_feed", lambda asked, pages, *rest: given.update(pages=pages))
    monkeypatch.setattr(Q.FI, "filings_run", lambda listed, documents, *rest: given.update(documents=documents) or listed.limit(0))
    try:
        Q._channel_run(spark, "/root/testdata/sf0.001")
        with pytest.raises(Exception):
            Q.filings_feed(spark, "/root/testdata/sf0.001")
        assert given["documents"].rdd.getNumPartitions() == 5
        posts = given["pages"].where("page_no > 1")
        assert posts.count() > 0 and posts._jdf.queryExecution().optimizedPlan().toString().count("Repartition 5, true") >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plain_pages_are_read_without_their_tree(monkeypatch):
    rng = random.Random(4)
    places = ["", "p", "li", ".k", "#m", "tr td", "div .x, li", "[href]", "div div", "ul li a"]
    bits = ["<p>", "</p>", "<div class='x k'>", "</div>", "<ul>", "</ul>", "<li id=m>", "<a href='q?a&amp;b'>", "</a>", "<br>", "<sup>", "</sup>", "<table>", "<tr>", "<td class=k>", "</table>", "<b/>", "one", " \n", "\xa0&amp;", "2 > 1"]

    def some(depth):
        pick = lambda: PI.Pick(rng.choice(places), attr=rng.choice([None, None, "href"]), which=rng.choice(["first", "last", "all"]), own=rng.random() < 0.2, outside=rng.choice(["", "", *places]), mark=rng.choice(["", "sup"]))
        return PI.Items(rng.choice(places), {"a": pick(), "b": pick(), **({"sub": some(depth - 1)} if depth else {})}, outside=rng.choice(["", "", *places]))

    cases = [(some(rng.randrange(3)), ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(4)]) for _ in range(100)]
    cases.append((MA.DETAIL, ["<div id=center><p class=boxBasic>a<sup>1</sup><table class=gDetail>" + "<tr><th>x<td class=tr>1" * n for n in (0, 3)]))
    want = [[PI.tree_items(page, items) for page in pages] for items, pages in cases]
    monkeypatch.setattr(PI, "_Tree", None)  # before, every page had a tree made of it
    for (items, pages), told in zip(cases, want, strict=True):
        reader = PI.Reader(items)
        for _ in range(2):  # the second time by layouts that are known
            assert [PI._as_dicts(PI.rows_of(page, reader), items) for page in pages] == told
    reader = PI.Reader(PI.Items("li", {"t": PI.Pick(), "href": PI.Pick("a", attr="href")}))
    reader.LAYOUTS = reader.TAGS = reader.STATES = 2  # what is kept is bounded, and what was given up is worked out again
    for n in range(30):
        assert reader.read("<ul>" + "".join(f"<li><a href={i}>{i}" for i in range(n % 7))) == [[str(i), str(i)] for i in range(n % 7)]
        assert len(reader.layouts) <= 2
    assert PI.Reader(PI.Items("li")).read("<li>a<!-- c -->") is None and PI.Reader(PI.Items("li")).read("a < b") is None


def test_marked_sets_without_and_beyond_numbers(spark):
    df = spark.createDataFrame([("7-6^4, 6^2-7^9 , 6-0\n, 1-x, 99999999999-6^3, 6^99999999999-7^5",)], "t string")
    got = df.select(MA.marked_sets("t").alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [(7, 6, 4), (6, 7, 2), (6, 0, None), (None, 6, 3), (6, 7, 5)]
    x = spark.createDataFrame([(v,) for v in ("1.5", "NaN", "inf", "-Infinity", "x", None, "-2")], "v string").select(MA.number("v").alias("n")).collect()
    assert [r.n for r in x] == [1.5, None, None, None, None, None, -2.0]
