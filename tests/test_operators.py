"""Operators that no SQL query covers, and their edge cases."""

import re

from pyspark.sql import functions as F

from recordmill.operators import documents as DOC
from recordmill.operators import enrich as E
from recordmill.operators import ordered as O
from recordmill.operators import state as ST
from recordmill.plans.jobs import Job
from recordmill.sources import adapters as A
from recordmill.streaming import feeds as STREAM


def feed(spark, rows):
    return spark.createDataFrame([(g, i, float(v)) for g, i, v in rows], "g string, seq int, v double")


def test_streak_stop_resets(spark):
    df = feed(spark, [("a", i, v) for i, v in enumerate([9, 1, 1, 9, 1, 1, 1, 9])])
    assert [r["seq"] for r in O.stop_after_streak(df, ["g"], ["seq"], F.col("v") < 5, 3).orderBy("seq").collect()] == [0, 3]
    assert O.stop_after_streak(df.limit(0), ["g"], ["seq"], F.col("v") < 5, 3).count() == 0


def test_fair_share_rolls_on(spark):
    df = feed(spark, [("a", i, 0) for i in range(2)] + [("b", i, 0) for i in range(10)] + [("c", i, 0) for i in range(10)])
    got = {r["g"]: r["n"] for r in O.fair_share(df, "g", ["seq"], 12).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 5, "c": 5}


def test_even_sample_holds_ends(spark):
    df = feed(spark, [("a", i, 0) for i in range(11)] + [("b", 1, 0)])
    assert sorted((r["g"], r["seq"]) for r in O.even_sample(df, ["g"], ["seq"], 3).collect()) == [("a", 0), ("a", 5), ("a", 10), ("b", 1)]


def test_rank_changes_and_jitter(spark):
    now = spark.createDataFrame([("l", "a", 1), ("l", "b", 2), ("l", "c", 3)], "l string, i string, r int")
    then = spark.createDataFrame([("l", "a", 2), ("l", "c", 4), ("l", "d", 1)], "l string, i string, r int")
    got = {r["i"]: r["change"] for r in ST.rank_changes(now, then, ["l"], "i", "r", visible=3).collect()}
    assert got == {"a": "up", "b": "new", "c": "new", "d": "dropped"}
    assert {r["i"]: r["change"] for r in ST.rank_changes(now, then, ["l"], "i", "r", visible=3, least=2).collect()}["c"] == "same"


def test_change_feed_incomplete_tells_no_removal(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, f string"), spark.createDataFrame([(2, None), (3, "z")], "k int, f string")
    assert {r["k"]: r["change"] for r in ST.change_feed(a, b, ["k"], "f").collect()} == {1: "new", 2: "unchanged", 3: "removed"}
    assert ST.change_feed(a, b, ["k"], "f", complete=False).count() == 2


def test_dated_seen_set(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2022-01-01")], "k int, s string").select("k", F.col("s").cast("date").alias("d"))
    assert [r["k"] for r in ST.prune_dated(df, "d", 400).collect()] == [1]


def test_latest_at_ties_count(spark):
    rows, marks = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "g string, t int"), spark.createDataFrame([("a", 5, "v5"), ("a", 3, "v3")], "g string, s int, v string")
    assert {(r["g"], r["t"]): r["v"] for r in E.latest_at(rows, marks, ["g"], "t", "s", "v").collect()} == {("a", 5): "v5", ("a", 1): None, ("b", 5): None}


def test_learned_name_and_lookup(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "n"), (2, 1, None)], "k int, s int, n string")
    assert sorted((r["k"], r["n"] or "") for r in E.learned_name(df, "k", "n", ["s"]).collect()) == [(1, "n"), (1, "n"), (2, "")]
    a, b = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, x string")
    assert sorted((r["k"], r["x"]) for r in E.lookup(df.select("k").distinct(), "k", a, "x", b).collect()) == [(1, "a"), (2, "c")]


def test_chunks_keep_their_size_and_all_words():
    text = "\n\n".join(" ".join(f"w{i}.{j}" for j in range(i * 7 % 90)) for i in range(40)) + "\n\n" + "x" * 950
    chunks = DOC.chunks_of(text, 400, 50)
    assert max(map(len, chunks)) <= 400
    have = set(re.findall(r"w\d+\.\d+", " ".join(chunks)))
    assert have == set(re.findall(r"w\d+\.\d+", text)) and sum(c.count("x") for c in chunks) >= 950
    assert DOC.chunks_of(None) == [] and DOC.chunks_of("  ") == []


def test_page_lines():
    lines, links = DOC.page_of('<html><head><title>t</title></head><body><p>a <b>b</b></p><script>x()</script><a href="/y">c</a><li>d</body>')
    assert lines == ["a b", "c", "d"] and links == ["/y"]


def test_captions_round_trip(spark):
    df = spark.createDataFrame([([(0.0, 1.5, "hi", "A"), (2.0, 3661.25, "there", "B")],)], "s array<struct<start:double,end:double,text:string,speaker:string>>")
    row = df.select(DOC.cues(F.col("s")).alias("srt"), DOC.cues(F.col("s"), False, ".").alias("vtt")).first()
    assert row["srt"].startswith("1\n00:00:00,000 --> 00:00:01,500\nhi\n") and "<v B>there" in row["vtt"]
    for kind in ("srt", "vtt"):
        back = spark.createDataFrame([(row[kind],)], "t string").select(DOC.parse_cues(F.col("t")).alias("c")).first()["c"]
        assert [tuple(x) for x in back] == [(0.0, 1.5, "hi"), (2.0, 3661.25, "there")]


def test_sentences(spark):
    words = [(0.0, 0.4, "Hello", "A"), (0.5, 0.9, "world.", "A"), (1.0, 1.2, "Next", "A"), (1.3, 1.5, "turn", "B"), (9.0, 9.2, "late", "B")]
    df = spark.createDataFrame([(words,)], "w array<struct<start:double,end:double,text:string,speaker:string>>")
    assert [x["text"] for x in df.select(DOC.sentences_of(F.col("w")).alias("s")).first()["s"]] == ["Hello world.", "Next", "turn", "late"]


def test_job_runs_the_whole_cycle(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7), (3, "a", 8), (4, "a", 9)], "k int, t string, s int")
    job = Job(key=["k"], order=["s"], keep=F.col("t") == "a", most=1)
    emitted, seen = job.run(df, spark.createDataFrame([(3, 0)], "k int, s int"))
    assert [r["k"] for r in emitted.collect()] == [1] and {r["k"] for r in seen.collect()} == {1, 3}


def test_keyset_pages_cover_all(spark):
    df, after, got = spark.range(10).select((F.col("id") % 3).alias("a"), F.col("id").alias("b")), None, []
    while page := A.keyset_page(df, ["a", "b"], after, 4).collect():
        got += [(r["a"], r["b"]) for r in page]
        after = got[-1]
    assert got == sorted(got) and len(got) == 10


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 01:00:00"), (1, "b", "2024-01-02 00:00:00"), (2, "a", "2024-01-02 05:00:00")], "k long, f string, t string")
    df.select("k", "f", F.col("t").cast("timestamp").alias("ts")).coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = lambda: STREAM.read_stream(spark, str(tmp_path / "in"), "k long, f string, ts timestamp")
    assert STREAM.run_now(STREAM.unseen(stream(), ["k", "f"], "ts"), "unseen", str(tmp_path / "c1")).count() == 3
    changes = STREAM.run_now(STREAM.changes(stream(), "k", "f", "ts"), "changes", str(tmp_path / "c2"))
    assert sorted(tuple(r) for r in changes.collect()) == [(1, "a", "new"), (1, "b", "updated"), (2, "a", "new")]
    counts = STREAM.run_now(STREAM.window_counts(stream(), "ts", "1 day", ["k"]), "counts", str(tmp_path / "c3"), "complete")
    assert sorted(r["n"] for r in counts.collect()) == [1, 1, 2]


def test_merges_place_every_row(spark):
    from recordmill.queries import feeds

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/events.parquet").count()
    assert n > 500
    assert sorted(r["place"] for r in feeds.QUERIES["kway_merge_all"](spark, d).collect()) == list(range(1, n + 1))
    assert feeds.QUERIES["round_robin_all"](spark, d).select("turn", "place").distinct().count() == n


def test_places_with_nulls_and_ties(spark):
    from recordmill.operators import ordered

    rows = [("a", 1, 5), ("a", None, 4), ("a", 2, 3), (None, 2, 2), ("b", 2, 1), ("a", 1, 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "s string, day int, id int")
    got = {r["id"]: r["p"] for r in ordered.placed(df, ["s"], [(F.col("day"), True)], ["id"], "p").collect()}
    assert got == {3: 1, 5: 2, 6: 3, 4: 4, 2: 1, 7: 2, 1: 1}
    got = {r["id"]: r["p"] for r in ordered.placed(df, [], [(F.col("day"), True), (F.col("s"), False)], ["id"], "p").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [3, 1, 2, 5, 6, 4, 7] and sorted(got.values()) == list(range(1, 8))


def test_shares_and_samples_of_odd_groups(spark):
    from recordmill.operators import ordered

    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), (None, 4)], "s string, k int")
    assert sorted(r["k"] for r in ordered.fair_share(df, "s", ["k"], 3).collect()) == [1, 2, 4]
    numbers = df.withColumn("s", F.when(F.col("s") == "a", 7))
    assert sorted(r["k"] for r in ordered.fair_share(numbers, "s", ["k"], 10).collect()) == [1, 2, 3, 4]
    assert [r["k"] for r in ordered.even_sample(df, ["s"], ["k"], 1).orderBy("k").collect()] == [1, 2]
    links = spark.createDataFrame([("p", "a", 2, 1), ("p", "a", 5, 2), ("p", "b", 5, 3), ("p", "c", 0, 4), ("p", "d", 1, 5)], "page string, link string, score int, i int")
    assert [r["link"] for r in ordered.best_links(links, ["page"], "link", "score", ["i"], 2).orderBy("i").collect()] == ["a", "b"]
    seasons = spark.createDataFrame([(1, 2024, "Fall"), (2, 2025, "winter"), (3, 2025, "Summer"), (4, None, None), (5, 2025, "?")], "k int, y int, t string")
    assert [r["k"] for r in seasons.orderBy(*ordered.season_order("y", "t", ["k"])).collect()] == [3, 2, 5, 1, 4]


def test_pages_without_closed_heads():
    from recordmill.operators.documents import page_of

    assert page_of("<html><head><title>t</title><meta charset=x><body><p>one<p>two <a href='/x'>link</a>")[0] == ["one", "two link"]
    assert page_of("<head><title>t</title></head><body>one<svg><g>no</svg> two")[0] == ["one two"]


def test_state_keys_and_second_cycles(spark):
    assert ST.state_key({"b": [2, 1], "a": "x", "max": 5}, ("max",)) == ST.state_key({"a": "x", "b": [1, 2], "max": 9, "c": None}, ("max",)) != ST.state_key({"a": "y", "b": [1, 2]})
    job = Job(key=["k"], order=["s"], mark="f", remembered=2)
    rows = lambda xs: spark.createDataFrame(xs, "k int, s int, f string")
    _, seen = job.run(rows([(1, 1, "x"), (2, 2, "x")]), rows([]))
    emitted, seen = job.run(rows([(1, 5, "x"), (2, 6, "y"), (3, 4, "x")]), seen)
    assert sorted(r["k"] for r in emitted.collect()) == [2, 3]
    assert {(r["k"], r["f"]) for r in seen.collect()} == {(1, "x"), (2, "y")}  # the returning key stays recent, 3 is older


def test_rolling_sums_run_from_both_ends_of_buckets(spark):
    from datetime import datetime, timedelta

    from recordmill.operators import series as S

    start = datetime(2024, 1, 1)
    hours = [0, 0, 1, 5, 5.5, 6, 6, 11.9, 12, 13, 30, None, None]
    rows = [(g, i, None if h is None else start + timedelta(hours=h), None if i % 4 == 3 else i + 1) for g in ("a", None) for i, h in enumerate(hours)]
    got = S.rolling(spark.createDataFrame(rows, "g string, i int, at timestamp, v long"), ["g"], "at", 6, F.col("v"), "s")
    near = lambda g, t: [w for h, _, u, w in rows if h == g and u and w is not None and t - timedelta(hours=6) <= u <= t]
    want = {(g, i): (sum(near(g, t)) if t and near(g, t) else None) for g, i, t, _ in rows}
    assert got.columns == ["g", "i", "at", "v", "s"]
    assert {(r.g, r.i): r.s for r in got.collect()} == want and got.count() == len(rows)
    # a frame that moves at both ends is summed anew for every row
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_private_addresses_work_their_number_out_once(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("11.0.0.1",), ("9.256.0.0",), ("172.31.255.255",), ("172.32.0.0",), ("::ffff:192.168.1.1",), ("fd00::1",), ("x",), (None,)], "ip string")
    got = df.select("ip", A.private_ip(F.col("ip")).alias("p"))
    assert [r.p for r in got.collect()] == [True, False, True, True, False, True, True, False, None]
    assert got._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
