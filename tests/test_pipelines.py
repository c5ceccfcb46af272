"""Whole pipelines, transcripts and Markdown on small values."""

from pyspark.sql import functions as F

from recordmill.functions import markdown as M
from recordmill.operators import transcripts as TR
from recordmill.plans import pipelines as P
from recordmill.sources.adapters import Adapter


def test_registrations_take_turns(spark):
    a = spark.createDataFrame([(1, "x", "LLC"), (2, "y", "LLC"), (3, "z", "Trust")], "id int, name string, kind string")
    b = spark.createDataFrame([(7, "q", "LLC")], "no int, title string, kind string").withColumnRenamed("no", "id").withColumnRenamed("title", "name")
    adapters = [Adapter("a", lambda: a, {"kind": "kind"}, lambda d: d), Adapter("b", lambda: b, {"kind": "kind"}, lambda d: d)]
    got = P.registrations(adapters, {}, ["id"], ["id"], F.when(F.col("kind") == "LLC", "company").otherwise("other"), ["company"], 3)
    assert [(r["source"], r["id"]) for r in got.orderBy("turn", "source").collect()] == [("a", 1), ("b", 7), ("a", 2)]


def test_monitored_reviews(spark):
    rows = lambda xs: spark.createDataFrame(xs, "g string, k int, d string, stars int").withColumn("d", F.col("d").cast("timestamp"))
    previous, current = rows([("a", 1, "2024-01-10", 5)]), rows([("a", 1, "2024-01-10", 5), ("a", 2, "2024-01-05", 4), ("a", 3, "2024-01-01", 4), ("a", 4, "2024-01-12", 1), ("b", 5, "2020-01-01", 5)])
    emitted, marks = P.monitored_reviews(current, previous, ["g"], "k", "d", F.col("stars") >= 3, 10)
    assert sorted(r["k"] for r in emitted.collect()) == [2, 5]
    assert {r["g"]: str(r["watermark"])[:10] for r in marks.collect()} == {"a": "2024-01-10", "b": "2020-01-01"}


def test_tracked_ranks(spark):
    now, then = spark.createDataFrame([("l", "a", 1)], "l string, i string, rank int"), spark.createDataFrame([("l", "a", 3)], "l string, i string, rank int")
    wanted = spark.createDataFrame([("l", "a"), ("l", "z")], "l string, i string")
    assert sorted((r["i"], r["change"]) for r in P.tracked_ranks(now, then, wanted, ["l"], "i", 10, 1).collect()) == [("a", "up"), ("z", "notRanked")]


def test_radar_and_boards(spark):
    listing = spark.createDataFrame([(1, "2024-02-01", None), (2, "2024-02-02", 5.0), (3, "2025-01-01", 900.0)], "k int, e string, v double")
    detail = spark.createDataFrame([(1, 700.0)], "k int, v double")
    assert [r["k"] for r in P.radar(listing, detail, "k", "e", ("2024-01-01", "2024-12-31"), 100.0, ["v"], ["v"], listing.limit(0)).collect()] == [1]
    boards = [spark.createDataFrame([("x", 1, 4), ("x", 2, None)], "board string, seq int, rank int"), spark.createDataFrame([("y", 1), ("y", 2), ("y", 3)], "board string, seq int")]
    assert sorted((r["board"], r["rank"]) for r in P.hot_boards(boards, 2).collect()) == [("x", 2), ("x", 4), ("y", 1), ("y", 2)]
    pages = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("t", 1, 0)], "site string, p int, f int")
    assert sorted((r["site"], r["p"]) for r in P.best_page(pages, "site", F.col("f"), ["p"]).collect()) == [("s", 2), ("t", 1)]


def test_transcript_chunks(spark):
    segments = [(float(i), i + 1.0, f"segment number {i}") for i in range(10)] + [(10.0, 20.0, "word " * 40)]
    chunks = TR.pack_segments(segments, 60, 20)
    assert max(len(c[2]) for c in chunks) <= 60 and chunks[0][0] == 0.0 and chunks[-1][1] <= 20.0
    assert all(f"segment number {i}" in " ".join(c[2] for c in chunks) for i in range(10)) and "segment number 2" in chunks[1][2]
    df = spark.createDataFrame([(1, [(0.0, 1.0, "a b")]), (2, None)], "k long, s array<struct<start:double,end:double,text:string>>")
    assert [(r["k"], r["text"]) for r in TR.chunk_transcripts(df, "k", "s").collect()] == [(1, "a b")]


def test_track_choice(spark):
    df = spark.createDataFrame([([("en", True), ("en-US", False), ("de", False)],)], "t array<struct<language:string,automatic:boolean>>")
    pick = lambda ls: df.select(TR.best_track(F.col("t"), ls).alias("b")).first()["b"]
    assert pick(["en"])["language"] == "en" and pick(["fr", "de"])["language"] == "de" and pick(["fr"]) is None
    assert spark.createDataFrame([(["html", "srt"],)], "k array<string>").select(TR.best_format(F.col("k")).alias("f")).first()["f"] == "srt"


def test_markdown(spark):
    md = "# A\ntext **b** [l](u)\n| x | y |\n| --- | --- |\n| 1 | 2 |\nend  \n\n\n\n## B\nmore"
    r = spark.createDataFrame([(md,)], "m string").select(M.normalise("m").alias("n"), M.to_plain("m").alias("p"), M.sections("m").alias("s"), M.table_rows("m").alias("t")).first()
    assert "[l](u)\n\n| x" in r["n"] and "| 1 | 2 |\n\nend" in r["n"] and "\n\n\n" not in r["n"]
    assert "text b l" in r["p"] and "1\t2" in r["p"] and "---" not in r["p"]
    assert len(r["s"]) == 2 and r["t"] == [["x", "y"], ["1", "2"]]


def test_long_tables_are_cut_between_rows():
    from recordmill.operators.documents import chunks_of

    table = "| a | b |\n| - | - |\n" + "\n".join(f"| row {i} | value |" for i in range(40))
    chunks = chunks_of("before\n\n" + table + "\n\nafter", 200, 0)
    assert max(map(len, chunks)) <= 200 and sum(c.count("| a | b |\n| - | - |\n") for c in chunks) == len([c for c in chunks if "| row" in c]) > 3
    assert all(sum(f"| row {i} |" in c for c in chunks) == 1 for i in range(40))
    assert max(map(len, chunks_of("| h |\n| - |\n| " + "x" * 500 + " |", 100, 0))) <= 100
