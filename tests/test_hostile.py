"""One table of null, repeated and text keys through the record operators."""

from pyspark.sql import functions as F

from recordmill.operators import documents as DOC
from recordmill.operators import ordered as O
from recordmill.operators import series as S
from recordmill.operators import state as ST
from recordmill.operators import transcripts as T

ROWS = [(None, 1, 5, "a"), (None, 2, None, "b"), ("g", 1, None, "a"), ("g", 1, None, "a"), ("g", 2, 3, None), ("h", 3, 9, "")]


def hostile(spark):
    return spark.createDataFrame(ROWS, "g string, page int, price int, mark string").withColumn("__last", F.lit("kept"))


def test_no_row_of_a_null_group_is_lost(spark):
    df = hostile(spark).drop("__last")
    assert O.cut_at_page(df, ["g"], "page", F.col("price") > 100).count() == len(ROWS)
    assert sorted(r["page"] for r in O.cut_at_page(df, ["g"], "page", F.col("price") == 5).where("g is null").collect()) == [1]
    assert O.stop_after_stale_pages(df, ["g"], "page", F.lit(True)).count() == len(ROWS)
    assert O.stop_after_stale_pages(df, ["g"], "page", F.lit(False), 1).count() == 4
    assert O.within_budget(df, ["g"], ["page"], F.col("price"), 8).count() == 5
    assert O.until_exhausted(df, ["g"], ["page"], F.col("price"), 5).where("g is null").count() == 1


def test_null_keys_are_known_again(spark):
    df = hostile(spark)
    assert ST.only_new(df, df, ["g", "page"]).count() == 0 and ST.only_new(df, df, ["g", "page"], "mark").count() == 0
    assert ST.only_new(df, df.where("g is not null"), ["g"]).count() == 2
    changes = ST.change_feed(df.dropDuplicates(["g", "page"]), df.dropDuplicates(["g", "page"]), ["g", "page"], "mark")
    assert {r["change"] for r in changes.collect()} == {"unchanged"} and changes.count() == 5
    assert ST.removed(df, df, ["g"], "page", 10).count() == 0 and ST.missing_wanted(df, df, ["g"]).count() == 0
    dated = df.withColumn("at", F.lit("2024-01-01").cast("date"))
    assert ST.watermark_monitor(dated, dated, ["g"], "page", "at").count() == 0
    assert ST.watermark_monitor(dated, dated.where("page > 2"), ["g"], "page", "at").count() == len(ROWS) - 1


def test_a_single_term_is_a_batch(spark):
    terms = spark.createDataFrame([("only",)], "t string")
    assert [tuple(r) for r in S.anchored_batches(terms, "t", "t").select("t", "batch").collect()] == [("only", 0)]
    assert S.anchored_batches(terms.limit(0), "t", "t").count() == 0


def test_documents_take_keys_of_any_type(spark):
    df = hostile(spark).withColumn("text", F.lit("one two.\n\nthree")).withColumn("html", F.lit("<p>x</p>")).withColumn("said", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), F.lit("hello").alias("text"))))
    for made in (DOC.chunk_documents(df, "g", "text"), DOC.page_lines(df, "g", "html"), T.chunk_transcripts(df, "g", "said")):
        assert made.count() == len(ROWS) and made.where("g is null").count() == 2 and made.schema["g"].dataType.simpleString() == "string"
    none = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in ("text", "html", "said")})
    assert DOC.chunk_documents(none, "g", "text").count() == 0 and DOC.page_lines(none, "g", "html").count() == len(ROWS) and T.chunk_transcripts(none, "g", "said").count() == 0


def test_text_behind_a_head_without_end(spark):
    assert DOC.page_of("<head><title>t</title>plain text<p>more")[0] == ["plain text", "more"]
    assert DOC.page_of("<head>\n <title>t</title>\n<style>p{}</style></head><p>more")[0] == ["more"]
