"""Functions that no query covers."""

import pytest
from pyspark.sql import functions as F

from recordmill.functions import listings as L
from recordmill.functions import numbers as N
from recordmill.functions import planning as PL
from recordmill.functions import trees as TR
from recordmill.operators import enrich as E
from recordmill.operators import records as R
from recordmill.operators import state as ST
from recordmill.sources import adapters as A


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: L.disclosed_pay(F.lit(4999), F.lit("INR")), None),
        (lambda: L.disclosed_pay(F.lit(5000), F.lit("INR")), 5000),
        (lambda: L.disclosed_pay(F.lit(100), F.lit("USD")), 100),
        (lambda: L.disclosed_pay(F.lit(None).cast("int"), F.lit("USD")), None),
        (lambda: L.size_tier(F.lit(3), [(2, "small"), (8, "medium")], "large"), "medium"),
        (lambda: L.size_tier(F.lit(9), [(8, "medium"), (2, "small")], "large"), "large"),
        (lambda: L.decode_factor(F.lit(3840), F.lit(2160)), 4),
        (lambda: L.decode_factor(F.lit(640), F.lit(360)), 1),
        (lambda: L.target_bitrate(F.lit(10), F.lit(60)), 1237),
        (lambda: L.target_bitrate(F.lit(1), F.lit(6000)), 100),
        (lambda: N.percent_saved(F.lit(200), F.lit(150)), 25.0),
        (lambda: N.percent_saved(F.lit(100), F.lit(130)), -30.0),
        (lambda: L.remote(F.array(F.lit("Oslo"), F.lit("Work From Home"))), True),
        (lambda: L.remote(F.array(F.lit("Oslo"))), False),
        (lambda: TR.tolerant(F.lit('{"a": 1, "b": "x"}'), "a int, b int")["a"], 1),
        (lambda: TR.tolerant(F.lit("no json"), "a int")["a"], None),
        (lambda: N.pay_period(F.lit("12 LPA p.a.")), "year"),
        (lambda: N.pay_period(F.lit("$30 - $40 / hr")), "hour"),
        (lambda: N.pay_period(F.lit("paid daily")), "day"),
        (lambda: N.pay_period(F.lit("a hourglass, per person")), None),
        (lambda: N.pay_period(F.lit(None).cast("string")), None),
        (lambda: N.affordable(F.lit(10), F.lit(3), F.lit(20)), 6),
        (lambda: N.affordable(F.lit(10), F.lit(0), F.lit(0)), 10),
        (lambda: N.affordable(F.lit(10), F.lit(3), F.lit(-1)), 0),
        (lambda: A.private_ip(F.lit("::1")), True),
        (lambda: A.private_ip(F.lit("FD12:3456::1")), True),
        (lambda: A.private_ip(F.lit("fe80::1")), True),
        (lambda: A.private_ip(F.lit("2001:db8::1")), False),
        (lambda: A.private_ip(F.lit("::ffff:10.1.2.3")), True),
        (lambda: A.private_ip(F.lit("::ffff:8.8.8.8")), False),
        (lambda: A.private_ip(F.lit("192.168.0.9")), True),
        (lambda: A.private_ip(F.lit("8.8.8.8")), False),
        (lambda: A.private_ip(F.lit("host")), False),
    ],
)
def test_column(one, column, want):
    assert one.select(column()).first()[0] == want


def test_star_filters():
    assert PL.star_filters([1, 5], 50, 100) == [[1, 5]] and PL.star_filters([1, 5], 101, 100) == [[1], [5]]


def test_content_too_large_for_a_row(spark):
    df = spark.createDataFrame([("short",), ("ä" * 60,), (None,)], "c string")
    assert [tuple(r) for r in df.select(*R.inline_limit("c", 100, 10)).collect()] == [("short", False), ("ä" * 10, True), (None, None)]


def test_a_run_failed_only_if_every_group_did(spark):
    stats = lambda *ok: spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(ok)], "g string, ok long")
    assert ST.all_failed(stats(0, 0), "ok").first()[0] and not ST.all_failed(stats(0, 3), "ok").first()[0]


def test_crawl_delay_of_the_own_group_first(spark):
    groups = spark.createDataFrame([("a", "*", 9), ("a", "Bot", 2), ("a", "bot", 4), ("b", "*", 3), ("b", "other", 8), ("c", "other", 1)], "host string, agent string, delay long")
    assert {r["host"]: r["delay"] for r in E.crawl_delay(groups, "BOT").collect()} == {"a": 4, "b": 3, "c": None}
