"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  Documents are
grouped by their vote pattern; there are at most 3 ** len(RULES) patterns, so the
pattern counts, which hold all that the estimation needs, are the only thing that
reaches the driver.  Expectation-maximisation over all documents' patterns estimates
how each rule votes on good and on bad documents (and the share of good ones); the
posterior probability of good is a sum of log ratios per rule, applied as a column.

Defined results: a null or empty text has counts of 0 and fails the base rules;
texts are read whole; equal texts get equal posteriors; an empty table gives an
empty result; further columns stay, but for those that have the name of a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, table

#: Parameters: passes of expectation-maximisation, prior strength of each vote, share of good documents to begin with.
PASSES, SMOOTHING, GOOD_SHARE = 25, 1.0, 0.8
#: Agreement with the majority that a rule is given to begin with.
START_ACCURACY = 0.8
STOPWORDS = """the of and to in is that for with was on as be by this are from at it or le la de les des et en un une du
que pour dans est der die das und ein eine mit von zu den ist nicht auf el los las del y por con se para""".split()


#: Columns that the operator returns beside those of its input.
COUNTS = ("n_words", "n_stopwords", "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words", "quality", "base_failed")


def _votes() -> list[tuple[str, Column]]:
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(x: Column, bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    length, stop = F.col("word_chars") / n, F.col("n_stopwords") / n
    shout, caps = F.col("n_shouts") / n, F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))
    variety = F.col("n_distinct") / n
    long_enough = F.col("n_words") >= 30
    return [
        ("symbols", vote(symbols, symbols > 0.1, symbols < 0.02)),
        ("repeats", vote(repeats, repeats > 0.3, repeats < 0.15)),
        ("lines", vote(lines, (lines > 0.3) & (F.col("n_dup_lines") > 2), lines < 0.1)),
        ("length", vote(length, (length < 2.5) | (length > 11), (length > 3) & (length < 9))),
        ("stopwords", vote(stop, (stop < 0.02) & long_enough, stop > 0.08)),
        ("shouting", vote(shout, (shout > 0.1) | (caps > 0.3), (shout < 0.02) & (caps < 0.15))),
        ("variety", vote(variety, (variety < 0.12) & long_enough, variety > 0.25)),
    ]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with the counts that rules and contract need (columns of df that have their names are replaced)."""
    keep = [c for c in df.columns if c != text and c not in COUNTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = df.select(*[F.col(f"`{c}`") for c in keep], body.alias("__text"), F.filter(F.split(body, SPACES), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    b = a.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__words").cast("long").alias("n_words"),
        F.array_join("__words", "").alias("__joined"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
        lines.alias("__lines"),
        F.size(F.filter("__words", lambda w: w.isin(STOPWORDS))).cast("long").alias("n_stopwords"),
    )
    n_grams = F.greatest(F.size("__h") - 2, F.lit(0))
    grams = F.slice(F.transform("__h", lambda h, i: F.xxhash64(h, F.get("__h", i + 1), F.get("__h", i + 2))), F.lit(1), n_grams)
    c = b.select(
        *[F.col(f"`{c}`") for c in [*keep, "n_words", "n_stopwords"]],
        F.char_length("__joined").cast("long").alias("word_chars"),
        F.regexp_count("__joined", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__joined", F.lit(r"!")).cast("long").alias("n_shouts"),
        F.regexp_count("__joined", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__h")).cast("long").alias("n_distinct"),
        grams.alias("__grams"),
    )
    ordered = c.withColumn("__sorted", F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.sort_array("__grams")).otherwise(F.array().cast("array<bigint>")))
    twice = ordered.withColumn("__twice", F.array_distinct(F.filter("__sorted", lambda x, i: x == F.get("__sorted", i + 1)))).drop("__sorted")
    # places of the grams found twice or more: by lookup where they are few kinds, else by sorting grams with their places
    few = F.filter(F.transform("__grams", lambda g, i: F.when(F.array_contains("__twice", g), i)), lambda i: i.isNotNull())
    pairs = twice.withColumn("__pairs", F.when(F.size("__twice") > 24, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i: (x["g"] == F.get("__pairs", i + 1)["g"]) | (x["g"] == F.get("__pairs", i - 1)["g"])
    many = F.sort_array(F.transform(F.filter("__pairs", lambda x, i: F.coalesce(same(x, i), F.lit(False)) | ((i > 0) & (x["g"] == F.get("__pairs", i - 1)["g"]))), lambda x: x["i"]))
    places = pairs.withColumn("__at", F.when(F.size("__twice") == 0, F.array().cast("array<int>")).when(F.col("__pairs").isNotNull(), many).otherwise(few))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__at", j + 1), p + 3) - p)), F.lit(0), lambda s, x: s + x)
    return places.withColumn("n_repeat_words", covered.cast("long")).drop("__grams", "__twice", "__pairs", "__at")


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[dict[int, float]]]:
    """(prior log odds of good, per rule the log ratio of each vote), by expectation-maximisation on pattern counts."""
    def ratios(good: list[float]) -> tuple[float, list[dict[int, float]]]:
        total = sum(n for _, n in patterns)
        n_good = sum(p * n for p, (_, n) in zip(good, patterns, strict=True))
        prior = math.log((n_good + SMOOTHING) / (total - n_good + SMOOTHING))
        out = []
        for j in range(n_rules):
            seen = {v: [SMOOTHING, SMOOTHING] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(good, patterns, strict=True):
                seen[votes[j]][0] += p * n
                seen[votes[j]][1] += (1 - p) * n
            out.append({v: math.log(g / (n_good + 3 * SMOOTHING)) - math.log(b / (total - n_good + 3 * SMOOTHING)) for v, (g, b) in seen.items()})
        return prior, out

    lean = math.log(START_ACCURACY / (1 - START_ACCURACY))
    prior, weight = math.log(GOOD_SHARE / (1 - GOOD_SHARE)), [{-1: -2 * lean, 0: 0.0, 1: lean / 2}] * n_rules
    for _ in range(PASSES):
        good = [1 / (1 + math.exp(-max(-40, min(40, prior + sum(w[v] for w, v in zip(weight, votes, strict=True)))))) for votes, _ in patterns]
        if patterns:
            prior, weight = ratios(good)
    return prior, weight


def judge_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with the counts, `quality` (posterior probability of good) and the base verdict."""
    counted = features(df, text)
    rules = _votes()
    voted = materialize(counted.select("*", *[v.cast("byte").alias(f"__v_{name}") for name, v in rules]), "quality-votes")
    names = [f"__v_{name}" for name, _ in rules]
    patterns = sorted((tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())
    prior, weight = estimate(patterns, len(rules))
    odds = F.lit(prior)
    for (name, _), w in zip(rules, weight, strict=True):
        v = F.col(f"__v_{name}")
        odds = odds + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    quality = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality", quality).withColumn("base_failed", failed).drop(*names)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality"
    )


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL: dict[str, str] = {}
