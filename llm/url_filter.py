"""URL filters: allow and block rules, and logistic regression on hashed n-grams of host and path.

The classifier is trained in numpy from a small labelled URL table: a DataFrame of
host, path and label (1: to be blocked), or, where none is given, made_urls(), which
is put together from word lists by a rule.  Features are the 3- to 5-grams of the host
and those of the path, hashed apart, so that a word in a path does not count as one in
a host.  The weights, a fixed number of floats, are broadcast.  Rules win over the
classifier: the longest rule whose host is the url's host or a parent domain of it and
whose path is a prefix of the url's path.

Defined results: a null url, or one without "://", has an empty host and path and
the verdict of the classifier for an empty text (allow); equal rows give equal
results; an empty rule list leaves all to the classifier; an empty table gives an
empty result; further columns stay, but for those that have the name of a result.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, table
from .textkernel import mix, texts_as_bytes

#: (host, path, verdict) of the rules of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Parameters: width of the weight table, n-gram lengths, passes, step and shrinkage of training; most rows of a labelled
#: table that training reads (the first by a hash of host and path).
SLOTS, GRAMS, PASSES, STEP, SHRINK, LABELLED = 1 << 16, (3, 4, 5), 150, 40.0, 2e-5, 5000
#: Words of hosts and paths from which the labelled table is made; UNWANTED: hosts to be blocked.
WANTED = """news blog docs science health library school museum garden recipe weather travel history music research open data
forum wiki journal local sport theatre review guide city nature alphabet better diabetes essex sussex analysis classic cashmere
therapist farmland traders badminton tracking academy bakery bank bicycle bridge camera castle chess cinema coffee college
concert cooking council dental design doctor energy engineering festival film finance fishing fitness flower football forest
furniture gallery geology hospital hotel insurance island kitchen language law market mathematics medical mountain national
observatory office opera orchestra painting paper parliament philosophy photo physics poetry police pottery press property
public radio railway river sailing software space stadium statistics stone studio swimming teacher technology tennis train
university vehicle village water winter wood world writing yoga zoo software archive code developer cloud network search
mail times daily post tribune herald globe encyclopedia dictionary translate maps movie book store shop""".split()
UNWANTED = """casino jackpot bet poker spam farm ads track clicks popup viagra pills loans cash adult xxx porn crack warez
torrent lottery bonus cheap replica phish win slots roulette escort hack keygen betting gamble cialis payday click free
bets""".split()
AFFIXES = "24 365 777 88 online best top hub zone 4u now vip pro king club live x".split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sh ch ble ly tion ther wh ing ment".split()
DOMAINS = "com net org com net org de fr es io co.uk info example.com example.net example.org".split()


def made_urls(n: int = 3000, seed: int = 11) -> list[tuple[str, str, int]]:
    """A labelled table by rule: (host, path, label)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 2
        plain = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))
        if bad:
            own = [rng.choice(UNWANTED), rng.choice([rng.choice(UNWANTED), rng.choice(UNWANTED), rng.choice(AFFIXES), rng.choice(AFFIXES), plain, rng.choice(WANTED)])]
        else:
            own = [rng.choice([rng.choice(WANTED), rng.choice(WANTED), plain]), *([rng.choice(WANTED)] * (rng.random() < 0.4))]
        rng.shuffle(own)
        name = rng.choice(["-", "-", "", ""]).join(own)
        host = rng.choice(["", "", "www.", "m.", "blog.", "en."]) + f"{name}.{rng.choice(DOMAINS)}"
        word = rng.choice(UNWANTED if rng.random() < 0.3 else WANTED)
        path = rng.choice([f"/{rng.choice(['en', 'de', 'fr', 'es'])}/", "/", "/wiki/", "/a/"]) + rng.choice([str(rng.randint(1, 99999)), f"{word}/{rng.randint(1, 999)}", f"{word}.html", word.capitalize(), ""])
        out.append((host, path, bad))
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the n-grams of each text, which is its host, U+0001 and its path; none spans both."""
    buf, bounds = texts_as_bytes(texts)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    parted = buf == 1
    # bytes after the first mark of their text belong to the path
    marks = np.cumsum(parted)
    side = marks - np.r_[0, marks][bounds[:-1]][owner] > 0 if len(buf) else parted
    value = mix(buf.astype(np.uint64) + np.uint64(1) + side.astype(np.uint64) * np.uint64(1 << 20))
    rows, slots = [], []
    for k in GRAMS:
        n = len(buf) - k + 1
        if n <= 0:
            break
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + value[j : j + n]
        whole = (owner[:n] == owner[k - 1 :]) & (side[:n] == side[k - 1 :])
        rows.append(owner[:n][whole])
        slots.append((mix(h[whole]) & np.uint64(SLOTS - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(slots)


def logits(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """weights[SLOTS] is the bias; n-gram counts are scaled by the root of their number."""
    n = len(texts)
    rows, slots = features(texts)
    sums = np.bincount(rows, weights=weights[slots], minlength=n)
    counts = np.bincount(rows, minlength=n)
    return sums / np.sqrt(np.maximum(counts, 1)) + weights[SLOTS]


def train(rows: list[tuple[str, str, int]]) -> np.ndarray:
    """Weights by gradient descent on (host, path, label) rows (full batches, fixed order: the same everywhere)."""
    w = np.zeros(SLOTS + 1)
    y = np.array([x[2] for x in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        w[SLOTS] = -5.0 if not len(y) or y[0] == 0 else 5.0
        return w
    at, slots = features(pa.array([f"{h}\x01{p}" for h, p, _ in rows]))
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=len(rows)), 1))
    for _ in range(PASSES):
        z = np.bincount(at, weights=w[slots], minlength=len(rows)) * scale + w[SLOTS]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w[:SLOTS] -= STEP * (np.bincount(slots, weights=(g * scale)[at], minlength=SLOTS) / len(rows) + SHRINK * w[:SLOTS])
        w[SLOTS] -= 2.0 * (g.mean() + 0.03)  # a lean towards allow
    return w


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    return train(made_urls())


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights from a table of host, path and label; LABELLED of its rows at most reach the driver."""
    own = labelled.where(F.col("label").isin(0, 1)).select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("int").alias("label"))
    return train([tuple(r) for r in own.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(LABELLED).collect()])


def score_urls(df: DataFrame, host: str = "host", path: str = "path", out: str = "block_score", weights: np.ndarray | None = None) -> DataFrame:
    """df with the double column `out`: probability that a url with this host and path is to be blocked."""
    sent = df.sparkSession.sparkContext.broadcast(trained() if weights is None else weights)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(logits(texts, sent.value), -30, 30))))

    return df.withColumn(out, scored(F.concat(F.coalesce(host, F.lit("")), F.lit("\x01"), F.coalesce(path, F.lit("")))))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in small letters; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as host + path, its verdict), null where none fits; ties go to the rule listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, weights: np.ndarray | None = None) -> DataFrame:
    """df with host, path, rule, block_score and verdict (columns of these names are replaced); weights: of fit() or train()."""
    parts = df.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    scored = score_urls(parts, weights=weights)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op2_url_filter": op2_url_filter}
SQL: dict[str, str] = {}
