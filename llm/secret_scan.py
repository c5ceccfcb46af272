"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained from labelled samples: random strings
(keys and tokens) and ordinary identifiers and words.  A candidate is a run of
16 or more characters of base-64 and URL alphabets, less the spans of fixed patterns.
Its secrets are the stretches of words and separators whose summed log-likelihood
ratio exceeds the threshold per character by most, if they hold 16 characters; so a
key is found behind a long path or name too, and whatever letters or digits it has.

Defined results: a null text has no span, an empty one neither; a text is scanned
whole whatever its length; spans are in code points, end exclusive; equal rows give
equal results; further columns of the input are kept and never read.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed patterns of the base scan (bytes; ASCII case only), in the order in which kinds are listed.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PIECE = re.compile(rb"[A-Za-z0-9]+|[+/_=-]")
KINDS = ("assign", "access", "hex", "markov")
WORDS_BEFORE_VALUE = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words from which ordinary identifiers are put together for training.
ORDINARY = """account action address after array before block buffer button cache change check client code column
config content count create cursor data date default delete document element error event field file filter first format
frame function group handle header height image index input insert instance item label layer length level line list
local lock manager message method model module name network node number object offset option order output page parent
path pattern point position process property query queue random range read record region request reset result return
row schema screen search select server session shape size source stack start state status stream string style system
table target task template text thread time title update user value vector version view width window word write""".split()
#: Words of running text in several languages, as they stand glued together in documents.
ORDINARY += """the that which through whose light night thought though strength knowledge question between world people would could should right water known work house why what when where
aber nicht werden schaft keit heit lich ung ein eine und der die das mit von auf nach durch zwischen gesellschaft entwicklung verwaltung rechnung versicherung nachricht wirtschaft
zeitung strasse schule arbeit haus stadt buch wort sprache schnell wasser zeichen pfeil schutz
que una para por los las del con cuando donde tiempo ciudad trabajo palabra mensaje nombre respuesta pregunta pueblo llave corazon ayuda desarrollo mente cion
les des dans pour avec sur plus tout faire ville travail maison temps jour eau vaux aux eux reponse gouvernement toujours quelque parole oiseau heureux beaucoup aujourd""".split()
#: Parameters: mean log-likelihood ratio (nats per character) above which a candidate is random; most rows of a labelled
#: table that training reads.
THRESHOLD, LABELLED = 0.75, 20_000
ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def samples(n: int = 4000, seed: int = 5) -> list[tuple[bytes, int]]:
    """Labelled training strings: 1 random, 0 ordinary."""
    rng = random.Random(seed)
    sets = [ALPHABET[:62], ALPHABET, b"0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52]]
    out = []
    for i in range(n):
        letters = sets[i % len(sets)]
        out.append((bytes(rng.choice(letters) for _ in range(rng.randint(16, 48))), 1))
        words = [rng.choice(ORDINARY) for _ in range(rng.randint(2, 6))]
        joined = (
            "_".join(words), "-".join(words), "/".join(words), "".join(words), "".join(w.capitalize() for w in words),
            "_".join(words).upper(), "_".join([*words, str(rng.randint(0, 9999))]), f"{'-'.join(words)}/{rng.randint(1990, 2030)}",
        )[i % 8]
        out.append((joined.encode(), 0))
    return out


def log_ratios(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """log P(b | a, random) - log P(b | a, ordinary) for bytes a, b, from labelled strings; row 0 stands for the start."""
    counts = np.ones((2, 128, 128)) * 0.05
    counts[:, :, list(ALPHABET)] += 0.5
    for text, label in rows:
        codes = np.frombuffer(b"\x00" + text, dtype=np.uint8)
        codes = np.where(codes < 128, codes, 127)
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


@lru_cache(maxsize=1)
def models() -> np.ndarray:
    return log_ratios(samples())


def fit(labelled: DataFrame) -> np.ndarray:
    """The ratios from a table of value and label (1: random); LABELLED of its rows at most, the first by a hash, reach the driver."""
    own = labelled.where(F.col("label").isin(0, 1) & F.col("value").isNotNull()).select("value", F.col("label").cast("int").alias("label"))
    return log_ratios([(r["value"].encode(), r["label"]) for r in own.orderBy(F.xxhash64("value"), "value", "label").limit(LABELLED).collect()])


def ratio(candidate: bytes, ratios: np.ndarray | None = None) -> float:
    """Mean log-likelihood ratio per character."""
    codes = np.frombuffer(b"\x00" + candidate, dtype=np.uint8)
    return float((models() if ratios is None else ratios)[codes[:-1], codes[1:]].mean())


def random_string(candidate: bytes) -> bool:
    """Likelier random than ordinary."""
    return ratio(candidate) > THRESHOLD


def random_parts(run: bytes, ratios: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Limits of the stretches of words and separators that are random.

    They are all maximal scoring subsequences (Ruzzo and Tompa, in linear time) of the
    ratio above the threshold.  The run itself is one if none of them is long enough.
    """
    codes = np.frombuffer(b"\x00" + run, dtype=np.uint8)
    sums = np.r_[0.0, np.cumsum((models() if ratios is None else ratios)[codes[:-1], codes[1:]] - THRESHOLD)].tolist()
    best: list[tuple[int, int, int]] = []  # start, end, place of the last one before that starts from a lower sum
    for m in PIECE.finditer(run):
        start, end = m.span()
        if sums[end] <= sums[start]:
            continue
        while True:
            j = len(best) - 1
            while j >= 0 and sums[best[j][0]] >= sums[start]:
                j = best[j][2]
            if j < 0 or sums[best[j][1]] >= sums[end]:
                best.append((start, end, j))
                break
            start = best[j][0]
            del best[j:]
    parts = [(a + len(run[a:b]) - len(run[a:b].lstrip(b"=")), b) for a, b, _ in best]  # padding never leads
    parts = [(a, b) for a, b in parts if b - a >= LEAST]
    return parts or [(0, len(run))] * (sums[-1] > 0)


def _outside(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a:b outside the sorted, disjoint spans in `taken`."""
    for i in range(bisect.bisect_right(taken, a, key=lambda x: x[1]), len(taken)):
        s, e = taken[i]
        if s >= b:
            break
        yield a, s
        a = e
    yield a, b


def spans_of(text: str | None, ratios: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of all spans, base kinds first found by pattern, then the models'; sorted."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(w in low for w in WORDS_BEFORE_VALUE):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    candidates = [m.span() for m in CANDIDATE.finditer(raw)]
    if candidates:
        for a, b in candidates:
            found += [(a + m.start(), a + m.end(), 2) for m in HEX.finditer(raw[a:b])]
        taken: list[tuple[int, int]] = []
        for s, e in sorted(x[:2] for x in found):
            if taken and s <= taken[-1][1]:
                s, e = taken[-1][0], max(e, taken.pop()[1])
            taken.append((s, e))
        for run in candidates:
            for a, b in _outside(*run, taken):
                if b - a >= LEAST:
                    found += [(a + s, a + e, 3) for s, e in random_parts(raw[a:b], ratios)]
    if not found:
        return []
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    if len(raw) == len(text):
        return found
    edges = sorted({x for s, e, _ in found for x in (s, e)})
    points, at, n = {}, 0, 0
    for edge in edges:  # each byte is decoded once, however many spans there are
        n += len(raw[at:edge].decode("utf-8", "surrogatepass"))
        points[edge], at = n, edge
    return [(points[s], points[e], k) for s, e, k in found]


SPANS_TYPE = "array<struct<start:bigint,end:bigint,kind:string>>"


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "spans", ratios: np.ndarray | None = None) -> DataFrame:
    """The columns `keep` (all when None) and the array `out` of {start, end, kind} by start, then kind as listed; a column of that
    name is replaced.  ratios: of fit() or log_ratios()."""
    sent = df.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf(SPANS_TYPE)
    def scanned(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans_of(t, sent.value)] for t in texts.to_pylist()], type=kind)

    names = [c for c in (df.columns if keep is None else keep) if c != out]
    return df.select(*[F.col(f"`{c}`") for c in names], scanned(F.col(f"`{text}`")).alias(out))


def redact(text: str | None, mark: str = "[SECRET]", ratios: np.ndarray | None = None) -> str | None:
    """text with every span (overlapping ones joined) replaced by the mark."""
    spans = spans_of(text, ratios)
    if not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text", ratios: np.ndarray | None = None) -> DataFrame:
    """df with the secrets in `text` replaced; every row and every other column stays, in its place."""
    sent = df.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t, ratios=sent.value) for t in texts.to_pylist()], type=pa.string())

    return df.withColumn(text, redacted(F.col(f"`{text}`")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.concat_ws(",", F.transform(base, one)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", one)).alias("spans"),
        count("markov").alias("n_markov"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL: dict[str, str] = {}
