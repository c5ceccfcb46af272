"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its 3- to 5-grams of bytes (word limits included) and of itself,
hashed into rows of one embedding table.  The mean of a window's rows goes into a
two-class linear softmax; table and softmax are trained together by gradient
descent, so misspellings share n-gram vectors with words seen in training.  Windows
are runs of WINDOW words; a text's logit is the mean of its two highest windows (of
its only one), so that a few toxic words weigh the same in a short and a long text.

As mean and softmax are linear, scoring needs one number per row of the table; the
n-grams of a whole batch are hashed in a few numpy passes.

Defined results: null and empty texts, and texts without letters, score the least;
texts are read whole; equal texts get equal scores; a doc_id that stands in several
labelled rows is toxic if one of them says so; with no labelled rows of class 1 every
score is near 0; keys of any type; further columns of the scored table stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkernel import LOWER_TABLE, blocks, mix, texts_as_bytes, words_of

#: Parameters: rows (2 ** 16: a row's number is its hash's highest 16 bits) and width of the embedding table; words of a
#: window; most labelled texts per class that training reads, whole (it bounds the training sample, not what is scored);
#: passes, step and windows of a step.
ROWS, WIDTH, WINDOW, GRAMS = 1 << 16, 8, 6, (3, 4, 5)
PER_CLASS, PASSES, STEP, BATCH = 1200, 6, 30.0, 256
#: ASCII letters in small, every other ASCII byte a blank; bytes of other letters stay.
LETTERS = LOWER_TABLE.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(977))
GRAM_BASE = np.uint64(0x100000001B3)


@dataclass
class Bag:
    """Rows of the table for the words of a run of texts, in order: word i has rows[place[i]:place[i + 1]]."""

    first: np.ndarray
    rows: np.ndarray
    place: np.ndarray


def gram_rows(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, int, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """First word of each text, number of words, and (rows, their words) for the words themselves and each n-gram length."""
    buf = LETTERS[buf]
    words = words_of(buf, bounds)
    size = words.end - words.start
    n_words = len(size)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not n_words:
            return
        yield (words.hash >> np.uint64(48)).astype(np.int32), np.arange(n_words)
        # each word with a blank on both sides, in one buffer
        inside = np.flatnonzero(buf != 0x20) if n_words else np.zeros(0, dtype=np.int64)
        word = np.repeat(np.arange(n_words, dtype=np.int32), size)
        spaced = np.zeros(len(inside) + n_words + 1, dtype=np.uint8)
        spaced[np.arange(1, len(inside) + 1) + word] = buf[inside]
        blank = spaced == 0
        before = np.cumsum(blank, dtype=np.int32)
        value = BYTE_VALUES[spaced]
        h = value[:-1] * GRAM_BASE + value[1:]
        for k in range(3, max(GRAMS) + 1):
            n = len(spaced) - k + 1
            if n <= 0:
                return
            h = h[:n] * GRAM_BASE + value[k - 1 :]
            good = np.flatnonzero(before[k - 2 : k - 2 + n] == before[:n])  # no blank but at the ends
            yield (h[good] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32), before[good] - 1

    return words.first, n_words, parts()


def bag(buf: np.ndarray, bounds: np.ndarray) -> Bag:
    """Made in blocks of texts, so that only the rows' numbers, two bytes each, stand in memory together."""
    firsts, rows, sizes, words = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)], 0
    for a, b in blocks(bounds):
        first, n, parts = gram_rows(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        firsts.append(first[1:] + words)
        words += n
        both = list(parts)
        if both:
            owners = np.concatenate([x[1] for x in both])
            rows.append(np.concatenate([x[0] for x in both])[np.argsort(owners, kind="stable")].astype(np.uint16))
            sizes.append(np.bincount(owners, minlength=n))
    return Bag(np.concatenate(firsts), np.concatenate(rows), np.r_[0, np.cumsum(np.concatenate(sizes))])


def word_sums(buf: np.ndarray, bounds: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, sum of share over each word's rows, number of its rows)."""
    first, n, parts = gram_rows(buf, bounds)
    sums, sizes = np.zeros(n), np.zeros(n, dtype=np.int64)
    for rows, owners in parts:
        sums += np.bincount(owners, weights=share[rows], minlength=n)
        sizes += np.bincount(owners, minlength=n)
    return first, sums, sizes


def window_cuts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each window."""
    n = np.diff(first)
    per = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), per)
    return first[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)), text


@dataclass
class Model:
    """share[r]: what row r adds to the difference of the two logits, times the number of rows of the window."""

    share: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = -30.0

    def raw(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean of the two highest windows of each text."""
        n = len(bounds) - 1
        out = np.full(n, -1e3)
        first, sums, sizes = word_sums(buf, bounds, self.share)
        if not len(sums):
            return out
        cuts, text = window_cuts(first)
        x = np.add.reduceat(sums, cuts) / np.add.reduceat(sizes, cuts) + self.bias
        order = np.lexsort((x, text))
        x, text = x[order], text[order]
        last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
        before = np.maximum(last - 1, np.r_[0, last[:-1] + 1])
        out[text[last]] = (x[last] + x[before]) / 2
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        buf, bounds = texts_as_bytes(column)
        parts = [self.raw(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in blocks(bounds)]
        raw = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 3) -> Model:
    """Joint training of embeddings and softmax on windows.

    The label belongs to the text, not to its windows: after a first pass over all
    windows, a toxic text's two highest windows under the model so far count as
    toxic and its others are left out; a clean text's windows all count as clean.
    """
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(ROWS), shift=-30.0 if not len(y) or y[0] == 0 else 30.0)
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.normal(0, 0.3 / WIDTH, (ROWS, WIDTH)), rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2)
    buf, bounds = texts_as_bytes(pa.array(texts, type=pa.large_string()))
    got = bag(buf, bounds)
    cuts, owner = window_cuts(got.first)
    begin = got.place[cuts]
    sizes = np.diff(np.r_[begin, len(got.rows)])
    label = y[owner]
    for turn in range(PASSES):
        use = np.arange(len(cuts))
        if turn:
            share = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
            pieces = range(0, len(begin), 20_000)
            x = np.concatenate([np.add.reduceat(share[got.rows[begin[i] : begin[j] if j < len(begin) else len(got.rows)]], begin[i:j] - begin[i]) for i, j in ((i, i + 20_000) for i in pieces)]) / sizes
            order = np.lexsort((-x, owner))
            rank = np.arange(len(order)) - np.r_[0, np.flatnonzero(np.diff(owner[order])) + 1][np.cumsum(np.r_[0, np.diff(owner[order]) != 0])]
            use = np.sort(order[(label[order] == 0) | (rank < 2)])
        weight = np.where(label[use] == 1, len(use) / 2 / max(1, (label[use] == 1).sum()), len(use) / 2 / max(1, (label[use] == 0).sum()))
        order = rng.permutation(len(use))
        for a in range(0, len(order), BATCH):
            picked = order[a : a + BATCH]
            ids = use[picked]
            n = sizes[ids]
            at = np.r_[0, np.cumsum(n)]
            rows = got.rows[np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(begin[ids], n)]
            mean = np.add.reduceat(vectors[rows], at[:-1], axis=0) / n[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ids)), label[ids]] -= 1
            p *= np.minimum(weight[picked], 20.0)[:, None] / len(ids)
            rate = STEP * (1 - (turn + a / len(order)) / PASSES)
            back = (p @ out.T) * (rate * BATCH / 64 / n[:, None])
            out -= 0.01 * rate * (mean.T @ p)
            bias -= 0.01 * rate * p.sum(axis=0)
            spread = np.repeat(back, n, axis=0)
            for d in range(WIDTH):
                vectors[:, d] -= np.bincount(rows, weights=spread[:, d], minlength=ROWS)
    model = Model((vectors @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0]), 1.0, 0.0)
    # the logit that parts the classes best on the training texts (a false alarm weighs double), and a slope from their spread
    raw = np.concatenate([model.raw(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in blocks(bounds)])
    a, b = np.sort(raw[y == 1]), np.sort(raw[y == 0])
    at = np.unique(raw)
    wrong = np.searchsorted(a, at) / len(a) + 2 * (len(b) - np.searchsorted(b, at)) / len(b)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = (at[max(0, best[0] - 1)] + at[best[-1]]) / 2
    model.scale = 4 / max(1e-6, float(np.median(a) - np.median(b)))
    model.shift = -model.scale * cut
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    """Train on the first PER_CLASS labelled texts of each class by a hash of doc_id (held-out rows never)."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    mixed = F.xxhash64("doc_id")
    picked = own.where("toxic = 1").orderBy(mixed, "doc_id").limit(PER_CLASS).unionByName(own.where("toxic = 0").orderBy(mixed, "doc_id").limit(PER_CLASS))
    ids = {r["doc_id"]: r["toxic"] for r in picked.collect()}  # 2 * PER_CLASS rows at most
    if not ids:
        return Model(np.zeros(ROWS))
    # one text of each doc_id, the smallest where rows repeat it
    rows = docs.where(F.col("doc_id").isin(list(ids))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] or "" for r in rows], [ids[r["doc_id"]] for r in rows])


def score_toxicity(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the double column `out` (one of this name is replaced); only the texts and scores travel to and from Python."""
    sent = df.sparkSession.sparkContext.broadcast((model.share.astype(np.float32), model.bias, model.scale, model.shift))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(Model(*sent.value).scores(texts), type=pa.float64())

    return df.withColumn(out, scored(F.col(f"`{text}`")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
