"""Spelling variants: distance-one Levenshtein automata meet broadcast trie shards.

Words are counted in tasks (numpy passes over the text bytes, Arrow value counts) and
summed by one aggregation.  The frequent ones are range partitioned and cut into shards
of neighbouring words, of a bounded number of code points; a shard is one compact trie: its
nodes in breadth-first order, a letter and the place of the first child of each.  One
shard at a time, of bounded size, is broadcast; tasks walk it depth-first with the
automaton of each word, whose states are the words' places with no edit or one edit
used, and emit the neighbours that it accepts.  A group by word over all shards gives
the number of neighbours and the most frequent one.  Chains of forms are followed by
pointer doubling; as a form has RATIO times the occurrences, their length is bounded by
the logarithm of the largest count.

In a run of equal letters only the edit at its end is tried, so each neighbour is
emitted once.

Defined results: a null or empty text has no words; every row counts, rows that repeat a
key too; a null key is written as nothing in the hashed text; keys of any type with a
string form; words of any length (the longest must fit into a task); an empty table
gives an empty result; further columns are not used.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .textkernel import LOWER_TABLE, blocks, texts_as_bytes

#: Parameters: code points and occurrences of a word at least; how much more frequent its form is; one of ALTERED runs loses a letter.
POINTS, OCCURRENCES, RATIO, ALTERED = 6, 5, 5, 199
#: Code points of one shard's words; words that one task searches; bytes of text in one pass; longest run, in bytes, whose checksum is taken in lockstep.
SHARD_POINTS, TASK_WORDS, PASS_BYTES, LOCKSTEP = 4_000_000, 20_000, 1_000_000, 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each buf[start:end], going on from the checksum `before`."""
    n, out = end - start, np.empty(len(start), dtype=np.uint32)
    for i in np.flatnonzero(n > LOCKSTEP).tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes(), int(before[i]))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] <= LOCKSTEP]
    state, first = ~before[order], start[order]
    longer = np.searchsorted(-n[order], -np.arange(LOCKSTEP), side="left")  # how many runs have more than j bytes
    for j in range(LOCKSTEP):
        if not (m := int(longer[j])):
            break
        s = state[:m]
        state[:m] = _CRC[(s ^ buf[first[:m] + j]) & 0xFF] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


def words_in(keys: list[str], buf: np.ndarray, bounds: np.ndarray) -> pa.StructArray:
    """The words of POINTS code points or more of some texts, with their number: {values, counts}."""
    low = LOWER_TABLE[buf]
    lead = low == 0xC3  # of À to ÿ, each two bytes
    inside = ((low >= 0x61) & (low <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    joint = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts  # runs that meet at the limit of two texts
    start, end = np.sort(np.r_[np.flatnonzero(edge == 1), joint]), np.sort(np.r_[np.flatnonzero(edge == -1), joint])
    two = np.r_[0, np.cumsum(lead)]
    points = end - start - (two[end] - two[start])
    long = points >= POINTS
    start, end, points = start[long], end[long], points[long]
    row = np.searchsorted(bounds, start, side="right") - 1
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], dtype=np.uint32)
    h = checksums(low, start, end, before[row])
    hit = h % ALTERED == 0
    altered = []
    for a, b, c, p in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), points[hit].tolist(), strict=True):
        if p > POINTS:
            word, at = low[a:b].tobytes().decode(), c % p
            altered.append(word[:at] + word[at + 1 :])
    start, end = start[~hit], end[~hit]
    edges = np.zeros(len(low) + 1, dtype=np.int8)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    data = low[np.cumsum(edges[:-1]).astype(bool)]
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    plain = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pc.value_counts(pa.concat_arrays([plain, pa.array(altered, type=pa.string())]))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (occurrences) of all words of POINTS code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            buf, bounds = texts_as_bytes(batch.column(1))
            for a, b in blocks(bounds, PASS_BYTES):
                found = words_in(keys[a:b], buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    given = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Words in a trie of arrays: node 0 is the root and node i + 1 has letter i; the children of a node are letters first[node] to first[node + 1];
    count is the n of the word that ends at a node, or 0."""

    def __init__(self, letters: str, first: array, count: array) -> None:
        self.letters, self.first, self.count = letters, first, count

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """The trie of distinct words in code-point order."""
        letters: list[str] = []
        first, count = array("i"), array("q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(letters))
                ends = lo < hi and len(words[lo]) == depth
                count.append(counts[lo] if ends else 0)
                lo += ends
                while lo < hi:
                    c, to = words[lo][depth], lo + 1
                    while to < hi and words[to][depth] == c:
                        to += 1
                    letters.append(c)
                    below.append((lo, to))
                    lo = to
            level, depth = below, depth + 1
        first.append(len(letters))
        return cls("".join(letters), first, count)

    def pack(self) -> dict[str, str | bytes]:
        return {"letters": self.letters, "first": self.first.tobytes(), "count": self.count.tobytes()}

    @classmethod
    def unpack(cls, letters: str, first: bytes, count: bytes) -> Trie:
        return cls(letters, array("i", bytes(first)), array("q", bytes(count)))

    def neighbours(self, word: str) -> list[tuple[str, int]]:
        """The words at distance one, with their n: the automaton of `word` and the trie, depth-first."""
        letters, first, count, size, found = self.letters, self.first, self.count, len(word), []

        def rest(node: int, i: int) -> int:
            """n of the word that follows word[i:] from a node, the edit being used; 0 if there is none."""
            while i < size:
                node = letters.find(word[i], first[node], first[node + 1]) + 1
                if not node:
                    return 0
                i += 1
            return count[node]

        node = 0
        for i in range(size + 1):  # the state without an edit, on the one path that spells word[:i]
            here = word[i] if i < size else ""
            after = word[i + 1] if i + 1 < size else ""
            exact = -1
            for at in range(first[node], first[node + 1]):
                c = letters[at]
                if c == here:
                    exact = at
                    continue
                if here:
                    child = at + 1
                    lo, hi = first[child], first[child + 1]
                    if not after or letters.find(after, lo, hi) >= 0:
                        if n := rest(child, i + 1):
                            found.append((word[:i] + c + word[i + 1 :], n))
                    if letters.find(here, lo, hi) >= 0 and (n := rest(child, i)):
                        found.append((word[:i] + c + word[i:], n))
                elif count[at + 1]:
                    found.append((word + c, count[at + 1]))
            if here and here != after and (n := rest(node, i + 1)):
                found.append((word[:i] + word[i + 1 :], n))
            if exact < 0:
                break
            node = exact + 1
        return found


FRAGMENT = pa.schema([("name", pa.string()), ("points", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SHARD_TYPE = "shard int, letters string, first binary, count binary"


def trie_shards(words: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Rows of SHARD_TYPE: tries of neighbouring words (word, n), of twice shard_points code points each at most (or one longer word).

    Range partitions are cut into fragments of neighbouring words; fragments that follow each other are put together until shard_points are reached,
    so that the number of shards follows from the words and not from the number of partitions.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[str] = []
        counts: list[int] = []
        points = 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and points + len(word) > shard_points:
                    yield pa.RecordBatch.from_pylist([{"name": own[0], "points": points, "words": own, "counts": counts}], schema=FRAGMENT)
                    own, counts, points = [], [], 0
                own.append(word)
                counts.append(n)
                points += len(word)
        if own:
            yield pa.RecordBatch.from_pylist([{"name": own[0], "points": points, "words": own, "counts": counts}], schema=FRAGMENT)

    def build(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name", key=lambda names: names.map(lambda x: x.encode()))
        trie = Trie.of([w for own in rows["words"] for w in own], [int(n) for own in rows["counts"] for n in own])
        return pd.DataFrame([{"shard": key[0], **trie.pack()}])

    total = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    ordered = words.select("word", "n").repartitionByRange(1 + total // shard_points, "word").sortWithinPartitions("word")
    fragments = materialize(ordered.mapInArrow(cut, "name string, points long, words array<string>, counts array<long>"), "spelling-fragments")
    shard_of, before = [], 0
    for name, points in sorted(fragments.select("name", "points").collect(), key=lambda r: r[0].encode()):  # names and sizes only
        shard_of.append((name, before // shard_points))
        before += points
    dealt = words.sparkSession.createDataFrame(shard_of, "name string, shard int")
    return fragments.join(dealt, "name").groupBy("shard").applyInPandas(build, SHARD_TYPE)


def near_words(words: DataFrame, trie: Broadcast) -> DataFrame:
    """word, near, near_n: the neighbours of each word in one broadcast shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Trie.unpack(*trie.value)
        for batch in batches:
            pairs = [(word, near, n) for word in batch.column(0).to_pylist() for near, n in shard.neighbours(word)]
            columns = [pa.array([p[i] for p in pairs], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    return words.select("word").mapInArrow(run, "word string, near string, near_n long")


def group_variants(words: DataFrame, shard_points: int = SHARD_POINTS, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words (word, n)."""
    spark = words.sparkSession
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    with scratch(spark):
        words = materialize(words.select("word", "n"), "spelling-words", keep=True)
        size, most = words.agg(F.count("*"), F.max("n")).first()
        dealt = materialize(words.repartition(1 + size // TASK_WORDS, "word"), "spelling-dealt")
        shards = materialize(trie_shards(words, shard_points), "spelling-shards")
        parts = None
        for (number,) in shards.select("shard").sort("shard").collect():  # numbers only; one shard is read and broadcast at a time
            row = shards.where(F.col("shard") == number).first()
            trie = spark.sparkContext.broadcast((row["letters"], bytes(row["first"]), bytes(row["count"])))
            part = materialize(near_words(dealt, trie).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
            trie.destroy()
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
        near = materialize(parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "spelling-best", keep=True)
        frequent = -F.col("best.m") >= F.col("n") * ratio
        judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"))
        roots = materialize(judged.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots", keep=True)
        steps = math.ceil(math.log(max(most, 2), ratio)) + 1 if ratio > 1 else size
        for _ in range(max(steps, 2).bit_length()):
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots", keep=True)
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of some texts."""
    return group_variants(count_words(docs, key, text).where(F.col("n") >= occurrences))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: crc32 as a fold over the bytes; near words share what is left when one letter is cut out or masked.
SQL = {
    "op13_spelling_variants": """
WITH RECURSIVE entries AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(0, 256) r(b)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), summed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295), 4294967295) AS h FROM counted, entries
), spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), masked AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM masked a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM masked a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other COLLATE "binary") AS k FROM near
), forms AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1
), chains AS (
  SELECT word, word AS last FROM forms
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, last AS root FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NULL
)
SELECT f.word, n, CAST(n_near AS BIGINT) AS n_near, form, form_n, root FROM forms f JOIN roots r ON r.word = f.word
"""
}
