"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words is
one window.  Fingerprints are hashes of GRAM consecutive words; winnowing keeps the
smallest one of the WINDOW - GRAM + 1 that start in a window, on both sides, so that
any shared window has a shared fingerprint: a certain catch, no sampling.  Neighbouring
windows of one fingerprint form a block, which is all that is kept of them.  One scan
of the documents makes the blocks of all window lengths; they are joined with the
fingerprints of the benchmark, and the hits are extended at their places: the words of
the block's windows, and of no others, are compared with those of the benchmark.  Items
shorter than WINDOW have windows, and fingerprints, of their own length.

Fingerprints and windows of the benchmark are written as a table and joined; the
planner broadcasts them only below the session's size threshold.  What is found
belongs to a text (by its MD5 sum), not to a key, so that copies are searched once.

Defined results: a null or empty text has no words; an item without words has no
window; texts are read whole; repeated rows of documents give equal rows each; rows
without a key, or with a key that stands for several texts, are judged each by its
own text; repeated items count under their own item_id, a null item_id not at all; an
empty benchmark leaves every document clean.  Further columns of documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, materialize, scratch, table

#: Parameters: words of a window (the contract's) and of a fingerprint; rows of a membership table, each of 64 bits.
WINDOW, GRAM, SLOTS = 10, 6, 1 << 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _runs(hashes: str, n: int, joined) -> Column:  # noqa: ANN001
    """For each n neighbours of an array what `joined` makes of them; empty where there are fewer."""
    return F.slice(F.transform(hashes, lambda h, i: joined(h, *[F.get(hashes, i + j) for j in range(1, n)])), F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


# explode_outer keeps the planner from pushing a filter on the exploded array below the columns that it is made of,
# where they would be computed anew for every element.


def with_blocks(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df with __blocks, an array of {size, fp, first, last}: the windows (by start) of each length that share a fingerprint;
    __h holds the hashes of the words."""
    grams = sorted({min(GRAM, size) for size in sizes})
    df = df.withColumns({f"__g{k}": _runs("__h", k, F.xxhash64) if k > 1 else F.transform("__h", lambda h: F.xxhash64(h)) for k in grams})
    least = {f"__m{size}": _runs(f"__g{min(GRAM, size)}", size - GRAM + 1, F.least) if size > GRAM else F.col(f"__g{size}") for size in sizes}
    df = df.withColumns(least).drop(*[f"__g{k}" for k in grams])

    def starts(size: int) -> Column:
        m = f"__m{size}"
        new = F.transform(m, lambda v, i: F.when((i == 0) | (v != F.get(m, i - 1)), F.struct(v.alias("fp"), i.alias("first"))))
        return F.filter(new, lambda x: x.isNotNull())

    df = df.withColumns({f"__s{size}": starts(size) for size in sizes})

    def blocks(size: int) -> Column:
        s = f"__s{size}"
        return F.transform(s, lambda x, i: F.struct(F.lit(size).alias("size"), x["fp"].alias("fp"), x["first"].alias("first"), (F.coalesce(F.get(s, i + 1)["first"], F.size(f"__m{size}")) - 1).alias("last")))

    return df.withColumn("__blocks", F.concat(*[blocks(size) for size in sizes])).drop(*[f"__{x}{size}" for x in "ms" for size in sizes])


def _slot(text: Column) -> list[Column]:
    """Row and bit of a text (by its MD5 sum) in a membership table."""
    h = F.xxhash64(text)
    return [F.pmod(h, F.lit(SLOTS)).alias("__slot"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int").alias("__bit")]


def membership(found: DataFrame, md5: str) -> DataFrame:
    """A table of SLOTS rows at most, whatever was found: the bits of the texts."""
    return found.select(*_slot(F.col(md5))).groupBy("__slot").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))


def with_maybe(documents: DataFrame, text: str, bits: DataFrame) -> DataFrame:
    """documents with __maybe: whether the membership table, which is broadcast for its fixed size, admits the text."""
    slot, bit = _slot(F.md5(F.col(f"`{text}`")))
    near = documents.select("*", slot, bit).join(F.broadcast(bits), "__slot", "left")
    return near.withColumn("__maybe", F.coalesce(F.expr("shiftrightunsigned(__bits, __bit) & 1") == 1, F.lit(False))).drop("__slot", "__bit", "__bits")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """size (words of the window), gram (its text) and items (the sorted item_ids that have it)."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = items.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    n = F.size("w") - F.col("size") + 1
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))
    return sized.select("item_id", "size", F.explode_outer(grams).alias("gram")).groupBy("size", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """text_md5 and hits (array of {at, size, items}, by place) of the texts that hold a window."""
    held = materialize(benchmark_windows(benchmark), "bench-windows")
    sizes = sorted(r["size"] for r in held.select("size").distinct().collect())  # WINDOW numbers at most
    if not sizes:
        item = benchmark.schema["item_id"].dataType.simpleString()
        return documents.select(F.md5(F.col(f"`{text}`")).alias("text_md5"), F.array().cast(f"array<struct<at:int,size:int,items:array<{item}>>>").alias("hits")).limit(0)
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    item_side = with_blocks(held.select(F.col("size").alias("own"), hashed(F.split("gram", " ")).alias("__h")), sizes)
    marks = item_side.select("own", F.explode_outer("__blocks").alias("b")).where("b.size = own").select("b.size", "b.fp").distinct()
    marks = materialize(marks, "bench-fingerprints")
    body = F.col(f"`{text}`")
    docs = documents.select(F.md5(body).alias("text_md5"), words_of(body).alias("__w")).select("text_md5", hashed("__w").alias("__h"))
    seeds = with_blocks(docs, sizes).select("text_md5", F.explode_outer("__blocks").alias("b")).select("text_md5", "b.*")
    places = seeds.join(marks, ["size", "fp"]).groupBy("text_md5").agg(F.collect_set(F.struct("size", "first", "last")).alias("places"))
    places = materialize(places.withColumnRenamed("text_md5", "__md5"), "bench-places")
    # the words at those places
    bits = materialize(membership(places, "__md5"), "bench-members")
    # copies of a text count once
    again = with_maybe(documents.select(body.alias("__text")), "__text", bits).where("__maybe").groupBy(F.md5("__text").alias("__md5")).agg(F.min("__text").alias("__text"))
    again = again.join(places, "__md5").select("__md5", "places", words_of(F.col("__text")).alias("__w"))
    window = lambda p, j: F.struct(j.alias("at"), p["size"].alias("size"), F.array_join(F.slice("__w", j + 1, p["size"]), " ").alias("gram"))
    there = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(p["first"], p["last"]), lambda j: window(p, j))))
    at = again.select("__md5", F.explode_outer(there).alias("x")).select("__md5", "x.*").distinct()
    hits = at.join(held, ["size", "gram"])
    return hits.groupBy(F.col("__md5").alias("text_md5")).agg(F.sort_array(F.collect_list(F.struct("at", "size", "items"))).alias("hits"))


def _covered(hits: str) -> Column:
    """Words inside any hit: hits are sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = x["at"] + x["size"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"]))).cast("long").alias("n"))

    return F.aggregate(hits, start, step, lambda a: a["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """documents without the rows whose text holds a window."""
    with scratch(documents.sparkSession):
        hit = materialize(find_contamination(documents, benchmark, text).select(F.col("text_md5").alias("__hit")), "bench-hit", keep=True)
        bits = materialize(membership(hit, "__hit"), "bench-hit-members", keep=True)
    marked = with_maybe(documents, text, bits)
    # most documents pass where they are; only those that the membership table cannot rule out are joined
    unsure = marked.where("__maybe").join(hit, F.md5(F.col(f"`{text}`")) == F.col("__hit"), "left_anti")
    return marked.where("not __maybe").unionByName(unsure).drop("__maybe")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda x: x["items"])), lambda i: i.cast("string"))))
    with scratch(spark):
        hits = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
        digest = materialize(hits.select("text_md5", _covered("hits").alias("n_hit"), items.alias("items")), "bench-digest", keep=True)
    counted = docs.select("doc_id", F.md5("text").alias("text_md5"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(digest, "text_md5", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


QUERIES = {"op9_decontamination": op9_decontamination}
SQL = {
    "op9_decontamination": """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), words AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs)
), places AS (
  SELECT doc_id, i, size, CASE size """
    + " ".join(f"WHEN {n} THEN " + " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER p" for j in range(1, n))]) for n in range(1, WINDOW + 1))
    + """ END AS gram
  FROM words, (SELECT DISTINCT size FROM windows) WINDOW p AS (PARTITION BY doc_id, size ORDER BY i)
), hits AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.gram = v.gram AND p.size = v.size
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
}
