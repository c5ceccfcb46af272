"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the k-gram hashes of every window of SPAN words the
smallest (leftmost) is kept, so any repeated span of SPAN words has its anchor in all
its copies.  Neighbouring windows with the same anchor form a block: the anchor
extended to both sides as far as it decides.  Documents are joined on anchors; where
all blocks of an anchor are equal the match is settled for the block as a whole, and
only blocks that differ (the ends of maximal repeats) are compared window by window,
one representative per distinct block.  A window is repeated when a document with a
smaller doc_id has it too; the words that repeated windows cover go.

Everything large is joined or grouped by keys of high cardinality with partial
aggregation; both sides of each join are written tables, so that adaptive execution
can split a hot anchor.

Defined results: a null or empty text has no words; texts of fewer than SPAN words
stay; rows with a null doc_id stay whole and remove nothing; rows that repeat a
doc_id are one document, each losing words of its own text; keys of any orderable type; an
empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .textkernel import blocks, grams, leftmost_minimum, mix, powers, signed, texts_as_bytes, words_of

#: Parameters: words of the shortest repeat that counts, words of an anchor.
SPAN, GRAM = 50, 12


def _range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of h[start:end] for each pair, by prefix sums."""
    base = 0xA0761D6478BD642F & ~7 | 5
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(seed)) * powers(base, len(h)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(h) + 1)[start] + (end - start).astype(np.uint64))


def anchor_blocks(ids: np.ndarray, buf: np.ndarray, bounds: np.ndarray, span: int = SPAN) -> dict[str, np.ndarray]:
    """The blocks of some texts: doc, anchor, content (hash of the block and of the anchor's place in it), start, n (windows)."""
    words = words_of(buf, bounds)
    n = len(words.hash) - span + 1
    text = np.repeat(np.arange(len(ids)), np.diff(words.first))
    whole = np.flatnonzero(text[: max(n, 0)] == text[span - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    if not len(whole):
        empty = np.zeros(0, dtype=np.int64)
        return {"doc": ids[:0], "anchor": empty, "content": empty, "start": empty.astype(np.int32), "n": empty.astype(np.int32)}
    g = grams(words.hash, GRAM)
    place = leftmost_minimum(g, span - GRAM + 1)[whole]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[whole[1:]] != text[whole[:-1]])]
    at = np.flatnonzero(new)
    first, last = whole[at], whole[np.r_[at[1:], len(whole)] - 1]
    anchor = place[at]
    content = mix(_range_hash(words.hash, first, last + span, 0x51) + (anchor - first).astype(np.uint64))
    return {
        "doc": ids[text[first]],
        "anchor": signed(g[anchor]),
        "content": signed(content),
        "start": (first - words.first[text[first]]).astype(np.int32),
        "n": (last - first + 1).astype(np.int32),
    }


BLOCK_TYPE = "anchor long, content long, start int, n int"


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, bounds = texts_as_bytes(batch.column("text"))
        for a, b in blocks(bounds):
            found = anchor_blocks(np.arange(a, b), buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            rows = pa.array(found.pop("doc"))
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(rows), "own": batch.column("own").take(rows), **{k: pa.array(v) for k, v in found.items()}})


def pack(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, own (a hash of the text, which tells rows of one key apart) and packed: the text compressed, for the joins that carry it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [None if t is None else press.compress(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())], names=[key, "own", "packed"])

    own = F.xxhash64(F.col(f"`{text}`")).alias("own")
    return df.select(F.col(f"`{key}`"), own, F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind(df, key)}, own long, packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [b"" if x is None else open_.decompress(x) for x in column.to_pylist()]


def as_buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)].astype(np.int64)


WINDOW_TYPE = "anchor long, content long, j int, window long"


def _block_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, packed, wanted: list of {start, n, anchor, content}) to a row per window of the wanted blocks."""
    for batch in batches:
        buf, bounds = as_buffer(unpacked(batch.column("packed")))
        wanted, docs = batch.column("wanted"), batch.column("doc").to_numpy(zero_copy_only=False)
        ends = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        start, n, anchor, content = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "anchor", "content"))
        for a, b in blocks(bounds):
            words = words_of(buf[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            whole = grams(words.hash, SPAN, seed=0x77)
            own = slice(ends[a], ends[b])
            count = n[own].astype(np.int64)
            text = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(words.first[text] + start[own], count) + j
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(docs[a:b][text], count), type=batch.column("doc").type), pa.array(np.repeat(anchor[own], count)), pa.array(np.repeat(content[own], count)), pa.array(j.astype(np.int32)), pa.array(signed(whole[at]))],
                names=["doc", "anchor", "content", "j", "window"],
            )


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, own (hash of the text), start, end (words, end exclusive): windows, or runs of them, that a document with a smaller id has too."""
    known = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    typed = f"doc {kind(known, 'doc')}"
    hashed = known.select("doc", F.xxhash64("text").alias("own"), "text")
    all_blocks = materialize(hashed.mapInArrow(_find_blocks, f"{typed}, own long, {BLOCK_TYPE}"), "dedup-blocks")
    seeds = all_blocks.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), (F.min("content") != F.max("content")).alias("mixed"))
    shared = materialize(seeds.where("least < most").select("anchor", "least", "mixed"), "dedup-seeds")
    joined = materialize(all_blocks.join(shared, "anchor"), "dedup-joined")
    end = F.col("start") + F.col("n") + (SPAN - 1)
    settled = joined.where("not mixed and doc > least").select("doc", "own", "start", end.alias("end"))
    # anchors whose blocks differ: one representative, the smallest document, of each distinct block
    mixed = joined.where("mixed").select("doc", "own", "anchor", "content", "start", "n")
    kinds = mixed.groupBy("anchor", "content").agg(F.min(F.struct("doc", "own", "start", "n")).alias("r"))
    kinds = materialize(kinds.select("anchor", "content", F.col("r.doc").alias("first_doc"), F.col("r.own").alias("first_own"), F.col("r.start").alias("start"), F.col("r.n").alias("n")), "dedup-kinds")
    wanted = kinds.groupBy(F.col("first_doc").alias("doc"), F.col("first_own").alias("own")).agg(F.collect_list(F.struct("start", "n", "anchor", "content")).alias("wanted"))
    texts = pack(known, "doc", "text")
    asked = texts.join(wanted, ["doc", "own"])
    windows = materialize(asked.mapInArrow(_block_windows, f"{typed}, {WINDOW_TYPE}"), "dedup-windows")
    first = windows.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    hit = windows.join(materialize(first.select("anchor", "window", "least"), "dedup-first"), ["anchor", "window"]).where("doc > least")
    places = materialize(hit.groupBy("anchor", "content").agg(F.collect_set("j").alias("js")), "dedup-places")
    members = mixed.join(kinds.select("anchor", "content", "first_doc"), ["anchor", "content"])
    later = members.where("doc > first_doc").select("doc", "own", "start", end.alias("end"))
    kept = members.where("doc = first_doc").join(places, ["anchor", "content"])
    single = kept.select("doc", "own", "start", F.explode("js").alias("j")).select("doc", "own", (F.col("start") + F.col("j")).alias("start"), (F.col("start") + F.col("j") + SPAN).alias("end"))
    return settled.unionByName(later).unionByName(single)


KEPT_TYPE = "n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept (the words that stay, joined by one blank)."""
    with scratch(docs.sparkSession):
        spans = repeated_spans(docs, key, text).groupBy(F.col("doc").alias("__doc"), F.col("own").alias("__own")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = materialize(spans, "dedup-spans", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for body, own in zip(unpacked(batch.column("packed")), batch.column("spans"), strict=True):
                words = body.split()
                n = len(words)
                if own.is_valid and n:
                    at = own.values
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, at.field("start").to_numpy(), 1)
                    np.add.at(edge, np.minimum(at.field("end").to_numpy(), n), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in stay.tolist()]
                out.append((n, n - len(words), b" ".join(words).decode()))
            columns = [pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "n_words", "n_removed", "kept"])

    joined = pack(docs, key, text).join(spans, (F.col(f"`{key}`") == F.col("__doc")) & (F.col("own") == F.col("__own")), "left").select(F.col(f"`{key}`"), "packed", "spans")
    return joined.mapInArrow(run, f"`{key}` {kind(docs, key)}, {KEPT_TYPE}")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {
    "op1_substring_dedup": """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), windows AS (
  SELECT doc_id, i, """
    + " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER p" for j in range(1, SPAN))])
    + """ AS gram FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), first AS (
  SELECT gram, min(doc_id) AS least FROM windows WHERE gram IS NOT NULL GROUP BY gram
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM (SELECT v.doc_id, v.i, unnest(range(0, 50)) AS j FROM windows v JOIN first f ON v.gram = f.gram AND f.least < v.doc_id)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = words.doc_id AND g.i = words.i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
}
