"""Line dedup with two Bloom filters, of once-seen and twice-seen lines.

Every task notes the hashes of its lines: a line that the once-filter does not have goes
there, one that it has already goes into the twice-filter.  The filters of two tasks are
merged bit by bit: once = a | b, twice = a' | b' | (a & b), so that a line of two tasks
has all its bits in the merged twice-filter and no repeated line can be missed.  Only
lines that this filter admits, as 16 bytes each (BLAKE2b), are shuffled: grouping them
confirms exactly which are in two documents and which document is the first.  Texts
without a suspected line are never shuffled; the others, compressed, meet the list of
what they lose.

The filters have BITS_A_LINE bits for each line of the table, MOST_BITS each at most, so
that they may be merged in levels and broadcast.  Beyond that bound they fill up: more
lines are suspected and shuffled as digests, with equal results.

Defined results: a line's key is the line without blanks (space, \\t \\n \\v \\f \\r) at both
ends, A-Z in small letters; keys shorter than LEAST code points stay; a null or empty
text is one empty line; rows without a key column value stay whole and remove nothing;
rows that repeat it are one document, each losing lines of its own text; keys of any
orderable type; an empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .sketch import PIECES, fixed_array
from .substring_dedup import kind, unpacked
from .textkernel import BLOCK_BYTES, LOWER_TABLE, SPACE_TABLE, mix, powers, texts_as_bytes

#: Parameters: code points of the shortest line that counts; bits a line and bits at most of each filter; bits that one line sets.
LEAST, BITS_A_LINE, MOST_BITS, HASHES = 10, 16, 1 << 29, 3


class Lines:
    """The lines of some texts as ranges of one buffer: text i has lines first[i]:first[i + 1]; start and end as in the text, s and e without blanks."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray) -> None:
        breaks = np.flatnonzero(buf == 0x0A)
        count = np.diff(np.searchsorted(breaks, bounds)) + 1
        self.buf, self.first = buf, np.r_[0, np.cumsum(count)]
        n = int(self.first[-1])
        opens, closes = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        opens[self.first[:-1]], closes[self.first[1:] - 1] = True, True
        self.start, self.end = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.start[opens], self.start[~opens] = bounds[:-1], breaks + 1
        self.end[closes], self.end[~closes] = bounds[1:], breaks
        self.text = np.repeat(np.arange(len(count)), count)
        self.s, self.e, self.hash, self.points = self.start.copy(), self.start.copy(), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        at = 0
        while at < n:  # whole lines of BLOCK_BYTES together, one at least
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BLOCK_BYTES, side="right")))
            self._keys(at, to)
            at = to

    def _keys(self, a: int, b: int) -> None:
        """Ends without blanks, hash and code points of the keys of lines a:b."""
        low = self.start[a]
        part = LOWER_TABLE[self.buf[low : self.end[b - 1]]]
        dark = np.flatnonzero(~SPACE_TABLE[part])
        lo, hi = np.searchsorted(dark, self.start[a:b] - low), np.searchsorted(dark, self.end[a:b] - low)
        some = hi > lo
        s, e = dark[lo[some]], dark[hi[some] - 1] + 1
        base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(0x1F)) * powers(base, len(part)), out=sums[1:])
        inner = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=inner[1:])
        at = a + np.flatnonzero(some)
        self.hash[at] = mix(mix((sums[e] - sums[s]) * powers(inverse, len(part) + 1)[s]) + (e - s).astype(np.uint64))
        self.points[at] = inner[e] - inner[s]
        self.s[at], self.e[at] = s + low, e + low

    def key(self, i: int) -> bytes:
        return LOWER_TABLE[self.buf[self.s[i] : self.e[i]]].tobytes()

    def digest(self, i: int) -> bytes:
        return hashlib.blake2b(self.key(i), digest_size=16).digest()


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]


def _has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter of 64-bit words admits each hash."""
    found = np.ones(len(h), dtype=bool)
    for p in _places(h, 64 * len(words)):
        found &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def _add(words: np.ndarray, h: np.ndarray) -> None:
    for p in _places(h, 64 * len(words)):
        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))


def note_lines(cells: np.ndarray, batch: pa.RecordBatch) -> None:
    """Notes a batch (key, text) in cells, where words of the once-filter and of the twice-filter take turns."""
    once, twice = cells[0::2], cells[1::2]
    lines = Lines(*texts_as_bytes(batch.column(1)))
    long = lines.points >= LEAST
    own = np.unique(np.rec.fromarrays([lines.text[long], lines.hash[long]], names="t,h"))["h"] if long.any() else np.zeros(0, dtype=np.uint64)
    h, times = np.unique(own, return_counts=True)
    _add(twice, h[(times > 1) | _has(once, h)])
    _add(once, h)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a | b
    out[1::2] |= a[0::2] & b[0::2]
    return out


def filter_bits(lines: int) -> int:
    """Bits of each filter for so many lines."""
    return min(MOST_BITS, 1 << max(20, (BITS_A_LINE * lines - 1).bit_length()))


def twice_filter(docs: DataFrame) -> np.ndarray:
    """The words of the filter of lines that are in two rows; docs has a key and a text."""
    text = F.col(docs.columns[1])
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.translate(text, "\n", "")) + 1)).first()[0] or 0
    width = 2 * filter_bits(lines) // 64
    assert width % (2 * PIECES) == 0
    return fixed_array(docs, width, "uint64", note_lines, merged)[1::2].copy()


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_dropped and kept (the lines that stay, joined by \\n)."""
    spark, own = docs.sparkSession, f"doc {kind(docs, key)}"
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    known = rows.where("doc is not null")
    words = twice_filter(known)
    shared = spark.sparkContext.broadcast(words)

    def suspected(batch: pa.RecordBatch) -> tuple[Lines, np.ndarray]:
        lines = Lines(*texts_as_bytes(batch.column(1)))
        at = np.flatnonzero(lines.points >= LEAST)
        return lines, at[_has(shared.value, lines.hash[at])]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at = suspected(batch)
            if len(at):
                _, one = np.unique(np.rec.fromarrays([lines.text[at], lines.hash[at]], names="t,h"), return_index=True)
                at = at[np.sort(one)]
            digests = pa.array([lines.digest(i) for i in at.tolist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lines.text[at])), digests], names=["doc", "line"])

    def unsuspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a suspected line, and all rows without a key, as they are."""
        for batch in batches:
            lines, at = suspected(batch)
            free = np.ones(batch.num_rows, dtype=bool)
            free[lines.text[at]] = False
            free |= batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n = pa.array(np.diff(lines.first)[free])
            chosen = batch.filter(pa.array(free))
            yield pa.RecordBatch.from_arrays([chosen.column(0), n, pa.array(np.zeros(len(n), dtype=np.int64)), chosen.column(1).fill_null("")], names=["doc", "n_lines", "n_dropped", "kept"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other texts, compressed."""
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lines, at = suspected(batch)
            rows_of = np.unique(lines.text[at])
            chosen = batch.take(pa.array(rows_of))
            yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array([press.compress(t.encode()) for t in chosen.column(1).to_pylist()], type=pa.binary())], names=["doc", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for body, gone in zip(unpacked(batch.column("packed")), batch.column("gone").to_pylist(), strict=True):
                if not gone:
                    out.append((body.count(b"\n") + 1, 0, body.decode()))
                    continue
                lost, lines = set(gone), Lines(np.frombuffer(body, dtype=np.uint8), np.array([0, len(body)]))
                n = len(lines.start)
                out_of = {i for i in np.flatnonzero(lines.points >= LEAST).tolist() if lines.digest(i) in lost}
                stay = [body[a:b] for i, (a, b) in enumerate(zip(lines.start.tolist(), lines.end.tolist(), strict=True)) if i not in out_of]
                out.append((n, len(out_of), b"\n".join(stay).decode()))
            columns = [pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", "n_lines", "n_dropped", "kept"])

    with scratch(spark):
        held = materialize(known.mapInArrow(suspects, f"{own}, line binary"), "lines-suspects")
        seen = held.groupBy("line").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        first = materialize(seen.select("line", "least"), "lines-first")
        gone = held.join(first, "line").where("doc > least").groupBy(F.col("doc").alias("of")).agg(F.collect_set("line").alias("gone"))
        gone = materialize(gone, "lines-gone", keep=True)
    result = f"{own}, n_lines long, n_dropped long, kept string"
    met = known.mapInArrow(packed, f"{own}, packed binary").join(gone, F.col("doc") == F.col("of"), "left").select("doc", "packed", "gone")
    return rows.mapInArrow(unsuspected, result).unionByName(met.mapInArrow(cut, result)).withColumnRenamed("doc", key)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}
SQL = {
    "op12_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), seen AS (
  SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE least IS NOT NULL AND least < doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE least IS NULL OR least >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN seen USING (k) GROUP BY doc_id
"""
}
