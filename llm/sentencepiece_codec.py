"""SentencePiece encoding and decoding: merges in the model's order, or Viterbi over an Aho-Corasick automaton.

The scores of a BPE model are ranks of merges: of all neighbours whose joined text is
a piece, the pair of the highest score is joined first, the leftmost of ties.  Those
of a unigram model are log probabilities: the automaton follows its output links at
every position, and each piece that ends there relaxes the best score of the prefix.
A character that no piece covers is spelt in byte pieces.  Blanks are written as the mark U+2581 in front of a word; a
mark that stands in the text itself is spelt in bytes, so that decoding gives back
the very text.  If no piece of the vocabulary holds a mark behind another character
(checked when it is loaded), words are solved apart, and each distinct
word of a slice of texts is solved once; the words of a BPE model are joined
together, one merge of every word at a time, in numpy.

Defined results: null gives null ids; an empty text gives an empty list; texts are
encoded whole; equal scores of paths go to the one whose last piece is longer.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Parameter: path of a SentencePiece model file on every machine; never copied into this repository.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
BYTE_SCORE = -1e6
#: Most distinct words solved one by one that a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Units of at most so many characters keep the scores of their neighbours in a list, longer ones in a heap.
SHORT = 64
#: Units are joined together among those of up to so many characters, in blocks of so many cells; fewer units than FEW one by one.
WIDTHS, CELLS, FEW = (8, 16, 32, SHORT), 1 << 18, 200
#: Odd multiplier of the keys of pairs.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts, and ids, that are handled at once (a longer row is a slice of its own).
SLICE_BYTES, SLICE_IDS = 4_000_000, 1_000_000
BPE, USER_DEFINED, UNUSED = 2, 4, 5


class Codec:
    """The pieces of one model with their scores, and the automaton over them."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        bpe = proto.trainer_spec.model_type == BPE
        if bpe and any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("merges around user-defined or unused pieces are not built")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, dtype=np.int32)
        self.value: list[bytes] = [b""] * n
        self.automaton = ahocorasick.Automaton()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.breaks = True
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.value[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece:
                self.value[i] = piece.replace(MARK, " ").encode()
                self.ids[piece], self.score[piece] = i, float(model.get_score(i))
                self.automaton.add_word(piece, (i, len(piece), self.score[piece]))
                self.breaks &= MARK not in piece.lstrip(MARK)
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces; texts could not be spelt in full")
        self.automaton.make_automaton()
        self.values = pa.array(self.value, type=pa.large_binary())
        self.solve = self.merged if bpe else self.best
        self.known: dict[str, tuple[int, ...]] = {}
        self.mark_bytes = tuple(self.bytes[list(MARK.encode())].tolist())
        self.together = bpe
        if bpe:
            self._number_pairs()

    def _number_pairs(self) -> None:
        """Symbols are the ids of pieces, and n + code point for characters that are no piece; each pair that makes a piece has a key."""
        n, ids = len(self.pieces), self.ids
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[0x20] = ids.get(MARK, n + 0x20)  # a blank is written as the mark, a mark of the text itself is spelt in bytes
        self.symbol[ord(MARK)] = n + ord(MARK)

        def number(part: str) -> int | None:
            return int(self.symbol[0x20 if part == MARK else ord(part)]) if len(part) == 1 else ids.get(part)

        pairs: dict[int, int] = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)) if " " not in piece else ():
                if (left := number(piece[:cut])) is not None and (right := number(piece[cut:])) is not None:
                    pairs[left << 32 | right] = i
        keys, made = np.fromiter(pairs, dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        bits = max(4, (3 * len(pairs)).bit_length())
        self.pair_shift, self.pair_keys, self.pair_ids = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        at, wait = self._home(keys), np.arange(len(keys))
        while len(wait):  # a key lies in the first free cell from its home on
            cells, ahead = np.unique(at[wait], return_index=True)
            free = ahead[self.pair_keys[cells] < 0]
            put = wait[free]
            self.pair_keys[at[put]], self.pair_ids[at[put]] = keys[put], made[put]
            wait = np.delete(wait, free)
            at[wait] = (at[wait] + 1) & ((1 << bits) - 1)
        #: By piece: the place of its score, smallest first, equal ones the same; the last is that of no piece (-1).
        self.rank = np.full(n + 1, -1, dtype=np.int32)
        own = list(ids.values())
        self.rank[own] = np.unique([self.score[p] for p in ids], return_inverse=True)[1]

    def best(self, unit: str) -> tuple[int, ...]:
        """The best path over one unit: each piece that ends at a position relaxes the score there."""
        n = len(unit)
        score, step, piece, settled = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1), 0
        for end, (i, size, s) in self.automaton.iter(unit):
            end += 1
            while settled < end:  # a character spelt in bytes
                settled += 1
                score[settled] = score[settled - 1] + BYTE_SCORE
            at = score[end - size] + s
            if at > score[end] or (at == score[end] and size > step[end]):
                score[end], step[end], piece[end] = at, size, i
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += self.bytes[list(unit[n - 1].replace(MARK, " ").encode()[::-1])].tolist()
            n -= step[n]
        return tuple(reversed(out))

    def merged(self, unit: str) -> tuple[int, ...]:
        """The unit's characters joined in the order of the merges' scores."""
        parts = self._joined(unit) if len(unit) <= SHORT else self._joined_by_heap(unit)
        ids = tuple(map(self.ids.get, parts))
        if None not in ids:
            return ids
        out: list[int] = []
        for part, i in zip(parts, ids, strict=True):
            if i is None:
                out += self.bytes[list(part.replace(MARK, " ").encode())].tolist()
            else:
                out.append(i)
        return tuple(out)

    def _joined(self, unit: str) -> list[str]:
        get, never, parts = self.score.get, float("-inf"), list(unit)
        gain = list(map(get, map(add, unit, unit[1:]), repeat(never)))
        while gain and (most := max(gain)) > never:
            i = gain.index(most)
            part = parts[i] = parts[i] + parts.pop(i + 1)
            del gain[i]
            if i:
                gain[i - 1] = get(parts[i - 1] + part, never)
            if i < len(gain):
                gain[i] = get(part + parts[i + 1], never)
        return parts

    def _joined_by_heap(self, unit: str) -> list[str]:
        get, parts, n = self.score.get, list(unit), len(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, text = heapq.heappop(heap)
            b = after[a]
            if not parts[a] or b >= n or len(parts[a]) + len(parts[b]) != len(text):
                continue  # one of the two has been joined otherwise
            parts[a], parts[b], after[a] = text, "", after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in parts if x]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> self.pair_shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, else -1."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        met = self.pair_keys[at]
        on = np.flatnonzero((met != keys) & (met >= 0))
        while len(on):
            at[on] = further = (at[on] + 1) & (len(self.pair_keys) - 1)
            met[on] = then = self.pair_keys[further]
            on = on[(then != keys[on]) & (then >= 0)]
        return np.where(met == keys, self.pair_ids[at], np.int32(-1))

    def _joined_together(self, symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units symbols[first:first + size], one behind another, and how many each has: a merge of every unit a round."""
        k, row = len(first), width + 2  # a unit's row begins and ends with a cell of no symbol (-1)
        sym = np.full((k, row), -1, dtype=np.int32)
        inside = np.arange(width) < sizes[:, None]
        sym[:, 1:-1][inside] = symbols[(first[:, None] + np.arange(width))[inside]]
        pair = np.zeros((k, row), dtype=bool)
        pair[:, 1:-2] = inside[:, 1:]
        flat, here = sym.reshape(-1), np.flatnonzero(pair)
        makes, gain = np.full(k * row, -1, dtype=np.int32), np.full((k, row), -1, dtype=np.int32)
        makes[here] = self._pairs(flat[here], flat[here + 1])
        most = gain.reshape(-1)
        most[:] = self.rank[makes]
        before, after = np.arange(-1, k * row - 1, dtype=np.int32), np.arange(1, k * row + 1, dtype=np.int32)
        active = np.arange(k)
        while True:
            at = active * row + gain[active].argmax(axis=1)
            going = most[at] >= 0
            active, at = active[going], at[going]
            if not len(active):
                break
            new, last = makes[at], after[at]
            left, right = before[at], after[last]
            flat[at], flat[last], most[last] = new, -1, -1
            after[at], before[right] = right, at
            changed = np.concatenate((left, at))
            makes[changed] = now = self._pairs(flat[changed], flat[np.concatenate((at, right))])
            most[changed] = self.rank[now]
        alive = sym >= 0
        return self._spelt(sym[alive], alive.sum(axis=1))

    def _spelt(self, parts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece in byte pieces."""
        n = len(self.pieces)
        bare = parts >= n
        if not bare.any():
            return parts, counts
        points = (parts[bare] - n).astype("<u4")
        size = np.ones(len(parts), dtype=np.int64)
        size[bare] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(parts, size)
        out[np.repeat(bare, size)] = self.bytes[np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        return out, np.diff(ends)

    def _alone(self, unit: str) -> tuple[int, ...]:
        if unit == MARK:
            return self.mark_bytes
        ids = self.known.get(unit)
        if ids is None:
            ids = self.solve(unit.replace(" ", MARK))
            if len(unit) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[unit] = ids
        return ids

    def _solved(self, units: pa.Array) -> pa.Array:
        """Lists of the ids of distinct units, whose blanks stand for marks."""
        sizes = pc.utf8_length(units).to_numpy()
        order, flats, counts, apart = [], [], [], [np.flatnonzero(sizes > (SHORT if self.together else 0))]
        if self.together:
            first, (ends, data) = np.cumsum(sizes) - sizes, _bytes_of(units)
            symbols = self.symbol[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")]
            for less, width in zip((0, *WIDTHS), WIDTHS, strict=False):
                rows = np.flatnonzero((sizes > less) & (sizes <= width))
                if len(rows) < FEW:
                    apart.append(rows)
                    continue
                for i in range(0, len(rows), step := CELLS // width):
                    some = rows[i : i + step]
                    ids, n = self._joined_together(symbols, first[some], sizes[some], width)
                    order.append(some)
                    flats.append(ids)
                    counts.append(n)
        rest = np.concatenate(apart)
        lists = [self._alone(unit) for unit in units.take(pa.array(rest)).to_pylist()]
        order.append(rest)
        flats.append(np.array([i for ids in lists for i in ids], dtype=np.int64))
        counts.append(np.array([len(ids) for ids in lists], dtype=np.int64))
        place = np.empty(len(units), dtype=np.int64)
        place[np.concatenate(order)] = np.arange(len(units))
        return _lists(np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(flats)).take(pa.array(place))

    def _encoded(self, texts: pa.Array) -> pa.Array:
        whole, nothing, blank = texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        whole = pc.if_else(pc.equal(whole, nothing), whole, pc.binary_join_element_wise(nothing, whole, blank))  # every text begins with a mark
        ends, data = _bytes_of(whole)
        first = np.zeros(len(data) + 4, dtype=bool)
        if self.breaks:
            blanks = data == 0x20
            first[: len(data)] = blanks
            first[1 : len(data)] &= ~blanks[:-1]
        first[ends] = True
        three = MARK.encode()
        marks = np.flatnonzero(data[:-2] == three[0])
        marks = marks[(data[marks + 1] == three[1]) & (data[marks + 2] == three[2])]  # of the text itself: units of their own, which no piece spans
        first[marks] = first[marks + 3] = True
        starts = np.flatnonzero(first[: len(data)])
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        found = self._solved(units.dictionary).take(units.indices)
        return _lists(found.offsets.to_numpy()[np.searchsorted(starts, ends)], found.values, texts.is_null())

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Lists of ids of a string array; null for null."""
        return pa.concat_arrays([_lists(np.zeros(1), np.zeros(0)), *map(self._encoded, _slices(texts, pc.binary_length(texts), SLICE_BYTES))])

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text])).to_pylist()[0]

    def _decoded(self, ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("a null among the ids of pieces")
        offsets, data = _bytes_of(self.values.take(flat))
        ends = offsets[np.r_[0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())]]
        whole = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(data))
        whole.validate(full=True)
        return pc.if_else(ids.is_valid(), pc.utf8_slice_codeunits(whole, 1), None).cast(pa.string())

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The texts that lists of ids spell, without the mark in front; null for null."""
        return pa.concat_arrays([pa.array([], pa.string()), *map(self._decoded, _slices(ids, pc.list_value_length(ids), SLICE_IDS))])

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32()))).to_pylist()[0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Limits (from 0) of the values of a large string or binary array, and its bytes."""
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return limits - limits[0], held[limits[0] : limits[-1]]


def _lists(limits: np.ndarray, ids: np.ndarray | pa.Array, null: pa.Array | None = None) -> pa.Array:
    values = ids if isinstance(ids, pa.Array) else pa.array(ids.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), values, mask=null)


def _slices(column: pa.Array, sizes: pa.Array, most: int) -> Iterator[pa.Array]:
    """The column in runs of rows: a run ends with the row that reaches the next multiple of `most`."""
    if len(column):
        sizes = sizes.fill_null(0).to_numpy().astype(np.int64)
        run = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield column.slice(a, b - a)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, column: str, out: str, kind: str, function) -> DataFrame:
    """df with the column `out`: the Arrow array that function makes of the column's; no other column travels to Python."""
    return df.withColumn(out, F.arrow_udf(function, kind)(F.col(f"`{column}`")))


def encode_pieces(df: DataFrame, text: str = "text", out: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """df with the array<int> column `out`; a column of that name is replaced."""

    def encode(column: pa.Array) -> pa.Array:
        return codec(model).encode_column(column)

    return _mapped(df, text, out, "array<int>", encode)


def decode_pieces(df: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the string column `out`: the text that the pieces spell."""

    def decode(column: pa.Array) -> pa.Array:
        return codec(model).decode_column(column)

    return _mapped(df, ids, out, "string", decode)


def round_trip(df: DataFrame, text: str = "text", ids: str = "piece_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the columns of encode_pieces and decode_pieces; apart, both in one plan, Spark would encode once for the ids and again for the decoder."""

    def both(column: pa.Array) -> pa.Array:
        own = codec(model)
        found = own.encode_column(column)
        return pa.StructArray.from_arrays([found, own.decode_column(found)], names=["ids", "text"])

    pair = F.arrow_udf(both, "ids array<int>, text string")(F.col(f"`{text}`"))
    return df.withColumns({ids: pair["ids"], out: pair["text"]})


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of pieces, digests of the ids and of the decoded text, and whether it is the same text."""
    back = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
SQL: dict[str, str] = {}
