"""Documents: chunks with overlap, page lines, captions, transcripts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.batches import by_slices, slices
from ..functions.dates import timecode
from ..functions.text import decode_entities

SKIPPED = {"script", "style", "noscript", "template", "head", "svg"}
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "nav", "header", "footer", "title", "main", "aside", "dd", "dt"}


def pieces_of(text: str, most: int) -> list[str]:
    """Cut at line ends, else sentence ends, else blanks, else anywhere."""
    out, rest = [], text.strip()
    while len(rest) > most:
        head = rest[: most + 1]
        cut = head.rfind("\n", 1)
        if cut <= 0:
            ends = [m.end() for m in re.finditer(r"[.!?](?= )", head[:most])]
            cut = ends[-1] if ends else head.rfind(" ", 1)
        if cut <= 0:
            cut = most
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [x for x in [*out, rest] if x]


def table_pieces(table: str, most: int) -> list[str]:
    """A Markdown table cut between rows, its two header lines repeated; one that does not fit so is cut as text."""
    lines = table.strip().split("\n")
    head, rows = lines[:2], lines[2:]
    room = most - sum(len(x) + 1 for x in head)
    if not rows or max(map(len, rows)) > room:
        return pieces_of(table, most)
    out: list[list[str]] = []
    size = most + 1
    for row in rows:
        if size + 1 + len(row) > room:
            out.append([])
            size = -1
        out[-1].append(row)
        size += 1 + len(row)
    return ["\n".join([*head, *part]) for part in out]


def is_table(paragraph: str) -> bool:
    return re.match(r"\|.*\|[ \t]*\n\|[ :|-]+\|", paragraph.strip()) is not None


def overlap_of(body: str, n: int) -> str:
    """The last n characters of a body, begun at a word."""
    if n <= 0 or not body:
        return ""
    tail = body[-n:]
    if len(body) > n and not body[-n - 1].isspace():
        tail = re.sub(r"^\S*\s*", "", tail)
    return tail.strip()


def spans_of(text: str | None, most: int = 1000, overlap: int = 100, separator: str = "\n\n") -> list[tuple[int, int, str]]:
    """Paragraphs packed into chunks of at most `most` characters, each led by the end of the body before: (start, end) of the body in the text, and the chunk."""
    text = text or ""
    room = most - (overlap + len(separator) if overlap else 0)
    bodies: list[list] = []
    limits = [0, *[x for m in re.finditer(r"\n\s*\n", text) for x in m.span()], len(text)]
    for lo, hi in zip(limits[::2], limits[1::2], strict=True):
        paragraph, at = text[lo:hi], lo
        cut = is_table(paragraph) and len(paragraph.strip()) > room
        for i, piece in enumerate((table_pieces if cut else pieces_of)(paragraph, room)):
            lines = piece.split("\n") if cut else [piece]
            lines = lines[2:] if i and len(lines) > 2 and lines[:2] == paragraph.strip().split("\n")[:2] else lines  # without the repeated header
            start = text.index(lines[0], at, hi)
            at = start
            for line in lines:
                at = text.index(line, at, hi) + len(line)
            if bodies and len(bodies[-1][2]) + len(separator) + len(piece) <= room:
                bodies[-1][1], bodies[-1][2] = at, bodies[-1][2] + separator + piece
            else:
                bodies.append([start, at, piece])
    leads = ["", *[overlap_of(b, overlap) for _, _, b in bodies]]
    return [(start, end, lead + separator + b if lead else b) for (start, end, b), lead in zip(bodies, leads, strict=False)]


def chunks_of(text: str | None, most: int = 1000, overlap: int = 100, separator: str = "\n\n") -> list[str]:
    """The chunks of spans_of."""
    return [chunk for _, _, chunk in spans_of(text, most, overlap, separator)]


def segment_chunks(segments: list[dict] | None, most: int = 1000, overlap: int = 100) -> list[tuple]:
    """Chunks over pages {page, markdown}: (chunk_no, start, end, first_page, last_page, heading, chunk).

    The pages, parted by a blank line, are one text; the pages of a chunk are those that its body touches (pages without a number
    count as none), its heading the last one at or before the body's start.
    """
    starts, pages, texts, at = [], [], [], 0
    for s in segments or []:
        starts.append(at)
        pages.append(s["page"])
        texts.append(s["markdown"] or "")
        at += len(texts[-1]) + 2
    whole = "\n\n".join(texts)
    marks = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t#]*$", whole)]
    heads = [m[0] for m in marks]
    out = []
    for i, (start, end, chunk) in enumerate(spans_of(whole, most, overlap)):
        touched = [p for p in pages[max(bisect_right(starts, start) - 1, 0) : bisect_right(starts, max(end - 1, start))] if p is not None]
        k = bisect_right(heads, start)
        out.append((i, start, end, min(touched, default=None), max(touched, default=None), marks[k - 1][1] if k else None, chunk))
    return out


def chunk_segments(df: DataFrame, key: str, segments: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """key and segment_chunks of a column array<struct<page, markdown>>."""
    return per_key(df, key, segments, "chunk_no long, start long, end long, first_page int, last_page int, heading string, chunk string", lambda x: segment_chunks(x, most, overlap))


def per_key(df: DataFrame, key: str, value: str, schema: str, rows_of: Callable[[object], list[tuple]]) -> DataFrame:
    """key, of whatever type and null too, and the columns of `schema` for each row that rows_of makes of a value, in slices of Arrow batches."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            found = [(i, row) for i, x in enumerate(part.column(1)) for row in rows_of(x.as_py())]
            keys = part.column(0).take(pa.array([i for i, _ in found], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([row[j] for _, row in found], type=f.type) for j, f in enumerate(kinds)]], names=[key, *kinds.names])

    return df.select(F.col(f"`{key}`"), F.col(f"`{value}`")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def chunk_documents(df: DataFrame, key: str, text: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_no and chunk."""
    return per_key(df, key, text, "chunk_no long, chunk string", lambda t: list(enumerate(chunks_of(t, most, overlap))))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.skip, self.at = [""], [], [], None

    def handle_starttag(self, tag, attrs):
        if self.skip and self.skip[-1] == "head" and tag not in IN_HEAD:
            self.skip.pop()  # the end of a head may be left out
        if tag in SKIPPED or tag == "title" and self.skip:
            self.skip.append(tag)
        if tag in BLOCKS:
            self.lines.append("")
        if tag == "a":
            self.at = (dict(attrs).get("href") or "", len(self.lines), len(self.lines[-1]))

    def handle_endtag(self, tag):
        if tag in self.skip:  # inner ones that were never closed end with it
            del self.skip[self.skip.index(tag) :]
        if tag in BLOCKS:
            self.lines.append("")
        if tag == "a" and self.at:
            self.links.append(self.at[0])
            self.at = None

    def handle_data(self, data):
        if self.skip and self.skip[-1] == "head" and data.strip():
            self.skip.pop()
        if not self.skip:
            self.lines[-1] += data


def page_of(html: str | None) -> tuple[list[str], list[str]]:
    """Visible lines of a page and the targets of its links."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return [x for x in (" ".join(line.split()) for line in page.lines) if x], page.links


def page_lines(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, lines and links of each page."""
    return per_key(df, key, html, "lines array<string>, links array<string>", lambda x: [page_of(x)])


def cues(segments: Column, numbered: bool = True, mark: str = ",") -> Column:
    """Caption text from an array of struct(start, end, text, speaker)."""

    def cue(s: Column, i: Column) -> Column:
        times = F.concat(timecode(s["start"], mark), F.lit(" --> "), timecode(s["end"], mark))
        voice = F.when(s["speaker"].isNotNull() & F.lit(not numbered), F.concat(F.lit("<v "), s["speaker"], F.lit(">"))).otherwise("")
        head = F.concat((i + 1).cast("string"), F.lit("\n")) if numbered else F.lit("")
        return F.concat(head, times, F.lit("\n"), voice, s["text"], F.lit("\n"))

    body = F.array_join(F.transform(segments, cue), "\n")
    return body if numbered else F.concat(F.lit("WEBVTT\n\n"), body)


def parse_cues(text: Column) -> Column:
    """Array of struct(start, end, text) from SRT or WebVTT text."""
    stamp = r"((?:\d{2}:)?\d{2}:\d{2}[.,]\d{3})"
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n"), lambda b: b.rlike(f"{stamp} --> {stamp}"))

    def seconds(t: Column) -> Column:
        parts = F.split(F.replace(t, F.lit(","), F.lit(".")), ":")
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))

    return F.transform(
        blocks,
        lambda b: F.struct(
            F.round(seconds(F.regexp_extract(b, f"{stamp} --> ", 1)), 3).alias("start"),
            F.round(seconds(F.regexp_extract(b, f" --> {stamp}", 1)), 3).alias("end"),
            F.regexp_replace(F.regexp_replace(F.regexp_replace(b, f"(?s)^.*?--> {stamp}[^\n]*\n?", ""), "<[^>]+>", ""), r"^\s+|\s+$", "").alias("text"),
        ),
    )


def timed_segments(xml: Column) -> Column:
    """Array of struct(start, end, text) of timed text: <text start dur> in seconds or <p t d> in milliseconds; blank ones go."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)(<(?:text|p)\b[^>]*>.*?</(?:text|p)>)"), 1)

    def segment(x: Column) -> Column:
        value = lambda name: F.regexp_extract(x, rf'^<[^>]*\s{name}="([0-9.]+)"', 1).try_cast("double")
        start, length = F.coalesce(value("start"), value("t") / 1000), F.coalesce(value("dur"), value("d") / 1000, F.lit(0.0))
        body = decode_entities(decode_entities(F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^>]*>|</[^>]*>$", ""), "<[^>]+>", "")))
        return F.struct(start.alias("start"), (start + length).alias("end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))

    return F.filter(F.transform(found, segment), lambda s: s["start"].isNotNull() & (s["text"] != ""))


def with_values(lines: Column) -> Column:
    """A line that is only a label ('Phone:') takes the next line as its value, unless that is a label too."""
    label = lambda x: F.coalesce(x.rlike(r":\s*$"), F.lit(False))
    after = lambda i: F.get(lines, i + 1)
    taken = lambda x, i: (i > 0) & ~label(x) & label(F.get(lines, i - 1))
    merged = F.transform(lines, lambda x, i: F.when(taken(x, i), None).when(label(x) & after(i).isNotNull() & ~label(after(i)), F.concat(F.rtrim(x), F.lit(" "), F.ltrim(after(i)))).otherwise(x))
    return F.array_compact(merged)


def sentences(words: list[dict], gap: float, span: float, most: int) -> list[dict]:
    out: list[dict] = []
    for w in words:
        last = out[-1] if out else None
        joins = (
            last is not None and last["speaker"] == w["speaker"] and w["start"] - last["end"] < gap and w["end"] - last["start"] <= span
            and last["size"] + 1 + len(w["text"]) < most and last["text"][-1][-1:] not in (".", "!", "?")
        )
        if joins:
            last["text"].append(w["text"])
            last["end"], last["size"] = w["end"], last["size"] + 1 + len(w["text"])
        else:
            out.append({"start": w["start"], "end": w["end"], "text": [w["text"]], "speaker": w["speaker"], "size": len(w["text"])})
    return [{"start": x["start"], "end": x["end"], "text": " ".join(x["text"]), "speaker": x["speaker"]} for x in out]


def sentences_of(words: Column, gap: float = 1.5, span: float = 15.0, most: int = 300) -> Column:
    """Adjacent words of one speaker merged up to a sentence end: array of struct(start, end, text, speaker), sorted; linear in the words."""
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("speaker", pa.string())]))

    @F.arrow_udf("array<struct<start:double,end:double,text:string,speaker:string>>")
    def merged(lists: pa.Array) -> pa.Array:
        return by_slices(lists, kind, lambda xs: [None if x is None else sentences(x, gap, span, most) for x in xs])

    return merged(words)
