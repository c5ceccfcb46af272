"""Timed text: splitting, packing into chunks, choice of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..types import join_keys
from .documents import parse_cues, per_key, pieces_of

#: Preference of published formats.
FORMATS = ("vtt", "srt", "json", "text", "html")
Segment = tuple[float, float, str]


def split_segment(segment: Segment, most: int) -> list[Segment]:
    """Pieces of at most `most` characters; times by the share of characters, 3 decimals."""
    start, end, text = segment
    out, at, length = [], 0, max(1, len(text))
    for piece in pieces_of(text, most):
        begin = text.index(piece, at)
        at = begin + len(piece)
        out.append((round(start + (end - start) * begin / length, 3), round(start + (end - start) * at / length, 3), piece))
    return out


def pack_segments(segments: list[Segment], most: int, overlap: int) -> list[Segment]:
    """Chunks of whole segments joined by blanks, each led by as many whole segments of the one before as fit the overlap."""
    small = [p for s in segments for p in split_segment(s, most)]
    chunks: list[list[Segment]] = []
    now: list[Segment] = []
    length = lambda xs: sum(len(x[2]) + 1 for x in xs) - 1
    for s in small:
        if now and length([*now, s]) > most:
            chunks.append(now)
            lead: list[Segment] = []
            for x in reversed(now):
                if length([x, *lead]) > overlap or length([x, *lead, s]) > most:
                    break
                lead.insert(0, x)
            now = lead
        now = [*now, s]
    if now:
        chunks.append(now)
    return [(c[0][0], c[-1][1], " ".join(x[2] for x in c)) for c in chunks]


def chunk_transcripts(df: DataFrame, key: str, segments: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_no, start, end and text from an array of struct(start, end, text)."""

    def rows_of(xs: list[dict] | None) -> list[tuple]:
        own = sorted((float(x["start"]), float(x["end"]), x["text"]) for x in xs or [])
        return [(i, *c) for i, c in enumerate(pack_segments(own, most, overlap))]

    return per_key(df, key, segments, "chunk_no long, start double, end double, text string", rows_of)


def best_track(tracks: Column, languages: list[str]) -> Column:
    """The track of the first wanted language that has one: manual before automatic, the exact code before its base."""

    def rank(t: Column) -> Column:
        exact = F.coalesce(F.array_position(F.array(*map(F.lit, languages)), t["language"]).cast("int"), F.lit(0))
        base = F.coalesce(F.array_position(F.array(*[F.lit(x.split("-")[0]) for x in languages]), F.split_part(t["language"], F.lit("-"), F.lit(1))).cast("int"), F.lit(0))
        place = F.when(exact > 0, exact * 4).when(base > 0, base * 4 + 2).otherwise(1 << 20)
        return place + F.when(t["automatic"], 1).otherwise(0)

    ranked = F.transform(tracks, lambda t: F.struct(rank(t).alias("rank"), t.alias("track")))
    best = F.array_min(F.transform(ranked, lambda r: r["rank"]))
    return F.when(best < (1 << 20), F.get(F.filter(ranked, lambda r: r["rank"] == best), F.lit(0))["track"])


def best_format(kinds: Column) -> Column:
    order = F.array(*map(F.lit, FORMATS))
    return F.get(F.filter(order, lambda f: F.array_contains(kinds, f)), F.lit(0))


#: Type of a list of segments; those of untimed texts have no times.
SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def _paragraphs(text: Column) -> Column:
    """Untimed segments, one for each paragraph."""
    found = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    nothing = F.lit(None).cast("double")
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.struct(nothing.alias("start"), nothing.alias("end"), x.alias("text")))


def _html_paragraphs(html: Column) -> Column:
    """Text of the block elements of a page, without head, scripts and navigation."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|head|nav|header|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    blocks = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"(?i)</?(?:p|div|li|h[1-6]|blockquote|section|article|tr|body)\b[^>]*>", "\n\n")
    return _paragraphs(decode_entities(F.regexp_replace(F.regexp_replace(blocks, r"(?i)<br\b[^>]*>", "\n"), "<[^>]+>", "")))


def published_segments(kind: Column, body: Column) -> Column:
    """Segments of a published transcript by its declared kind (one of FORMATS); null where it is none of that kind.

    A web page behind a link of another kind is no transcript, nor is one without text.
    """
    page = body.rlike(r"(?i)^\s*(?:<!doctype html|<html[\s>]|<head[\s>]|<body[\s>])")
    json = F.from_json(body, "segments array<struct<startTime:double,endTime:double,body:string>>")["segments"]
    timed = F.filter(F.transform(json, lambda s: F.struct(s["startTime"].alias("start"), F.coalesce(s["endTime"], s["startTime"]).alias("end"), F.trim(s["body"]).alias("text"))), lambda s: (s["text"] != "") & s["start"].isNotNull())
    own = (
        F.when(kind == "html", _html_paragraphs(body))
        .when(page, None)
        .when(kind.isin("vtt", "srt"), F.filter(parse_cues(body), lambda s: s["text"] != ""))
        .when(kind == "json", timed)
        .when(kind == "text", _paragraphs(body))
    )
    return F.when(F.size(own) > 0, own.cast(SEGMENTS))


def choose_transcripts(items: DataFrame, published: DataFrame, keys: list[str], own: str, only_published: bool = False) -> DataFrame:
    """items with source ('published', 'own' or null), kind, segments and note.

    published(*keys, kind, body) has any number of links for an item; the usable one of the kind that stands
    first in FORMATS is taken (of several of one kind the least hash of its text).  Else the item's `own` segments
    count, unless only_published.  Columns of items with these names are replaced.  note names the kinds that could not be used where none could.  Only the best link
    of an item is shuffled with its text on the reduce side; a null key is a key like others.
    """
    order = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("kind"))
    parsed = published.select(*keys, F.col("kind").alias("__kind"), F.when(order > 0, order).alias("__order"), published_segments(F.col("kind"), F.col("body")).alias("__segments"), F.xxhash64("body").alias("__tie"))
    usable = F.col("__segments").isNotNull()
    best = parsed.groupBy(*keys).agg(
        F.min_by(F.struct("__kind", "__segments"), F.when(usable, F.struct("__order", "__tie"))).alias("__best"),
        F.array_join(F.sort_array(F.collect_set(F.when(~usable, F.col("__kind")))), ", ").alias("__bad"),
    )
    both = join_keys(items, best, keys, "left")
    found = F.col("__best.__segments").isNotNull()
    mine = F.lit(not only_published) & (F.size(own) > 0)
    return both.select(
        *[c for c in items.columns if c not in ("source", "kind", "segments", "note")],
        F.when(found, "published").when(mine, "own").alias("source"),
        F.when(found, F.col("__best.__kind")).alias("kind"),
        F.when(found, F.col("__best.__segments")).when(mine, F.col(own).cast(SEGMENTS)).alias("segments"),
        F.when(~found & (F.col("__bad") != ""), F.concat(F.lit("unusable: "), F.col("__bad"))).alias("note"),
    )


def billed_minutes(source: Column, seconds: Column) -> Column:
    """Minutes begun, one at least, for a transcript of one's own; a published one costs none."""
    return F.when(source == "own", F.greatest(F.lit(1), F.ceil(seconds / 60))).otherwise(0).cast("long")


def metered(items: DataFrame, account: list[str], day: str, order: list[str], minutes: str, budget: Column) -> DataFrame:
    """Items that an account's budget pays for whole, in order: `spent` up to and with the item stays within it.

    The sum runs over the items of one day, moved on by the sums of the days before, so that no
    task holds more than one day of an account.  A null budget has no end, null minutes cost nothing.
    """
    cost = F.coalesce(F.col(minutes), F.lit(0))
    within = F.sum(cost).over(Window.partitionBy(*account, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    days = items.groupBy(*account, day).agg(F.sum(cost).alias("__sum"))
    before = Window.partitionBy(*account).orderBy(F.col(day).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    rows = join_keys(items.withColumn("__within", within), days, [*account, day])
    out = rows.withColumn("spent", (F.col("__within") + F.col("__before")).cast("long")).drop("__within", "__before")
    return out.where(budget.isNull() | (F.col("spent") <= budget))


def billed_chunks(items: DataFrame, key: str, segments: str, minutes: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of every item with chunk_count and billed: the whole item is billed on its first chunk, the others cost nothing.

    Chunks of untimed segments have no times and keep the order of the segments.  An item without segments
    has no chunk and no bill.  Nothing is shuffled.
    """

    def rows_of(x: dict) -> list[tuple]:
        own = [(s["start"], s["end"], s["text"]) for s in x["segments"] or []]
        timed = all(start is not None for start, _, _ in own)
        own = sorted((float(a), float(b), t) for a, b, t in own) if timed else [(float(i), float(i), t) for i, (_, _, t) in enumerate(own)]
        chunks = pack_segments(own, most, overlap)
        return [(i, len(chunks), a if timed else None, b if timed else None, t, (x["minutes"] or 0) if i == 0 else 0) for i, (a, b, t) in enumerate(chunks)]

    return per_key(items.select(key, F.struct(F.col(segments).alias("segments"), F.col(minutes).alias("minutes")).alias("__x")), key, "__x", "chunk_no long, chunk_count long, start double, end double, text string, billed long", rows_of)
