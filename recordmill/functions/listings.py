"""Fields of listings: pay, experience, products, flights, matches, media plans, coordinates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col, number, round_half_up

LAKH, CRORE = 100_000, 10_000_000


def indian_pay(text) -> Column:
    """'₹5L – ₹8L', '1.2 crore', 'Up to 12 lakh' to struct(low, high) in rupees."""
    t = F.lower(F.regexp_replace(col(text), "[₹, ]", ""))
    pattern = r"([0-9.]+)(l|lakh|lakhs|lpa|cr|crore|k)?(?:[-–to]+([0-9.]+)(l|lakh|lakhs|lpa|cr|crore|k)?)?"

    def amount(i: int, unit: Column) -> Column:
        n = number(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")))
        return round_half_up(n * F.when(unit.startswith("l"), LAKH).when(unit.startswith("cr"), CRORE).when(unit == "k", 1000).otherwise(1)).cast("long")

    u1, u2 = F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 4)
    first, second = amount(1, F.when(u1 != "", u1).otherwise(u2)), amount(3, F.when(u2 != "", u2).otherwise(u1))
    upto = t.startswith("upto")
    return F.struct(F.when(~upto, first).alias("low"), F.when(upto, first).otherwise(second).alias("high"))


def disclosed_pay(amount, currency) -> Column:
    """Amounts below the floor (5000 INR, 100 of others) count as undisclosed."""
    return F.when(col(amount) >= F.when(col(currency) == "INR", 5000).otherwise(100), col(amount))


def equity(text) -> Column:
    """struct(low, high) of the first and last percentage."""
    found = F.regexp_extract_all(col(text), F.lit(r"([0-9]+(?:\.[0-9]+)?) *%"), 1)
    return F.struct(number(F.get(found, F.lit(0))).alias("low"), number(F.when(F.size(found) > 0, F.element_at(found, -1))).alias("high"))


def from_cents(x) -> Column:
    return (col(x).cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def kilograms(grams) -> Column:
    return F.when(col(grams) > 0, round_half_up(col(grams) / 1000).cast("long"))


def coordinates(text) -> Column:
    """'48.1, 11.5' to struct(lat, lng) inside the ranges."""
    lat = number(F.nullif(F.regexp_extract(col(text), r"^ *(-?[0-9.]+) *[,;] *(-?[0-9.]+) *$", 1), F.lit("")))
    lng = number(F.nullif(F.regexp_extract(col(text), r"^ *(-?[0-9.]+) *[,;] *(-?[0-9.]+) *$", 2), F.lit("")))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def stops(layovers, legs) -> Column:
    """Number of stops: layovers, or legs less one where those are more."""
    return F.greatest(F.size(col(layovers)), F.size(col(legs)) - 1, F.lit(0)).cast("long")


def set_scores(text) -> Column:
    """'6-3, 7-6(4)' to an array of struct(a, b, tiebreak)."""
    found = F.filter(F.transform(F.split(col(text), "[,;]"), lambda s: F.trim(s)), lambda s: s.rlike(r"^\d+-\d+(\(\d+\))?$"))
    part = lambda s, i: F.nullif(F.regexp_extract(s, r"^(\d+)-(\d+)(?:\((\d+)\))?$", i), F.lit("")).try_cast("int")
    return F.transform(found, lambda s: F.struct(part(s, 1).alias("a"), part(s, 2).alias("b"), part(s, 3).alias("tiebreak")))


def set_finished(a, b) -> Column:
    """Six with two ahead, seven against five or six, or a match tiebreak from ten with two ahead."""
    high, low = F.greatest(a, b), F.least(a, b)
    return ((high == 6) & (high - low >= 2)) | ((high == 7) & low.isin(5, 6)) | ((high >= 10) & (high - low >= 2))


def match_winner(sets) -> Column:
    """1, 2 or null by finished sets won."""
    won = lambda f: F.size(F.filter(col(sets), lambda s: set_finished(s["a"], s["b"]) & f(s)))
    a, b = won(lambda s: s["a"] > s["b"]), won(lambda s: s["b"] > s["a"])
    return F.when(a > b, 1).when(b > a, 2).cast("long")


def swapped(pair, reverse) -> Column:
    """A pair turned round where it was listed the other way."""
    return F.when(col(reverse), F.struct(col(pair)[1].alias("first"), col(pair)[0].alias("second"))).otherwise(F.struct(col(pair)[0].alias("first"), col(pair)[1].alias("second")))


def decode_factor(width, height) -> Column:
    """Units of a full-HD area, a tenth of slack, one at least."""
    return F.greatest(F.lit(1), F.ceil(col(width) * col(height) / F.lit(1920 * 1080) - 0.1)).cast("long")


def size_tier(megapixels, bounds: list[tuple[float, str]], beyond: str) -> Column:
    out = F.lit(beyond)
    for bound, label in sorted(bounds, reverse=True):
        out = F.when(col(megapixels) <= bound, label).otherwise(out)
    return out


def target_bitrate(size_mb, seconds, audio_kbps: int = 128) -> Column:
    """Video kilobits a second that fit a file size, 100 at least."""
    return F.greatest(F.lit(100), F.floor(col(size_mb) * 8192 / col(seconds)) - audio_kbps).cast("long")


def frame_times(duration, n: int) -> Column:
    """n evenly spaced points inside a duration."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.round(col(duration) * i / (n + 1), 3))


def interval_times(duration, every: float, most: int) -> Column:
    count = F.least(F.lit(most), (F.floor(col(duration) / every) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(i * F.lit(every), 3))


def contact_sheet(n, columns: int, cell_w: int, cell_h: int) -> Column:
    rows = F.ceil(col(n) / columns)
    return F.struct(F.least(col(n), F.lit(columns)).cast("long").alias("columns"), rows.cast("long").alias("rows"), (F.least(col(n), F.lit(columns)) * cell_w).cast("long").alias("width"), (rows * cell_h).cast("long").alias("height"))


def round_code(label) -> Column:
    """'Semifinals' to SF, 'Round of 16' to R16, qualification with Q-."""
    t = F.lower(col(label))
    size = F.regexp_extract(t, r"(?:round of|1/)\s*([0-9]+)", 1)
    code = F.when(t.rlike("quarter"), "QF").when(t.rlike("semi"), "SF").when(size != "", F.concat(F.lit("R"), size)).when(t.rlike(r"\bfinal"), "F")
    return F.when(t.rlike("^qual"), F.concat(F.lit("Q-"), code)).otherwise(code)


def quoted_tags(text) -> Column:
    """'edm "deep house" live' to its tags."""
    found = F.regexp_extract_all(col(text), F.lit(r'("[^"]*"|[^\s"]+)'), 1)
    return F.filter(F.transform(found, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))), lambda x: x != "")


def remote(locations) -> Column:
    return F.exists(col(locations), lambda x: F.lower(x).rlike("remote|anywhere|work from home"))


def file_kind(content) -> Column:
    """Kind of a file by its first bytes."""
    h = F.hex(F.substring(col(content), 1, 16))
    return (
        F.when(h.startswith("25504446"), "pdf")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("47494638"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("61766966", "61766973"), "avif")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("68656963", "68656978", "6D696631"), "heic")
        .when(F.substring(h, 9, 8) == "66747970", "mp4")
        .when(h.startswith("504B0304"), "zip")
        .when(h.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(h.startswith("424D"), "bmp")
    )


def png_size(content) -> Column:
    """struct(width, height) from a PNG header."""
    h = F.hex(F.substring(col(content), 1, 24))
    side = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.when(h.startswith("89504E470D0A1A0A"), F.struct(side(33).alias("width"), side(41).alias("height")))


def _image_size(b: bytes | None) -> dict | None:
    size = None
    if b and b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        size = int.from_bytes(b[16:20]), int.from_bytes(b[20:24])
    elif b and b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        size = int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little")
    elif b and b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            size = int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
        elif b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif b[12:16] == b"VP8 ":
            size = int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
    elif b and b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            kind, length = b[at + 1], int.from_bytes(b[at + 2 : at + 4])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
                size = int.from_bytes(b[at + 7 : at + 9]), int.from_bytes(b[at + 5 : at + 7])
                break
            at += 1 if kind == 0xFF else 2 + length
    return None if size is None or 0 in size else {"width": size[0], "height": size[1]}


def image_size(content) -> Column:
    """struct(width, height) from the header of a PNG, JPEG, WebP or GIF file."""
    kind = pa.struct([("width", pa.int64()), ("height", pa.int64())])
    sizes = F.arrow_udf(lambda files: pa.array([_image_size(b) for b in files.to_pylist()], type=kind), "struct<width:long,height:long>")
    return sizes(col(content))


def media_streams(probe) -> Column:
    """struct(duration, width, height, video, audio) from a media probe's JSON."""
    p = F.from_json(col(probe), "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int>>")
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    return F.struct(number(p["format"]["duration"]).alias("duration"), first("video")["width"].alias("width"), first("video")["height"].alias("height"), first("video")["codec_name"].alias("video"), first("audio")["codec_name"].alias("audio"))
