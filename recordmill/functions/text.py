"""Text columns: cleaning, slugs, snippets, counting, markup to text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col

BLANKS = r"[ \t\n\x0B\f\r]+"
#: Letters and digits whose compatibility decomposition is one ASCII letter or digit and marks, what they fold to, and the marks.
_FOLDED = {c: d for c in map(chr, range(0x80, 0x2FFF)) for d in ["".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))] if len(d) == 1 and d.isascii() and d.isalnum()}
_MARKS = "".join(c for c in map(chr, range(0x300, 0x2FFF)) if unicodedata.combining(c))
#: Named entities that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def squash(text) -> Column:
    """Trim and collapse white space; blank becomes null."""
    t = F.trim(F.regexp_replace(col(text), BLANKS, " "))
    return F.nullif(t, F.lit(""))


def first_filled(*columns) -> Column:
    return F.coalesce(*[squash(c) for c in columns])


def join_filled(separator: str, *columns) -> Column:
    """Non-blank parts joined; null when there are none."""
    return F.nullif(F.concat_ws(separator, *[squash(c) for c in columns]), F.lit(""))


def none_to_null(text) -> Column:
    t = squash(text)
    return F.when(F.lower(t).isin("none", "n/a", "[redacted]"), None).otherwise(t)


def slug(text, longest: int | None = None) -> Column:
    """Small ASCII letters and digits joined by '-'; accents go, '+' and '#' are spelt out, '&' separates."""
    t = F.lower(col(text))
    for a, b in (("&", " "), ("+", " plus "), ("#", " sharp ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "".join(_FOLDED) + _MARKS, "".join(_FOLDED.values()))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if longest:
        t = F.regexp_replace(F.substring(t, 1, longest), "-+$", "")
    return F.nullif(t, F.lit(""))


def once(value: Column, body) -> Column:
    """body(value), the value computed a single time however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def snippet(text, most: int = 300) -> Column:
    """At most `most` characters, cut at the last blank if that is beyond 60 %, trailing punctuation off, ' ...' put on."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, most)
        before = F.regexp_replace(head, " [^ ]*$", "")
        kept = F.when(F.char_length(before) > most * 0.6, before).otherwise(head)
        return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(kept, "[ ,.;:!?-]+$", ""), F.lit(" ...")))

    return once(squash(text), cut)


def word_count(text) -> Column:
    return F.regexp_count(col(text), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def letter_word_count(text) -> Column:
    """Runs of letters and digits, with inner apostrophes or hyphens."""
    return F.regexp_count(col(text), F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*")).cast("long")


def _numeric_entities(t: Column) -> Column:
    """&#8364; and &#x20AC; to their characters; numbers that are none stay as they are."""

    def decoded(part: Column) -> Column:
        hexed = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        number = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(part, r"^(\d{1,7});", 1)).try_cast("int")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(32)), 8, "0")), "UTF-32")
        return F.when(F.coalesce(good, F.lit(False)), F.concat(char, F.regexp_replace(part, r"^[xX]?[0-9A-Fa-f]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(t, "&#")
    return F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")).otherwise(t)


def decode_entities(text) -> Column:
    """Named and numeric entities; unknown ones stay."""
    t = _numeric_entities(col(text))
    for a, b in ENTITIES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_to_text(html) -> Column:
    """Blocks on lines of their own, list items as bullets, tags gone, entities decoded, at most one blank line."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>", "")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/h[1-6]|/ul|/ol|/li|/tr|/title)[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, r"(?s)<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def first_heading(markdown) -> Column:
    return squash(F.nullif(F.regexp_extract(col(markdown), r"(?m)^#{1,6}[ \t]+(.+)$", 1), F.lit("")))


def clear_email(text) -> Column:
    """`name (at) host [dot] tld` to an address."""
    t = F.regexp_replace(col(text), r"(?i) *[(\[{] *(at|@) *[)\]}] *", "@")
    return F.regexp_replace(t, r"(?i) *[(\[{] *(dot|\.) *[)\]}] *", ".")


def name_key(name) -> Column:
    """Company name without case, punctuation and legal form."""
    t = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9 ]+", " ")
    return squash(F.regexp_replace(t, r" (inc|llc|ltd|gmbh|ag|corp|co|sa|sas)( |$)", " "))


def category_of(kind, rules: list[tuple[str, str]], other: str) -> Column:
    """Label of the first pattern that fits."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(F.lower(col(kind)).rlike(pattern), label).otherwise(out)
    return out


def same_but_punctuation(a, b) -> Column:
    bare = lambda x: F.lower(F.regexp_replace(col(x), r"[^\p{L}\p{N}]+", ""))
    return bare(a) == bare(b)


def base_language(code) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(code), "^([A-Za-z]{2,3})", 1)), F.lit(""))


def same_language(a, b) -> Column:
    return (F.lower(col(a)) == F.lower(col(b))) | (base_language(a) == base_language(b))


def comma_list(text) -> Column:
    """Trimmed items of a comma list, first spelling of each kept."""
    items = F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return unique_any_case(items)


def unique_any_case(items) -> Column:
    items = col(items)
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def pretty_enum(text) -> Column:
    """SIZE_51_200 to 51-200, ONSITE_OR_REMOTE to onsiteOrRemote."""
    size = F.regexp_extract(col(text), r"^SIZE_(\d+)_(\d+)$", 1)
    words = F.split(F.lower(col(text)), "_")
    camel = F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.initcap), ""))
    return F.when(size != "", F.concat(size, F.lit("-"), F.regexp_extract(col(text), r"^SIZE_(\d+)_(\d+)$", 2))).otherwise(camel)


def excess_words(text, declared) -> Column:
    """A preview has fewer than 95 % of the declared words."""
    return word_count(text) < 0.95 * col(declared)


def any_keyword(keywords: list[str], *columns) -> Column:
    """Any keyword stands in the columns' texts, without case; no keywords: all fit."""
    if not keywords:
        return F.lit(True)
    hay = F.lower(F.concat_ws(" ", *[col(c) for c in columns]))
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(hay, k))
