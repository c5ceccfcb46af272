"""Data that pages and responses carry inside: object literals, keyed blobs, attributes, linked data, envelopes, charsets.

What a regular expression can delimit stays in column functions; only the matching of
braces runs as an Arrow UDF, which gets the texts and returns the JSON text.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import decode_entities


def value_end(text: str, start: int) -> int:
    """Place behind the JSON array or object that begins at `start`; -1 if it is not closed."""
    closing, at = [], start
    while at < len(text):
        c = text[at]
        if c == '"':
            at += 1
            while at < len(text) and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
        elif c in "[{":
            closing.append("]" if c == "[" else "}")
        elif closing and c == closing[-1]:
            closing.pop()
            if not closing:
                return at + 1
        at += 1
    return -1


def _valid(text: str) -> str | None:
    try:
        json.loads(text)
    except ValueError:
        return None
    return text


def window_object(html: Column, name: str) -> Column:
    """The object literal assigned to window.<name>, as a variant."""

    @F.arrow_udf("string")
    def cut(pages: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for page in pages.to_pylist():
            at = (page or "").find(f"window.{name}")
            start = page.find("{", at) if at >= 0 else -1
            end = value_end(page, start) if start >= 0 else -1
            out.append(_valid(page[start:end]) if end >= 0 else None)
        return pa.array(out, type=pa.string())

    return F.try_parse_json(cut(html))


def keyed_blobs(html: Column, opening: str = "AF_initDataCallback({key:") -> Column:
    """Map from key to JSON text of the data blobs of a page; the last blob of a key stays."""

    @F.arrow_udf("array<struct<key:string,value:string>>")
    def cut(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            found, at = {}, 0
            while (at := (page or "").find(opening, at)) >= 0:
                at += len(opening)
                quote = page.find("'", at)
                key_end = page.find("'", quote + 1)
                data = page.find("data:", key_end)
                if min(quote, key_end, data) < 0:
                    break
                start = data + 5
                end = value_end(page, start) if page[start : start + 1] in ("[", "{") else -1
                if end > 0 and _valid(page[start:end]):
                    found[page[quote + 1 : key_end]] = page[start:end]
                    at = end
            out.append([{"key": k, "value": v} for k, v in found.items()])
        return pa.array(out, type=pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))

    return F.map_from_entries(cut(html))


def escaped_state(html: Column, marker: str) -> Column:
    """JSON inside a script string: marker = JSON.parse("..."), as a variant."""
    literal = F.nullif(F.regexp_extract(html, rf'(?s){marker}\s*=\s*JSON\.parse\(("(?:[^"\\]|\\.)*")\)', 1), F.lit(""))
    return F.try_parse_json(F.try_variant_get(F.try_parse_json(literal), "$", "string"))


def attribute_json(html: Column, attribute: str = "data-page") -> Column:
    """JSON of an attribute, its entities decoded, as a variant."""
    return F.try_parse_json(F.nullif(decode_entities(F.regexp_extract(html, rf'(?s)\s{attribute}="([^"]*)"', 1)), F.lit("")))


def linked_data(html: Column, kind: str = "Event$") -> Column:
    """The first linked-data script whose @type fits the pattern, as a variant."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    parsed = F.transform(scripts, lambda s: F.try_parse_json(s))
    return F.get(F.filter(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string").rlike(kind), F.lit(False))), F.lit(0))


def between(html: Column, left: str, right: str) -> Column:
    """JSON between the first left mark and the right mark behind it, as a variant."""
    tail = F.when(F.contains(html, F.lit(left)), F.substring_index(F.split(html, F.lit(_quoted(left)), 2)[1], right, 1))
    return F.try_parse_json(F.trim(tail))


def _quoted(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def rpc_payload(text: Column, rpc: str) -> Column:
    """The inner JSON of the first line of a batch response that holds the call's id, as a variant."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("[")))
    calls = F.flatten(F.transform(lines, lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"), F.array().cast("array<variant>"))))
    own = F.filter(calls, lambda c: F.coalesce(F.try_variant_get(c, "$[1]", "string") == rpc, F.lit(False)))
    return F.try_parse_json(F.try_variant_get(F.get(own, F.lit(0)), "$[2]", "string"))


#: Charset labels that mean windows-1252.
WESTERN = ["latin1", "iso-8859-1", "ascii", "us-ascii", "windows-1252", "cp1252"]


def charset(body: Column, content_type: Column) -> Column:
    """Label of the header, else of a meta or xml declaration in the first 4 KiB, else utf-8."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    label = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))
    found = F.coalesce(label(content_type, r"(?i)charset=[\"']?([A-Za-z0-9_-]+)"), label(head, r"(?i)<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)"), label(head, r"(?i)<\?xml[^>]+encoding=[\"']([A-Za-z0-9_-]+)"), F.lit("utf-8"))
    return F.when(found.isin(WESTERN), "windows-1252").otherwise(found)


def decoded_body(body: Column, content_type: Column) -> Column:
    """Text of a response body: strict UTF-8 where it is so declared and valid, else windows-1252."""

    @F.arrow_udf("string")
    def western(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("cp1252", "replace") for b in bodies.to_pylist()], type=pa.string())

    return F.when((charset(body, content_type) != "windows-1252") & F.coalesce(F.is_valid_utf8(body.cast("string")), F.lit(False)), body.cast("string")).otherwise(western(body))
