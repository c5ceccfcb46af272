"""Helpers over unknown or loosely shaped JSON and nested lists."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash, unique_any_case


def joined_lists(*lists: Column) -> Column:
    """Lists one after the other, the first spelling of each item kept."""
    empty = F.array().cast("array<string>")
    return unique_any_case(F.filter(F.concat(*[F.coalesce(x, empty) for x in lists]), lambda x: F.trim(x) != ""))


def prefixed_tags(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the tags that have it, each once."""
    own = F.filter(tags, lambda t: F.startswith(t, F.lit(prefix)))
    return F.array_distinct(F.transform(own, lambda t: F.substring(t, len(prefix) + 1, 1_000_000)))


def text_at(node: Column, *path: str) -> Column:
    """Trimmed text under a path of names of a variant, null where it leads nowhere."""
    return squash(F.try_variant_get(node, "$" + "".join(f"['{p}']" for p in path), "string"))


def runs_text(node: Column) -> Column:
    """{simpleText} or {runs: [{text}]} to text."""
    runs = F.transform(F.try_variant_get(node, "$.runs", "array<variant>"), lambda r: F.coalesce(F.try_variant_get(r, "$.text", "string"), F.lit("")))
    return F.coalesce(F.try_variant_get(node, "$.simpleText", "string"), F.nullif(F.array_join(runs, ""), F.lit("")))


def _each(value):
    """All values of a JSON tree, depth first, parents before children."""
    stack = [value]
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, dict):
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def values_under(text: Column, *names: str) -> Column:
    """JSON texts of all values that stand under one of the names, wherever they are, in order."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        out = [[json.dumps(x[n], ensure_ascii=False) for x in _each(_parsed(t)) if isinstance(x, dict) for n in names if n in x] for t in texts.to_pylist()]
        return pa.array(out, type=pa.list_(pa.string()))

    return found(text)


def version_pair(text: Column) -> Column:
    """The version of the first [number, "x.y"] pair of a JSON tree."""

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        pairs = lambda t: (x[1] for x in _each(_parsed(t)) if isinstance(x, list) and len(x) == 2 and type(x[0]) in (int, float) and isinstance(x[1], str) and re.fullmatch(r"\d+(\.\d+)+", x[1]))
        return pa.array([next(pairs(t), None) for t in texts.to_pylist()], type=pa.string())

    return found(text)


def tolerant(text: Column, schema: str) -> Column:
    """A struct by schema; anything unexpected is null, whole or by field."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def group_of(value: Column, groups: dict[str, list[str]]) -> Column:
    """The group that lists the value, itself when it is a group."""
    out = F.when(value.isin(list(groups)), value)
    for name, members in groups.items():
        out = out.when(value.isin(members), F.lit(name))
    return out


def _inline(node) -> str:
    """Text of a node's inline content."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if not isinstance(x, dict):
            continue
        if x.get("type") == "text":
            out.append(x["text"] if isinstance(x.get("text"), str) else "")
        elif x.get("type") == "hard_break":
            out.append("\n")
        elif isinstance(x.get("content"), list):
            stack += reversed(x["content"])
    return "".join(out)


def rich_blocks(document) -> list[str]:
    """Blocks of a rich-text document tree in order, list items led by their mark; of any depth."""
    blocks, stack = [], [(document, "")]
    while stack:
        node, mark = stack.pop()
        if not isinstance(node, dict):
            continue
        kind, inner = node.get("type"), node["content"] if isinstance(node.get("content"), list) else []
        if kind in ("doc", "blockquote"):
            below = [(x, mark) for x in inner]
        elif kind in ("bullet_list", "ordered_list"):
            below = [(x, f"{i}. " if kind == "ordered_list" else "- ") for i, x in enumerate(inner, 1)]
        elif kind == "list_item":
            below = [(x, "" if i else mark) for i, x in enumerate(inner)]
        else:
            below = []
            text = "---" if kind == "horizontal_rule" else _inline(node).strip()
            if text:
                blocks.append(text if kind == "horizontal_rule" else mark + text)
        stack += reversed(below)
    return blocks


def rich_text(document: Column) -> Column:
    """Plain text of a JSON document tree (doc, lists, quotes, rules, paragraphs, text, hard breaks), blocks parted by a blank line; else null."""

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append("\n\n".join(rich_blocks(_parsed(t))).strip() or None)
            except RecursionError:  # deeper than the JSON reader goes
                out.append(None)
        return pa.array(out, type=pa.string())

    return plain(document)


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<data>.*?)\]\]>|<[?!][^>]*>|</(?P<end>[^\s>]+)\s*>|<(?P<name>[A-Za-z_][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?P<empty>/?)>|(?P<text>[^<]+|<)", re.S)


def xml_rows(text: str | None) -> list[dict]:
    """Elements of an XML text depth-first: at, parent (null at the top), depth, name (without prefix) and text (its own, trimmed; null if blank).

    End tags that close nothing are passed over; elements without an end tag end with the one around them.
    """
    from html import unescape

    rows: list[dict] = []
    open_: list[int] = []
    for m in _MARKUP.finditer(text or ""):
        if m["name"]:
            rows.append({"at": len(rows), "parent": open_[-1] if open_ else None, "depth": len(open_), "name": m["name"].rpartition(":")[2], "text": []})
            if not m["empty"]:
                open_.append(len(rows) - 1)
        elif m["end"]:
            name = m["end"].rpartition(":")[2]
            for i in range(len(open_) - 1, -1, -1):
                if rows[open_[i]]["name"] == name:
                    del open_[i:]
                    break
        elif open_ and (m["text"] or m["data"]):
            rows[open_[-1]]["text"].append(m["data"] if m["data"] else unescape(m["text"]))
    return [{**r, "text": "".join(r["text"]).strip() or None} for r in rows]


def xml_nodes(text: Column) -> Column:
    """xml_rows as an array of struct(at, parent, depth, name, text): the general form of XML trees, to be exploded and joined on parent."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<at:int,parent:int,depth:int,name:string,text:string>>")
    def nodes(texts: pa.Array) -> pa.Array:
        return pa.array([xml_rows(t) for t in texts.to_pylist()], type=kind)

    return nodes(text)
