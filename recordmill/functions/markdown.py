"""Markdown columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col


def normalise(markdown) -> Column:
    """No blanks at line ends, one blank line at most, blank lines round tables."""
    t = F.regexp_replace(F.regexp_replace(col(markdown), "\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    t = F.regexp_replace(t, r"(?m)^(?!\|)(.+)\n(?=\|)", "$1\n\n")
    t = F.regexp_replace(t, r"(?m)^(\|.*)\n(?!\||\n)(?=.)", "$1\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def promote_header(markdown) -> Column:
    """The first row of a table becomes its header where the header's cells are all empty."""
    return F.regexp_replace(col(markdown), r"(?m)^\|(?:[ \t]*\|)+[ \t]*\n(\|[ :|-]+\|)[ \t]*\n(\|.*)$", "$2\n$1")


def to_plain(markdown) -> Column:
    """Text without marks: comments, fences (not what they hold), rules, bullets, emphasis, links; table rows tab-separated."""
    t = F.regexp_replace(col(markdown), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(```|~~~).*$\n?", "")
    t = F.regexp_replace(t, r"(?m)^\|[ :|-]+\|$\n?", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*$\n?", "")
    t = F.regexp_replace(t, r"(?m)^\| *(.*?) *\|$", "$1")
    t = F.regexp_replace(t, r" *\| *", "\t")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^#{1,6}[ \t]+|^>[ \t]?|^([ \t]*)[-*+][ \t]+", "$1")
    t = F.regexp_replace(t, r"(\*\*|__|`)", "")
    return F.regexp_replace(t, r"(?<![\w*_])([*_])([^\s*_](?:[^*_\n]*[^\s*_])?)\1(?![\w*_])", "$2")


def sections(markdown, pattern: str = r"#{1,2} ") -> Column:
    """The text cut in front of each line that begins with the pattern."""
    return F.filter(F.transform(F.split(col(markdown), rf"\n(?={pattern})"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def table_rows(markdown) -> Column:
    """Cells of the table lines, rules left out."""
    lines = F.filter(F.split(col(markdown), "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^\|[ :|-]+\|$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\| *| *\|$", ""), r" *\| *"), lambda c: F.trim(c)))
