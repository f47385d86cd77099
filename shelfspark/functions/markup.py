"""Markup: text of HTML, HTML without what can run, entities, white space, and text nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content goes with them, elements that break a paragraph, named entities.
DANGEROUS = ("script", "style", "iframe", "object", "embed")
BLOCKS = ("p", "div", "h[1-6]", "ul", "ol", "blockquote", "tr", "table", "section", "article")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal entities of at most ten characters, each decoded once; others stay.

    Code points come from the text itself, which no built-in expression turns
    into characters inside a string, so texts with a numeric entity take a
    vectorised function; all others stay in expressions.
    """
    import re

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    pattern = re.compile("&(#?[^;&]{1,9});")

    def one(m) -> str:
        name = m[1].lower()
        if name in ENTITIES:
            return ENTITIES[name]
        if name.startswith("#"):
            try:
                n = int(name[2:], 16) if name[1:2] == "x" else int(name[1:])
                return chr(n) if not 0xD800 <= n < 0xE000 else m[0]
            except (ValueError, OverflowError):
                return m[0]
        return m[0]

    def run(x):
        return pd.Series([None if t is None else pattern.sub(one, t) for t in x], dtype="object")

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")(c)


def without_dangerous(c: Column) -> Column:
    """Markup without elements that run or embed, their unclosed tags, event attributes and script or data addresses."""
    for tag in DANGEROUS:
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?</{tag}>", "")
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*(>|$)", "")
    c = F.regexp_replace(c, r"""(?is)(<[^>]*?)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "$1")
    c = F.regexp_replace(c, r"""(?is)(<[^>]*?)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "$1")
    return F.regexp_replace(c, r"""(?is)(=\s*["'])(?:javascript|data):[^"'>]*""", "$1")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space as one blank, one line break or, with two breaks or more, an empty line."""
    c = F.regexp_replace(c, r"(?U)[^\S\n]*\n[^\S\n]*(?:\n[^\S\n]*)+", "\u0001")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\n]*\n[^\S\n]*", "\n"), r"(?U)[^\S\n]+", " ")
    return F.replace(c, F.lit("\u0001"), F.lit("\n\n"))


def _finished(c: Column, decode: Callable[[Column], Column]) -> Column:
    return F.nullif(F.regexp_replace(collapse_whitespace(decode(c)), r"(?U)^\s+|\s+$", ""), F.lit(""))


def strip_html(c: Column) -> Column:
    """Text of markup: dangerous elements and comments out, block elements to line breaks, text of CDATA kept; empty to null."""
    t = without_dangerous(c)
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|<hr\s*/?>|</?li\b[^>]*>", "\n")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n\n")
    # one pass, so that what stands in CDATA is no tag
    t = F.regexp_replace(t, r"(?s)<!\[CDATA\[(.*?)(?:\]\]>|$)|<!--.*?(?:-->|$)|<[^>]*(?:>|$)", "$1")
    return _finished(t, decode_entities)


def safe_html(c: Column) -> Column:
    """Markup that may be shown: as ``without_dangerous``, entities decoded and white space collapsed; empty to null."""
    return _finished(without_dangerous(c), decode_entities)


def text_nodes(c: Column) -> Column:
    """Text between tags, parted by blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
