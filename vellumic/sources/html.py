"""XHTML to markdown-like text: of columns with built-in functions only, of strings for file readers."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumic.functions import text as T

# Levels of headings, and elements that stand apart.
LEVELS = {"h1": 2, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
APART = "p|div|br|li|tr|blockquote|section|figcaption"
_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&"}


def markdown(html: Column) -> Column:
    """Text of well-formed markup: headings as ``##``, blank lines around blocks, no scripts or head."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)<(script|style|head|svg)\b[^>]*>.*?</\1\s*>", "")
    for tag, level in LEVELS.items():
        out = F.regexp_replace(out, rf"(?i)<{tag}\b[^>]*>", "\n\n" + "#" * level + " ")
        out = F.regexp_replace(out, rf"(?i)</{tag}\s*>", "\n\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{APART})\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"(?s)<[a-zA-Z/][^>]*>", "")
    for name, c in _ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return T.trimmed(F.regexp_replace(T.normalized(out), r"\n{3,}", "\n\n"))


def markdown_text(html: str) -> str:
    """The same for one string, with a heading's text on one line."""
    out = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head|svg)\b[^>]*>.*?</\1\s*>", "", html)
    out = re.sub(r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1\s*>", lambda m: f"\n\n{'#' * LEVELS[m[1].lower()]} {' '.join(m[2].split())}\n\n", out)
    out = re.sub(r"(?s)<[a-zA-Z/][^>]*>", "", re.sub(rf"(?i)</?(?:{APART})\b[^>]*>", "\n\n", out))
    out = unescape(out).translate(str.maketrans(T.TYPOGRAPHY))
    out = re.sub("[ \t\xa0]+", " ", re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", out))
    return re.sub(r"\n\s*\n", "\n\n", out).strip()


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def count(html: Column, tag: str) -> Column:
    """Opening tags of a kind."""
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]")).cast("long")
