"""Text cleaning, display names and label spelling."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values, as cleaned texts must come out the same: what counts as markup (without regard to case, over lines), which
# characters are invisible, which are control characters, and what repair removes: terminal escapes, control characters but tab, line feed,
# form feed and carriage return, and Unicode's deprecated format, interlinear and byte-order marks.
MARKUP = r"<!--.*?-->|<!doctype\s+[^>]*>|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*?)?/?>"
INVISIBLE = "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
ESCAPE = r"\x1b\[[\d;]*[A-Za-z]"
REMOVED = "".join(map(chr, (*range(0, 9), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD))))

_MARKUP, _ESCAPE = re.compile(MARKUP, re.I | re.S), re.compile(ESCAPE)
# What repair writes plainly: wide forms, ligatures and curled quotes.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
LIGATURES = {c: unicodedata.normalize("NFKC", c) for c in map(chr, (0x132, 0x133, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)))}
QUOTES = {c: "'" for c in "‘’‚‛ʼ"} | {c: '"' for c in "“”„‟"}
_REPAIR = str.maketrans({c: None for c in REMOVED} | dict(zip(WIDE, NARROW)) | LIGATURES | QUOTES)


class _Visible(HTMLParser):
    """Collects the text of a page, without that of scripts and styles."""

    hidden = ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.depth += tag in self.hidden

    def handle_endtag(self, tag) -> None:
        if tag in self.hidden and self.depth:
            self.depth -= 1

    def handle_data(self, data) -> None:
        if not self.depth:
            self.parts.append(data)


def strip_and_repair(text: str | None) -> str | None:
    """Markup off, character references decoded, wide forms, ligatures and quotes plain, composed accents.

    Text decoded in the wrong encoding is left as it is: the standard library has nothing to repair it."""
    if text is None:
        return None
    if _MARKUP.search(text):
        page = _Visible()
        page.feed(text)
        page.close()
        text = " ".join(page.parts)
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    if text.isascii() and text.isprintable():
        return text
    text = _ESCAPE.sub("", text).translate(_REPAIR)
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n"))


@F.pandas_udf(StringType())
def strip_markup(text: pd.Series) -> pd.Series:
    return text.map(strip_and_repair, na_action="ignore")


def tidy(c: Column) -> Column:
    """Invisible characters go, control characters become blanks, white space collapses and leaves punctuation."""
    c = F.regexp_replace(c, INVISIBLE, "")
    c = F.regexp_replace(c, CONTROL, " ")
    c = F.regexp_replace(c, "(?U)\\s+", " ")
    return F.regexp_replace(F.trim(c), " ([,.;:!?])", "$1")


def clean_text(c: Column) -> Column:
    return tidy(strip_markup(c))


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def label(c: Column) -> Column:
    """A label in one spelling: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def output_label(c: Column) -> Column:
    """A model's output as it is held against the labels: white space off both ends, lower case."""
    return F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))


def file_slug(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("--"))
