"""Text cleaning as native column expressions."""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dash characters that count as a hyphen.
DASHES = "‐‑–—−"
# Thresholds of the text rules.
OPENING_WORDS = 40
OPENING_LENGTH = 1000
TRUNCATION_LENGTH = 500
SUMMARY_LENGTH = 2500
WORD = r"([a-z0-9]+(?:#|\+\+)?)"
AGGREGATOR_SUFFIX = r"\s*-\s*(?:vaga(?: aberta)?|recrutamento aberto)\s*$"
MODES = ("remoto", "presencial", "hibrido", "indiferente")


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is one ASCII character, and those that give several."""
    source, target, several = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            several[char] = plain
    return "".join(source), "".join(target), several


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ranges(chars: str) -> str:
    """The characters as a regular-expression class of few ranges."""
    out, points = [], sorted(map(ord, chars))
    start = last = points[0]
    for point in [*points[1:], sys.maxunicode + 2]:
        if point != last + 1:
            out.append(chr(start) if start == last else f"{chr(start)}-{chr(last)}")
            start = point
        last = point
    return "[" + "".join(out) + "]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


NOT_ASCII = r"[^\x00-\x7F]"


def ascii_fold(text: Column, dashes: str = "") -> Column:
    """Compatibility decomposition without anything outside ASCII, lower case; `dashes` become hyphens.

    ASCII text passes untouched. Other text is translated one to one; the few characters that
    decompose into several are expanded only where one is left.
    """
    source, target, several = _ascii_tables()
    # The first entry of a character counts.
    source, target = dashes + source, "-" * len(dashes) + target
    left = _ranges("".join(several))

    def expand(translated: Column) -> Column:
        # One constant: each entry is a character followed by what it decomposes into.
        entries = F.split(F.lit("\u0001".join(k + v for k, v in several.items())), "\u0001")
        expanded = F.aggregate(
            entries, translated, lambda done, e: F.replace(done, F.left(e, F.lit(1)), F.substring(e, 2, 100))
        )
        strange = F.regexp_replace(translated, r"[\x00-\x7F]+", "")
        rest = F.when(strange.rlike(left), expanded).otherwise(translated)
        return F.when(is_ascii(translated), translated).otherwise(F.regexp_replace(rest, NOT_ASCII, ""))

    def fold(value: Column) -> Column:
        plain = with_value(F.translate(value, source, target), expand)
        return F.lower(F.when(is_ascii(value), value).otherwise(plain))

    return with_value(text, fold)


def fold_text(text: Column) -> Column:
    # A single space is left as it is, so plain text is scanned but not rebuilt.
    return F.trim(F.regexp_replace(ascii_fold(text, DASHES), r"[\s\x1c-\x1f]{2,}|[\t-\r\x1c-\x1f]", " "))


def fold_place(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_fold(text), "[^a-z0-9]+", " "))


def words_of_folded(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD), 1)


def clean_key(text: Column) -> Column:
    return F.array_join(words_of_folded(fold_text(text)), " ")


def opening_words(text: Column) -> Column:
    """Distinct words among the first forty: the cut comes before the distinct.

    Where the text's start holds a word more than that, only its last word can be cut short, so the start is
    enough; other texts are read whole.
    """
    start = with_value(words_of_folded(fold_text(F.left(text, F.lit(OPENING_LENGTH)))), lambda words: F.when(F.size(words) > OPENING_WORDS, words))
    words = with_value(start, lambda words: F.when(words.isNotNull(), words).otherwise(words_of_folded(fold_text(text))))
    return F.array_distinct(F.slice(words, 1, OPENING_WORDS))


def strip_aggregator_suffix(folded: Column) -> Column:
    return F.regexp_replace(folded, AGGREGATOR_SUFFIX, "")


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85   -     　]+", " "))


def clean_html(text: Column) -> Column:
    """Tags become spaces, entities are read, whitespace is collapsed.

    Rows without an ampersand send a null to the entity reader.
    """
    without_tags = F.regexp_replace(text, "<[^>]+>", " ")
    has_entity = without_tags.contains("&")
    return collapse_spaces(F.coalesce(_unescape(F.when(has_entity, without_tags)), without_tags))


def strip_invalid(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00", "")


def is_truncated(text: Column) -> Column:
    return (F.length(text) >= TRUNCATION_LENGTH) | F.rtrim(text).rlike(r"(…|\.\.\.)$")


def recognize_mode(text: Column) -> Column:
    folded = F.trim(ascii_fold(text))
    return F.when(folded.isin(*MODES), folded)


def escape_all(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_truncate(text: Column, limit: int) -> Column:
    escaped = escape_all(collapse_spaces(text))
    cut = F.regexp_replace(F.left(escaped, F.lit(limit)), "&[#a-zA-Z0-9]*$", "")
    return F.when(F.length(escaped) <= limit, escaped).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def summarize(text: Column, limit: int = SUMMARY_LENGTH) -> Column:
    spaced = collapse_spaces(text)
    return F.when(F.length(spaced) <= limit, spaced).otherwise(
        F.concat(F.left(spaced, F.lit(limit)), F.lit(" […]"))
    )


def url_host(url: Column, fallback: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(F.length(bare) > 0, bare).otherwise(fallback)


def origin_label(text: Column, limit: int) -> Column:
    """Visit-origin label: lower case, safe characters, cut, nothing when empty."""
    safe = F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-")
    trimmed = F.regexp_replace(safe, "^-+|-+$", "")
    cut = F.left(trimmed, F.lit(limit))
    return F.when(F.length(cut) > 0, cut)
