"""Text normalisation and n-gram terms as JVM-side expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character as the token rule sees it: letters and numbers of any script.
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
TOKEN = rf"(?<!{WORD})[a-zA-Z][a-zA-Z0-9_/-]+{EDGE}"
# The same tokens in text that is all ASCII: there a token ends with the last word character of its run.
ASCII_TOKEN = r"(?<![a-zA-Z0-9_])[a-zA-Z][a-zA-Z0-9_/-]*[a-zA-Z0-9_]"


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions that yield ASCII, split by result length."""
    singles, multiples = {}, {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if unicodedata.combining(ch) or 0xD800 <= code < 0xE000:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain == ch or not any(x.isascii() for x in plain):
            continue
        if len(plain) == 1:
            singles[ch] = plain
        elif code < 0x10000:
            multiples[ch] = plain
    return "".join(singles), "".join(singles.values()), multiples


def _ranges(codes: list[int], gap: int = 1) -> str:
    """Regex class covering the sorted code points, closing gaps up to ``gap``."""
    spans: list[list[int]] = []
    for c in codes:
        if spans and c - spans[-1][1] <= gap:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in spans) + "]"


@cache
def _combining_class() -> str:
    """Combining marks of the basic plane."""
    return _ranges([c for c in range(0x10000) if unicodedata.combining(chr(c))])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A plain reference would be copied into every place it is used, also inside
    lambdas, where it would be computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(c: Column) -> Column:
    """Whether every character takes one byte."""
    return F.octet_length(c) == F.char_length(c)


def strip_accents(c: Column) -> Column:
    """Decompose, then drop the marks; pure ASCII text is passed through.

    Letters with a plain one are put first, as most texts are ASCII after that and need no pattern.
    """
    source, target, multiples = _decompositions()
    # One literal for the whole map; a wide class is enough to find texts that need it.
    table = F.str_to_map(
        F.lit("\x02".join(f"{k}\x01{v}" for k, v in multiples.items())), F.lit("\x02"), F.lit("\x01")
    )
    maybe = _ranges(sorted(map(ord, multiples)), gap=64)

    def spelled(text: Column) -> Column:
        letters = F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
        return F.when(text.rlike(maybe), F.array_join(letters, "")).otherwise(text)

    def rest(text: Column) -> Column:
        unmarked = F.when(text.rlike(r"\p{M}"), F.regexp_replace(text, _combining_class(), "")).otherwise(text)
        return F.when(is_ascii(text), text).otherwise(let(unmarked, spelled))

    return F.when(is_ascii(c), c).otherwise(let(F.translate(c, source, target), rest))


def tokens(c: Column) -> Column:
    """Lower-cased, accent-free tokens of at least two characters."""

    def found(text: Column) -> Column:
        plain = F.regexp_extract_all(text, F.lit(ASCII_TOKEN), F.lit(0))
        return F.when(is_ascii(text), plain).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))

    return let(let(F.lower(F.coalesce(c, F.lit(""))), strip_accents), found)


def with_bigrams(words: Column) -> Column:
    """The tokens, then each pair of neighbours joined by a blank."""

    def joined(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, pairs)

    return let(words, joined)


def feature_names(terms: list[str], prefix: str = "tfidf_descriptor__") -> list[str]:
    """Column names for terms; names that coincide get a number."""
    seen: dict[str, int] = {}
    names = []
    for term in terms:
        base = prefix + ("_".join(re.findall(r"[0-9a-z]+", term.lower())) or "empty")
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return names
