"""Text expressions: stripping, sentences, tokens, phrase tests, templates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.arrays import empty, let, running

# White space in the Unicode sense, with the four separators U+001C..U+001F.
_WS = r"[\s\x1c-\x1f]"
# CJK unified ideographs and extension A.
CJK = r"一-鿿㐀-䶿"
# Runs that become tokens: CJK runs, or runs of other letters and digits.
RUNS = rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
# The same for Python's regex engine, used on short configured keywords only.
PY_RUNS = rf"[{CJK}]+|[^\W_{CJK}]+"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def non_blank(parts: Column) -> Column:
    """Strip every element of a string array and drop the empty ones."""
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Ordered sentences; a sentence keeps its end mark."""
    return non_blank(F.split(text, rf"(?U)(?<=[。！？.!?\n]){_WS}*", -1))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    return non_blank(F.split(strip(text), rf"(?U)\n{_WS}*\n", -1))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{CJK}]"), F.lit(False))


def tokens(text: Column, fold: bool = True) -> Column:
    """Index terms: letter and digit runs, lower-case if ``fold``; CJK runs as overlapping bigrams."""
    words = F.regexp_extract_all(F.lower(text) if fold else text, F.lit(RUNS), 0)

    def split_run(word: Column) -> Column:
        bigrams = F.transform(
            F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substr(word, i, F.lit(2))
        )
        return F.when(has_cjk(word) & (F.length(word) >= 2), bigrams).otherwise(F.array(word))

    # Splitting runs is only paid for by texts that hold CJK characters.
    return F.when(has_cjk(text), F.flatten(F.transform(words, split_run))).otherwise(words)


def query_terms(text: Column) -> Column:
    """Distinct terms of a question worth looking up."""
    return F.array_distinct(
        F.filter(tokens(text), lambda t: (F.length(t) > 1) | t.rlike(r"^[\p{L}\p{N}]$"))
    )


def long_tokens(text: Column, fold: bool = True) -> Column:
    """Distinct tokens of more than one character."""
    return F.array_distinct(F.filter(tokens(text, fold), lambda t: F.length(t) > 1))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Case-insensitive test for any of the phrases; null counts as no."""
    pattern = "|".join(re.escape(p.lower()) for p in phrases)
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def estimate_tokens(text: Column) -> Column:
    """About 2.5 characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) * 2 / 5)).cast("long")


def substring_positions(text: Column, word: Column, quoted: Column) -> Column:
    """0-based offsets of all occurrences, overlapping ones included.

    ``quoted`` is the word as a regular expression. The text is cut in front of
    every occurrence, so the piece lengths add up to the offsets; the text is read
    once. The text must contain the word.
    """
    before = F.split(text, F.concat(F.lit("(?="), quoted, F.lit(")")), -1)
    lengths = F.transform(before, lambda p: F.length(p))
    offsets = let(lengths, lambda n: running(F.slice(n, 1, F.size(n) - 1)))
    head = F.when(F.startswith(text, word), F.array(F.lit(0))).otherwise(empty("int"))
    return F.concat(head, offsets)


MARK, NOT_MARK = "\ufdd0", "\ufdd1"  # code points that no text may use


def regex_positions(text: Column, pattern: str | Column) -> Column:
    """0-based offsets of the matches of a pattern, empty ones included, left to right.

    A mark goes in front of every match; what stands before a mark adds up to its offset.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(F.translate(text, MARK, NOT_MARK), pattern, F.lit(f"{MARK}$0"))
    lengths = F.transform(F.split(marked, MARK, -1), lambda p: F.length(p))
    offsets = let(lengths, lambda n: running(F.slice(n, F.lit(1), F.size(n) - 1)))
    return F.when(F.rlike(text, pattern), offsets).otherwise(empty("int"))


def render(template: str, values: Mapping[str, Column], strict: bool = True) -> Column:
    """Fill ``{{ name }}`` placeholders from columns, in one pass over the template.

    A placeholder without a value is an error when ``strict``, else it stays.
    """
    parts: list[Column] = []
    end = 0
    for match in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        name = match.group(1)
        if name not in values and strict:
            raise KeyError(f"template variable {name!r} has no value")
        parts.append(F.lit(template[end : match.start()]))
        known = F.coalesce(values[name].cast("string"), F.lit("")) if name in values else None
        parts.append(known if known is not None else F.lit(match.group(0)))
        end = match.end()
    parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def size_label(size: Column) -> Column:
    """Human-readable byte size, ties rounded to the even digit."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", F.bround(size / 1024, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(size / 1024 / 1024, 1)))
    )
