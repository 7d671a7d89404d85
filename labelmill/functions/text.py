"""Cleaning, tokens and n-grams over whole texts, as native column expressions.

Arrays worked out from a text are unfolded with the `_outer` generators and a null filter behind
them: for the plain ones Spark infers `size(array) > 0` filters that work the array out twice more,
before any rebalancing of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything except letters, digits, underscore, white space and . , ! ? " ' is
# dropped. The classes are spelled out because a plain \w is ASCII-only in Java.
DROPPED = r"""[^\p{L}\p{N}_\s.,!?"'\x0b\x1c-\x1f\x85\p{Z}]"""

WORD = r"\S+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"

CHAPTER_BREAK = "\n"


def clean(text: Column) -> Column:
    """Lower-cased text without characters outside words, spaces and basic punctuation."""
    return F.regexp_replace(F.lower(text), DROPPED, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def chapters(text: Column) -> Column:
    return F.split(text, CHAPTER_BREAK)


def join_chapters(parts: Column, prepare=clean) -> Column:
    """Each chapter prepared on its own, then joined by one space."""
    return F.array_join(F.transform(parts, prepare), " ")


def tokens(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int, high: int | None = None) -> Column:
    """All runs of `low` to `high` neighbouring tokens, each joined by one space."""
    high = low if high is None else high
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range ({low}, {high})")
    runs, wanted = words, []
    for n in range(1, high + 1):
        if n > 1:
            # Each run of n tokens is a run of n - 1 tokens and the token after it.
            more = F.greatest(F.size(words) - (n - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, 1, more), F.slice(words, n, more),
                              lambda run, word: F.concat(run, F.lit(" "), word))
        if n >= low:
            wanted.append(runs)
    return wanted[0] if len(wanted) == 1 else F.concat(*wanted)


def truncate(words: Column, max_len: int) -> Column:
    """The first `max_len` tokens, and how many were kept, dropped and padded."""
    return F.struct(
        F.slice(words, 1, max_len).alias("tokens"),
        F.least(F.size(words), F.lit(max_len)).alias("kept"),
        F.greatest(F.size(words) - max_len, F.lit(0)).alias("dropped"),
        F.greatest(max_len - F.size(words), F.lit(0)).alias("padded"),
    )


# Notes that tie a work to another one, tried in this order from the start of the text.
ASSOCIATION_RULES = [
    ("translation_into", r"^Translation into (.*?) available:\s*(.*)\s*by\s*(.*?)\s*"),
    ("translated_from", r"^A translation of\s*(.*?)\s*by\s*(.*?)\.\s*"),
    ("gift_for", r"^For\s*(.*)\."),
    ("inspired_by", r"^Inspired by\s*(.*?)\s*by\s*(.*?)\.\s*"),
]


def classify(text: Column, rules=ASSOCIATION_RULES, otherwise: str = "unmatched") -> Column:
    """Name of the first rule that matches."""
    return F.coalesce(
        *[F.when(text.rlike(pattern), name) for name, pattern in rules], F.lit(otherwise))
