"""Scalar rules as native column expressions: numbers, dates, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_div(2 * tp, 2 * tp + fp + fn)


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_div(tp, tp + fn)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def threshold(scores: Column, cut: float = 0.5, inclusive: bool = True) -> Column:
    """0/1 array from an array of scores; `inclusive` decides a score that equals the cut."""
    bar = F.lit(float(cut))
    return F.transform(
        scores, lambda s: ((s >= bar) if inclusive else (s > bar)).cast("int"))


# All white space, which a plain trim would leave in place but for spaces.
EDGES = r"(?s)^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+\z"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, EDGES, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured text of the first match, null when there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def parse_count(text: Column) -> Column:
    """Integer with thousands commas; empty or malformed text gives null."""
    return F.replace(strip(text), F.lit(","), F.lit("")).try_cast("int")


def parse_fraction(text: Column) -> Column:
    """`present/planned` with `?` for an unknown plan, as a struct."""
    parts = F.split(strip(text), "/")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).try_cast("int").alias("present"),
        F.nullif(F.try_element_at(parts, F.lit(2)), F.lit("?")).try_cast("int").alias("planned"),
    )


def parse_day(text: Column) -> Column:
    """`2020-03-05` to a date; anything else gives null."""
    # A blank text would be null as well, but only by way of an exception, which costs far more.
    return F.try_to_timestamp(blank_to_null(strip(text)), F.lit("yyyy-MM-dd")).cast("date")


def parse_clock(text: Column) -> Column:
    """`5 Mar 2020 03:14PM` to a timestamp without zone; anything else gives null."""
    return F.try_to_timestamp(blank_to_null(strip(text)), F.lit("d MMM yyyy hh:mma")).cast("timestamp_ntz")


def file_stem(file_name: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")


def show_score(score: Column, missing: str = "--") -> Column:
    """Score with two decimals for a report, `--` where there is none."""
    return F.when(score.isNull(), missing).otherwise(F.format_string("%.2f", score))


# The query that asks a site for a whole work with its comments.
FULL_WORK_QUERY = "show_comments=true&view_adult=true&view_full_work=true"


def work_url(work_id: Column, site: str) -> Column:
    """Address of a work on `site`, for instance `https://host`."""
    return F.concat(F.lit(f"{site}/works/"), work_id.cast("string"), F.lit(f"?{FULL_WORK_QUERY}"))


# Path patterns of references inside work pages.
REFERENCE_PATTERNS = {
    "work_id": r"^(?:https?://[^/]+)?/works/(\d+)",
    "chapter_id": r"^(?:https?://[^/]+)?/works/\d+/chapters/(\d+)",
    "series_id": r"^(?:https?://[^/]+)?/series/(\d+)",
    "comment_id": r"^(?:https?://[^/]+)?/comments/(\d+)",
    "user": r"^(?:https?://[^/]+)?/users/([^/?#]+)",
    "gift_user": r"^(?:https?://[^/]+)?/users/(.*)/gifts",
    "comment_page": r"^https?://[^/]+/works/\d+\?.*?page=(\d+)",
}


def reference_part(path: Column, kind: str) -> Column:
    """Identifier named by a link; null when the link is of another kind."""
    return first_match(path, REFERENCE_PATTERNS[kind])
