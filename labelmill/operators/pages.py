"""Structured fields from HTML pages. Every function is a narrow projection unless it counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import html as H
from labelmill.functions import text as X


@dataclass(frozen=True)
class Layout:
    """Where a kind of page keeps its content."""

    body: str                             # pattern that must match, otherwise the page is malformed
    chapters: Callable[[Column], Column]  # contents of the chapters of a page, as an array
    whole: Callable[[Column], Column]     # content of a page without chapters


# Fixed value: mark of the chapters of work pages.
CHAPTER_DIV = r"""<div\b[^>]*\bid\s*=\s*["']chapter-"""


def chapter_pieces(html: Column) -> Column:
    """The page cut where chapters start; each piece begins with a chapter's start tag."""
    return F.filter(F.split(html, f"(?i)(?={CHAPTER_DIV})"), lambda p: p.rlike(f"(?i)^{CHAPTER_DIV}"))


def userstuff(fragment: Column) -> Column:
    """Content of the first text of a fragment, with all elements inside it."""
    return F.trim(H.inner(fragment, "div", cls="userstuff"))


def _whole_work(html: Column) -> Column:
    return userstuff(H.inner(html, "div", id="chapters"))


WORK_LAYOUT = Layout(
    body=r"""(?is)<div\b[^>]*\bid\s*=\s*["']workskin["']""",
    chapters=lambda html: F.transform(chapter_pieces(html), userstuff),
    whole=_whole_work,
)
PARAGRAPH = r"(?is)<p\b[^>]*>([^<]*)</p>"
ARTICLE_LAYOUT = Layout(
    body=r"(?is)<body\b.*</body\s*>",
    chapters=lambda html: F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1)),
    whole=lambda html: F.nullif(H.inner(html, "article"), F.lit("")),
)

# Fixed value: notice on works that were not yet public.
UNREVEALED = (r"""(?is)<p\b[^>]*\bclass\s*=\s*["'][^"']*\bnotice\b[^"']*["'][^>]*>\s*"""
              r"This work is part of an ongoing challenge and will be revealed soon! "
              r"You can find details here:")


def status(html: Column, layout: Layout) -> Column:
    """Why a page cannot be read: private, error, unrevealed or malformed - otherwise `ok`.

    The login box and the error box count only in their place, directly in the main part and in the
    inner wrapper; the same marks in a footer or a chapter do not.
    Checked in this order. Pages with errors stay rows and are counted, nothing is raised.
    """
    wrapper = H.inner(html, "div", id="inner", cls="wrapper")
    login = F.exists(H.children(H.inner(wrapper, "div", id="main")), lambda tag: H.has(tag, r"\w+", id="signin"))
    failed = F.exists(H.children(wrapper), lambda tag: H.has(tag, r"\w+", cls="system errors"))
    return (
        F.when(H.has(html, r"\w+", id="signin") & login, "private")
        .when(H.has(html, r"\w+", cls="system errors") & failed, "error")
        .when(html.rlike(UNREVEALED), "unrevealed")
        .when(~html.rlike(layout.body), "malformed")
        .otherwise("ok")
    )


def meta(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Language, title and first heading."""
    html = F.col("html")
    return pages.select(
        key, H.attribute(html, "html", "lang").alias("lang"),
        H.to_text(H.inner(html, "title")).alias("title"),
        H.to_text(H.inner(html, "h1")).alias("heading"))


def link_rows(pages: DataFrame, key: str = "page_id", within: Column | None = None) -> DataFrame:
    """One row per link: position from 1, name, path."""
    found = H.links(F.col("html") if within is None else within)
    return (pages.select(key, F.posexplode_outer(found)).filter(F.col("pos").isNotNull())
            .select(key, (F.col("pos") + 1).alias("position"), "col.name", "col.path"))


def grouped_links(rows: DataFrame, group: Column, key: str = "page_id") -> DataFrame:
    """Number of links per page and group."""
    return rows.groupBy(key, group.alias("link_group")).agg(F.count("*").alias("links"))


def distinct_links(rows: DataFrame) -> DataFrame:
    return rows.select("name", "path").distinct()


def module_type(class_list: Column) -> Column:
    """Type of a module: its classes without `module`, joined by underscore."""
    return F.array_join(F.array_remove(F.split(F.trim(class_list), r"\s+"), "module"), "_")


def association_types(associations: Column) -> Column:
    """Kinds of the related works that a list of associations names, in order."""
    items = F.regexp_extract_all(associations, F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    return F.transform(items, lambda item: X.classify(H.to_text(item)))


def sections(pages: DataFrame, kinds: dict[str, tuple[str, str | None]], key: str = "page_id") -> DataFrame:
    """One row per page and section: `kinds` names the tag and class of each section type."""
    found = F.array(*[
        F.struct(F.lit(name).alias("section"),
                 H.inner(F.col("html"), tag, **({"cls": cls} if cls else {})).alias("content"))
        for name, (tag, cls) in kinds.items()])
    return (pages.select(key, F.inline(found)).filter(F.col("content").isNotNull()))


def chapter_rows(pages: DataFrame, layout: Layout, key: str = "page_id") -> DataFrame:
    """Chapters numbered from 1; a page without chapters gives its whole content without a number."""
    html = F.col("html")
    many = layout.chapters(html)
    numbered = F.transform(many, lambda content, i: F.struct(
        (i + 1).alias("number"), content.alias("content")))
    single = F.array(F.struct(
        F.lit(None).cast("int").alias("number"), layout.whole(html).alias("content")))
    return pages.select(key, F.inline_outer(
        F.when(F.size(many) > 0, numbered).otherwise(single)))


def text_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, H.to_text(F.col("html")).alias("text"))


def page_count(pagination: Column) -> Column:
    """Number on the last link of a pagination list that is a number; 1 without pagination."""
    numbers = F.regexp_extract_all(pagination, F.lit(r">\s*(\d+)\s*</a\s*>"), F.lit(1))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)).try_cast("int"), F.lit(1))


def record_json(record: DataFrame, key: str) -> DataFrame:
    """Record as one JSON document per row, dates in ISO form."""
    return record.select(key, F.to_json(
        F.struct(*record.columns),
        {"dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
         "ignoreNullFields": "false"}).alias("record"))


