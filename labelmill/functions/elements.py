"""A page read once: its marked elements as one array of structs, in page order.

Where an element ends depends on all tags between, which is a walk with state; array functions can only say it
by scanning the rest of the page again for each field. So the walk alone is a small helper on Arrow batches: it
finds the tags and keeps a stack for each tag name. Everything read from a page is then a filter over the array.

An element ends at its own end tag; one that never ends has null ends. Comments, scripts and styles hold no
elements. Places are code points from 0, ends exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions import html as H

ELEMENT = ("struct<sign:string,id:string,cls:string,path:string,head:string,depth:int,level:int,start:int,raw:string,"
           "end:int,inside:int>")
_FIELDS = [("sign", pa.string()), ("id", pa.string()), ("cls", pa.string()), ("path", pa.string()), ("head", pa.string()),
           ("depth", pa.int32()), ("level", pa.int32()), ("start", pa.int32()), ("raw", pa.string()), ("end", pa.int32()),
           ("inside", pa.int32())]
_RAW, _END, _INSIDE = 8, 9, 10

_TAGS = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([A-Za-z][\w-]*)([^>]*)>", re.S | re.I)
_CLASS, _ID, _HREF = (re.compile(rf"""(?<![\w-]){name}\s*=\s*["']([^"']*)["']""", re.I) for name in ("class", "id", "href"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Mark:
    """Elements worth a row: of a tag (any without one), with all classes of `cls` and an id (`id*` for a prefix).

    Elements with the class `but` are left out. `keep`: the row also holds the HTML between the tags.
    """

    sign: str
    tag: str | None = None
    cls: str = ""
    id: str | None = None
    keep: bool = False
    but: str | None = None

    def fits(self, own_id: str | None, classes: frozenset[str]) -> bool:
        if self.id is not None:
            low = (own_id or "").lower()
            if not (low.startswith(self.id[:-1]) if self.id.endswith("*") else low == self.id):
                return False
        return self.but not in classes and (not self.cls or classes.issuperset(self.cls.split()))


#: Start tags whose attributes a task remembers, and how long a tag may be for that.
KNOWN_TAGS, KNOWN_LENGTH = 4096, 256


def tag_reader(by_tag: dict[str | None, list[Mark]]) -> Callable[[str, str], tuple]:
    """What a start tag says, by its name and the text behind it: id, classes, link and the signs it fits.

    Most tags of a page come again, so short ones are remembered; the memory of a task stays bounded.
    """
    anywhere = by_tag.get(None, [])

    def read(name: str, text: str) -> tuple:
        marks = by_tag.get(name, anywhere)
        if not marks or not (text or name in by_tag):
            return None, None, None, ()
        own_class, own_id = _CLASS.search(text), _ID.search(text)
        cls, ident = own_class and own_class[1], own_id and own_id[1]
        classes = frozenset((cls or "").lower().split())
        fitting = tuple((mark.sign, mark.keep) for mark in marks if mark.fits(ident, classes))
        href = _HREF.search(text) if name == "a" and fitting else None
        return ident, cls, href and href[1], fitting

    known = lru_cache(KNOWN_TAGS)(read)
    return lambda name, text: (known if len(text) < KNOWN_LENGTH else read)(name, text)


def walk(page: str, read: Callable[[str, str], tuple]) -> list[list]:
    """Rows of `_FIELDS` for the marked elements of a page."""
    rows: list[list] = []
    # What is open, by tag name: for each element its places in `rows` and where its kept HTML starts, if anything.
    open_: dict[str, list[list[tuple[int, int]] | None]] = defaultdict(list)
    lists, depth = open_["ol"], 0
    for m in _TAGS.finditer(page):
        ends, name, text = m.group(2, 3, 4)
        if name is None:
            continue
        name = name.lower()
        if ends:
            if depth:
                depth -= 1
            same = open_[name]
            if same:
                for at, inner in same.pop() or ():
                    row = rows[at]
                    row[_END], row[_INSIDE] = m.end(), len(rows) - at - 1
                    if inner:
                        row[_RAW] = page[inner:m.start()]
            continue
        ident, cls, href, fitting = read(name, text)
        own: list[tuple[int, int]] | None = None
        if fitting:
            own, head, start, end = [], m[0], m.start(), m.end()
            for sign, keep in fitting:
                own.append((len(rows), end if keep else 0))
                rows.append([sign, ident, cls, href, head, depth, len(lists), start, None, None, None])
        if name in _VOID or text.endswith("/"):
            for at, _ in own or ():
                rows[at][_END], rows[at][_INSIDE] = m.end(), 0
        else:
            open_[name].append(own)
            depth += 1
    return rows


#: Elements of a batch of pages: a batch ends with the page that reaches them.
BATCH_ELEMENTS = 20_000


def _struct(rows: list[list]) -> pa.StructArray:
    columns = zip(*rows) if rows else [[]] * len(_FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, type=kind) for c, (_, kind) in zip(columns, _FIELDS)],
                                      fields=[pa.field(name, kind) for name, kind in _FIELDS])


def with_elements(pages: DataFrame, html: str, marks: list[Mark]) -> DataFrame:
    """Adds `elements`, the marked elements of a page; null without a page.

    Batches are cut by their number of elements, so a worker holds the elements of a few pages however many there are.
    """
    by_tag: dict[str | None, list[Mark]] = {}
    for mark in marks:
        by_tag.setdefault(mark.tag, []).append(mark)
    anywhere = by_tag.get(None, [])
    by_tag = {tag: found + (anywhere if tag else []) for tag, found in by_tag.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = tag_reader(by_tag)
        for batch in batches:
            first, rows, offsets = 0, [], []
            for at, page in enumerate(batch.column(html), 1):
                offsets.append(len(rows) if page.is_valid else None)
                if page.is_valid:
                    rows += walk(page.as_py(), tags)
                if len(rows) >= BATCH_ELEMENTS or at == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array([*offsets, len(rows)], type=pa.int32()), _struct(rows))
                    part = batch.slice(first, at - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, "elements"])
                    first, rows, offsets = at, [], []

    added = T.StructType.fromDDL(f"elements array<{ELEMENT}>")
    return pages.mapInArrow(read, T.StructType([*pages.schema.fields, *added.fields]))


# --- reading the array ---


def with_texts(found: Column, signs: list[str], cut: Callable[[Column], Column]) -> Column:
    """The elements with `text`: shown text on one line of what `cut` gives for elements of the given signs."""
    fields = re.findall(r"(\w+):", ELEMENT)
    return F.transform(found, lambda e: F.struct(
        *[e[name].alias(name) for name in fields], H.to_text(F.when(e["sign"].isin(signs), cut(e))).alias("text")))


def of(found: Column, sign: str, cls: str | None = None) -> Column:
    """Elements of a sign, with all the given classes."""
    def wanted(e: Column) -> Column:
        good = e["sign"] == sign
        for one in (cls or "").split():
            good = good & F.array_contains(F.split(F.lower(F.trim(e["cls"])), r"\s+"), one)
        return good

    return F.filter(found, wanted)


def first(found: Column, sign: str, cls: str | None = None) -> Column:
    return F.try_element_at(of(found, sign, cls), F.lit(1))


def inside(found: Column, holder: Column) -> Column:
    """Elements that start inside another one; to the end of the page where that never ends."""
    # What a lambda names from outside is worked out again for each element, so the range is bound first.
    span = F.struct(holder["start"].alias("start"), holder["end"].alias("end"))
    return H.let(span, lambda h: F.filter(
        found, lambda e: (e["start"] > h["start"]) & (e["start"] < F.coalesce(h["end"], e["start"] + 1))))


def links(found: Column) -> Column:
    """Links among the elements as (name, path), in order."""
    usable = F.filter(found, lambda e: (e["sign"] == "a") & e["path"].isNotNull() & e["text"].isNotNull())
    return F.transform(usable, lambda e: F.struct(e["text"].alias("name"), e["path"].alias("path")))
