"""Rules that read HTML with regular expressions, as native column expressions.

There is no document tree: each rule is a pattern over the page, so every page stays one row and one
narrow projection. Where elements of one kind nest, the rule cuts the page at their start and end tags
and folds the depth, so an element ends at its own end tag.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions.scalars import blank_to_null

# Elements whose content is never shown.
HIDDEN = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script>|style\b[^>]*>.*?</style>|head\b[^>]*>.*?</head>)"
# Tags inside a line of text: they separate nothing.
INLINE = (r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|"
          r"strike|strong|sub|sup|tt|u|var)(?:\s[^>]*)?>")
# A tag starts with a letter, a slash or a sign; any other `<` is text.
TAG = r"<(?:/?[A-Za-z]|[!?])[^>]*+>"
# Runs of white space that are not one space already.
SPACES = r"[\t\n\x0B\f\r]\s*+| \s++"

# All named references of the standard; those that may stand without a semicolon, longest first, so that
# the longest name wins.
NAMES = {name.rstrip(";"): character for name, character in html5.items()}
BARE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
# Codes 128 to 159 stand for the characters of the Windows code page, where it has one.
RENAMED = {code: bytes([code]).decode("cp1252", "replace") for code in range(0x80, 0xA0)}
REFERENCE = (r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(BARE_NAMES) + "))")


def _literal_map(values: dict, kind: str) -> Column:
    """A constant map column; read from its JSON form, which keeps the plan short."""
    return F.from_json(F.lit(json.dumps(values)), kind)


#: Named references lie in this many short strings, by a checksum of their name.
DRAWERS = 2048


def _named(name: Column) -> Column:
    """Characters of a named reference; null for an unknown name.

    A map constant of this size in every field would slow the optimiser, and is searched from end to end.
    """
    drawers = [""] * DRAWERS
    for known, characters in sorted(NAMES.items()):
        drawers[zlib.crc32(known.encode()) % DRAWERS] += f"\x01{known}\x02{characters}"
    # One constant that is split once, when the plan is optimised.
    shelf = F.split(F.lit("\x03".join(d + "\x01" for d in drawers)), "\x03")
    drawer = F.element_at(shelf, (F.crc32(name.cast("binary")) % DRAWERS + 1).cast("int"))

    def found(drawer: Column) -> Column:
        behind = F.call_function("substring_index", drawer, F.concat(F.lit("\x01"), name, F.lit("\x02")), F.lit(-1))
        return let(behind, lambda b: F.when(F.length(b) < F.length(drawer), F.substring_index(b, "\x01", 1)))

    return let(drawer, found)


def _code_point(digits: Column, base: int) -> Column:
    """Character of a code in digits; null when there is none."""
    renamed = _literal_map({str(code): c for code, c in RENAMED.items() if c != "�"}, "map<string,string>")

    def character(code: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when(code.between(0x80, 0x9F), F.coalesce(renamed[code.cast("string")], plain))
                .when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), plain)
                .otherwise(F.lit("�")))

    return let(let(F.ltrim(digits, F.lit("0")), lambda short: F.when(
        F.length(short) <= 8, F.conv(short, base, 10).cast("bigint"))), character)


def decode_entities(text: Column) -> Column:
    """Character references to characters, in one pass from left to right.

    What a reference gives is never read again. Unknown names stay as they are; codes without a
    character give U+FFFD.
    """
    # What is named more than once is bound first: an expression is worked out again wherever it stands.
    def number(body: Column) -> Column:
        return F.when(body.rlike("^#[xX]"), _code_point(F.substring(body, 3, 1 << 20), 16)).otherwise(
            _code_point(F.substring(body, 2, 1 << 20), 10))

    def one(piece: Column) -> Column:
        body = F.rtrim(F.substring(piece, 2, 1 << 20), F.lit(";"))
        return F.when(~piece.startswith("&") | (F.length(piece) == 1), piece).otherwise(let(body, lambda b: F.when(
            b.startswith("#"), number(b)).otherwise(F.coalesce(_named(b), piece))))

    def decoded(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit(rf"{REFERENCE}|[^&]+|&"), F.lit(0))
        return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(value)

    return let(text, decoded)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def to_text(html: Column) -> Column:
    """Shown text of a page or fragment on one line."""
    def stripped(value: Column) -> Column:
        shown = F.regexp_replace(value, HIDDEN, " ")
        return F.when(F.contains(value, F.lit("<")), F.regexp_replace(
            F.regexp_replace(shown, INLINE, ""), TAG, " ")).otherwise(value)

    return one_line(decode_entities(let(html, stripped)))


def open_tag(tag: str, **attributes: str) -> str:
    """Pattern of a start tag that has the given attributes; `cls` lists classes it must carry."""
    wanted = ""
    for name, value in attributes.items():
        if name == "cls":
            for one in value.split():
                wanted += rf"""(?=[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{re.escape(one)}(?:\s[^"']*)?["'])"""
        else:
            wanted += rf"""(?=[^>]*\b{name}\s*=\s*["']{re.escape(value)}["'])"""
    return rf"<{tag}\b{wanted}[^>]*>"


def _own_content(after: Column, tag: str) -> Column:
    """What of `after`, the text behind a start tag, belongs to the element; null when it never ends."""
    pieces = F.split(after, rf"(?i)(?=<{tag}(?![\w-]))|(?=</{tag}\s*>)")
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("kept"))

    def step(done: Column, piece: Column) -> Column:
        depth = done["depth"] + F.when(piece.rlike(rf"(?i)^<{tag}(?![\w-])"), 1).when(
            piece.rlike(rf"(?i)^</{tag}\s*>"), -1).otherwise(0)
        return F.when(done["depth"] == 0, done).otherwise(F.struct(
            depth.alias("depth"),
            F.when(depth == 0, done["kept"]).otherwise(F.concat(done["kept"], piece)).alias("kept")))

    return F.aggregate(pieces, start, step, lambda found: F.when(found["depth"] == 0, found["kept"]))


def inner(html: Column, tag: str, **attributes: str) -> Column:
    """Content of the first such element up to its own end tag; null when there is none."""
    return _own_content(F.nullif(F.regexp_extract(
        html, rf"(?is){open_tag(tag, **attributes)}(.*)\z", 1), F.lit("")), tag)


def outer(html: Column, tag: str, **attributes: str) -> Column:
    """The first such element with its own tags; null when there is none."""
    return let(html, lambda value: F.concat(
        F.regexp_extract(value, rf"(?is){open_tag(tag, **attributes)}", 0), inner(value, tag, **attributes), F.lit(f"</{tag}>")))


def children(fragment: Column) -> Column:
    """Start tags of the elements that lie directly in a fragment, in order.

    Elements without an end tag of their own open no level.
    """
    pieces = F.regexp_extract_all(fragment, F.lit(r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>"), F.lit(0))
    empty = r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b|/>$"
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("found"))

    def step(done: Column, piece: Column) -> Column:
        opens = piece.rlike("^<[A-Za-z]")
        depth = F.when(opens & ~piece.rlike(empty), done["depth"] + 1).when(
            piece.startswith("</"), F.greatest(done["depth"] - 1, F.lit(0))).otherwise(done["depth"])
        return F.struct(depth.alias("depth"), F.when(
            opens & (done["depth"] == 0), F.array_append(done["found"], piece)).otherwise(done["found"]).alias("found"))

    return F.aggregate(pieces, start, step, lambda done: done["found"])


def inner_all(html: Column, tag: str, **attributes: str) -> Column:
    pattern = rf"(?is){open_tag(tag, **attributes)}(.*?)</{tag}\s*>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def has(html: Column, tag: str, **attributes: str) -> Column:
    return html.rlike(rf"(?is){open_tag(tag, **attributes)}")


def attribute(html: Column, tag: str, name: str) -> Column:
    """Value of an attribute of the first such start tag."""
    return blank_to_null(F.regexp_extract(html, rf"""(?is)<{tag}\b[^>]*\b{name}\s*=\s*["']([^"']*)["']""", 1))


LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def links(html: Column) -> Column:
    """All links of a fragment as an array of (name, path), in order."""
    paths = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    names = F.regexp_extract_all(html, F.lit(LINK), F.lit(2))
    return F.transform(
        F.arrays_zip(names.alias("name"), paths.alias("path")),
        lambda link: F.struct(to_text(link["name"]).alias("name"), link["path"].alias("path")))
