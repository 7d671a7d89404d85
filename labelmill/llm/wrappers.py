"""Main text of web pages through wrappers: union-free regular expressions inferred for each host.

A page is a stream of tokens: block tags and text (inline tags belong to the text around them). All pages of a host
are aligned one after the other, those that the expression holds already but once. Repeated groups of tokens fold into `(group)+`; where
the streams differ, the tokens that only one side has become optional; texts are slots. What results is a
regular expression over tags without alternatives, cut into regions that are either main text or not: a token
is main text by its place, inside the page's article and outside menus, adverts, forms, comments and
the like. What only a class, id or role says to be such (a whole name, never of html, body, main, article or a
heading) is dropped in the article if at least two of the host's pages have it there. A page is matched against its host's expression, and the text slots in main regions, in page order, are its
blocks. The tokens of a page that the expression doesn't match are judged by their own place, whatever the page's size.

Pages are read where they lie: their tokens without texts are made distinct for each host, then folded, made distinct
again and merged in rounds of bounded groups, so a host with a third of all pages sends its distinct shapes alone. Every
page is then matched, whole.

Defined results: null or empty html has an empty text and no characters; a missing or odd url belongs to the host
""; pages without article and main take all text outside of boilerplate; repeated rows are answered once each; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import durable

#: Shapes of a host's pages that are merged in one task.
GROUP = 64
#: Longest group of tokens that is tried as a repetition.
PERIOD = 16

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter "
                   "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold no main text, elements that are never told by a name, and names (in class, id or role) of what
#: holds no main text. A name is one of these words or made of nothing else.
ASIDE = frozenset("head title nav footer aside form script style noscript template button select textarea iframe svg "
                  "object dialog menu".split())
UNNAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
_WORDS = (
    r"(?:nav|navbar|navigation|menus?|footer|sidebars?|side|asides?|ads?|adverts?|advertisements?|adsense|"
    r"banners?|cookies?|consent|notices?|popups?|modal|newsletters?|subscribe|subscription|promos?|promotion|sponsor(?:ed)?|"
    r"related|recommended|share|sharing|social|breadcrumbs?|comments?|commentlist|respond|replies|disqus|pagination|pager|"
    r"skip|login|signin|signup|search|widgets?|toolbar|masthead|topbar|complementary|contentinfo)")
ASIDE_WORDS = re.compile(f"{_WORDS}(?:[-_]+{_WORDS})*")
_TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|noscript|iframe|template|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_MARKS = re.compile(r"(?is)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
TEXT = "T"


def read_tokens(html: str) -> tuple[list[str], list[str]]:
    """(signatures, texts): block tags as `name`, `name!ad` (named as boilerplate) or `/name`, texts as `T`."""
    signs: list[str] = []
    texts: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            signs.append(TEXT)
            texts.append(text)

    at = 0
    for m in _TOKEN.finditer(html):
        parts.append(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        mark = "" if m["end"] or name in UNNAMED else _mark(m["rest"])
        if name in INLINE and not mark:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        sign = "/" + name if m["end"] else f"{name}!{mark}" if mark else name
        signs.append(sign)
        texts.append("")
    parts.append(html[at:])
    flush()
    return signs, texts


def _mark(rest: str) -> str:
    """The first name among the attributes of a tag that says boilerplate, or nothing."""
    for m in _MARKS.findall(rest) if rest else ():
        for name in m.strip("\"'").lower().split():
            if ASIDE_WORDS.fullmatch(name):
                return name
    return ""


def _root(signs: list[str]) -> str | None:
    return "article" if "article" in signs else "main" if "main" in signs else None


def named_inside(signs: list[str]) -> set[str]:
    """Signs of the elements in the page's article that are named as boilerplate."""
    root, inside, found = _root(signs), 0, set()
    for sign in signs:
        inside += (sign == root) - (root is not None and sign == "/" + root)
        if inside > 0 and "!" in sign:
            found.add(sign)
    return found


def places(signs: list[str], shown: set[str] = frozenset()) -> list[bool]:
    """Whether each token is main text by the elements that are open around it, on both sides of a tag.

    In the article an element is boilerplate by its name only if it is in `shown`.
    """
    root = _root(signs)
    open_: list[tuple[str, bool]] = []
    outside = inside = 0
    out = []
    for sign in signs:
        before = not outside and (root is None or inside > 0)
        name = sign.lstrip("/").partition("!")[0]
        if sign != TEXT and sign[0] != "/" and name not in VOID:
            bad = ("!" in sign and (not inside or sign in shown)) or name in ASIDE or (name == "header" and not inside)
            open_.append((name, bad))
            outside += bad
            inside += name == root
        elif sign[0] == "/" and any(o == name for o, _ in open_):
            while open_:
                last, bad = open_.pop()
                outside -= bad
                inside -= last == root
                if last == name:
                    break
        out.append(before and not outside and (root is None or inside > 0))
    return out


# An item is (signature, main) or ("+", (items...), main).


def fold(items: list[tuple]) -> list[tuple]:
    """Folds repeated groups of items that are all main or all not."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(items):
            group = items[i:i + period]
            n = 1
            if items[i + period:i + 2 * period] == group and len({g[-1] for g in group}) == 1 and any(g[0] != TEXT for g in group):
                while items[i + n * period:i + (n + 1) * period] == group:
                    n += 1
            if n > 1:
                body = group[0][1] if period == 1 and group[0][0] == "+" else tuple(group)
                out.append(("+", body, group[0][-1]))
                i += n * period
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def fold_known(items: list[tuple], bodies: set[tuple]) -> list[tuple]:
    """Folds single occurrences of groups that another page repeats."""
    for body in sorted(bodies, key=len):
        out, i, n = [], 0, len(body)
        while i < len(items):
            if tuple(items[i:i + n]) == body:
                if out and out[-1] == ("+", body, body[0][-1]):
                    i += n
                    continue
                out.append(("+", body, body[0][-1]))
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _bodies(items: list[tuple]) -> set[tuple]:
    return {i[1] for i in items if i[0] == "+"}


def align(wrapper: list[tuple], other: list[tuple]) -> list[tuple]:
    """Wrapper (item, optional) that holds two others; what only one of them has is optional."""
    if not any(o for _, o in wrapper):
        wrapper = [(i, False) for i in fold_known([i for i, _ in wrapper], _bodies([i for i, _ in other]))]
    items = [i for i, _ in wrapper]
    if not any(o for _, o in other):
        other = [(i, False) for i in fold_known([i for i, _ in other], _bodies(items))]
    out = []
    for kind, a, b, c, d in SequenceMatcher(None, items, [i for i, _ in other], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(i, o or also) for (i, o), (_, also) in zip(wrapper[a:b], other[c:d])]
        else:
            out += [(i, True) for i, _ in wrapper[a:b] + other[c:d]]
    return out


def shape(signs: list[str], shown: set[str]) -> list[tuple]:
    """The wrapper of one page: its tokens with their places, repetitions folded, nothing optional."""
    return [(item, False) for item in fold(list(zip(signs, places(signs, shown))))]


def merged(wrappers: list[list[tuple]]) -> list[tuple]:
    """One wrapper that holds all the given ones, aligned one after the other; what it holds already changes nothing."""
    out: list[tuple] = []
    compiled = None
    for own in wrappers:
        if compiled is None:
            out, compiled = own, Wrapper(own)
        elif not compiled.holds(own):
            out = align(out, own)
            compiled = Wrapper(out)
    return out


def infer(pages: list[str]) -> list[tuple]:
    read = [read_tokens(html)[0] for html in pages]
    times = Counter(sign for signs in read for sign in named_inside(signs))
    shown = {sign for sign, n in times.items() if n > 1}
    return merged([shape(signs, shown) for signs in read])


class Wrapper:
    """A wrapper as an expression over one character for each signature, with a group for each region."""

    def __init__(self, items: list[tuple]):
        self.items, self.letters = items, {TEXT: "T"}
        flat = [i for item, _ in items for i in _flat(item)]
        self.shown = named_inside([sign for sign, _ in flat]) & {sign for sign, main in flat if not main}
        regions: list[tuple[bool, list[str]]] = []
        for item, optional in items:
            if not regions or regions[-1][0] != item[-1]:
                regions.append((item[-1], []))
            regions[-1][1].append(self._source(item) + "?+" * optional)
        self.main = [main for main, _ in regions]
        self.expression = re.compile("".join(f"({''.join(parts)})" for _, parts in regions))

    def _source(self, item: tuple) -> str:
        if item[0] == "+":
            return "(?:(?:" + "".join(self._source(i) for i in item[1]) + ")++)"
        return self.letters.setdefault(item[0], chr(0x4E00 + len(self.letters)))

    def _match(self, signs: list[str]) -> re.Match | None:
        return self.expression.fullmatch("".join(self.letters.get(s, "?") for s in signs)) if self.main else None

    def _regions(self, m: re.Match) -> list[bool]:
        out: list[bool] = []
        for i, main in enumerate(self.main):
            out += [main] * (m.end(i + 1) - m.start(i + 1))
        return out

    def holds(self, own: list[tuple]) -> bool:
        """Whether a page's own wrapper, its groups repeated twice and three times, gets its labels from the expression."""
        if any(optional for _, optional in own):
            return False
        for times in (2, 3):
            flat = [i for item, _ in own for i in _flat(item, times)]
            m = self._match([sign for sign, _ in flat])
            if m is None or self._regions(m) != [main for _, main in flat]:
                return False
        return True

    def labels(self, signs: list[str]) -> list[bool]:
        """Whether each token lies in a main region; by its own place on a page that the expression does not match."""
        m = self._match(signs)
        return places(signs, self.shown) if m is None else self._regions(m)


def _flat(item: tuple, times: int = 1) -> Iterator[tuple]:
    if item[0] != "+":
        yield item
    else:
        for _ in range(times):
            for i in item[1]:
                yield from _flat(i, min(times, 2))


def main_text(html: str | None, wrapper: Wrapper) -> str:
    signs, texts = read_tokens(html or "")
    return "\n\n".join(t for s, t, main in zip(signs, texts, wrapper.labels(signs)) if s == TEXT and main)


def _tuples(value):
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, page) to (host, signs, named, page): the token streams without their texts."""
    for batch in batches:
        read = [read_tokens(html)[0] for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("host"), pa.array([" ".join(signs) for signs in read], pa.string()),
            pa.array([sorted(named_inside(signs)) for signs in read], pa.list_(pa.string())), batch.column("page")],
            ["host", "signs", "named", "page"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, signs, shown) to (host, wrapper)."""
    for batch in batches:
        found = [json.dumps(shape(signs.split(" ") if signs else [], set(shown or ()))) for signs, shown in zip(
            batch.column("signs").to_pylist(), batch.column("shown").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "wrapper"])


def _merge(table: pa.Table) -> pa.Table:
    found = sorted(table.column("wrapper").to_pylist(), key=lambda w: (len(w), w))
    return pa.table({"host": table.column("host").slice(0, 1),
                     "wrapper": pa.array([json.dumps(merged([list(_tuples(json.loads(w))) for w in found]))], pa.string())})


def host_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON, from all of its pages.

    Pages with the same tokens, and then those with the same shape, go on as one. The shapes of a host are merged in groups of
    about `group`, in rounds, so that a host of many shapes meets in no task before few wrappers are left.
    """
    page = F.xxhash64("page_id", "url", "html").alias("page")
    streams = durable(
        pages.filter(F.col("html").isNotNull()).select("host", "html", page)
        .mapInArrow(_streams, "host string, signs string, named array<string>, page long")
        .groupBy("host", "signs").agg(F.first("named").alias("named"), F.min("page").alias("first"), F.max("page").alias("last")))
    # A name counts from the second page on; a page that is there twice is one page.
    names = streams.select("host", "first", "last", F.explode("named").alias("sign")).groupBy("host", "sign").agg(
        F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last")
    shown = names.groupBy("host").agg(F.collect_list("sign").alias("shown"))
    found = durable(streams.join(shown, "host", "left").select("host", "signs", "shown")
                    .mapInArrow(_shapes, "host string, wrapper string").distinct())
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= group:
            return found.groupBy("host").applyInArrow(_merge, "host string, wrapper string")
        parts = F.ceil(F.col("n") / F.lit(group)).cast("long")
        dealt = found.join(sizes, "host").select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), parts).alias("part"))
        found = durable(dealt.groupBy("host", "part").applyInArrow(_merge, "host string, wrapper string"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    joined = rows.join(host_wrappers(rows), "host", "left").select("page_id", "url", "html", "wrapper")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {None: Wrapper([])}
        for batch in batches:
            texts = []
            for html, source in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                if source not in known:
                    if len(known) > 500:
                        known = {None: known[None]}
                    known[source] = Wrapper(_tuples(json.loads(source)))
                texts.append(main_text(html, known[source]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string())], schema=schema)

    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
