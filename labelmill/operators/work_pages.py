"""Work pages: record, hydration, comments and guards, all read from the page's elements.

`read` adds the elements of a page once (functions.elements); every field below is a filter over that array. Shown texts are worked out with the elements, so the rules for
character references occur once in a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import elements as E
from labelmill.functions import html as H
from labelmill.functions.elements import Mark
from labelmill.functions.scalars import first_match, parse_clock, parse_count, parse_day, parse_fraction, reference_part
from labelmill.operators.pages import UNREVEALED, module_type

# The marks of work pages.
MARKS = [
    Mark("wrapper", "div", "wrapper", "inner"), Mark("main", "div", id="main"), Mark("signin", id="signin"),
    Mark("failed", cls="system errors"), Mark("skin", "div", id="workskin"), Mark("dd", "dd", keep=True), Mark("stats", "dl", "stats"),
    Mark("title", "h2", "title heading", keep=True), Mark("byline", "h3", "byline heading"), Mark("heading", "h3", "heading", keep=True),
    Mark("chapter_title", "h3", "title", keep=True), Mark("chapters", "div", id="chapters"), Mark("chapter", "div", id="chapter-*"),
    Mark("endnotes", "div", id="work_endnotes*"), Mark("module", "div", "module", keep=True, but="userstuff"), Mark("userstuff", "div", "userstuff", keep=True),
    Mark("quote", "blockquote", "userstuff", keep=True), Mark("blockquote", "blockquote"), Mark("associations", "ul", "associations", keep=True),
    Mark("series", "div", id="series"), Mark("children", "div", id="children"), Mark("kudos", "p", "kudos", keep=True),
    Mark("pagination", "ol", "pagination actions"), Mark("placeholder", "div", id="comments_placeholder"),
    Mark("thread", "ol", "thread"), Mark("comment", "li", "comment"), Mark("author", "h4", "heading byline", keep=True),
    Mark("span", "span", keep=True), Mark("abbr", "abbr", keep=True), Mark("a", "a", keep=True),
]
SHOWN = ["dd", "title", "heading", "chapter_title", "author", "span", "abbr", "a"]

# Tag types of a work page and the name each gets in the record; statistics a page may show.
TAG_TYPES = {
    "rating": "rating", "warning": "warning", "category": "category", "fandom": "fandom",
    "relationship": "relationship", "character": "character", "freeform": "additional",
}
STATISTICS = ["published", "status", "words", "chapters", "comments", "kudos", "bookmarks", "hits"]
# How the kudos of a work name users that are not listed, and guests.
MORE_USERS = r">\s*([\d,]+) more users"
GUESTS = r"([\d,]+) guests?\s+left\s+kudos\s+on\s+this\s+work!"

MODULE = "struct<module_type:string,heading:string,content:string,associations:string,jumps:array<string>>"


def _html() -> Column:
    return F.col("html")


def _all() -> Column:
    return F.col("elements")


def read(pages: DataFrame) -> DataFrame:
    """Pages with their `elements` and a `status`: private, error, unrevealed or malformed - otherwise `ok`.

    The login box and the error box count only in their place, directly in the main part and in the inner
    wrapper. Checked in this order; pages with errors stay rows, nothing is raised.
    """
    # The text of an author's line is what stands before its first tag.
    def shown(e: Column) -> Column:
        return F.when(e["sign"] == "author", F.regexp_extract(e["raw"], r"(?s)^\s*([^<]*)", 1)).otherwise(e["raw"])

    found = E.with_elements(pages, "html", MARKS)

    def directly(sign: str, holder: Column) -> Column:
        return H.let(holder, lambda h: F.exists(E.inside(E.of(_all(), sign), h), lambda e: e["depth"] == h["depth"] + 1))

    wrapper = E.first(_all(), "wrapper")
    main = E.first(E.inside(_all(), wrapper), "main")
    status = (
        F.when(F.coalesce(directly("signin", main), F.lit(False)), "private")
        .when(F.coalesce(directly("failed", wrapper), F.lit(False)), "error")
        .when(F.contains(_html(), F.lit("will be revealed soon!")) & _html().rlike(UNREVEALED), "unrevealed")
        .when(F.size(E.of(_all(), "skin")) == 0, "malformed")
        .when(_html().isNull(), "malformed").otherwise("ok"))
    return found.withColumn("status", status).withColumn("elements", E.with_texts(_all(), SHOWN, shown))


def _at(found: Column, holder: Column) -> Column:
    """The elements from a holder with a place in the array to the last one inside it; see `_places`."""
    return F.slice(found, holder["at"], holder["n"])


def _places(found: Column, signs: list[str]) -> Column:
    """(at, n) of the elements of some signs: place from 1, and the number of elements up to the end of its inside."""
    at = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: F.element_at(found, i)["sign"].isin(signs))
    own = F.transform(at, lambda i: F.struct(i.alias("at"), (F.coalesce(
        F.element_at(found, i)["inside"], F.size(found) - i) + 1).alias("n")))
    return F.when(F.size(found) > 0, own).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def modules(found: Column, in_chapter: bool = False) -> Column:
    """Modules among some elements - summary, notes, end notes - as structs.

    Fields: type, heading, content, `associations` (the list of related works, as HTML) and `jumps`, the paragraphs
    that point to other notes: marked ones around a work, all in a chapter, which has no associations.
    """
    jump = r"<p\b[^>]*>" if in_chapter else H.open_tag("p", cls="jump")
    parts = F.transform(E.of(found, "module"), lambda m: F.struct(m.alias("m"), E.inside(found, m).alias("own")))
    cut = F.transform(parts, lambda p: F.struct(
        module_type(p["m"]["cls"]).alias("kind"), E.first(p["own"], "heading")["text"].alias("heading"),
        E.first(p["own"], "quote")["raw"].alias("content"), E.first(p["own"], "associations").alias("list"), p["m"]["raw"].alias("own")))
    nothing = F.lit(None).cast("string")
    return F.transform(cut, lambda c: F.struct(
        c["kind"].alias("module_type"), c["heading"].alias("heading"), c["content"].alias("content"),
        (nothing if in_chapter else F.concat(c["list"]["head"], c["list"]["raw"], F.lit("</ul>"))).alias("associations"),
        F.regexp_extract_all(
            F.replace(c["own"], F.coalesce(F.nullif(c["content"], F.lit("")), F.lit("\x00")), F.lit("")),
            F.lit(rf"(?is){jump}.*?</p\s*>"), F.lit(0)).alias("jumps")))


def chapters(found: Column) -> Column:
    """Chapters as structs; a page without chapters gives one without title and number.

    The number is the one in the chapter's id, because titles repeat numbers.
    """
    def module(of: Column, kind: str) -> Column:
        return F.try_element_at(F.filter(of, lambda m: m["module_type"] == kind), F.lit(1))

    def texts(own: Column) -> Column:
        return F.trim(E.first(own, "userstuff")["raw"])

    pieces = F.transform(_places(found, ["chapter"]), lambda p: _at(found, p))
    inner = F.transform(pieces, lambda own: F.struct(
        own.alias("own"), E.first(own, "chapter_title").alias("title"), modules(own, True).alias("modules")))
    many = F.transform(inner, lambda c: F.struct(
        c["title"]["text"].alias("title"), first_match(F.element_at(c["own"], 1)["id"], r"(?i)^chapter-(\d+)").try_cast("int").alias("chapter_index"),
        F.try_element_at(E.links(E.inside(c["own"], c["title"])), F.lit(1))["path"].alias("path"),
        module(c["modules"], "summary").alias("summary"), module(c["modules"], "notes").alias("notes"),
        texts(c["own"]).alias("content"), module(c["modules"], "end_notes").alias("endnotes")))
    nothing = F.lit(None)
    single = F.struct(
        nothing.cast("string").alias("title"), nothing.cast("int").alias("chapter_index"), nothing.cast("string").alias("path"),
        nothing.cast(MODULE).alias("summary"), nothing.cast(MODULE).alias("notes"),
        texts(E.inside(found, E.first(found, "chapters"))).alias("content"), nothing.cast(MODULE).alias("endnotes"))
    return F.when(F.size(pieces) > 0, many).otherwise(F.array(single))


def _around_chapters(found: Column) -> Column:
    """Elements of a work outside of its chapters: notes of the work stand before the first or behind the last."""
    def around(held: Column) -> Column:
        later = F.filter(E.of(found, "endnotes"), lambda e: e["start"] > held["start"])
        behind = F.coalesce(F.try_element_at(later, F.lit(1))["start"], held["end"], F.length(_html()))
        return H.let(F.struct(held["start"].alias("start"), behind.alias("behind")), lambda h: F.filter(
            E.inside(found, E.first(found, "skin")), lambda e: h["start"].isNull() | (e["start"] < h["start"]) | (e["start"] >= h["behind"])))

    return H.let(E.first(found, "chapters"), around)


def series(found: Column) -> Column:
    """Series a work belongs to, as (series_id, name, path, part); links of another form drop out."""
    rows = F.transform(F.filter(found, lambda e: (e["sign"] == "a") & e["path"].isNotNull()), lambda e: F.struct(
        reference_part(e["path"], "series_id").alias("series_id"), e["text"].alias("name"), e["path"].alias("path"),
        first_match(F.substring(_html(), F.greatest(e["start"] - 100, F.lit(0)) + 1, F.least(e["start"], F.lit(100))),
                    r"(?is)Part (\d+) of[^<]*$").alias("part")))
    return F.filter(rows, lambda s: s["series_id"].isNotNull() & s["part"].isNotNull())


def named_users(found: Column) -> Column:
    """Links to users as (name, path)."""
    return F.filter(E.links(found), lambda link: reference_part(link["path"], "user").isNotNull())


def stats(dds: Column) -> Column:
    """Shown texts of the language and the statistics of a page by name; null where one is missing."""
    names = F.array(*[F.lit(name) for name in ("language", *STATISTICS)])
    texts = H.let(_classed(dds), lambda own: F.transform(names, lambda name: F.try_element_at(
        F.filter(own, lambda e: F.array_contains(e["classes"], name)), F.lit(1))["e"]["text"]))
    return F.map_from_arrays(names, texts)


def tags(dds: Column, found: Column) -> Column:
    """Tags as (name, path) by the name of their type; none where a page has no tags of a type."""
    def listed(own: Column, kind: Column) -> Column:
        holder = F.try_element_at(F.filter(own, lambda e: F.array_contains(e["classes"], kind)), F.lit(1))
        links = H.let(holder["e"], lambda h: F.when(h.isNotNull(), E.links(E.inside(found, h))))
        return F.coalesce(links, F.array().cast("array<struct<name:string,path:string>>"))

    tagged = F.filter(_classed(dds), lambda e: F.array_contains(e["classes"], F.lit("tags")))
    kinds, names = (F.array(*[F.lit(x) for x in xs]) for xs in (TAG_TYPES, TAG_TYPES.values()))
    return F.map_from_arrays(names, H.let(tagged, lambda own: F.transform(kinds, lambda kind: listed(own, kind))))


def _classed(found: Column) -> Column:
    """Elements as (e, classes): the classes of each cut apart once, however many are asked for."""
    return F.transform(found, lambda e: F.struct(e.alias("e"), F.split(F.lower(F.trim(e["cls"])), r"\s+").alias("classes")))


def page_count(found: Column) -> Column:
    """Number on the last link of the pagination that is a number; 1 without pagination."""
    numbers = F.filter(E.links(E.inside(found, E.first(found, "pagination"))), lambda a: a["name"].rlike(r"^\d+$"))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1))["name"].try_cast("int"), F.lit(1))


def comments(found: Column, key: Column) -> Column:
    """Comments in page order, with the comment whose thread holds each.

    A comment reaches to the next comment or thread. Its level is the number of lists open before it; its parent
    is the last comment one level up, which a fold keeps for each level. `deleted` comments have no author's line;
    `operators.threads.reattach` moves the replies to them.
    """
    marks = F.transform(_places(found, ["thread", "comment"]), lambda p: p["at"])
    ends = F.concat(F.slice(marks, 2, F.size(marks)), F.array(F.size(found) + 1))
    blocks = F.transform(F.arrays_zip(marks.alias("at"), ends.alias("upto")), lambda p, k: F.struct(
        (k + 1).alias("position"), F.slice(found, p["at"], p["upto"] - p["at"]).alias("own")))
    only = F.filter(blocks, lambda b: F.element_at(b["own"], 1)["sign"] == "comment")
    parts = F.transform(only, lambda b: F.struct(
        b["position"].alias("position"), F.element_at(b["own"], 1).alias("li"), b["own"].alias("own"),
        E.first(b["own"], "author").alias("author"), E.first(b["own"], "abbr", "timezone").alias("zone")))

    def text(p: Column, sign: str, cls: str) -> Column:
        return E.first(p["own"], sign, cls)["text"]

    def user(p: Column) -> Column:
        link = F.try_element_at(E.links(E.inside(p["own"], p["author"])), F.lit(1))
        return F.coalesce(link, F.struct(
            F.nullif(p["author"]["text"], F.lit("")).alias("name"), F.lit(None).cast("string").alias("path")))

    def thread(p: Column) -> Column:
        up = F.filter(E.links(p["own"]), lambda a: (F.lower(a["name"]) == "parent thread") & a["path"].startswith("/comments/"))
        return reference_part(F.try_element_at(up, F.lit(1))["path"], "comment_id")

    titled = lambda p: F.try_element_at(F.filter(E.of(p["own"], "abbr"), lambda e: e["head"].rlike(r"(?i)\btitle\s*=")), F.lit(1))
    rows = F.transform(parts, lambda p: F.struct(
        p["position"].alias("position"), p["li"]["level"].alias("level"),
        F.coalesce(first_match(p["li"]["id"], r"(\d+)$"), F.concat(key.cast("string"), F.lit("#"), p["position"].cast("string"))).alias("comment_id"),
        F.lit(None).cast("string").alias("parent_comment"), p["author"].isNull().alias("deleted"), user(p).alias("author"),
        first_match(p["author"]["raw"], r"on Chapter (\d+)").try_cast("int").alias("refers_to_chapter"),
        E.first(p["own"], "quote")["raw"].alias("content"), thread(p).alias("parent_thread"),
        parse_clock(F.concat_ws(" ", text(p, "span", "date"), text(p, "abbr", "month"), text(p, "span", "year"), text(p, "span", "time"))).alias("published_at"),
        F.create_map(F.lit("title"), first_match(titled(p)["head"], r"""(?i)\btitle\s*=\s*["']([^"']*)["']"""),
                     F.lit("abbreviation"), p["zone"]["text"]).alias("timezone")))
    # For each level the last comment's id, from level 0; a fold over ids alone, which the rows then take up.
    start = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast("array<string>").alias("parents"))

    def step(done: Column, c: Column) -> Column:
        last, level = done["last"], c["level"]
        filled = F.concat(last, F.array_repeat(F.lit(None).cast("string"), F.greatest(level + 1 - F.size(last), F.lit(0))))
        return F.struct(
            F.concat(F.slice(filled, F.lit(1), level), F.array(c["comment_id"]), F.slice(filled, level + 2, F.size(filled))).alias("last"),
            F.array_append(done["parents"], F.when(level > 0, F.try_element_at(filled, level))).alias("parents"))

    def linked(found_rows: Column) -> Column:
        parents = F.aggregate(F.transform(found_rows, lambda c: F.struct(
            c["level"].alias("level"), c["comment_id"].alias("comment_id"))), start, step, lambda done: done["parents"])
        return F.zip_with(found_rows, parents, lambda c, parent: F.struct(*[
            (parent if name == "parent_comment" else c[name]).alias(name) for name in COMMENT_FIELDS]))

    return H.let(rows, linked)


COMMENT_FIELDS = ["position", "comment_id", "parent_comment", "deleted", "author", "refers_to_chapter", "content",
                  "parent_thread", "published_at", "timezone"]


def comment_rows(pages: DataFrame, key: str = "work_id") -> DataFrame:
    """One row per comment of a page, with its fields and the comment whose thread holds it."""
    found = read(pages).select(key, comments(_all(), F.col(key)).alias("comments"))
    return found.select(key, F.inline_outer("comments")).filter(F.col("comment_id").isNotNull())


def work_record(pages: DataFrame, key: str = "work_id") -> DataFrame:
    """All fields of a work page as columns. Unreadable pages keep their status and null fields."""
    return full_record(pages, key).drop("comments")


def full_record(pages: DataFrame, key: str = "work_id") -> DataFrame:
    """The page record with its comments, in page order; null fields for pages that cannot be read."""
    # Columns of their own, because several fields read them and each should be worked out once.
    ok = F.col("status") == "ok"
    readable = (
        read(pages).withColumn("html", F.when(ok, _html())).withColumn("elements", F.when(ok, _all()))
        .withColumn("outer", _around_chapters(_all())).withColumn("modules", modules(F.col("outer")))
        .withColumn("dds", E.of(_all(), "dd")).withColumn("stats", stats(F.col("dds"))).withColumn("tags", tags(F.col("dds"), _all()))
        .withColumn("kudos", E.first(_all(), "kudos")).withColumn("byline", E.first(_all(), "byline"))
    )
    dds = F.col("dds")

    def module(kind: str) -> Column:
        return F.try_element_at(F.filter("modules", lambda m: m["module_type"] == kind), F.lit(1))

    def stat(name: str) -> Column:
        return F.col("stats")[name]

    def count(name: str) -> Column:
        return parse_count(F.coalesce(stat(name), F.lit("0")))

    kudos = F.col("kudos")
    kudos_html = kudos["raw"]
    planned = parse_fraction(stat("chapters"))
    # The end of a work lists its series; works without that list name them in the page head.
    in_series = F.coalesce(E.first(_all(), "series"), E.first(dds, "dd", "series"))
    children = F.transform(E.links(E.inside(_all(), E.first(_all(), "children"))), lambda c: reference_part(c["path"], "work_id"))
    collections = E.first(dds, "dd", "collections")
    return readable.select(
        key, "status",
        "tags", stat("language").alias("language"),
        F.when(collections.isNotNull(), E.links(E.inside(_all(), collections))).alias("collections"),
        series(E.inside(_all(), in_series)).alias("series"),
        planned["present"].alias("number_of_chapters"), planned["planned"].alias("number_of_chapters_planned"),
        parse_count(stat("words")).alias("number_of_words"),
        *[count(name).alias(f"number_of_{name}") for name in ("kudos", "comments", "bookmarks", "hits")],
        parse_day(stat("published")).alias("published_at"), parse_day(stat("status")).alias("updated_at"),
        E.first(_all(), "title")["text"].alias("title"), F.array_distinct(E.links(E.inside(_all(), F.col("byline")))).alias("authors"),
        module("summary").alias("summary"), module("notes").alias("notes"),
        F.when(ok, chapters(_all())).alias("chapters"), module("end_notes").alias("endnotes"),
        F.filter(children, lambda c: c.isNotNull()).alias("children"),
        F.struct(named_users(E.inside(_all(), kudos)).alias("users"),
                 F.when(kudos.isNotNull(), F.coalesce(parse_count(first_match(kudos_html, MORE_USERS)), F.lit(0))).alias("more_users"),
                 F.when(kudos.isNotNull(), F.coalesce(parse_count(first_match(kudos_html, GUESTS)), F.lit(0))).alias("guests")).alias("kudos_from"),
        page_count(_all()).alias("comment_pages"),
        F.when(ok, F.transform(comments(_all(), F.col(key)), lambda c: F.struct(*[c[f].alias(f) for f in COMMENT_FIELDS[1:]]))).alias("comments"))


def hydration(pages: DataFrame, key: str = "work_id") -> DataFrame:
    """The fields a work gets from its page: status, chapter texts, notes, end notes and summary."""
    ok = F.col("status") == "ok"
    readable = read(pages).withColumn("elements", F.when(ok, _all())).withColumn(
        "chapters", F.when(ok, chapters(_all()))).withColumn("modules", modules(_around_chapters(_all())))

    def content(kind: str) -> Column:
        return F.try_element_at(F.filter("modules", lambda m: m["module_type"] == kind), F.lit(1))["content"]

    return readable.select(
        key, "status", F.col("chapters.content").alias("text"), content("notes").alias("notes"),
        content("end_notes").alias("endnotes"), content("summary").alias("summary"))


def quality_report(pages: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of pages that break each rule, in one pass over the pages."""
    counted = read(pages).agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def work_rules() -> dict[str, Column]:
    """Guards of work pages: what must hold at most once, and which modules and numbers are known."""
    known = ["summary", "notes", "end_notes", "series", "children"]
    first_class = lambda e: F.lower(F.split(F.trim(e["cls"]), r"\s+")[0])
    shown = F.filter(E.inside(_all(), E.first(_all(), "stats")), lambda e: (e["sign"] == "dd") & e["cls"].isNotNull())
    placeholder = E.first(_all(), "placeholder")
    parent_links = F.transform(_places(_all(), ["comment"]), lambda p: F.size(F.filter(
        E.links(_at(_all(), p)), lambda a: F.lower(a["name"]) == "parent thread")))
    quotes = F.transform(_places(_all(), ["blockquote"]), lambda p: F.size(E.of(_at(_all(), p), "blockquote")))
    kinds = lambda found: F.transform(E.of(found, "module"), lambda m: module_type(m["cls"]))
    return {
        "unknown statistic": F.exists(shown, lambda e: ~first_class(e).isin(STATISTICS)),
        "unknown tag type": F.exists(E.of(_all(), "dd", "tags"), lambda e: ~first_class(e).isin(list(TAG_TYPES))),
        "several languages": F.size(E.of(_all(), "dd", "language")) > 1,
        "unknown module": F.exists(kinds(_all()), lambda k: ~k.isin(known)),
        "several end notes": F.size(F.filter(kinds(_around_chapters(_all())), lambda k: k == "end_notes")) > 1,
        "several root threads": H.let(placeholder, lambda p: F.size(F.filter(
            E.inside(E.of(_all(), "thread"), p), lambda e: e["depth"] == p["depth"] + 1))) > 1,
        "several parent links": F.exists(parent_links, lambda n: n > 1),
        "nested quotes": F.exists(quotes, lambda n: n > 1),
        "bad word count": E.first(_all(), "dd", "words")["text"].rlike(r"[^\d,]"),
        "no chapters fraction": parse_fraction(E.first(_all(), "dd", "chapters")["text"])["present"].isNull(),
    }
