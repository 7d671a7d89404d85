"""Registered queries over work pages and comment threads that are built from documents and conversations.

The pages are put together in the row, with nested elements, character references and misleading marks; the SQL side
reads the lines that went in, so both sides share no pattern.
"""

from __future__ import annotations

import html as html_names

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions import html as H
from labelmill.operators import hydrate, threads
from labelmill.operators import pages as P
from labelmill.operators import work_pages as W
from labelmill.session import spread
from labelmill.sources.readers import read_table

# References of several kinds: names, names without a semicolon, numbers, and text that only looks like one.
TAIL = ("&pound;5 caf&eacute; &Agrave;&Aacute;&Acirc;&Atilde;&Auml;&Aring;&AElig;&Ccedil;&Egrave;&Eacute;&Ecirc;&Euml;&Igrave;"
        "&Iacute;&Ntilde;&Ograve;&Oacute;&Ouml;&Oslash;&Ugrave;&Uuml;&szlig;&euro;&trade;&larr;&infin;&alpha;&Omega;&hearts;"
        "&sup2;&frac12;&times;&copy &#00000233; &#xE9; &#146; &#38;lt; &amp;amp; a < b and c > d, I <3 you &unknown; & co")
TAIL_TEXT = " ".join(html_names.unescape(TAIL).split())
# Letters that the pages write as references.
WRITTEN = {"é": "&eacute;", "ü": "&#252;", "ñ": "&#xF1;", "è": "&egrave;", "ß": "&szlig;"}


def _pages(spark, sf, key, html, wanted=None):
    """Pages put together from documents, and only then evened out, as if they had been read."""
    docs = read_table(spark, sf, "documents")
    docs = docs if wanted is None else docs.filter(wanted)
    return spread(docs.select(key, html.alias("html")))


def _written(text):
    for letter, reference in WRITTEN.items():
        text = F.replace(text, F.lit(letter), F.lit(reference))
    return text


def html_round_trip(spark, sf):
    """Text of a quote within a quote and of a tail full of references, read back from HTML."""
    body = F.concat(
        F.lit("<div><blockquote class='userstuff'><p>"), _written(F.col("text")), F.lit("</p><blockquote>in "),
        F.col("doc_id").cast("string"), F.lit("</blockquote> behind</blockquote><p>"), F.lit(TAIL), F.lit("</p></div>"))
    pages = _pages(spark, sf, F.col("doc_id"), body)
    return pages.select(
        "doc_id", F.md5(H.to_text(F.col("html"))).alias("text_md5"),
        F.md5(H.to_text(H.inner(F.col("html"), "blockquote", cls="userstuff"))).alias("quote_md5"))


def _work_pages(spark, sf):
    """Documents as work pages: each line a chapter with notes inside its text.

    Some pages are private, show an error, are not revealed yet or have no work, and some works have no page.
    """
    lines = F.split("text", "\n")
    chapter = F.transform(lines, lambda line, i: F.concat(
        F.lit("<div id=\"chapter-"), (i + 1).cast("string"), F.lit("\" class=\"chapter\"><h3 class=\"title\">"
              "<a href=\"/works/1/chapters/2\">Chapter "), (i + 1).cast("string"),
        F.lit("</a></h3><div class=\"notes module\"><h3 class=\"heading\">Notes:</h3><blockquote class=\"userstuff\">"
              "before</blockquote></div><div class=\"userstuff module\" role=\"article\"><p>"), line,
        F.lit("</p><div class=\"notes\">mid</div><p>end</p></div></div>")))
    readable = F.concat(
        F.lit("<html><body><div id=\"inner\" class=\"wrapper\"><div id=\"main\"><div id=\"workskin\"><div class=\"preface group\">"
              "<h2 class=\"title heading\">Title</h2><div class=\"summary module\"><h3 class=\"heading\">Summary:</h3>"
              "<blockquote class=\"userstuff\"><p>About "), F.col("doc_id").cast("string"),
        F.lit("</p><blockquote>quoted</blockquote>reply</blockquote></div></div><div id=\"chapters\">"), F.array_join(chapter, ""),
        F.lit("</div></div></div></div><div id=\"footer\"><div id=\"signin\">Log in</div><p>3 guests left kudos on this work!</p>"
              "</div></body></html>"))
    private = F.lit("<html><body><div id=\"inner\" class=\"wrapper\"><div id=\"main\"><p>x</p><div id=\"signin\">Log in</div>"
                    "</div></div></body></html>")
    error = F.lit("<html><body><div id=\"inner\" class=\"wrapper\"><div class=\"system errors\"><h2>Error</h2></div></div></body></html>")
    unrevealed = F.lit("<html><body><div id=\"inner\" class=\"wrapper\"><div id=\"main\"><p class=\"notice\"> This work is part of an ongoing "
                       "challenge and will be revealed soon! You can find details here: <a href=\"/c\">c</a></p></div></div></body></html>")
    none = F.lit("<html><body><div class=\"system\"><p>will be revealed soon!</p></div></body></html>")
    d = F.col("doc_id")
    page = F.when(d % 11 == 0, private).when(d % 17 == 0, error).when(d % 19 == 0, unrevealed).when(d % 23 == 0, none).otherwise(readable)
    return _pages(spark, sf, d.cast("string").alias("work_id"), page, d % 13 != 0)


def _rich_pages(spark, sf, broken=False):
    """Documents as work pages with tags, statistics, notes with associations, end notes, series, children and two comments.

    With `broken`, each rule of `work_rules` is broken by the pages of some ids.
    """
    number, d = F.col("doc_id").cast("string"), F.col("doc_id")

    def each(n, text, otherwise=""):
        return F.when(d % n == 0, text).otherwise(otherwise) if broken else (F.lit(otherwise) if isinstance(otherwise, str) else otherwise)

    meta = F.concat(
        F.lit("<dl class=\"work meta group\"><dd class=\"fandom tags\"><ul><li><a href=\"/tags/"), F.col("source"),
        F.lit("/works\">"), F.col("source"), F.lit("</a></li></ul></dd>"),
        F.when(F.col("doc_id") % 7 == 0, "<dd class=\"odd tags\"><a href=\"/tags/x/works\">x</a></dd>").otherwise(""),
        F.lit("<dd class=\"rating tags\"><a href=\"/tags/T/works\">Teen</a></dd><dd class=\"freeform tags\"><a href=\"/tags/a/works\">Angst</a>, "
              "<a href=\"/tags/b/works\">Fluff &amp; co</a></dd>"),
        F.lit("<dd class=\"language\">"), F.coalesce("lang", F.lit("none")), each(9, "</dd><dd class=\"language\">two"),
        F.lit("</dd><dl class=\"stats\"><dd class=\"published\">2020-03-05</dd><dd class=\"words\">"),
        F.format_number("n_chars", 0), each(16, "x"), F.lit("</dd><dd class=\"chapters\">"), each(18, "?", "1/?"),
        F.lit("</dd><dd class=\"kudos\">"), number, F.lit("</dd>"), each(8, "<dd class=\"odd\">1</dd>"), F.lit("</dl></dl>"))
    notes = F.concat(
        F.lit("<div class=\"notes module\"><h3 class=\"heading\">Notes:</h3><ul class=\"associations\"><li>"),
        F.when(F.col("doc_id") % 2 == 0, "For <a href=\"/users/u/gifts\">u</a>.").otherwise(
            "Inspired by <a href=\"/works/1\">W</a> by <a href=\"/users/v\">v</a>. "),
        F.lit("</li></ul><blockquote class=\"userstuff\"><p>note</p></blockquote><p class=\"jump\">(See the end)</p></div>"),
        each(10, "<div class=\"odd module\"></div>"))
    afterword = F.concat(
        F.lit("<div class=\"afterword preface group\"><div id=\"work_endnotes\" class=\"end notes module\"><h3 class=\"heading\">Notes:</h3>"
              "<blockquote class=\"userstuff\"><p>end "), number, F.lit("</p></blockquote></div>"), each(12, "<div class=\"end notes module\"></div>"),
        F.lit("<div id=\"series\" class=\"series module\"><h3 class=\"heading\">Series</h3><ul><li><span class=\"position\">Part "),
        (d % 9 + 1).cast("string"), F.lit(" of <a href=\"/series/"), (d + 5).cast("string"), F.lit("\">Saga "), number,
        F.lit("</a></span></li><li>Part of <a href=\"/collections/c\">c</a></li></ul></div><div id=\"children\" class=\"children module\">"
              "<ul><li><a href=\"/works/"), (d * 3).cast("string"), F.lit("\">c</a> by <a href=\"/users/z\">z</a></li></ul></div></div>"))
    users = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), d % 4), lambda i: F.concat(
        F.lit("<a href=\"/users/k"), i.cast("string"), F.lit("\">k"), i.cast("string"), F.lit("</a>"))), ", ")
    kudos = F.concat(users, F.when(d % 3 == 0, F.concat(
        F.lit(", <a href=\"/works/1/kudos\">"), F.format_number(d + 1000, 0), F.lit(" more users</a>"))).otherwise(""),
        F.when(d % 5 != 1, F.concat(F.lit(" and "), F.format_number(d + 1, 0), F.when(d == 0, " guest").otherwise(" guests"), F.lit(" left kudos on this work!"))).otherwise(""))
    comments = F.concat(
        F.lit("<div id=\"comments_placeholder\"><ol class=\"thread\"><li class=\"comment group\" id=\"comment_"), number,
        F.lit("1\"><h4 class=\"heading byline\"><a href=\"/users/a\">a</a> on Chapter 1</h4><blockquote class=\"userstuff\">first"),
        each(15, "<blockquote>q</blockquote>"), F.lit("</blockquote>"), each(14, "<a href=\"/comments/1\">Parent Thread</a>"),
        each(14, "<a href=\"/comments/2\">Parent Thread</a>"), F.lit("</li><li><ol class=\"thread\"><li class=\"comment group\" id=\"comment_"), number,
        F.lit("2\"><h4 class=\"heading byline\">guest</h4><blockquote class=\"userstuff\">second</blockquote></li></ol></li></ol>"),
        F.when(F.col("doc_id") % 5 == 0, "<ol class=\"thread\"></ol>").otherwise(""), F.lit("</div>"))
    page = F.concat(
        F.lit("<html><body><div id=\"inner\" class=\"wrapper\"><div id=\"main\">"), meta,
        F.lit("<div id=\"workskin\"><h2 class=\"title heading\">"), F.col("source"),
        F.lit("</h2><h3 class=\"byline heading\"><a href=\"/users/w\">w</a></h3>"), notes,
        F.lit("<div id=\"chapters\"><div class=\"userstuff\">"), F.col("text"), F.lit("</div></div>"), afterword,
        F.lit("</div><p class=\"kudos\">"), kudos, F.lit("</p>"), comments, F.lit("</div></div></body></html>"))
    return _pages(spark, sf, F.col("doc_id").cast("string").alias("work_id"), page)


def page_record_json(spark, sf):
    """Whole page records, comments included, written as JSON and read back with a schema."""
    record = W.full_record(_rich_pages(spark, sf))
    schema = record.drop("work_id").schema
    fields = P.record_json(record, "work_id").select("work_id", F.from_json("record", schema).alias("r"))
    return fields.select(
        "work_id", "r.status", "r.language", "r.title", F.col("r.tags")["fandom"][0]["path"].alias("fandom"),
        "r.number_of_words", "r.number_of_chapters", "r.number_of_chapters_planned", "r.number_of_kudos",
        F.date_format("r.published_at", "yyyy-MM-dd").alias("published_at"), F.col("r.authors")[0]["name"].alias("author"),
        F.col("r.notes.jumps")[0].alias("jump"), P.association_types(F.col("r.notes.associations"))[0].alias("association"),
        F.col("r.kudos_from.guests").alias("guests"), F.col("r.kudos_from.more_users").alias("more_users"),
        F.size("r.kudos_from.users").alias("users"), F.element_at("r.kudos_from.users", -1)["name"].alias("last_user"),
        F.array_join(F.transform(F.array(*[F.lit(name) for name in W.TAG_TYPES.values()]), lambda t: F.concat_ws(
            ":", t, F.array_join(F.col("r.tags")[t]["name"], "+"))), " ").alias("tags"),
        F.col("r.endnotes.content").alias("endnotes"), F.array_join(F.transform("r.series", lambda s: F.concat_ws(
            "/", s["series_id"], s["part"], s["name"])), ",").alias("series"), F.array_join("r.children", ",").alias("children"),
        F.size("r.comments").alias("comments"),
        F.col("r.comments")[1]["parent_comment"].alias("parent"), F.col("r.comments")[1]["author"]["name"].alias("guest"),
        F.md5(H.to_text(F.col("r.chapters")[0]["content"])).alias("md5"))


def page_quality_report(spark, sf):
    return W.quality_report(_rich_pages(spark, sf, broken=True), W.work_rules())


def work_page_hydration(spark, sf):
    """Status, chapters and summary of every document's page."""
    works = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("work_id"))
    fields = W.hydration(_work_pages(spark, sf)).select(
        "work_id", "status", F.size("text").alias("chapters"),
        F.md5(F.array_join(F.transform("text", H.to_text), "|")).alias("text_md5"),
        H.to_text(F.col("summary")).alias("summary"))
    return hydrate.attach_pages(works, fields)


def work_page_record(spark, sf):
    """Fields of the page record: status, title, kudos (none on these pages) and chapter numbers; null where not readable."""
    record = W.work_record(_work_pages(spark, sf))
    return record.select(
        "work_id", "status", "title", F.size("chapters").alias("chapters"),
        F.array_max(F.transform("chapters", lambda c: c["chapter_index"])).alias("last_chapter"),
        F.col("kudos_from.guests").alias("guests"), F.col("kudos_from.more_users").alias("more_users"))


def _thread_pages(spark, sf):
    """Lines as comments: even lines are replies, in a list of their own, to the line before."""
    lines = F.split("text", "\n")
    named = F.col("doc_id") % 2 == 1

    def comment(line, i):
        mark = F.when(named, F.concat(F.lit(" id=\"comment_"), (F.col("doc_id") * 100_000 + i).cast("string"), F.lit("\""))).otherwise("")
        own = F.concat(F.lit("<li class=\"comment group\""), mark, F.lit("><h4 class=\"heading byline\"><a href=\"/users/u\">u</a></h4>"
                       "<blockquote class=\"userstuff\"><p>"), line, F.lit("</p><blockquote>quoted</blockquote>reply</blockquote></li>"))
        return F.when(i % 2 == 1, F.concat(F.lit("<li><ol class=\"thread\">"), own, F.lit("</ol></li>"))).otherwise(own)

    body = F.concat(F.lit("<ol class=\"thread\">"), F.array_join(F.transform(lines, comment), ""), F.lit("</ol>"))
    return _pages(spark, sf, F.col("doc_id"), body)


def comment_rows(spark, sf):
    """Comments in page order with their text and their parent's place. Half of the pages have no comment ids."""
    rows = W.comment_rows(_thread_pages(spark, sf), "doc_id").select(
        "doc_id", "position", "comment_id", "parent_comment", F.md5(H.to_text(F.col("content"))).alias("md5"))
    in_page = Window.partitionBy("doc_id").orderBy("position")
    numbered = rows.withColumn("number", F.row_number().over(in_page))
    # A comment stands once under its own id, as a parent, and once under its parent's: a join of the rows with
    # themselves would read every page twice.
    nothing = F.lit(None)
    own = F.struct(F.when(F.col("doc_id").isNotNull(), F.col("comment_id")).alias("key"), F.col("number").alias("as_parent"),
                   nothing.cast("int").alias("number"), nothing.cast("string").alias("md5"))
    reply = F.struct(F.col("parent_comment").alias("key"), nothing.cast("int").alias("as_parent"), "number", "md5")
    listed = numbered.select("doc_id", F.inline(F.array(own, reply)))
    parents = F.collect_list("as_parent").over(Window.partitionBy("doc_id", "key"))
    return listed.select("doc_id", "key", "number", "md5", F.when(F.col("key").isNotNull(), parents).alias("parents")).filter(
        F.col("number").isNotNull()).select("doc_id", "number", F.explode_outer("parents").alias("parent_number"), "md5")


def _comments(spark, sf):
    """Turns as comments with ids that repeat from conversation to conversation; each fifth is deleted."""
    turn = F.col("turn")
    return read_table(spark, sf, "conversations").select(
        "conv_id", turn.alias("comment_id"), F.when(turn > 0, F.floor((turn - 1) / 2)).cast("bigint").alias("parent_comment"),
        ((turn % 5 == 3) & (turn > 0)).alias("deleted"))


def comment_tree(spark, sf):
    """Live parent, root and depth of each live comment."""
    live = threads.reattach(_comments(spark, sf), within="conv_id")
    return threads.trees(live, within="conv_id")


QUERIES = {f.__name__: f for f in (
    html_round_trip, page_record_json, page_quality_report, work_page_hydration, work_page_record, comment_rows,
    comment_tree)}

_LINE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_LINES = """lines AS (SELECT doc_id, i, l[i] AS line, len(l) AS n FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
_QUOTE = _LINE.format("text || ' in ' || doc_id || ' behind'")
_ALL = _LINE.format("text || ' in ' || doc_id || ' behind ' || '" + TAIL_TEXT.replace("'", "''") + "'")

_STATUS = """CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'private' WHEN doc_id % 17 = 0 THEN 'error'
    WHEN doc_id % 19 = 0 THEN 'unrevealed' WHEN doc_id % 23 = 0 THEN 'malformed' ELSE 'ok' END"""

ORACLES = {
    "html_round_trip": f"SELECT doc_id, md5({_ALL}) AS text_md5, md5({_QUOTE}) AS quote_md5 FROM documents",
    "page_record_json": f"""SELECT doc_id::VARCHAR AS work_id, 'ok' AS status, coalesce(lang, 'none') AS language, source AS title,
            '/tags/' || source || '/works' AS fandom, CAST(n_chars AS INT) AS number_of_words, 1 AS number_of_chapters,
            NULL::INT AS number_of_chapters_planned, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1000 AS INT) ELSE 0 END AS more_users,
            CAST(doc_id % 4 + 1 AS INT) AS users, 'k' || doc_id % 4 AS last_user,
            'rating:Teen warning: category: fandom:' || source || ' relationship: character: additional:Angst+Fluff & co' AS tags,
            '<p>end ' || doc_id || '</p>' AS endnotes, (doc_id + 5) || '/' || (doc_id % 9 + 1) || '/Saga ' || doc_id AS series,
            (doc_id * 3)::VARCHAR AS children, CAST(doc_id AS INT) AS number_of_kudos, '2020-03-05' AS published_at,
            'w' AS author, '<p class="jump">(See the end)</p>' AS jump,
            CASE WHEN doc_id % 2 = 0 THEN 'gift_for' ELSE 'inspired_by' END AS association, CASE WHEN doc_id % 5 <> 1 THEN CAST(doc_id + 1 AS INT) ELSE 0 END AS guests, 2 AS comments,
            doc_id || '1' AS parent, 'guest' AS guest, md5({_LINE.format("text")}) AS md5 FROM documents""",
    "page_quality_report": """SELECT rule, count(*) FILTER (doc_id % every = 0) AS violations FROM documents CROSS JOIN (VALUES
            ('unknown statistic', 8), ('unknown tag type', 7), ('several languages', 9), ('unknown module', 10), ('several end notes', 12),
            ('several root threads', 5), ('several parent links', 14), ('nested quotes', 15), ('bad word count', 16),
            ('no chapters fraction', 18)) rules(rule, every) GROUP BY rule""",
    "work_page_hydration": f"""WITH {_LINES}, texts AS (
            SELECT doc_id, CAST(count(*) AS INT) AS chapters,
                   md5(string_agg({_LINE.format("line || ' mid end'")}, '|' ORDER BY i)) AS text_md5 FROM lines GROUP BY 1)
        SELECT doc_id::VARCHAR AS work_id, {_STATUS} AS status,
            CASE WHEN {_STATUS} = 'ok' THEN chapters END AS chapters, CASE WHEN {_STATUS} = 'ok' THEN text_md5 END AS text_md5,
            CASE WHEN {_STATUS} = 'ok' THEN 'About ' || doc_id || ' quoted reply' END AS summary
        FROM texts""",
    "work_page_record": f"""SELECT doc_id::VARCHAR AS work_id, {_STATUS} AS status,
            CASE WHEN {_STATUS} = 'ok' THEN 'Title' END AS title,
            CASE WHEN {_STATUS} = 'ok' THEN CAST(len(string_split(text, chr(10))) AS INT) END AS chapters,
            CASE WHEN {_STATUS} = 'ok' THEN CAST(len(string_split(text, chr(10))) AS INT) END AS last_chapter,
            NULL::INT AS guests, NULL::INT AS more_users
        FROM documents WHERE doc_id % 13 <> 0""",
    "comment_rows": f"""WITH {_LINES} SELECT doc_id, CAST(i AS INT) AS number,
            CASE WHEN i % 2 = 0 THEN CAST(i - 1 AS INT) END AS parent_number,
            md5({_LINE.format("line || ' quoted reply'")}) AS md5 FROM lines""",
    "comment_tree": """WITH RECURSIVE up AS (
            SELECT conv_id, turn AS comment_id, turn AS at, 0 AS hops,
                   CASE WHEN turn > 0 THEN CAST(floor((turn - 1) / 2) AS BIGINT) END AS next, NULL::BIGINT AS parent
            FROM conversations WHERE NOT (turn % 5 = 3 AND turn > 0)
            UNION ALL
            SELECT conv_id, comment_id, next,
                   hops + CASE WHEN next % 5 = 3 THEN 0 ELSE 1 END,
                   CASE WHEN next > 0 THEN CAST(floor((next - 1) / 2) AS BIGINT) END,
                   CASE WHEN parent IS NULL AND NOT next % 5 = 3 THEN next ELSE parent END
            FROM up WHERE next IS NOT NULL)
        SELECT conv_id, comment_id, max(parent) AS parent_comment, 0::BIGINT AS root, CAST(max(hops) AS INT) AS depth
        FROM up GROUP BY 1, 2""",
}
