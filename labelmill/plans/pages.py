"""Registered queries: fields from HTML pages, references, numbers and dates in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import html as H
from labelmill.functions.scalars import (
    first_match, parse_clock, parse_count, parse_day, parse_fraction, reference_part, work_url)
from labelmill.operators import pages as P
from labelmill.plans import standins as S
from labelmill.plans.text import html_text_sql
from labelmill.sources.readers import read_table

SECTION_KINDS = {"nav": ("nav", None), "ad": ("div", "ad"), "article": ("article", None),
                 "footer": ("footer", None)}


def page_status(spark, sf):
    return (S.pages(spark, sf).select(P.status(F.col("html"), P.ARTICLE_LAYOUT).alias("status"))
            .groupBy("status").agg(F.count("*").alias("pages")))


def page_meta(spark, sf):
    return P.meta(S.pages(spark, sf))


def page_links(spark, sf):
    return P.link_rows(S.pages(spark, sf))


def page_links_by_group(spark, sf):
    """Links grouped by how their path starts."""
    group = (F.when(F.col("path").rlike(r"^/\p{Lu}"), "capital")
             .when(F.col("path").rlike(r"^/\p{Ll}"), "small").otherwise("additional"))
    return P.grouped_links(page_links(spark, sf), group)


def page_links_distinct(spark, sf):
    return P.distinct_links(page_links(spark, sf))


def page_sections(spark, sf):
    return P.sections(S.pages(spark, sf), SECTION_KINDS).select(
        "page_id", "section", F.md5("content").alias("md5"))


def page_chapters(spark, sf):
    return P.chapter_rows(S.pages(spark, sf), P.ARTICLE_LAYOUT).select(
        "page_id", "number", F.md5("content").alias("md5"))


def page_text(spark, sf):
    return P.text_rows(S.pages(spark, sf)).select(
        "page_id", F.md5("text").alias("md5"), F.length("text").alias("length"))


def page_counters(spark, sf):
    """Numbers inside pages: with commas, by pattern, and from the last match of a list."""
    html = F.col("html")
    prices = F.regexp_extract_all(html, F.lit(r">[^<]*?(\d[\d,]*)"), F.lit(1))
    return S.pages(spark, sf).select(
        "page_id",
        parse_count(first_match(html, r"<!-- ad ([\d,]*) -->")).alias("ad"),
        parse_count(first_match(html, r"track\(([\d,]*)\)")).alias("track"),
        parse_count(F.try_element_at(prices, F.lit(-1))).alias("last_number"),
        F.size(H.links(html)).alias("links"), P.page_count(html).alias("comment_pages"))


def url_parts(spark, sf):
    """Parts of page addresses, and references built from them and read back by their patterns."""
    url = F.col("url")
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    parts = read_table(spark, sf, "pages").select(
        "page_id", site.alias("site"), first_match(url, r"^https?://[^/]+/([a-z]{2})/").alias("lang"),
        first_match(url, r"^https?://[^/]+/[a-z]{2}/(\d+)").try_cast("bigint").alias("id"))
    number = F.col("id").cast("string")
    work = F.concat("site", work_url(F.col("id"), ""))
    return parts.select(
        "page_id", "lang", "id", reference_part(work, "work_id").alias("work"),
        reference_part(F.concat(work, F.lit("&page=3")), "comment_page").alias("comment_page"),
        reference_part(F.concat(F.lit("/works/1/chapters/"), number), "chapter_id").alias("chapter"),
        reference_part(F.concat("site", F.lit("/series/"), number), "series_id").alias("series"),
        reference_part(F.concat(F.lit("/comments/"), number, F.lit("?x=1")), "comment_id").alias("comment"),
        reference_part(F.concat(F.lit("/users/"), "lang", F.lit("/pseuds/x")), "user").alias("user"),
        reference_part(F.concat(F.lit("/users/"), "lang", F.lit("/gifts")), "gift_user").alias("gift_user"),
        reference_part(work, "series_id").alias("none"))


def parse_fractions(spark, sf):
    """`linenumber/quantity` as text, with `?` for quantities above 40, parsed back."""
    quantity = F.col("l_quantity").cast("int")
    text = F.concat_ws("/", F.col("l_linenumber").cast("string"),
                       F.when(quantity > 40, "?").otherwise(quantity.cast("string")))
    return (
        read_table(spark, sf, "lineitem").select(text.alias("value"))
        .groupBy("value").agg(F.count("*").alias("rows"))
        .withColumn("f", parse_fraction(F.col("value")))
        .select("value", "f.present", "f.planned", "rows")
    )


def parse_dates(spark, sf):
    """Order dates as text in two formats, some of them damaged, parsed back."""
    day = F.col("o_orderdate")
    damaged = F.col("o_orderkey") % 50 == 0
    texts = read_table(spark, sf, "orders").select(
        F.date_format(day, "yyyy-MM").alias("month"),
        F.when(damaged, F.lit("unknown")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("plain"),
        F.when(damaged, F.lit("soon")).otherwise(
            F.concat(F.date_format(day, "d MMM yyyy "), F.lit("03:14PM"))).alias("clock"))
    return texts.groupBy("month").agg(
        F.count("*").alias("rows"), F.count_if(parse_day(F.col("plain")).isNull()).alias("bad_days"),
        F.date_format(F.max(parse_day(F.col("plain"))), "yyyy-MM-dd").alias("last_day"),
        F.count_if(parse_clock(F.col("clock")).isNull()).alias("bad_clocks"),
        F.date_format(F.max(parse_clock(F.col("clock"))), "yyyy-MM-dd HH:mm").alias("last_clock"))


QUERIES = {f.__name__: f for f in (
    page_status, page_meta, page_links, page_links_by_group, page_links_distinct, page_sections,
    page_chapters, page_text, page_counters, url_parts, parse_dates)}
QUERIES["parse_fraction"] = parse_fractions

_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>"""
_LINKS = f"""links AS (
    SELECT page_id, i AS position, {html_text_sql('names[i]')} AS name, paths[i] AS path
    FROM (SELECT page_id, names, paths, unnest(range(1, len(paths) + 1)) AS i
          FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS paths,
                       regexp_extract_all(html, '{_LINK}', 2) AS names FROM pages)))"""
_PARAGRAPH = r"(?is)<p\b[^>]*>([^<]*)</p>"

ORACLES = {
    "page_status": r"""SELECT CASE WHEN contains(html, 'id="signin"') THEN 'private'
            WHEN contains(html, 'class="system errors"') THEN 'error'
            WHEN contains(html, 'will be revealed soon!') THEN 'unrevealed'
            WHEN NOT regexp_matches(html, '(?is)<body\b.*</body\s*>') THEN 'malformed' ELSE 'ok' END AS status,
        count(*) AS pages FROM pages GROUP BY 1""",
    "page_meta": f"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
        {html_text_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
        {html_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM pages""",
    "page_links": f"WITH {_LINKS} SELECT page_id, CAST(position AS INT) AS position, name, path FROM links",
    "page_links_by_group": rf"""WITH {_LINKS}
        SELECT page_id, CASE WHEN regexp_matches(path, '^/\p{{Lu}}') THEN 'capital'
            WHEN regexp_matches(path, '^/\p{{Ll}}') THEN 'small' ELSE 'additional' END AS link_group,
            count(*) AS links FROM links GROUP BY 1, 2""",
    "page_links_distinct": f"WITH {_LINKS} SELECT DISTINCT name, path FROM links",
    "page_sections": r"""WITH found AS (
            SELECT page_id, 'nav' AS section, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS content FROM pages
            WHERE regexp_matches(html, '(?s)<nav>.*?</nav>')
            UNION ALL SELECT page_id, 'ad', regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) FROM pages
            WHERE regexp_matches(html, '(?s)<div class="ad">.*?</div>')
            UNION ALL SELECT page_id, 'article', regexp_extract(html, '(?s)<article>(.*?)</article>', 1) FROM pages
            WHERE regexp_matches(html, '(?s)<article>.*?</article>')
            UNION ALL SELECT page_id, 'footer', regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) FROM pages
            WHERE regexp_matches(html, '(?s)<footer>.*?</footer>'))
        SELECT page_id, section, md5(content) AS md5 FROM found""",
    "page_chapters": f"""WITH many AS (SELECT page_id, html, regexp_extract_all(html, '{_PARAGRAPH}', 1) AS c FROM pages)
        SELECT page_id, CAST(i AS INT) AS number, md5(c[i]) AS md5
        FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS i FROM many)
        UNION ALL
        SELECT page_id, NULL, md5(nullif(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''))
        FROM many WHERE len(c) = 0""",
    "page_text": f"""SELECT page_id, md5(t) AS md5, CAST(length(t) AS INT) AS length
        FROM (SELECT page_id, {html_text_sql('html')} AS t FROM pages)""",
    "page_counters": r"""SELECT page_id,
        try_cast(replace(regexp_extract(html, '<!-- ad ([\d,]*) -->', 1), ',', '') AS INT) AS ad,
        try_cast(replace(regexp_extract(html, 'track\(([\d,]*)\)', 1), ',', '') AS INT) AS track,
        try_cast(replace(regexp_extract_all(html, '>[^<]*?(\d[\d,]*)', 1)[-1], ',', '') AS INT) AS last_number,
        CAST(len(regexp_extract_all(html, '(?s)<a [^>]*href="[^"]*"[^>]*>.*?</a>')) AS INT) AS links,
        coalesce(try_cast(regexp_extract_all(html, '>\s*(\d+)\s*</a\s*>', 1)[-1] AS INT), 1) AS comment_pages
        FROM pages""",
    "url_parts": r"""WITH p AS (SELECT page_id, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang,
            try_cast(nullif(regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\d+)', 1), '') AS BIGINT) AS id FROM pages)
        SELECT page_id, lang, id, id::VARCHAR AS work, CASE WHEN id IS NOT NULL THEN '3' END AS comment_page,
            id::VARCHAR AS chapter, id::VARCHAR AS series, id::VARCHAR AS comment, lang AS "user", lang AS gift_user,
            NULL::VARCHAR AS "none" FROM p""",
    "parse_fraction": """SELECT value, CAST(n AS INT) AS present,
        CASE WHEN q > 40 THEN NULL ELSE q END AS planned, count(*) AS rows
        FROM (SELECT l_linenumber AS n, CAST(trunc(l_quantity) AS INT) AS q,
              l_linenumber::VARCHAR || '/' || CASE WHEN trunc(l_quantity) > 40 THEN '?'
              ELSE CAST(trunc(l_quantity) AS INT)::VARCHAR END AS value FROM lineitem)
        GROUP BY 1, 2, 3""",
    "parse_dates": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows,
        count(*) FILTER (o_orderkey % 50 = 0) AS bad_days,
        strftime(max(o_orderdate) FILTER (o_orderkey % 50 <> 0), '%Y-%m-%d') AS last_day,
        count(*) FILTER (o_orderkey % 50 = 0) AS bad_clocks,
        strftime(max(o_orderdate) FILTER (o_orderkey % 50 <> 0), '%Y-%m-%d') || ' 15:14' AS last_clock
        FROM orders GROUP BY 1""",
}
