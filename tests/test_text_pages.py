import datetime
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from labelmill.functions import elements
from labelmill.functions import html as H
from labelmill.functions import scalars
from labelmill.functions import text as X
from labelmill.operators import hydrate, pages, threads, work_pages
from labelmill.operators.prepare import prepare_works
from labelmill.plans import text as text_plan


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_clean_keeps_accents_and_spaces(spark):
    assert one(spark, "Café — naïve!?", X.clean) == "café  naïve!?"
    assert one(spark, ["A—b", "C"], X.join_chapters, "array<string>") == "ab c"


def test_tokens_ngrams_truncate(spark):
    assert one(spark, "Don't stop, now!", X.tokens) == ["don", "'", "t", "stop", ",", "now", "!"]
    words = ["a", "b", "c"]
    assert one(spark, words, lambda w: X.ngrams(w, 1, 3), "array<string>") == [
        "a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, ["a"], lambda w: X.ngrams(w, 2), "array<string>") == []
    assert one(spark, [], lambda w: X.ngrams(w, 1, 5), "array<string>") == []
    cut = one(spark, words, lambda w: X.truncate(w, 2), "array<string>")
    assert (cut["tokens"], cut["kept"], cut["dropped"], cut["padded"]) == (["a", "b"], 2, 1, 0)


def test_html_to_text(spark):
    page = ("<html><head><title>T</title></head><body><!-- c --><script>var t='</p>';</script>"
            "<p>a<b>b</b> &amp;lt; &#233;&#x1F600; &copy;</p>\n<p>x &quot;y&quot;</p></body></html>")
    assert one(spark, page, H.to_text) == 'ab &lt; é😀 © x "y"'
    assert one(spark, None, H.to_text) is None


def test_numbers_and_dates(spark):
    assert one(spark, "1,234", scalars.parse_count) == 1234
    assert one(spark, "", scalars.parse_count) is None
    assert tuple(one(spark, "3/?", scalars.parse_fraction)) == (3, None)
    assert tuple(one(spark, "3/5", scalars.parse_fraction)) == (3, 5)
    assert one(spark, "2020-03-05", scalars.parse_day) == datetime.date(2020, 3, 5)
    assert one(spark, "5 Mar 2020 03:14PM", scalars.parse_clock) == datetime.datetime(2020, 3, 5, 15, 14)
    assert one(spark, "soon", scalars.parse_clock) is None
    assert one(spark, "soon", scalars.parse_day) is None


def test_references(spark):
    assert one(spark, "/works/12/chapters/34", lambda p: scalars.reference_part(p, "chapter_id")) == "34"
    assert one(spark, "https://host.example/series/9", lambda p: scalars.reference_part(p, "series_id")) == "9"
    assert one(spark, "/users/ann/pseuds/x", lambda p: scalars.reference_part(p, "user")) == "ann"
    assert one(spark, "/tags/x", lambda p: scalars.reference_part(p, "work_id")) is None
    url = one(spark, "7", lambda w: scalars.work_url(w, "https://host.example"))
    assert url == "https://host.example/works/7?show_comments=true&view_adult=true&view_full_work=true"


def test_association_rules(spark):
    assert one(spark, "For Ann and Bob.", X.classify) == "gift_for"
    assert one(spark, "Inspired by Sun by Ann. ", X.classify) == "inspired_by"
    assert one(spark, "A translation of Sun by Ann. ", X.classify) == "translated_from"
    assert one(spark, "Translation into English available: Sun by Ann", X.classify) == "translation_into"
    assert one(spark, "So, For Ann.", X.classify) == "unmatched"


def page(**kw):
    words = kw.get("words", "1,234")
    chapters = kw.get("chapters", """
      <div class="chapter" id="chapter-1"><div class="chapter preface group"><h3 class="title"><a href="/works/5/chapters/51">Chapter 1</a></h3></div>
        <div class="userstuff module"><p>One &amp; all</p></div></div>
      <div class="chapter" id="chapter-2"><div class="userstuff module"><p>Two</p></div></div>""")
    return f"""<html><body><div id="inner" class="wrapper"><div id="main">
    <div class="wrapper"><dl class="work meta group">
      <dd class="rating tags"><ul class="commas"><li><a class="tag" href="/tags/T">Teen</a></li></ul></dd>
      <dd class="freeform tags"><ul class="commas"><li><a class="tag" href="/tags/a">Angst</a></li>
        <li><a class="tag" href="/tags/b">Fluff</a></li></ul></dd>
      <dd class="language">English</dd>
      <dd class="series"><span class="series"><span class="position">Part 2 of <a href="/series/77">Saga</a></span></span></dd>
      <dd class="stats"><dl class="stats"><dd class="published">2020-03-05</dd><dd class="words">{words}</dd>
        <dd class="chapters">3/?</dd><dd class="kudos">10</dd><dd class="hits">2,000</dd></dl></dd>
    </dl></div>
    <div id="workskin"><div class="preface group"><h2 class="title heading"> Sun </h2>
      <h3 class="byline heading"><a href="/users/ann">ann</a>, <a href="/users/ann">ann</a></h3>
      <div class="summary module"><h3 class="heading">Summary:</h3><blockquote class="userstuff"><p>S</p></blockquote></div>
      <div class="notes module"><h3 class="heading">Notes:</h3><blockquote class="userstuff"><p>N</p></blockquote></div></div>
      <div id="chapters">{chapters}</div>
      <div id="work_endnotes" class="end notes module"><h3 class="heading">Notes:</h3><blockquote class="userstuff">E</blockquote></div>
    </div>
    <div id="feedback" class="feedback"><div id="kudos"><p class="kudos"><a href="/users/bob">bob</a>,
       <a href="/works/5/kudos">12 more users</a> as well as 3 guests left kudos on this work!</p></div>
      <div id="comments_placeholder"><ol class="pagination actions"><li><a href="?page=1">1</a></li><li><a href="?page=9">9</a></li><li class="next"><a href="?page=2">Next</a></li></ol>
      <ol class="thread">
       <li class="comment group" id="comment_1"><h4 class="heading byline"><a href="/users/cat">cat</a>
         <span class="parent">on Chapter 2</span><span class="posted datetime"><abbr class="day">Thu</abbr>
         <span class="date">5</span> <abbr class="month">Mar</abbr> <span class="year">2020</span>
         <span class="time">03:14PM</span> <abbr class="timezone" title="UTC">UTC</abbr></span></h4>
         <blockquote class="userstuff"><p>hi <ol><li>x</li></ol></p></blockquote></li>
       <li><ol class="thread">
         <li class="comment group" id="comment_2">(deleted)</li>
         <li><ol class="thread"><li class="comment group" id="comment_3"><h4 class="heading byline">Guest
           <span class="posted datetime"></span></h4><blockquote class="userstuff">yo</blockquote>
           <ul class="actions"><li><a href="/comments/1">Parent Thread</a></li></ul></li></ol></li>
       </ol></li>
       <li class="comment group" id="comment_4"><h4 class="heading byline"><a href="/users/dan">dan</a></h4>
         <blockquote class="userstuff">end</blockquote></li>
      </ol></div></div></div></div></body></html>"""


def pages_df(spark, *rows):
    return spark.createDataFrame(list(rows), "work_id string, html string")


def test_work_record(spark):
    row = work_pages.work_record(pages_df(spark, ("5", page()))).first()
    assert row["status"] == "ok" and row["title"] == "Sun" and row["language"] == "English"
    assert [t["name"] for t in row["tags"]["additional"]] == ["Angst", "Fluff"]
    assert [t["path"] for t in row["tags"]["rating"]] == ["/tags/T"] and row["tags"]["warning"] == []
    assert (row["number_of_chapters"], row["number_of_chapters_planned"]) == (3, None)
    assert (row["number_of_words"], row["number_of_hits"], row["number_of_comments"]) == (1234, 2000, 0)
    assert row["published_at"] == datetime.date(2020, 3, 5) and row["updated_at"] is None
    assert [a["name"] for a in row["authors"]] == ["ann"]
    assert row["series"][0]["series_id"] == "77" and row["series"][0]["part"] == "2"
    assert row["summary"]["content"] == "<p>S</p>" and row["notes"]["heading"] == "Notes:"
    assert row["endnotes"]["module_type"] == "end_notes" and row["endnotes"]["content"] == "E"
    kudos = row["kudos_from"]
    assert [u["name"] for u in kudos["users"]] == ["bob"]
    assert (kudos["more_users"], kudos["guests"], row["comment_pages"]) == (12, 3, 9)


def test_record_chapters_and_hydration(spark):
    single = page(chapters='<div class="userstuff"><p>Only</p></div>')
    df = pages_df(spark, ("m", page()), ("s", single), ("x", "<p>"))
    many = {r["work_id"]: r["chapters"] for r in work_pages.work_record(df).collect()}
    assert [(c["title"], c["chapter_index"], c["path"], c["content"]) for c in many["m"]] == [
        ("Chapter 1", 1, "/works/5/chapters/51", "<p>One &amp; all</p>"), (None, 2, None, "<p>Two</p>")]
    assert [c["chapter_index"] for c in many["s"]] == [None] and many["x"] is None
    got = {r["work_id"]: r for r in work_pages.hydration(df).collect()}
    assert got["m"]["text"] == ["<p>One &amp; all</p>", "<p>Two</p>"] and got["s"]["text"] == ["<p>Only</p>"]
    assert (got["m"]["summary"], got["m"]["notes"], got["m"]["endnotes"]) == ("<p>S</p>", "<p>N</p>", "E")
    assert got["x"]["status"] == "malformed" and got["x"]["text"] is None


def test_empty_word_count_is_null(spark):
    assert work_pages.work_record(pages_df(spark, ("5", page(words="")))).first()["number_of_words"] is None


def test_chapters_many_and_single(spark):
    single = page(chapters='<div class="userstuff"><p>Only</p></div>')
    rows = pages.chapter_rows(pages_df(spark, ("m", page()), ("s", single)), pages.WORK_LAYOUT, "work_id")
    got = {(r["work_id"], r["number"]): r["content"] for r in rows.collect()}
    assert set(got) == {("m", 1), ("m", 2), ("s", None)}
    assert "One &amp; all" in got[("m", 1)] and "Two" not in got[("m", 1)]
    assert got[("s", None)].startswith("<p>Only</p>")


def test_page_status(spark):
    signin = '<div id="inner" class="wrapper"><div id="main"><div id="signin"></div></div></div>'
    error = '<div id="inner" class="wrapper"><div class="system errors"><h2 class="heading">E</h2></div></div>'
    hidden = ('<p class="notice">This work is part of an ongoing challenge and will be revealed soon! '
              'You can find details here: x</p>')
    df = pages_df(spark, ("a", signin), ("b", error), ("c", hidden), ("d", "<p>"), ("e", page()))
    got = {r[0]: r[1] for r in df.select("work_id", pages.status(F.col("html"), pages.WORK_LAYOUT)).collect()}
    assert got == {"a": "private", "b": "error", "c": "unrevealed", "d": "malformed", "e": "ok"}


def test_comments(spark):
    rows = work_pages.comment_rows(pages_df(spark, ("5", page())))
    got = {r["comment_id"]: r for r in rows.collect()}
    assert {k: r["parent_comment"] for k, r in got.items()} == {"1": None, "2": "1", "3": "2", "4": None}
    assert got["2"]["deleted"] and not got["1"]["deleted"]
    assert got["1"]["published_at"] == datetime.datetime(2020, 3, 5, 15, 14)
    assert got["1"]["refers_to_chapter"] == 2 and got["1"]["timezone"]["title"] == "UTC"
    assert tuple(got["1"]["author"]) == ("cat", "/users/cat") and tuple(got["3"]["author"]) == ("Guest", None)
    assert got["3"]["parent_thread"] == "1" and got["4"]["content"] == "end"
    live = {r["comment_id"]: r["parent_comment"] for r in threads.reattach(
        rows.select("comment_id", "parent_comment", "deleted")).collect()}
    assert live == {"1": None, "3": "1", "4": None}


def test_reattach_follows_chains_and_hot_parents(spark):
    rows = [("0", None, False)] + [(str(i), str(i - 1), True) for i in range(1, 12)]
    rows += [(f"r{i}", "11", False) for i in range(300)] + [("t", "r0", False)]
    got = {r[0]: r[1] for r in threads.reattach(spark.createDataFrame(
        rows, "comment_id string, parent_comment string, deleted boolean")).collect()}
    assert got == {"0": None, "t": "r0", **{f"r{i}": "0" for i in range(300)}}


def test_previous_in_group_over_many_blocks(spark):
    orders = {"hot": [0, 1, 2, 5, 9, 30, 31, 64, 100, 101, 500], "cold": [3], "late": [70, 200]}
    df = spark.createDataFrame([(g, o) for g, os in orders.items() for o in os], "g string, o bigint")
    got = {(r["g"], r["o"]): (r["previous"], r["rank"], r["first"])
           for r in threads.previous_in_group(df, "g", "o", block=4).collect()}
    for g, os in orders.items():
        for i, o in enumerate(os):
            assert got[(g, o)] == (os[i - 1] if i else None, i, os[0])


def test_record_json(spark):
    record = work_pages.work_record(pages_df(spark, ("5", page())))
    data = json.loads(pages.record_json(record, "work_id").first()["record"])
    assert data["published_at"] == "2020-03-05" and data["updated_at"] is None


def test_quality_report(spark):
    twice = page().replace('<dd class="language">English</dd>', '<dd class="language">A</dd><dd class="language">B</dd>')
    got = {r["rule"]: r["violations"] for r in work_pages.quality_report(
        pages_df(spark, ("1", page()), ("2", twice)), work_pages.work_rules()).collect()}
    assert got["several languages"] == 1 and got["unknown module"] == 0


def test_hydrate(spark):
    works = spark.createDataFrame([("1", ["t"]), ("2", []), ("3", [])], "work_id string, freeform array<string>")
    found = spark.createDataFrame(
        [("1", "ok", None), ("2", "private", None)], "work_id string, status string, notes string")
    attached = hydrate.attach_pages(works, found)
    assert {r[0]: r[1] for r in hydrate.outcome(attached).collect()} == {"ok": 1, "private": 1, "missing": 1}
    assert [r["notes"] for r in hydrate.available(attached).collect()] == [""]
    splits = spark.createDataFrame([("1", "train"), ("1", "small"), ("1", "train"), ("2", "test")],
                                   "work_id string, split string")
    got = sorted((r["work_id"], r["split"]) for r in hydrate.assign_splits(works, splits).collect())
    assert got == [("1", "small"), ("1", "train"), ("2", "test")]
    assert [r["work_id"] for r in hydrate.unassigned(works, splits).collect()] == ["3"]
    assert [r["work_id"] for r in hydrate.duplicate_keys(splits).orderBy("work_id").collect()] == ["1"]


def test_prepare(spark):
    works = spark.createDataFrame(
        [("1", ["<p>Hi — &amp;</p>", "<b>Two</b>"], ["abuse"], ["abuse"])],
        "work_id string, text array<string>, warnings_fine_open array<string>, warnings_coarse_open array<string>")
    row = prepare_works(works, "warnings_coarse_open").first()
    assert row["text"] == "hi   two" and row["labels"] == [0, 0, 1, 0, 0, 0, 0]


def test_elements_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(elements, "BATCH_ELEMENTS", 2)
    pages = spark.createDataFrame([(i, None if i == 2 else "<p>a</p>" * i) for i in range(5)], "page_id long, html string").coalesce(1)
    found = elements.with_elements(pages, "html", [elements.Mark("p", "p", keep=True)])
    assert {r["page_id"]: None if r["elements"] is None else [e["raw"] for e in r["elements"]] for r in found.collect()} == {
        0: [], 1: ["a"], 2: None, 3: ["a"] * 3, 4: ["a"] * 4}


def test_grams_are_counted_over_documents(monkeypatch):
    monkeypatch.setattr(text_plan, "COUNTED_TERMS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([["a", "b"], None, [], ["a", "b", "c"], ["a"]])], ["tokens"])
    total = Counter()
    for part in text_plan._count_grams([batch]):
        for term, count in zip(*[column.to_pylist() for column in part.columns]):
            total[term] += count
    assert total == {"a": 3, "b": 2, "a b": 2, "c": 1, "b c": 1, "a b c": 1}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_looked_up_once_each(spark):
    frame = spark.createDataFrame([("&amp;eacute; &eacute &#233;&#xe9; &#00065; &#0; &#x110000; &#146; &nope; &;& &amp",)], "t string")
    text = frame.select(H.decode_entities(F.col("t")).alias("t"))
    assert _plan(text).count("crc32(") == 1
    assert text.first()["t"] == "&eacute; é éé A � � ’ &nope; &;& &"
    spaces = frame.select(H.one_line(F.lit(" a  b\t c\n\n d\x0b e ")).alias("t"))
    assert spaces.first()["t"] == "a b c d e"


def test_start_tags_that_come_again_are_read_once(monkeypatch):
    seen = []
    fits = elements.Mark.fits
    monkeypatch.setattr(elements.Mark, "fits", lambda self, *a: seen.append(a) or fits(self, *a))
    read = elements.tag_reader({"p": [elements.Mark("p", "p", "x")]})
    rows = elements.walk("<p class='x'>a</p>" * 50 + "<p class='y'>b</p>" * 50, read)
    assert len(rows) == 50 and len(seen) == 2
    long = f"<p class='x' title='{'t' * elements.KNOWN_LENGTH}'>"
    assert len(elements.walk(long * 3, read)) == 3 and len(seen) == 5


def test_classes_and_blank_dates_are_looked_at_once(spark):
    from labelmill.functions.scalars import parse_clock
    from labelmill.operators import work_pages

    found = spark.createDataFrame([([],)], f"found array<struct<{elements.ELEMENT[7:-1]},text:string>>")
    for field in (work_pages.tags(F.col("found"), F.col("found")), work_pages.stats(F.col("found"))):
        assert "lambdafunction(struct(e, " in _plan(found.select(field))
    texts = spark.createDataFrame([("",), (" ",), ("5 Mar 2020 03:14PM",)], "t string").select(parse_clock(F.col("t")).alias("at"))
    assert [str(r["at"]) for r in texts.collect()] == ["None", "None", "2020-03-05 15:14:00"]


def test_comment_rows_read_every_page_once(spark):
    from labelmill.plans import works

    assert _plan(works.comment_rows(spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1


def test_comment_rows_match_parents_inside_a_page(spark, monkeypatch):
    from labelmill.plans import works

    rows = [(1, 1, "a", None), (1, 2, "b", "a"), (1, 3, "c", "gone"), (2, 1, "a", None), (2, 5, "d", "a"), (None, 1, "a", None), (None, 2, "e", "a")]
    found = spark.createDataFrame([(*r, "text") for r in rows], "doc_id long, position int, comment_id string, parent_comment string, content string")
    monkeypatch.setattr(works, "_thread_pages", lambda *_: None)
    monkeypatch.setattr(works.W, "comment_rows", lambda *_: found)
    got = sorted(((r.doc_id or 0, r.number, r.parent_number) for r in works.comment_rows(spark, "").collect()), key=str)
    assert got == sorted([(1, 1, None), (1, 2, 1), (1, 3, None), (2, 1, None), (2, 2, 1), (0, 1, None), (0, 2, None)], key=str)
