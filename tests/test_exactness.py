"""Nothing is lost in silence: nested elements, references, vectors of wrong width, ids that repeat, wide vocabularies."""

import html as standard

import pytest
from pyspark.sql import functions as F

from labelmill.functions import html as H
from labelmill.functions.labelsets import LabelSet
from labelmill.functions.scalars import parse_count, strip
from labelmill.operators import evaluate, labeling, pages, scoring, support, threads

AB = LabelSet(["a", "b"], open_labels=frozenset(["a"]), by_frequency=["a", "b"])
ONE = LabelSet(["a"], by_frequency=["a"])
SETS = {"coarse": ONE, "fine": AB}


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_text_with_signs_stays(spark):
    texts = ["I <3 you all. if a < b then c > d end", "x<br>y <!-- z --> w", "a <b>b</b>c <1 d"]
    assert one(spark, H.to_text, *texts) == ["I <3 you all. if a < b then c > d end", "x y w", "a bc <1 d"]


@pytest.mark.parametrize("text", [
    "caf&eacute; &pound;5 &#00000233; &#xE9;&#146;", "&#38;lt; &amp;amp; &lt", "&copy 2020 &notanentity; & &; &# &#x", "&#0; &#xD800; &#99999999;",
    "&NotEqualTilde; &nbsp;x", "no references"])
def test_references_as_the_standard_has_them(spark, text):
    assert one(spark, H.decode_entities, text) == [standard.unescape(text).replace("¬anentity;", "&notanentity;")]


def test_elements_end_at_their_own_tag(spark):
    nested = "<div><blockquote class='u'>a<blockquote>q</blockquote>b</blockquote>c</div><blockquote>d</blockquote>"
    open_ = "<blockquote class='u'>a<blockquote>q</blockquote>"
    assert one(spark, lambda v: H.inner(v, "blockquote", cls="u"), nested, open_, "x") == ["a<blockquote>q</blockquote>b", None, None]
    assert one(spark, H.children, "<p id='a'>x<b>y</b></p><br><img src='z'/><div id='b'></div>") == [
        ["<p id='a'>", "<br>", "<img src='z'/>", "<div id='b'>"]]


def test_login_box_counts_in_its_place_only(spark):
    work = "<div id='workskin'></div>"
    footer = f"<div id='inner' class='wrapper'><div id='main'>{work}<div><p id='signin'>x</p></div></div></div><p id='signin'>in</p>"
    private = "<div id='inner' class='wrapper'><div id='main'><a>b</a><div id='signin'>x</div></div></div>"
    error = "<div id='inner' class='wrapper'><div class='system errors'><h2>x</h2></div></div>"
    assert one(spark, lambda v: pages.status(v, pages.WORK_LAYOUT), footer, private, error) == ["ok", "private", "error"]


def test_strip_takes_all_white_space(spark):
    assert one(spark, strip, "7\t", "\n a b ", "") == ["7", "a b", ""]
    assert one(spark, parse_count, "1,234\t") == [1234]


def preds(spark):
    rows = [(1, "coarse_x", [1], [1]), (2, "coarse_x", [0], [1]), (1, "fine_x", [1, 0], [1, 1]), (2, "fine_x", [1, 0], [1, 0]),
            (3, "fine_x", None, [1, 0]), (4, "fine_x", [1, 0], None), (5, "fine_x", [1], [1, 0]), (6, "fine_x", [1, 0, 1], [1, 0, 1])]
    return spark.createDataFrame(rows, "work_id int, model string, truth array<int>, pred array<int>")


def test_flawed_rows_are_listed_and_never_counted_in_part(spark):
    found = {r["work_id"]: r["flaw"] for r in scoring.rejected(preds(spark), SETS).collect()}
    assert found == {3: "no truth", 4: "no prediction", 5: "wrong width", 6: "wrong width"}
    counted = scoring.confusion(scoring.accepted(preds(spark), SETS), SETS, ["model"]).collect()
    assert {(r["model"], r["label"], r["n"]) for r in counted} == {("coarse_x", "a", 2), ("fine_x", "a", 2), ("fine_x", "b", 2)}
    with pytest.raises(Exception, match="wrong width"):
        scoring.confusion(preds(spark).filter("work_id = 6"), SETS, ["model"]).collect()
    with pytest.raises(Exception, match="no truth"):
        scoring.report(preds(spark).filter("work_id = 3"), AB).collect()


def test_one_evaluation_for_models_of_both_levels(spark):
    records = spark.createDataFrame([(1, 100, [1, 0], [1]), (1, 100, [1, 0], [1]), (2, 600, [0, 0], [0])],
                                    "work_id int, n_words int, support_fine array<int>, support_coarse array<int>")
    done = evaluate.evaluate(preds(spark), records, ["coarse_x", "fine_x"], SETS)
    scores = {(r["model"], r["slice"]): r for r in done.scores.collect()}
    assert scores["coarse_x", "all"]["n"] == 2 and scores["fine_x", "all"]["sub_acc"] == 0.5
    assert scores["fine_x", "512"]["n"] == 1 and scores["fine_x", "open"]["mic_f1"] == 1.0
    assert ("coarse_x", "open") not in scores
    classes = [(r["level"], r["label"], r["coarse_x"], r["fine_x"]) for r in done.classes.collect()]
    assert classes == [("coarse", "a", pytest.approx(2 / 3), None), ("fine", "a", None, 1.0), ("fine", "b", None, 0.0)]
    assert "top_f1" in done.properties.columns and done.tree.count() == 2
    assert {r["work_id"] for r in done.without_metadata.collect()} == {3, 4, 5, 6}


def test_replies_stay_in_their_work(spark):
    rows = [(w, f"{w}#{i}" if named else str(i), p, d) for w, named in (("x", False), ("y", False)) for i, p, d in (
        (1, None, False), (2, "1", True), (3, "2", False), (4, "3", True), (5, "4", False))]
    comments = spark.createDataFrame(rows, "work_id string, comment_id string, parent_comment string, deleted boolean")
    live = threads.reattach(comments, within="work_id")
    got = {(r["work_id"], r["comment_id"]): r["parent_comment"] for r in live.collect()}
    assert live.count() == 6 and got == {(w, i): p for w in "xy" for i, p in (("1", None), ("3", "1"), ("5", "3"))}
    tree = {(r["work_id"], r["comment_id"]): (r["root"], r["depth"]) for r in threads.trees(live, within="work_id").collect()}
    assert tree == {(w, i): ("1", d) for w in "xy" for i, d in (("1", 0), ("3", 1), ("5", 2))}


def test_long_chains_and_missing_parents(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(500, 999)]
    comments = spark.createDataFrame(rows, "comment_id long, parent_comment long")
    got = {r["comment_id"]: (r["root"], r["depth"]) for r in threads.trees(comments).collect()}
    assert got == {i: (0, i) for i in range(200)} | {500: (500, 0)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "comment_id long, parent_comment long")
    with pytest.raises(ValueError):
        threads.trees(loop, rounds=4)


def test_a_hundred_labels(spark):
    wide = LabelSet([f"l{i}" for i in range(100)], {f"l{i}": "low" if i < 70 else "high" for i in range(100)})
    rows = spark.createDataFrame([(u, f"l{i}") for u in (1, 2) for i in range(0, 100, u + 1)] + [(3, "other")], "unit int, label string")
    got = {(r["unit"], r["coarse"]): r["fine_labels"] for r in labeling.rollup(rows, wide, ["unit"]).collect()}
    assert got == {(1, "low"): 35, (1, "high"): 15, (2, "low"): 24, (2, "high"): 10}
    masks = [F.bit_or(labeling.mask_of(F.col("label"), wide, w)) for w in range(labeling.n_masks(wide))]
    row = rows.filter("unit = 2").agg(labeling.unmask(masks, wide).alias("v")).first()
    assert [i for i, bit in enumerate(row["v"]) if bit] == list(range(0, 100, 3))


def test_repeated_work_ids_do_not_multiply_support(spark):
    works = spark.createDataFrame([("w", ["t"]), ("w", ["t", "t"])], "work_id string, freeform array<string>").withColumns({
        "warnings_fine_open": F.array(F.lit("a")), "warnings_coarse_open": F.array(F.lit("a")), "n_words": F.lit(1), "n_chapters": F.lit(1)})
    tags = spark.createDataFrame([("t", "a")], "tag string, warning string")
    rows = support.work_records(works, tags, AB, ONE).collect()
    assert len(rows) == 1 and rows[0]["support_fine"][0] == len(rows[0]["freeform"])
