import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import scalars
from labelmill.functions.labelsets import LabelSet
from labelmill.operators import scoring, support
from labelmill.session import small_table

ABC = LabelSet(["a", "b", "c"], open_labels=frozenset(["c"]))
SCHEMA = "work_id int, model string, truth array<int>, pred array<int>"


def rows(n, seed=1, models=("fine_x", "coarse_y")):
    rng = random.Random(seed)
    bits = lambda: [rng.randint(0, 1), rng.randint(0, 1), 0]  # noqa: E731 - label c never occurs
    return [(i, m, bits(), bits()) for i in range(n) for m in models]


def by_hand(pairs, positions):
    """Scores in plain Python: (mac_p, mac_r, mac_f1, mic_p, mic_r, mic_f1, sub_acc)."""
    div = lambda a, b: a / b if b else 0.0
    counts = []
    for i in positions:
        tp = sum(t[i] and p[i] for t, p in pairs)
        counts.append((tp, sum(p[i] for _, p in pairs) - tp, sum(t[i] for t, _ in pairs) - tp))
    prf = lambda tp, fp, fn: (div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn))
    each = [prf(*c) for c in counts]
    macro = [sum(x) / len(each) for x in zip(*each)]
    same = sum(all(t[i] == p[i] for i in positions) for t, p in pairs) / len(pairs)
    return (*macro, *prf(*[sum(c) for c in zip(*counts)]), same)


COLUMNS = (*scoring.MACRO, *scoring.MICRO, "sub_acc")


def test_scores_match_hand_computation(spark):
    data = rows(40)
    got = scoring.score(spark.createDataFrame(data, SCHEMA), ABC, ["model"]).collect()
    for row in got:
        want = by_hand([(t, p) for _, m, t, p in data if m == row["model"]], range(3))
        assert [row[c] for c in COLUMNS] == pytest.approx(want, abs=1e-8)


def test_slices_equal_scoring_the_filtered_rows(spark):
    data = rows(60, seed=3)
    words = {i: [0, 512, 513, 4096, 20000, 93001][i % 6] for i in range(60)}
    tags = {i: [[0, 0, 0], [1, 0, 0], [2, 5, 0], [3, 1, 0]][i % 4] for i in range(60)}
    df = spark.createDataFrame(
        [(*r, words[r[0]], tags[r[0]]) for r in data], SCHEMA + ", n_words int, support array<int>")
    df = df.withColumn("slices", scoring.row_slices(
        F.col("model"), F.col("n_words"), F.col("support"), F.array(F.lit(0))))
    got = {(r["model"], r["slice"]): r for r in scoring.score_slices(df, ABC).collect()}
    for model in ("fine_x", "coarse_y"):
        mine = [r for r in data if r[1] == model]
        kept = {"all": mine}
        for name, (low, high) in support.LENGTH_RANGES.items():
            kept[name] = [r for r in mine if low <= words[r[0]] <= high]
        for k in support.SUPPORT_LEVELS:
            kept[f"support_{k}"] = mine if "coarse" in model else [
                r for r in mine if not any(0 < s < k for s in tags[r[0]])]
        for name, part in kept.items():
            row = got[(model, name)]
            assert row["n"] == len(part)
            if part:
                assert [row[c] for c in COLUMNS] == pytest.approx(
                    by_hand([(t, p) for _, _, t, p in part], range(3)), abs=1e-8)
            else:
                assert row["mac_f1"] is None
        if "fine" in model:
            for name, positions in (("open", [2]), ("closed", [0, 1])):
                assert [got[(model, name)][c] for c in COLUMNS] == pytest.approx(
                    by_hand([(t, p) for _, _, t, p in mine], positions), abs=1e-8)
        else:
            assert (model, "open") not in got


def test_any_predicate_may_define_a_slice(spark):
    df = spark.createDataFrame(rows(10, models=("m",)), SCHEMA)
    df = df.withColumn("slices", scoring.name_slices({"even": F.col("work_id") % 2 == 0}))
    got = {r["slice"]: r["n"] for r in scoring.score_slices(df, ABC, names=["all", "even"]).collect()}
    assert got == {"all": 10, "even": 5}


def test_empty_slice_keeps_zero_rows_and_null_scores(spark):
    df = spark.createDataFrame(rows(4, models=("fine_x",)), SCHEMA).withColumn("slices", F.lit("all,512"))
    got = {r["slice"]: r for r in scoring.score_slices(df, ABC).collect()}
    assert got["16k"]["n"] == 0 and got["16k"]["mic_f1"] is None and got["512"]["n"] == 4


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rows(50, seed=5), SCHEMA)
    one = sorted(scoring.score(df.coalesce(1), ABC, ["model"]).collect())
    many = sorted(scoring.score(df.repartition(7), ABC, ["model"]).collect())
    assert one == many


def test_auc_of_one_class_label_is_left_out(spark):
    conf = scoring.confusion(spark.createDataFrame(
        [(1, "m", [1, 0, 0], [1, 0, 0]), (2, "m", [0, 1, 0], [0, 0, 0])], SCHEMA), ABC, ["model"])
    row = scoring.roc_auc(conf, ["model"]).first()
    assert row["roc_auc"] == pytest.approx((1.0 + 0.5) / 2) and row["undefined_labels"] == 1


def test_both_layouts_unify(spark):
    df = spark.createDataFrame(
        [("1", [1.0, 0.0], [0.0, 1.0], None, None), ("2", None, None, [1.0, 0.0], [0.0, 1.0])],
        "work_id string, truth array<double>, predictions array<double>, labels array<double>, "
        "prediction array<double>")
    got = scoring.unify(df).collect()
    assert [(r["truth"], r["pred"]) for r in got] == [([1, 0], [0, 1])] * 2


def test_length_ranges(spark):
    counts = [0, 511, 512, 513, 4096, 16000, 93000, 93001, None]
    df = spark.createDataFrame([(c,) for c in counts], "n bigint")
    got = [r[0] for r in df.select(support.length_slices(F.col("n"))).collect()]
    assert got == [["512"], ["512"], ["512", "4096"], ["4096"], ["4096", "16k"], ["16k", "16k_plus"],
                   ["16k_plus"], [], []]


def test_support_filter(spark):
    df = spark.createDataFrame([([0, 0],), ([1, 0],), ([2, 0],), ([1, 5],)], "s array<int>")
    assert [r[0] for r in df.select(support.well_supported(F.col("s"), 2)).collect()] == [
        True, False, True, False]


def test_tag_support(spark):
    tag_map = small_table(spark, [("t1", "a"), ("t2", "a"), ("t2", "b"), ("t3", "None")],
                          "tag string, warning string")
    labels = LabelSet(["a", "b"], {"a": "x", "b": "x"})
    df = spark.createDataFrame(
        [("w1", ["t1", "t1", "t2", "nope"]), ("w2", ["t3"]), ("w3", []), ("w4", None)],
        "work_id string, tags array<string>")
    got = {r["work_id"]: (r["support_fine"], r["support_coarse"]) for r in support.tag_support(
        df, tag_map, labels, coarse=LabelSet(["x"])).collect()}
    assert got == {"w1": ([3, 1], [4]), "w2": ([0, 0], [0]), "w3": ([0, 0], [0]), "w4": ([0, 0], [0])}


def test_work_records(spark):
    works = spark.createDataFrame(
        [("1", ["t"], ["violence", "other-abuse"], ["aggression"], 12, 1)],
        "work_id string, freeform array<string>, warnings_fine_open array<string>, "
        "warnings_coarse_open array<string>, n_words bigint, n_chapters int")
    from labelmill.functions.labelsets import COARSE, FINE
    tag_map = small_table(spark, [("t", "violence")], "tag string, warning string")
    row = support.work_records(works, tag_map, FINE, COARSE).first()
    assert row["open"] == ["other-abuse"] and row["closed"] == ["violence"]
    assert sum(row["support_fine"]) == 1 and row["support_coarse"] == [0, 1, 0, 0, 0, 0, 0]


def test_thresholds(spark):
    df = spark.createDataFrame([([0.0, 0.2],)], "x array<double>")
    probs = F.transform("x", scalars.sigmoid)
    assert df.select(scalars.threshold(probs, 0.5, True)).first()[0] == [1, 1]
    assert df.select(scalars.threshold(probs, 0.5, False)).first()[0] == [0, 1]


def test_report_has_all_averages(spark):
    got = scoring.report(spark.createDataFrame(rows(30, models=("m",)), SCHEMA), ABC).orderBy("position")
    assert [r["row"] for r in got.collect()] == [
        "a", "b", "c", "micro avg", "macro avg", "weighted avg", "samples avg"]


def test_training_metrics_and_tables(spark):
    preds = spark.createDataFrame(rows(20), SCHEMA).withColumn("slices", F.lit("all"))
    metrics = scoring.training_metrics(preds, ABC).first()
    assert set(metrics.asDict()) == {"f1", "f1_macro", "accuracy"}
    levels = [(r["level"], r["model"]) for r in scoring.model_table(
        scoring.score(preds.withColumn("model", F.regexp_replace("model", "coarse_y", "plain")), ABC,
                      ["model"])).collect()]
    assert levels == [("coarse", "plain"), ("fine", "fine_x"), ("fine", "plain")]
    table = scoring.property_table(scoring.score_slices(preds, ABC)).collect()
    assert table[0]["model"] == "coarse_y" and table[0]["mac_open"] == "--"
    tree = scoring.score_tree(scoring.score_slices(preds, ABC), scoring.slice_confusion(preds, ABC))
    assert tree.count() == 2
