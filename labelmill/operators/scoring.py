"""Scores of 0/1 predictions: overall, per label, per slice and per frequency section.

One idea carries the module. Predictions are folded once to `confusion` rows, one per model,
combination of slices and label, by an aggregation that each task does before the shuffle. The number
of these rows depends on models, slices and labels and never on the data. Everything else - slices,
averages, reports - is computed from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.labelsets import LabelSet, level_of
from labelmill.functions.scalars import f1, precision, recall, safe_div, show_score
from labelmill.operators.support import LENGTH_RANGES, SUPPORT_LEVELS, well_supported

COUNTS = ("tp", "fp", "fn", "tn")
MACRO = ("mac_p", "mac_r", "mac_f1")
MICRO = ("mic_p", "mic_r", "mic_f1")
ALL, OPEN, CLOSED = "all", "open", "closed"
# Averages of doubles depend on the order of their sum; this many decimals do not.
DECIMALS = 9


def unify(predictions: DataFrame) -> DataFrame:
    """Both prediction layouts as `truth` and `pred` integer vectors.

    A row with `prediction` carries its truth in `labels`, any other row in `truth`.
    """
    second = F.col("prediction").isNotNull()
    others = [c for c in predictions.columns
              if c not in ("truth", "predictions", "labels", "prediction")]
    return predictions.select(
        *others,
        F.when(second, F.col("labels")).otherwise(F.col("truth")).cast("array<int>").alias("truth"),
        F.when(second, F.col("prediction")).otherwise(F.col("predictions"))
        .cast("array<int>").alias("pred"))


#: One label set for all models, or one for each level that a model's name states.
Labels = LabelSet | dict[str, LabelSet]


def _by_level(labels: Labels, of: Callable[[LabelSet], Column]) -> Column:
    """A column worked out from the label set of the row's model."""
    if isinstance(labels, LabelSet):
        return of(labels)
    chosen = F.lit(None)
    for level, own in labels.items():
        chosen = F.when(level_of(F.col("model")) == level, of(own)).otherwise(chosen)
    return chosen


def flaw(labels: Labels) -> Column:
    """What keeps a row from being scored; null for a good row.

    Vectors must be there and have one value for each label of the model's set.
    """
    width = _by_level(labels, lambda own: F.lit(len(own.labels)))
    return (F.when(F.col("truth").isNull(), "no truth").when(F.col("pred").isNull(), "no prediction")
            .when(width.isNull(), "no label set")
            .when((F.size("truth") != width) | (F.size("pred") != width), "wrong width"))


def accepted(preds: DataFrame, labels: Labels) -> DataFrame:
    """Rows that can be scored."""
    return preds.filter(flaw(labels).isNull())


def rejected(preds: DataFrame, labels: Labels) -> DataFrame:
    """The other rows, each with its `flaw`."""
    return preds.withColumn("flaw", flaw(labels)).filter(F.col("flaw").isNotNull())


def _cells(labels: Labels) -> Column:
    """(t, p) of each label; a row with a flaw fails the job instead of being counted in part."""
    pairs = F.arrays_zip(F.col("truth").alias("t"), F.col("pred").alias("p"))
    return F.when(flaw(labels).isNull(), pairs).otherwise(F.raise_error(F.concat(
        F.lit("a prediction has "), flaw(labels), F.lit("; list such rows with scoring.rejected"))))


def _same_at(positions: list[int]) -> Column:
    same = F.lit(True)
    for i in positions:
        same = same & (F.get("truth", F.lit(i)) == F.get("pred", F.lit(i)))
    return same


def confusion(preds: DataFrame, labels: Labels, by: list[str]) -> DataFrame:
    """Counts per `by` and label: tp, fp, fn, tn, rows `n`, and rows that match exactly.

    `exact`, `exact_open` and `exact_closed` count rows and repeat on each label of a group. With a label
    set per level, `by` must hold `model`, and each model's vectors are named by the set of its level.
    """
    cells = (
        preds.withColumns({
            "_exact": F.col("truth") == F.col("pred"),
            "_exact_open": _by_level(labels, lambda own: _same_at(own.positions(own.open_labels))),
            "_exact_closed": _by_level(labels, lambda own: _same_at(own.positions(own.closed_labels))),
        })
        .select(*by, "_exact", "_exact_open", "_exact_closed", F.posexplode(_cells(labels)))
    )
    truth, pred = F.col("col.t") == 1, F.col("col.p") == 1
    return (
        cells.groupBy(*by, F.col("pos").alias("idx")).agg(
            F.count_if(truth & pred).alias("tp"),
            F.count_if(~truth & pred).alias("fp"),
            F.count_if(truth & ~pred).alias("fn"),
            F.count_if(~truth & ~pred).alias("tn"),
            F.count("*").alias("n"),
            F.count_if("_exact").alias("exact"),
            F.count_if("_exact_open").alias("exact_open"),
            F.count_if("_exact_closed").alias("exact_closed"))
        .withColumn("label", F.get(_by_level(labels, LabelSet.literal), F.col("idx")))
    )


def per_label(conf: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 of the positive class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumns({"p": precision(tp, fp), "r": recall(tp, fn), "f1": f1(tp, fp, fn)})


def average(conf: DataFrame, by: list[str]) -> DataFrame:
    """Macro and micro scores and exact-match share per `by`, from one row per group and label.

    Macro values are unweighted means over all labels of the vocabulary, so a label that never
    occurs counts as 0. Groups without rows keep n = 0 and null scores.
    """
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    summed = per_label(conf).groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.round(F.avg(c), DECIMALS).alias(f"mac_{c}") for c in ("p", "r", "f1")],
        *[F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "fn")],
        F.max("exact").alias("_exact"))
    scored = summed.select(
        *by, "n", "mac_p", "mac_r", "mac_f1",
        precision(tp, fp).alias("mic_p"), recall(tp, fn).alias("mic_r"),
        f1(tp, fp, fn).alias("mic_f1"),
        safe_div(F.col("_exact"), F.col("n")).alias("sub_acc"))
    return scored.select(*by, "n", *[
        F.when(F.col("n") > 0, F.col(c)).alias(c) for c in (*MACRO, *MICRO, "sub_acc")])


def score(preds: DataFrame, labels: Labels, by: list[str]) -> DataFrame:
    """Macro and micro scores per `by`."""
    return average(confusion(preds, labels, by), by)


def name_slices(predicates: dict[str, Column]) -> Column:
    """Names of the slices whose predicate holds for a row, as one comma-joined string.

    Any boolean column may define a slice; every row is in the slice `all`.
    """
    return F.array_join(F.array_compact(F.array(F.lit(ALL), *[
        F.when(holds, name) for name, holds in predicates.items()])), ",")


def row_slices(model: Column, n_words: Column, support_fine: Column, support_coarse: Column) -> Column:
    """Slices of a prediction row by word count and tag support.

    The support vector follows the model's name; a name with neither `coarse` nor `fine` in it is
    not filtered by support.
    """
    coarse, fine = model.contains("coarse"), model.contains("fine")
    lengths = {name: n_words.between(low, high) for name, (low, high) in LENGTH_RANGES.items()}
    supports = {
        f"support_{k}": (~coarse | well_supported(support_coarse, k)) & (~fine | well_supported(support_fine, k))
        for k in SUPPORT_LEVELS}
    return name_slices({**lengths, **supports})


def slice_confusion(preds: DataFrame, labels: Labels, model: str = "model",
                    slices: str = "slices", names: list[str] | None = None) -> DataFrame:
    """Confusion counts per model, slice and label in one pass over the predictions.

    Slices overlap. Rows are counted per combination of slices first; the few counted rows, not the
    predictions, are then copied to each slice. A slice without rows keeps zero counts. Models with
    `fine` in their name also get the slices `open` and `closed`, which keep all rows and only some
    labels.
    """
    return unfold_slices(confusion(preds, labels, [model, slices]), labels, model, slices, names)


def unfold_slices(combined: DataFrame, labels: Labels, model: str = "model", slices: str = "slices",
                  names: list[str] | None = None) -> DataFrame:
    """Counts per model, slice and label from counts per model, combination of slices and label."""
    every = F.array(*[F.lit(s) for s in (slice_names() if names is None else names)])
    member = F.when(F.col("slice").isin(OPEN, CLOSED), ALL).otherwise(F.col("slice"))
    opened = _by_level(labels, lambda own: F.array_contains(
        F.array(*[F.lit(n) for n in sorted(own.open_labels)]).cast("array<string>"), F.col("label")))
    exact = (F.when(F.col("slice") == OPEN, F.col("exact_open"))
             .when(F.col("slice") == CLOSED, F.col("exact_closed")).otherwise(F.col("exact")))
    wanted = (F.when(F.col("slice") == OPEN, F.col(model).contains("fine") & opened)
              .when(F.col("slice") == CLOSED, F.col(model).contains("fine") & ~opened)
              .otherwise(F.lit(True)))

    def inside(count: Column) -> Column:
        return F.sum(F.when(F.array_contains(F.split(slices, ","), member), count).otherwise(0))

    return (
        combined.withColumn("slice", F.explode(every)).filter(wanted)
        .groupBy(model, "slice", "idx", "label")
        .agg(*[inside(F.col(c)).alias(c) for c in (*COUNTS, "n")], inside(exact).alias("exact"))
    )


def slice_names() -> list[str]:
    return [ALL, *LENGTH_RANGES, *[f"support_{k}" for k in SUPPORT_LEVELS], OPEN, CLOSED]


def score_slices(preds: DataFrame, labels: Labels, model: str = "model",
                 slices: str = "slices", names: list[str] | None = None) -> DataFrame:
    """Macro, micro and exact-match scores per model and slice in one pass."""
    return average(slice_confusion(preds, labels, model, slices, names), [model, "slice"])


def sections(conf: DataFrame, dim: DataFrame, by: list[str]) -> DataFrame:
    """Micro scores per frequency section. `dim` has one row per label, or level and label, with its section."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    keys = ["level", "label"] if "level" in dim.columns else ["label"]
    leveled = conf.withColumn("level", level_of(F.col("model"))) if "level" in keys else conf
    return (
        leveled.join(F.broadcast(dim.select(*keys, "section")), keys)
        .groupBy(*by, "section")
        .agg(precision(tp, fp).alias("p"), recall(tp, fn).alias("r"), f1(tp, fp, fn).alias("f1"))
    )


def roc_auc(conf: DataFrame, by: list[str]) -> DataFrame:
    """Macro ROC-AUC of hard predictions: mean of (TPR + TNR) / 2 over labels.

    A label with one class only has no AUC; it is left out of the mean and counted.
    """
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    auc = F.try_divide(tp, tp + fn) / 2 + F.try_divide(tn, tn + fp) / 2
    return conf.groupBy(*by).agg(
        F.round(F.avg(auc), DECIMALS).alias("roc_auc"),
        F.count_if(auc.isNull()).alias("undefined_labels"))


def report(preds: DataFrame, labels: LabelSet) -> DataFrame:
    """Per-label precision, recall, F1 and support, then micro, macro, weighted and sample averages."""
    width = len(labels.labels)
    at = [(F.get("truth", F.lit(i)) == 1, F.get("pred", F.lit(i)) == 1) for i in range(width)]
    hits = sum((F.when(t & p, 1).otherwise(0) for t, p in at), F.lit(0))
    said = sum((F.when(p, 1).otherwise(0) for _, p in at), F.lit(0))
    real = sum((F.when(t, 1).otherwise(0) for t, _ in at), F.lit(0))
    sampled = preds.select(
        "truth", "pred", safe_div(hits, said).alias("sp"), safe_div(hits, real).alias("sr"),
        safe_div(2 * hits, said + real).alias("sf"))
    cells = sampled.select("sp", "sr", "sf", F.posexplode(_cells(labels)))
    truth, pred = F.col("col.t") == 1, F.col("col.p") == 1
    conf = cells.groupBy(F.col("pos").alias("idx")).agg(
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"),
        F.avg("sp").alias("sp"), F.avg("sr").alias("sr"), F.avg("sf").alias("sf"),
    ).withColumn("label", labels.literal()[F.col("idx")])
    scored = per_label(conf).withColumn("support", F.col("tp") + F.col("fn"))
    by_label = scored.select(
        F.col("label").alias("row"), "p", "r", "f1", "support", F.col("idx").alias("position"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return safe_div(F.sum(F.col(c) * F.col("support")), total)

    rows = {
        "micro avg": (precision(tp, fp), recall(tp, fn), f1(tp, fp, fn)),
        "macro avg": (F.avg("p"), F.avg("r"), F.avg("f1")),
        "weighted avg": (weighted("p"), weighted("r"), weighted("f1")),
        "samples avg": (F.max("sp"), F.max("sr"), F.max("sf")),
    }
    averages = scored.agg(
        F.array(*[F.struct(F.lit(name).alias("row"), p.alias("p"), r.alias("r"), f.alias("f1"))
                  for name, (p, r, f) in rows.items()]).alias("rows"),
        total.alias("support"),
    ).select(F.posexplode("rows"), "support").select(
        "col.row", "col.p", "col.r", "col.f1", "support",
        (F.col("pos") + width).alias("position"))
    return by_label.unionByName(averages)


def model_table(scores: DataFrame) -> DataFrame:
    """Scores of the whole data per model: coarse models first, then fine ones.

    A model whose name says neither appears at both levels.
    """
    model = F.col("model")
    levels = F.array_compact(F.array(
        F.when(~model.contains("fine"), "coarse"), F.when(~model.contains("coarse"), "fine")))
    return (
        scores.withColumn("level", F.explode(levels))
        .select("level", "model", *MACRO, *MICRO).orderBy("level", "model")
    )


def property_table(slice_scores: DataFrame, section_scores: DataFrame | None = None) -> DataFrame:
    """One row per model: macro and micro F1 of each slice as text, `--` where there is none."""
    wanted = [s for s in slice_names() if s not in ("support_3", "support_5")]
    wide = slice_scores.groupBy("model").pivot("slice", wanted).agg(
        F.first("mac_f1").alias("mac"), F.first("mic_f1").alias("mic"))
    columns = [show_score(F.col(f"{s}_{kind}")).alias(f"{kind}_{s}")
               for kind in ("mac", "mic") for s in wanted]
    if section_scores is not None:
        parts = section_scores.groupBy("model").pivot("section", ["top", "mid", "bot"]).agg(F.first("f1"))
        wide = wide.join(parts, "model", "left")
        columns += [show_score(F.col(s)).alias(f"{s}_f1") for s in ("top", "mid", "bot")]
    return wide.select("model", *columns).orderBy("model")


def class_table(conf: DataFrame, dim: DataFrame, models: list[str]) -> DataFrame:
    """Labels in frequency order with one F1 column per model.

    With a `level` in `dim` there is a block of labels for each level, filled by the models of that level: a
    name may be a label of both.
    """
    keys = ["level", "label"] if "level" in dim.columns else ["label"]
    leveled = conf.withColumn("level", level_of(F.col("model"))) if "level" in keys else conf
    wide = per_label(leveled).groupBy(*keys).pivot("model", models).agg(F.first("f1"))
    return (wide.join(F.broadcast(dim.select(*keys, "freq_rank")), keys)
            .select(*keys[:-1], "freq_rank", "label", *models).orderBy(*keys[:-1], "freq_rank"))


def training_metrics(preds: DataFrame, labels: LabelSet) -> DataFrame:
    """Micro F1, macro F1 and exact-match share, as watched during training."""
    return score(preds.withColumn("_all", F.lit(ALL)), labels, ["_all"]).select(
        F.col("mic_f1").alias("f1"), F.col("mac_f1").alias("f1_macro"),
        F.col("sub_acc").alias("accuracy"))


def best(scores: DataFrame, metric: str = "mac_f1", name: str = "model") -> DataFrame:
    """Row with the highest metric, ties by name."""
    return scores.orderBy(F.col(metric).desc(), F.col(name)).limit(1)


def score_tree(slice_scores: DataFrame, conf: DataFrame) -> DataFrame:
    """Scores of a model as one nested JSON document: slices, and classes under `all`."""
    classes = per_label(conf.filter(F.col("slice") == ALL)).groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "label", F.struct(*[F.round(c, 2).alias(c) for c in ("p", "r", "f1")])))).alias("classes"))
    slices = slice_scores.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "slice", F.struct(*[F.round(c, 2).alias(c) for c in (*MACRO, *MICRO, "sub_acc")])))
        ).alias("slices"))
    return slices.join(classes, "model").select(
        "model", F.to_json(F.struct("slices", "classes")).alias("scores"))
