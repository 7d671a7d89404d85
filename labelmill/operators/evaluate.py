"""The whole evaluation of a folder of predictions: metadata, slices, scores, tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.labelsets import LEVELS, LabelSet
from labelmill.operators import hydrate, scoring
from labelmill.operators.support import one_per_key
from labelmill.session import durable

RECORD = ("work_id", "n_words", "support_fine", "support_coarse")


def label_dim(sets: dict[str, LabelSet], spark) -> DataFrame:
    """One row per level and label: index, section and frequency rank."""
    rows = None
    for level, own in sets.items():
        part = own.dim(spark).withColumn("level", F.lit(level))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@dataclass
class Evaluation:
    """Tables of an evaluation. `rejected` rows and rows `without_metadata` took no part in the scores."""

    scores: DataFrame
    sections: DataFrame
    classes: DataFrame
    properties: DataFrame
    models: DataFrame
    tree: DataFrame
    rejected: DataFrame
    without_metadata: DataFrame


def with_metadata(preds: DataFrame, records: DataFrame, key: str = "work_id") -> DataFrame:
    """Predictions with the slices of their work. One record per work, so no prediction multiplies."""
    known = one_per_key(records.select(key, *RECORD[1:]), key)
    return preds.join(known, key).withColumn("slices", scoring.row_slices(
        F.col("model"), F.col("n_words"), F.col("support_fine"), F.col("support_coarse"))).drop(*RECORD[1:])


def evaluate(preds: DataFrame, records: DataFrame, models: list[str], sets: dict[str, LabelSet] | None = None,
             dim: DataFrame | None = None, key: str = "work_id") -> Evaluation:
    """Scores unified predictions (work, model, truth, pred) against work records.

    Each model is read by the label set of its level. One pass counts all slices of all models; every
    table is computed from these counts, whose number does not depend on the data.
    """
    sets = LEVELS if sets is None else sets
    dim = label_dim(sets, preds.sparkSession) if dim is None else dim
    sliced = with_metadata(scoring.accepted(preds, sets), records, key)
    conf = durable(scoring.slice_confusion(sliced, sets))
    scores = scoring.average(conf, ["model", "slice"])
    whole = conf.filter(F.col("slice") == scoring.ALL)
    sections = scoring.sections(whole, dim, ["model"])
    return Evaluation(
        scores=scores, sections=sections, classes=scoring.class_table(whole, dim, models),
        properties=scoring.property_table(scores, sections),
        models=scoring.model_table(scores.filter(F.col("slice") == scoring.ALL)),
        tree=scoring.score_tree(scores, conf), rejected=scoring.rejected(preds, sets),
        without_metadata=hydrate.without_metadata(preds, records, key))
