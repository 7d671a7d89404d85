"""Registered queries: one evaluation of models with label sets of different width.

The coarse stand-in model predicts one label (content: quality or toxic), the fine ones two. Some rows are damaged on
purpose: documents whose id divides by 19 have a truth that is too long, and one model has no prediction for
ids that divide by 17.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelmill.operators import evaluate, scoring
from labelmill.operators.support import tag_support
from labelmill.plans import standins as S
from labelmill.session import durable, ensure_checkpoint_dir, small_table
from labelmill.sources import readers, writers
from labelmill.streaming.evaluation import count_stream, scores

SETS = {"coarse": S.DOCS_COARSE, "fine": S.DOCS}
DIM = [("coarse", "content", "top", 1), ("fine", "toxic", "top", 1), ("fine", "quality", "mid", 2)]


def _preds(spark, sf):
    wide = S.doc_preds(spark, sf)
    coarse = F.col("model").contains("coarse")
    narrow = {c: F.when(coarse, F.array(F.array_max(c))).otherwise(F.col(c)) for c in ("truth", "pred")}
    unit = F.col("doc_id")
    return wide.select(
        F.col("doc_id").alias("work_id"), "model",
        F.when(unit % 19 == 0, F.concat(narrow["truth"], F.array(F.lit(0)))).otherwise(narrow["truth"]).alias("truth"),
        F.when((unit % 17 == 0) & (F.col("model") == "fine_words"), F.lit(None)).otherwise(narrow["pred"]).alias("pred"))


def _records(spark, sf):
    facts = S.documents(spark, sf).select(
        "doc_id", S.X.tokens(F.col("text")).alias("tags"), S.X.word_count(F.col("text")).alias("n_words"))
    return tag_support(facts, S.tag_map(spark, S.DOC_TAGS), S.DOCS, "doc_id", S.DOCS_COARSE, keep=["n_words"]
                       ).withColumnRenamed("doc_id", "work_id")


def _evaluation(spark, sf):
    dim = small_table(spark, DIM, "level string, label string, section string, freq_rank int")
    return evaluate.evaluate(_preds(spark, sf), _records(spark, sf), S.DOC_MODELS, SETS, dim)


METRICS = (*scoring.MACRO, *scoring.MICRO, "sub_acc")


def evaluate_all(spark, sf):
    """All scores of all models and slices, one row per metric."""
    scores = _evaluation(spark, sf).scores
    return scores.unpivot(["model", "slice", "n"], list(METRICS), "metric", "value")


def evaluate_tables(spark, sf):
    """Section scores and the class table with its two levels, in one long form."""
    done = _evaluation(spark, sf)
    classes = done.classes.unpivot(["level", "label"], S.DOC_MODELS, "model", "f1").filter(F.col("f1").isNotNull())
    return classes.select(F.concat_ws("/", "level", "label").alias("name"), "model", "f1").unionByName(
        done.sections.select(F.col("section").alias("name"), "model", "f1"))


def rejected_predictions(spark, sf):
    """Rows that cannot be scored, by model and flaw."""
    return scoring.rejected(_preds(spark, sf), SETS).groupBy("model", "flaw").agg(F.count("*").alias("rows"))


def evaluate_folder(spark, sf):
    """Result files of both layouts, some without labels, counted in two runs of a stream; scores written and read back.

    The second run meets the files of one more model and counts only those.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4()}"
    name = f"counts_{uuid.uuid4().hex}"
    preds, records = durable(_preds(spark, sf)), durable(_records(spark, sf))
    neural = F.col("model") == "fine_words"
    for own, scored in ((~neural, False), (neural, True)):
        part = preds.filter(own)
        writers.write_predictions(part, f"{folder}/files", scored)
        # Rows that only say what was predicted.
        writers.write_predictions(part.withColumn("truth", F.lit(None).cast("array<int>")), f"{folder}/files", scored)
        count_stream(spark, f"{folder}/files", records, SETS, f"{folder}/state", name).awaitTermination()
    writers.write_scores(scores(spark.table(name), SETS), f"{folder}/scores")
    kinds = "model string, slice string, n bigint, " + ", ".join(f"{m} double" for m in METRICS)
    return readers.read_json(spark, f"{folder}/scores", kinds).unpivot(["model", "slice", "n"], list(METRICS), "metric", "value")


def training_metrics(spark, sf):
    """Micro F1, macro F1 and exact-match share of one model, as watched during training."""
    return scoring.training_metrics(S.doc_preds(spark, sf).filter(F.col("model") == "fine_length"), S.DOCS)


QUERIES = {f.__name__: f for f in (evaluate_all, evaluate_folder, evaluate_tables, rejected_predictions, training_metrics)}

_BASE = S.DOC_CELLS.replace("\ncells AS (", "\nall_cells AS (")
_CELLS = f"""{_BASE}, cells AS (
    SELECT * FROM all_cells WHERE model <> 'coarse_lang' AND unit % 19 <> 0 AND NOT (model = 'fine_words' AND unit % 17 = 0)
    UNION ALL
    SELECT unit, n_words, model, 'content', 0, true, max(t), max(p) FROM all_cells
    WHERE model = 'coarse_lang' AND unit % 19 <> 0 GROUP BY unit, n_words, model)"""
_SLICED = (f"{_CELLS}, {S.DOC_SUPPORT}, {S.DOC_SLICES}, conf AS ({S.conf_sql('model, slice', 'sliced')}), "
           f"exact AS ({S.exact_sql('model, slice', 'sliced')}), scored AS ({S.average_sql('model, slice')}), "
           "wanted AS (SELECT model, slice FROM models CROSS JOIN slices "
           "WHERE slice NOT IN ('open', 'closed') OR contains(model, 'fine')), "
           "every AS (SELECT model, slice, coalesce(n, 0)::BIGINT AS n, mac_p, mac_r, mac_f1, mic_p, "
           "mic_r, mic_f1, sub_acc FROM wanted LEFT JOIN scored USING (model, slice))")
_DIM = f"dim(level, label, section, freq_rank) AS (VALUES {S.sql_values(DIM)})"

_ALL = f"""WITH {_SLICED} SELECT model, slice, n, metric, value
    FROM every UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(METRICS)}))"""

ORACLES = {
    "evaluate_all": _ALL,
    "evaluate_folder": _ALL,
    "training_metrics": f"""SELECT mic_f1 AS f1, mac_f1 AS f1_macro, sub_acc AS accuracy
        FROM ({S.score_sql(S.DOC_CELLS, 'model')}) WHERE model = 'fine_length'""",
    "evaluate_tables": f"""WITH {_CELLS}, conf AS ({S.conf_sql('model')}), {_DIM},
        named AS (SELECT *, CASE WHEN contains(model, 'coarse') THEN 'coarse' ELSE 'fine' END AS level FROM conf),
        summed AS (SELECT section AS name, model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
                   FROM named JOIN dim USING (level, label) GROUP BY 1, 2)
        SELECT level || '/' || label AS name, model, {S.ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1
        FROM named JOIN dim USING (level, label)
        UNION ALL SELECT name, model, {S.ratio_sql('2 * tp', '2 * tp + fp + fn')} FROM summed""",
    "rejected_predictions": f"""WITH {_BASE}, rows_ AS (SELECT DISTINCT unit, model FROM all_cells),
        flawed AS (SELECT model, CASE WHEN model = 'fine_words' AND unit % 17 = 0 THEN 'no prediction'
                   WHEN unit % 19 = 0 THEN 'wrong width' END AS flaw FROM rows_)
        SELECT model, flaw, count(*) AS rows FROM flawed WHERE flaw IS NOT NULL GROUP BY 1, 2""",
}
