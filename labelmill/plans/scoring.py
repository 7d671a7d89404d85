"""Registered queries: scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.operators import labeling, scoring
from labelmill.operators.support import LENGTH_RANGES, SUPPORT_LEVELS
from labelmill.plans import standins as S


def _event_dim(spark, sf):
    counted = labeling.frequency(S.event_label_rows(spark, sf), S.EVENTS)
    return counted.select("label", "section", "freq_rank")


def confusion_by_label(spark, sf):
    return scoring.confusion(S.doc_preds(spark, sf), S.DOCS, ["model"]).select(
        "model", "label", *scoring.COUNTS)


def score_models(spark, sf):
    return scoring.score(S.doc_preds(spark, sf), S.DOCS, ["model"])


def score_all_slices(spark, sf):
    return scoring.score_slices(S.doc_sliced(spark, sf), S.DOCS)


def unify_predictions(spark, sf):
    """The rule predictions in both layouts: documents of even id in the first, odd id in the second."""
    preds = S.doc_preds(spark, sf)
    first = F.col("doc_id") % 2 == 0
    layouts = preds.select(
        "doc_id", "model",
        F.when(first, F.col("truth").cast("array<double>")).alias("truth"),
        F.when(first, F.col("pred").cast("array<double>")).alias("predictions"),
        F.when(~first, F.col("truth").cast("array<double>")).alias("labels"),
        F.when(~first, F.col("pred").cast("array<double>")).alias("prediction"))
    return scoring.unify(layouts).select(
        "doc_id", "model", F.array_join("truth", "").alias("truth"), F.array_join("pred", "").alias("prediction"))


def subset_accuracy(spark, sf):
    return scoring.score(S.event_preds(spark, sf), S.EVENTS, ["model"]).select("model", "n", "sub_acc")


def roc_auc_macro(spark, sf):
    return scoring.roc_auc(scoring.confusion(S.doc_preds(spark, sf), S.DOCS, ["model"]), ["model"])


def class_scores(spark, sf):
    conf = scoring.confusion(S.event_preds(spark, sf), S.EVENTS, ["model"])
    return scoring.per_label(conf).select("model", "label", "p", "r", "f1")


def section_scores(spark, sf):
    conf = scoring.confusion(S.event_preds(spark, sf), S.EVENTS, ["model"])
    return scoring.sections(conf, _event_dim(spark, sf), ["model"])


def classification_report(spark, sf):
    preds = S.event_preds(spark, sf).filter(F.col("model") == "coarse_forenoon")
    return scoring.report(preds, S.EVENTS).select(
        "row", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")], "support")


def _slice_part(spark, sf, wanted):
    return score_all_slices(spark, sf).filter(F.col("slice").isin(wanted))


def score_by_length(spark, sf):
    return _slice_part(spark, sf, list(LENGTH_RANGES))


def score_by_support(spark, sf):
    return _slice_part(spark, sf, [f"support_{k}" for k in SUPPORT_LEVELS]).withColumn(
        "k", F.substring("slice", 9, 2).cast("int")).drop("slice")


def score_open_closed(spark, sf):
    preds = S.event_preds(spark, sf).withColumn("slices", F.lit(scoring.ALL))
    return scoring.average(
        scoring.slice_confusion(preds, S.EVENTS).filter(
            F.col("slice").isin(scoring.OPEN, scoring.CLOSED)), ["model", "slice"])


def model_table(spark, sf):
    return scoring.model_table(scoring.score(S.event_preds(spark, sf), S.EVENTS, ["model"]))


def property_table(spark, sf):
    return scoring.property_table(score_all_slices(spark, sf))


def class_score_table(spark, sf):
    conf = scoring.confusion(S.event_preds(spark, sf), S.EVENTS, ["model"])
    return scoring.class_table(conf, _event_dim(spark, sf), S.EVENT_MODELS)


def best_model(spark, sf):
    return scoring.best(score_models(spark, sf)).select("model", "mac_f1", "mic_f1")


QUERIES = {f.__name__: f for f in (
    confusion_by_label, score_models, score_all_slices, unify_predictions, subset_accuracy,
    roc_auc_macro, class_scores, section_scores, classification_report, score_by_length,
    score_by_support, score_open_closed, model_table, property_table, class_score_table, best_model)}

_SLICED = (f"{S.DOC_CELLS}, {S.DOC_SUPPORT}, {S.DOC_SLICES}, "
           f"conf AS ({S.conf_sql('model, slice', 'sliced')}), "
           f"exact AS ({S.exact_sql('model, slice', 'sliced')}), "
           f"scored AS ({S.average_sql('model, slice')}), "
           "wanted AS (SELECT model, slice FROM models CROSS JOIN slices "
           "WHERE slice NOT IN ('open', 'closed') OR contains(model, 'fine')), "
           "every AS (SELECT model, slice, coalesce(n, 0)::BIGINT AS n, mac_p, mac_r, mac_f1, mic_p, "
           "mic_r, mic_f1, sub_acc FROM wanted LEFT JOIN scored USING (model, slice))")
_EVENT_FREQUENCY = """freq AS (SELECT event_type AS label, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, event_type) AS freq_rank,
    ntile(3) OVER (ORDER BY count(*) DESC, event_type) AS third FROM events GROUP BY 1)"""


def _show(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '--' ELSE printf('%.2f', {column}) END"


_PROPERTY = ", ".join(
    f"{_show(f'''max({kind}_f1) FILTER (slice = '{s}')''')} AS {kind}_{s}"
    for kind in ("mac", "mic")
    for s in ("all", "512", "4096", "16k", "16k_plus", "support_2", "open", "closed"))

ORACLES = {
    "confusion_by_label": f"WITH {S.DOC_CELLS}, conf AS ({S.conf_sql('model')}) "
                          "SELECT model, label, tp, fp, fn, tn FROM conf",
    "score_models": S.score_sql(S.DOC_CELLS, "model"),
    "score_all_slices": f"WITH {_SLICED} SELECT * FROM every",
    "unify_predictions": f"""WITH {S.DOC_CELLS}
        SELECT unit AS doc_id, model, string_agg(t::VARCHAR, '' ORDER BY idx) AS truth,
               string_agg(p::VARCHAR, '' ORDER BY idx) AS prediction
        FROM cells GROUP BY 1, 2""",
    "subset_accuracy": f"SELECT model, n, sub_acc FROM ({S.score_sql(S.EVENT_CELLS, 'model')})",
    "roc_auc_macro": f"""WITH {S.DOC_CELLS}, conf AS ({S.conf_sql('model')})
        SELECT model, round(avg(tp::DOUBLE / nullif(tp + fn, 0) / 2 + tn::DOUBLE / nullif(tn + fp, 0) / 2), 9)
               AS roc_auc,
               count(*) FILTER (tp + fn = 0 OR tn + fp = 0) AS undefined_labels
        FROM conf GROUP BY 1""",
    "class_scores": f"WITH {S.EVENT_CELLS}, conf AS ({S.conf_sql('model')}) "
                    f"SELECT model, label, {S.PRF_SQL} FROM conf",
    "section_scores": f"""WITH {S.EVENT_CELLS}, conf AS ({S.conf_sql('model')}), {_EVENT_FREQUENCY},
        summed AS (SELECT model, third, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
                   FROM conf JOIN freq USING (label) GROUP BY ALL)
        SELECT model, CASE third WHEN 1 THEN 'top' WHEN 2 THEN 'mid' ELSE 'bot' END AS section, {S.PRF_SQL}
        FROM summed""",
    "classification_report": f"""WITH {S.EVENT_CELLS}, mine AS (SELECT * FROM cells WHERE model = 'coarse_forenoon'),
        conf AS ({S.conf_sql('model', 'mine')}),
        scored AS (SELECT *, {S.PRF_SQL}, tp + fn AS support FROM conf),
        rows_ AS (SELECT unit, sum(t * p) AS hit, sum(p) AS said, sum(t) AS real FROM mine GROUP BY 1),
        samples AS (SELECT avg({S.ratio_sql('hit', 'said')}) AS p, avg({S.ratio_sql('hit', 'real')}) AS r,
                           avg({S.ratio_sql('2 * hit', 'said + real')}) AS f1 FROM rows_),
        total AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support)::BIGINT AS support FROM scored),
        every AS (
            SELECT label AS row, p, r, f1, support FROM scored
            UNION ALL SELECT 'micro avg', {S.PRF_SQL}, support FROM total
            UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM scored
            UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                             sum(f1 * support) / sum(support), sum(support) FROM scored
            UNION ALL SELECT 'samples avg', p, r, f1, (SELECT support FROM total) FROM samples)
        SELECT row, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, support::BIGINT AS support FROM every""",
    "score_by_length": f"WITH {_SLICED} SELECT * FROM every WHERE slice IN ('512', '4096', '16k', '16k_plus')",
    "score_by_support": f"""WITH {_SLICED} SELECT * EXCLUDE (slice), CAST(slice[9:] AS INT) AS k
        FROM every WHERE slice LIKE 'support%'""",
    "score_open_closed": f"""WITH {S.EVENT_CELLS}, sliced AS (
            SELECT *, CASE WHEN closed THEN 'closed' ELSE 'open' END AS slice FROM cells
            WHERE contains(model, 'fine')),
        conf AS ({S.conf_sql('model, slice', 'sliced')}), exact AS ({S.exact_sql('model, slice', 'sliced')})
        {S.average_sql('model, slice')}""",
    "model_table": f"""SELECT CASE WHEN contains(model, 'coarse') THEN 'coarse' ELSE 'fine' END AS level, model,
        mac_p, mac_r, mac_f1, mic_p, mic_r, mic_f1 FROM ({S.score_sql(S.EVENT_CELLS, 'model')})""",
    "property_table": f"WITH {_SLICED} SELECT model, {_PROPERTY} FROM every GROUP BY model",
    "class_score_table": f"""WITH {S.EVENT_CELLS}, conf AS ({S.conf_sql('model')}), {_EVENT_FREQUENCY},
        scored AS (SELECT model, label, {S.PRF_SQL} FROM conf)
        SELECT CAST(freq_rank AS INT) AS freq_rank, label,
               {", ".join(f"max(f1) FILTER (model = '{m}') AS {m}" for m in S.EVENT_MODELS)}
        FROM scored JOIN freq USING (label) GROUP BY freq_rank, label""",
    "best_model": f"SELECT model, mac_f1, mic_f1 FROM ({S.score_sql(S.DOC_CELLS, 'model')}) "
                  "ORDER BY mac_f1 DESC, model LIMIT 1",
}
