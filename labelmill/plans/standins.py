"""Multi-label data derived from the given tables, and the same derivations as SQL.

Documents: truth is the (quality, toxic) pair of `labels`; predictions are fixed rules; tags are the
document's tokens. Events: a unit is a user's day; truth is the set of event types from noon on,
predictions are sets of event types before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.functions.labelsets import LabelSet
from labelmill.operators.labeling import mask_of, unmask
from labelmill.operators.scoring import row_slices
from labelmill.operators.support import tag_support
from labelmill.session import small_table, spread
from labelmill.sources.readers import read_table

EVENTS = LabelSet(
    ["view", "click", "signup", "purchase", "error"],
    {"view": "engagement", "click": "engagement", "signup": "conversion", "purchase": "conversion",
     "error": "fault"},
    frozenset(["signup", "error"]),
)
EVENT_MODELS = ["coarse_forenoon", "fine_early", "fine_valued"]

DOCS = LabelSet(["quality", "toxic"], {"quality": "content", "toxic": "content"}, frozenset(["quality"]))
DOCS_COARSE = LabelSet(["content"])
DOC_MODELS = ["coarse_lang", "fine_length", "fine_words"]
DOC_TAGS = [
    ("worthless", "toxic"), ("pathetic", "toxic"), ("stupid", "toxic"), ("idiot", "toxic"),
    ("idiot", "quality"), ("attion", "quality"), ("nicht", "quality"), ("les", "quality"),
    ("the", "None"),
]
# Tags over the full label sets: one tag with two warnings, one that supports nothing, one whose
# warning is not a label.
FULL_TAGS = [
    ("pathetic", "abusive-language"), ("worthless", "abusive-language"), ("worthless", "abuse"),
    ("idiot", "abusive-language"), ("stupid", "ableism"), ("nicht", "violence"), ("les", "death"),
    ("und", "other-medical"), ("que", "incest"), ("license", "procedures"), ("attion", "suicide"),
    ("the", "None"), ("of", "unheard-of"),
]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "pages"))


def event_units(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day with bit masks of event types. The masks fold before the shuffle."""
    bit = mask_of(F.col("event_type"), EVENTS)
    hour = F.hour("ts")
    before = hour < 12

    def types_where(condition: Column) -> Column:
        return F.bit_or(F.when(condition, bit))

    return (
        read_table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.bit_or(bit).alias("any"), types_where(~before).alias("truth"),
             types_where(before).alias("coarse_forenoon"), types_where(hour < 6).alias("fine_early"),
             types_where(before & (F.col("value") > 20)).alias("fine_valued"))
    )


def event_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (user_id, day, model, truth, pred)."""
    stacked = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("mask")) for m in EVENT_MODELS])
    return (
        event_units(spark, sf).select("user_id", "day", "truth", F.inline(stacked))
        .select("user_id", "day", "model", unmask(F.col("truth"), EVENTS).alias("truth"),
                unmask(F.col("mask"), EVENTS).alias("pred"))
    )


def event_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("label"))


def _facts() -> dict[str, Column]:
    lower = F.lower("text")
    return {
        "is_english": F.col("lang") == "en", "n_chars": F.col("n_chars"),
        "n_words": X.word_count(F.col("text")),
        "says_worthless": F.contains(lower, F.lit("worthless")),
        "says_pathetic": F.contains(lower, F.lit("pathetic")),
    }


def doc_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Small facts per document, worked out before any join so that no text is shuffled for them."""
    return documents(spark, sf).select("doc_id", *[fact.alias(name) for name, fact in _facts().items()])


def _predict(facts: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Rows (doc_id, model, truth, pred) of labelled documents by fixed rules over their facts."""
    n_words = F.col("n_words")
    rules = {
        "coarse_lang": (F.col("is_english"), F.col("n_chars") < 500),
        "fine_length": (n_words.between(100, 2000), n_words > 1000),
        "fine_words": (~F.col("says_worthless"), F.col("says_pathetic")),
    }
    stacked = F.array(*[
        F.struct(F.lit(model).alias("model"),
                 F.array(quality.cast("int"), toxic.cast("int")).alias("pred"))
        for model, (quality, toxic) in rules.items()])
    return facts.join(labels, "doc_id").select(
        "doc_id", *keep, F.array("quality", "toxic").alias("truth"), F.inline(stacked))


def doc_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (doc_id, model, truth, pred) for labelled documents."""
    return _predict(doc_facts(spark, sf), read_table(spark, sf, "labels"))


def tag_map(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return small_table(spark, rows, "tag string, warning string")


def doc_tags(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("tags"))


def doc_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with the slices each row belongs to. Texts of labelled documents are read once, for facts
    and tags; others are dropped by id before any work is done on them."""
    facts = _facts()
    wanted = documents(spark, sf).join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    read_once = wanted.select(
        "doc_id", X.tokens(F.col("text")).alias("tags"), *[fact.alias(name) for name, fact in facts.items()])
    supported = tag_support(
        read_once, tag_map(spark, DOC_TAGS), DOCS, "doc_id", DOCS_COARSE, keep=list(facts))
    return (
        _predict(supported, read_table(spark, sf, "labels"), "n_words", "support_fine", "support_coarse")
        .withColumn("slices", row_slices(
            F.col("model"), F.col("n_words"), F.col("support_fine"), F.col("support_coarse")))
        .select("doc_id", "model", "slices", "truth", "pred")
    )


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Split lists: one row per document and split that names it."""
    digit = F.col("doc_id") % 10
    names = F.array_compact(F.array(
        F.when(digit <= 7, "train"), F.when(digit == 8, "validation"), F.when(digit == 9, "test"),
        F.when(digit < 2, "train_small")))
    return (
        read_table(spark, sf, "documents").filter(F.col("doc_id") % 97 != 0)
        .select("doc_id", F.explode_outer(names).alias("split")).filter(F.col("split").isNotNull())
    )


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with text, label vector and the split of the model experiments."""
    digit = F.col("doc_id") % 10
    labels = read_table(spark, sf, "labels").select("doc_id", F.array("quality", "toxic").alias("labels"))
    return (
        documents(spark, sf).select("doc_id", "text").join(labels, "doc_id")
        .withColumn("split", F.when(digit <= 7, "train").when(digit == 8, "validation").otherwise("test"))
    )


# ---- The same derivations as SQL ------------------------------------------------------------------

def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")"
                     for row in rows)


TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\p{Z}]"

EVENT_CELLS = f"""
lab(label, idx, coarse, closed) AS (VALUES ('view', 0, 'engagement', true), ('click', 1, 'engagement', true),
    ('signup', 2, 'conversion', false), ('purchase', 3, 'conversion', true), ('error', 4, 'fault', false)),
models(model) AS (VALUES {sql_values([(m,) for m in EVENT_MODELS])}),
units AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
flags AS (
    SELECT user_id, CAST(ts AS DATE) AS day, event_type AS label,
           max(CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END) AS t,
           max(CASE WHEN hour(ts) < 12 THEN 1 ELSE 0 END) AS forenoon,
           max(CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END) AS early,
           max(CASE WHEN hour(ts) < 12 AND value > 20 THEN 1 ELSE 0 END) AS valued
    FROM events GROUP BY ALL),
cells AS (
    SELECT u.user_id || '/' || u.day AS unit, m.model, l.label, l.idx, l.closed, coalesce(f.t, 0) AS t,
           coalesce(CASE m.model WHEN 'coarse_forenoon' THEN f.forenoon WHEN 'fine_early' THEN f.early
                    ELSE f.valued END, 0) AS p
    FROM units u CROSS JOIN lab l CROSS JOIN models m
    LEFT JOIN flags f ON f.user_id = u.user_id AND f.day = u.day AND f.label = l.label)
"""

DOC_CELLS = rf"""
lab(label, idx, closed) AS (VALUES ('quality', 0, false), ('toxic', 1, true)),
models(model) AS (VALUES {sql_values([(m,) for m in DOC_MODELS])}),
facts AS (
    SELECT d.doc_id, lang, n_chars, len(regexp_extract_all(text, '\S+')) AS n_words,
           contains(lower(text), 'worthless') AS wl, contains(lower(text), 'pathetic') AS pa, quality, toxic
    FROM documents d JOIN labels USING (doc_id)),
cells AS (
    SELECT doc_id AS unit, n_words, model, label, idx, closed,
           CASE label WHEN 'quality' THEN quality ELSE toxic END AS t,
           CAST(CASE model || '/' || label
                WHEN 'coarse_lang/quality' THEN lang = 'en' WHEN 'coarse_lang/toxic' THEN n_chars < 500
                WHEN 'fine_length/quality' THEN n_words BETWEEN 100 AND 2000
                WHEN 'fine_length/toxic' THEN n_words > 1000
                WHEN 'fine_words/quality' THEN NOT wl ELSE pa END AS INT) AS p
    FROM facts CROSS JOIN models CROSS JOIN lab)
"""

DOC_SUPPORT = rf"""
tag_map(tag, warning) AS (VALUES {sql_values(DOC_TAGS)}),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS tag FROM documents),
hits AS (SELECT doc_id, warning, count(*) AS n FROM words JOIN tag_map USING (tag) GROUP BY ALL),
support AS (
    SELECT d.doc_id AS unit, coalesce(max(CASE WHEN warning = 'quality' THEN n END), 0) AS s_quality,
           coalesce(max(CASE WHEN warning = 'toxic' THEN n END), 0) AS s_toxic
    FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1)
"""

DOC_SLICES = """
slices(slice) AS (VALUES ('all'), ('512'), ('4096'), ('16k'), ('16k_plus'), ('support_2'), ('support_3'),
    ('support_5'), ('open'), ('closed')),
sliced AS (
    SELECT c.*, s.slice FROM cells c JOIN support USING (unit) CROSS JOIN slices s
    WHERE CASE s.slice
        WHEN 'all' THEN true
        WHEN '512' THEN n_words BETWEEN 0 AND 512
        WHEN '4096' THEN n_words BETWEEN 512 AND 4096
        WHEN '16k' THEN n_words BETWEEN 4096 AND 16000
        WHEN '16k_plus' THEN n_words BETWEEN 16000 AND 93000
        WHEN 'open' THEN contains(model, 'fine') AND NOT closed
        WHEN 'closed' THEN contains(model, 'fine') AND closed
        ELSE CASE WHEN contains(model, 'coarse')
                  THEN NOT (s_quality + s_toxic > 0 AND s_quality + s_toxic < CAST(slice[9:] AS INT))
                  ELSE NOT (s_quality > 0 AND s_quality < CAST(slice[9:] AS INT))
                   AND NOT (s_toxic > 0 AND s_toxic < CAST(slice[9:] AS INT)) END
    END)
"""


def conf_sql(by: str, cells: str = "cells") -> str:
    return f"""SELECT {by}, label, idx, count(*) FILTER (t = 1 AND p = 1) AS tp,
        count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn,
        count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) AS n FROM {cells} GROUP BY {by}, label, idx"""


def ratio_sql(numerator: str, denominator: str) -> str:
    return (f"CASE WHEN {denominator} = 0 THEN 0.0::DOUBLE "
            f"ELSE ({numerator})::DOUBLE / ({denominator})::DOUBLE END")


PRF_SQL = (f"{ratio_sql('tp', 'tp + fp')} AS p, {ratio_sql('tp', 'tp + fn')} AS r, "
           f"{ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1")


def average_sql(by: str, conf: str = "conf", exact: str = "exact") -> str:
    """Scores per `by` from tables `conf` and `exact(by, ok)` of matching units."""
    return f"""SELECT {by}, CAST(n AS BIGINT) AS n, mac_p, mac_r, mac_f1,
        {ratio_sql('tp', 'tp + fp')} AS mic_p, {ratio_sql('tp', 'tp + fn')} AS mic_r,
        {ratio_sql('2 * tp', '2 * tp + fp + fn')} AS mic_f1, ok::DOUBLE / n::DOUBLE AS sub_acc
    FROM (SELECT {by}, max(n) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
              round(avg(p), 9) AS mac_p, round(avg(r), 9) AS mac_r, round(avg(f1), 9) AS mac_f1
          FROM (SELECT *, {PRF_SQL} FROM {conf}) GROUP BY {by})
    JOIN {exact} USING ({by})"""


def exact_sql(by: str, cells: str = "cells") -> str:
    return f"""SELECT {by}, count(*) FILTER (same) AS ok
    FROM (SELECT {by}, unit, bool_and(t = p) AS same FROM {cells} GROUP BY {by}, unit) GROUP BY {by}"""


def score_sql(base: str, by: str, cells: str = "cells") -> str:
    return (f"WITH {base}, conf AS ({conf_sql(by, cells)}), exact AS ({exact_sql(by, cells)}) "
            f"{average_sql(by)}")
