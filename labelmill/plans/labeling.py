"""Registered queries: label sets, tag support, length ranges, splits and threads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelmill.functions.labelsets import COARSE, COARSE_LABELS, FINE, FINE_LABELS
from labelmill.functions.scalars import sigmoid, threshold
from labelmill.operators import hydrate, labeling, pages, support, threads
from labelmill.plans import standins as S
from labelmill.session import ensure_checkpoint_dir
from labelmill.sources.readers import read_table


def encode_labels(spark, sf):
    """Names of each unit's labels, then their 0/1 vector in label order."""
    names = labeling.decode(labeling.unmask(F.col("any"), S.EVENTS), S.EVENTS)
    return S.event_units(spark, sf).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.array_join(labeling.encode(names, S.EVENTS), "").alias("labels"))


def decode_labels(spark, sf):
    return read_table(spark, sf, "labels").select(
        "doc_id",
        F.array_join(labeling.decode(F.array("quality", "toxic"), S.DOCS), ",").alias("labels"))


def open_closed_labels(spark, sf):
    names = labeling.decode(labeling.unmask(F.col("any"), S.EVENTS), S.EVENTS)
    return S.event_units(spark, sf).select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.array_join(labeling.only_open(names, S.EVENTS), ",").alias("open"),
        F.array_join(labeling.only_closed(names, S.EVENTS), ",").alias("closed"))


def label_rollup(spark, sf):
    return labeling.rollup(S.event_label_rows(spark, sf), S.EVENTS, ["user_id", "day"]).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


def label_frequency(spark, sf):
    return labeling.frequency(S.event_label_rows(spark, sf), S.EVENTS)


def length_buckets(spark, sf):
    names = support.length_slices(F.col("n_words"))
    return (S.doc_facts(spark, sf).select(F.explode_outer(names).alias("bucket"))
            .filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("docs")))


def _full_support(spark, sf):
    return support.tag_support(
        S.doc_tags(spark, sf), S.tag_map(spark, S.FULL_TAGS), FINE, "doc_id", COARSE)


def tag_support(spark, sf):
    return _full_support(spark, sf).select(
        "doc_id", F.array_join("support_fine", ",").alias("support"))


def tag_support_coarse(spark, sf):
    return _full_support(spark, sf).select(
        "doc_id", F.array_join("support_coarse", ",").alias("support"))


def support_filter(spark, sf):
    """Documents that pass each support level."""
    return (
        _full_support(spark, sf)
        .select(F.explode_outer(support.support_slices(F.col("support_fine"))).alias("slice"))
        .filter(F.col("slice").isNotNull())
        .groupBy(F.substring("slice", 9, 2).cast("int").alias("k")).agg(F.count("*").alias("docs"))
    )


def threshold_scores(spark, sf):
    """Embedding elements as logits: positions at or above, and strictly above, one half."""
    scores = F.transform("embedding", lambda x: sigmoid(x.cast("double")))

    def ones(inclusive):
        return F.aggregate(threshold(scores, 0.5, inclusive), F.lit(0), lambda a, b: a + b)

    return read_table(spark, sf, "embeddings").select(
        "vec_id", ones(True).alias("at_least"), ones(False).alias("above"))


def hydrate_outcome(spark, sf):
    """Documents joined to pages of the same id: how many could be read, counted by the job that writes them."""
    found = S.pages(spark, sf).select(
        F.col("page_id").alias("doc_id"), pages.status(F.col("html"), pages.ARTICLE_LAYOUT).alias("status"))
    works = read_table(spark, sf, "documents").select("doc_id")
    attached, seen = hydrate.counted(hydrate.attach_pages(works, found, "doc_id"))
    attached.write.parquet(f"{ensure_checkpoint_dir(spark)}/hydrated-{uuid.uuid4()}")
    return hydrate.outcome_of(seen, spark)


def split_assign(spark, sf):
    works = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return (hydrate.assign_splits(works, S.split_rows(spark, sf), "doc_id")
            .groupBy("split").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("n_chars")))


def split_membership(spark, sf):
    return hydrate.membership(S.split_rows(spark, sf), "doc_id").select(
        "doc_id", F.array_join("splits", ",").alias("splits"))


def split_unassigned(spark, sf):
    works = read_table(spark, sf, "documents").select("doc_id")
    return hydrate.unassigned(works, S.split_rows(spark, sf), "doc_id")


def thread_parents(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return threads.previous_in_group(turns, "conv_id", "turn").select(
        "conv_id", "turn", F.col("previous").alias("parent_turn"))


def thread_depth(spark, sf):
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn")
    return threads.previous_in_group(turns, "conv_id", "turn").select(
        "conv_id", "turn", F.col("first").alias("root"), F.col("rank").alias("depth"))


QUERIES = {f.__name__: f for f in (
    encode_labels, decode_labels, open_closed_labels, label_rollup, label_frequency, length_buckets,
    tag_support, tag_support_coarse, support_filter, threshold_scores, hydrate_outcome, split_assign,
    split_membership, split_unassigned, thread_parents, thread_depth)}

_UNIT_LABELS = """lab(label, idx, coarse, closed) AS (VALUES ('view', 0, 'engagement', true),
    ('click', 1, 'engagement', true), ('signup', 2, 'conversion', false),
    ('purchase', 3, 'conversion', true), ('error', 4, 'fault', false)),
has AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS label FROM events),
units AS (SELECT DISTINCT user_id, day FROM has)"""

_COARSE_CASE = "CASE label " + " ".join(
    f"WHEN '{fine}' THEN '{coarse}'" for fine, coarse in FINE.coarse_of.items()) + " END"
_FULL_SUPPORT = rf"""fine(label, idx) AS (VALUES {S.sql_values(list(zip(FINE_LABELS, range(36))))}),
coarse(label, idx) AS (VALUES {S.sql_values(list(zip(COARSE_LABELS, range(7))))}),
tag_map(tag, label) AS (VALUES {S.sql_values(S.FULL_TAGS)}),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{S.TOKEN_SQL}')) AS tag FROM documents),
hits AS (SELECT doc_id, label, count(*) AS n FROM words JOIN tag_map USING (tag) GROUP BY ALL),
coarse_hits AS (SELECT doc_id, {_COARSE_CASE} AS label, sum(n)::BIGINT AS n FROM hits GROUP BY ALL)"""
_SPLITS = """rule(split, low, high) AS (VALUES ('train', 0, 7), ('validation', 8, 8), ('test', 9, 9),
    ('train_small', 0, 1)),
splits AS (SELECT doc_id, split FROM documents JOIN rule ON doc_id % 10 BETWEEN low AND high
    WHERE doc_id % 97 <> 0)"""

ORACLES = {
    "encode_labels": f"""WITH {_UNIT_LABELS}
        SELECT u.user_id, u.day, string_agg(CASE WHEN h.label IS NULL THEN '0' ELSE '1' END, '' ORDER BY idx) AS labels
        FROM units u CROSS JOIN lab LEFT JOIN has h
          ON h.user_id = u.user_id AND h.day = u.day AND h.label = lab.label GROUP BY 1, 2""",
    "decode_labels": """SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END,
        CASE WHEN toxic = 1 THEN 'toxic' END) AS labels FROM labels""",
    "open_closed_labels": f"""WITH {_UNIT_LABELS}
        SELECT user_id, day, coalesce(string_agg(label, ',' ORDER BY idx) FILTER (NOT closed), '') AS open,
               coalesce(string_agg(label, ',' ORDER BY idx) FILTER (closed), '') AS closed
        FROM has JOIN lab USING (label) GROUP BY 1, 2""",
    "label_rollup": f"""WITH {_UNIT_LABELS}
        SELECT user_id, day, coarse, count(*) AS fine_labels FROM has JOIN lab USING (label) GROUP BY 1, 2, 3""",
    "label_frequency": """SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INT) AS freq_rank,
        CASE ntile(3) OVER (ORDER BY n DESC, label) WHEN 1 THEN 'top' WHEN 2 THEN 'mid' ELSE 'bot' END AS section
        FROM (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)""",
    "length_buckets": r"""WITH b(bucket, low, high) AS (VALUES ('512', 0, 512), ('4096', 512, 4096),
            ('16k', 4096, 16000), ('16k_plus', 16000, 93000)),
        d AS (SELECT len(regexp_extract_all(text, '\S+')) AS n_words FROM documents)
        SELECT bucket, count(*) AS docs FROM d JOIN b ON n_words BETWEEN low AND high GROUP BY 1""",
    "tag_support": f"""WITH {_FULL_SUPPORT}
        SELECT d.doc_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY idx) AS support
        FROM documents d CROSS JOIN fine LEFT JOIN hits ON hits.doc_id = d.doc_id AND hits.label = fine.label
        GROUP BY 1""",
    "tag_support_coarse": f"""WITH {_FULL_SUPPORT}
        SELECT d.doc_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY idx) AS support
        FROM documents d CROSS JOIN coarse c
        LEFT JOIN coarse_hits h ON h.doc_id = d.doc_id AND h.label = c.label GROUP BY 1""",
    "support_filter": f"""WITH {_FULL_SUPPORT}, levels(k) AS (VALUES (2), (3), (5)),
        low AS (SELECT DISTINCT doc_id, k FROM hits JOIN fine USING (label) JOIN levels ON n < k)
        SELECT k, count(*) AS docs FROM documents d CROSS JOIN levels ANTI JOIN low USING (doc_id, k) GROUP BY 1""",
    "threshold_scores": """SELECT vec_id,
        CAST(len([x for x in embedding if 1.0 / (1.0 + exp(-(x::DOUBLE))) >= 0.5]) AS INT) AS at_least,
        CAST(len([x for x in embedding if 1.0 / (1.0 + exp(-(x::DOUBLE))) > 0.5]) AS INT) AS above
        FROM embeddings""",
    "hydrate_outcome": r"""SELECT CASE WHEN page_id IS NULL THEN 'missing'
            WHEN regexp_matches(html, '<body.*</body', 's') THEN 'ok' ELSE 'malformed' END AS status,
            count(*) AS works
        FROM documents LEFT JOIN pages ON page_id = doc_id GROUP BY 1""",
    "split_assign": f"""WITH {_SPLITS} SELECT split, count(*) AS docs, sum(n_chars)::BIGINT AS n_chars
        FROM documents JOIN splits USING (doc_id) GROUP BY 1""",
    "split_membership": f"""WITH {_SPLITS}
        SELECT doc_id, string_agg(split, ',' ORDER BY split) AS splits FROM splits GROUP BY 1""",
    "split_unassigned": f"WITH {_SPLITS} SELECT doc_id FROM documents ANTI JOIN splits USING (doc_id)",
    "thread_parents": """SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn
        FROM conversations""",
    "thread_depth": """SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS root,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations""",
}
