"""Registered queries over files: tables written in the formats of the readers and read back.

Files go to the shared folder of `session.ensure_checkpoint_dir`, a new one for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.functions.scalars import file_stem
from labelmill.operators import vectorize
from labelmill.plans import features
from labelmill.plans import standins as S
from labelmill.plans.text import DROPPED_SQL
from labelmill.session import ensure_checkpoint_dir
from labelmill.sources import readers, writers
from labelmill.sources.readers import read_table


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4()}/{name}"


def works_read_back(spark, sf):
    """Hydrated works as JSON lines, written as whole set and read by the reader's schema."""
    path = _folder(spark, "works")
    works = S.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("work_id"), F.array("source", F.coalesce("lang", F.lit("none"))).alias("freeform"),
        F.array(F.lit("abuse")).alias("warnings_fine_open"), F.array().cast("array<string>").alias("warnings_coarse_open"),
        X.word_count(F.col("text")).alias("n_words"), F.lit(1).alias("n_chapters"),
        X.chapters(F.col("text")).alias("text"), F.lit("").alias("notes"), F.lit("").alias("endnotes"), F.lit("s").alias("summary"))
    writers.write_json(works, path)
    back = readers.read_hydrated(spark, path)
    return back.select(
        "work_id", F.array_join("freeform", ",").alias("tags"), F.array_join("warnings_fine_open", ",").alias("fine"),
        F.size("warnings_coarse_open").alias("coarse"), "n_words", "n_chapters",
        F.md5(F.array_join("text", "\n")).alias("md5"), "summary")


def tag_map_read_back(spark, sf):
    """Tag lines with white space around their fields, and lines that have not two fields, by source."""
    path = _folder(spark, "tags")
    doc = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(doc, F.lit(",a,b"))).when(F.col("doc_id") % 7 == 0, doc).otherwise(
        F.concat(F.lit("\t"), doc, F.lit(" ,\t"), F.col("source"), F.lit(" ")))
    read_table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    good, bad = readers.read_tag_map(spark, path)
    return good.select("tag", "warning").unionByName(bad.select(
        F.split("line", ",")[0].alias("tag"), F.lit("rejected").alias("warning")))


def splits_written(spark, sf):
    """The corpus written whole and once more per split; works per split folder, and in the whole set."""
    folder = _folder(spark, "hydrated")
    works = S.documents(spark, sf).select(F.col("doc_id").cast("string").alias("work_id"), F.length("text").alias("length"))
    splits = S.split_rows(spark, sf).select(F.col("doc_id").cast("string").alias("work_id"), "split")
    # Written twice, as a repeated job does: one copy is left.
    for _ in range(2):
        writers.write_hydrated(works, splits, folder, "overwrite")
    copies = spark.read.schema("work_id string, length int, split string").json(f"{folder}/splits")
    whole = spark.read.parquet(f"{folder}/corpus").withColumn("split", F.lit("corpus"))
    return copies.unionByName(whole).groupBy("split").agg(
        F.count("*").alias("works"), F.sum("length").alias("length"))


def split_lists_read_back(spark, sf):
    """Id lists as text files with stray white space and empty lines; how many ids the reader finds for each split."""
    folder = _folder(spark, "lists")
    doc = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" \t"), doc, F.lit("\r"))).otherwise(doc)
    S.split_rows(spark, sf).select("split", F.explode(F.array(line, F.lit(" "))).alias("value")).write.partitionBy("split").text(folder)
    found = readers.read_splits(spark, folder)
    return found.groupBy("split").agg(F.count("*").alias("works"), F.sum(F.col("work_id").cast("bigint")).alias("ids"))


def prepared_read_back(spark, sf):
    """Prepared examples of three splits, read in one scan; some lines have no labels."""
    folder = _folder(spark, "prepared")
    docs = S.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("work_id"), X.clean(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 4 > 0, F.array((F.col("doc_id") % 2).cast("int"), F.lit(1))).alias("labels"),
        F.when(F.col("doc_id") % 10 <= 7, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test").alias("split"))
    docs.write.partitionBy("split").json(folder)
    read = readers.read_prepared(spark, **{name: f"{folder}/split={name}" for name in ("train", "validation", "test")})
    return read.groupBy("split").agg(
        F.count("*").alias("works"), F.sum(F.length("text")).alias("length"), F.count_if(F.col("labels").isNull()).alias("unlabelled"),
        F.sum(F.col("labels")[0].cast("bigint")).alias("first"))


def label_set_read_back(spark, sf):
    """Event types as a JSON array file, read as a label set and used to encode users' sets of types."""
    path = _folder(spark, "labels")
    events = read_table(spark, sf, "events")
    events.agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("value")).coalesce(1).write.text(path)
    names = readers.read_label_set(spark, path)
    has = [F.max((F.col("event_type") == name).cast("int")).cast("string") for name in names]
    return events.groupBy("user_id").agg(F.concat(*has).alias("labels"))


def vectorizer_read_back(spark, sf):
    """Vocabulary and weights fitted on training documents, saved twice over, loaded, and applied to test documents."""
    folder = _folder(spark, "vectorizer")
    docs = S.documents(spark, sf).select("doc_id", "text")
    fitted = vectorize.fit_vectorizer(docs.filter(F.col("doc_id") % 10 <= 7), n_gram_range=(1, 2))
    for _ in range(2):
        fitted.save(folder, "overwrite")
    loaded = vectorize.Vectorizer.load(spark, folder)
    return loaded.transform(docs.filter(F.col("doc_id") % 10 == 9)).select("doc_id", "term", F.round("w", 6).alias("w"))


def file_stems(spark, sf):
    """Stems of file names with folders, several dots or none."""
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/a.b/c/"), F.col("source"), F.lit(".v"), number, F.lit(".jsonl"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.col("source"), F.lit(".txt"))).otherwise(F.concat(F.lit("x/"), number))
    return read_table(spark, sf, "documents").select("doc_id", file_stem(name).alias("stem"))


QUERIES = {f.__name__: f for f in (
    works_read_back, tag_map_read_back, splits_written, split_lists_read_back, prepared_read_back, label_set_read_back,
    vectorizer_read_back, file_stems)}

ORACLES = {
    "works_read_back": r"""SELECT doc_id::VARCHAR AS work_id, source || ',' || coalesce(lang, 'none') AS tags, 'abuse' AS fine,
        0 AS coarse, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words, 1 AS n_chapters, md5(text) AS md5,
        's' AS summary FROM documents""",
    "tag_map_read_back": """SELECT doc_id::VARCHAR AS tag,
        CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'rejected' ELSE source END AS warning FROM documents""",
    "splits_written": """WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 10 AS digit FROM documents),
        s AS (SELECT n, CASE WHEN digit <= 7 THEN 'train' WHEN digit = 8 THEN 'validation' ELSE 'test' END AS split FROM d WHERE doc_id % 97 <> 0
              UNION ALL SELECT n, 'train_small' FROM d WHERE doc_id % 97 <> 0 AND digit < 2
              UNION ALL SELECT n, 'corpus' FROM d)
        SELECT split, count(*) AS works, CAST(sum(n) AS BIGINT) AS length FROM s GROUP BY 1""",
    "split_lists_read_back": """WITH s AS (SELECT doc_id, unnest(CASE WHEN doc_id % 10 < 2 THEN ['train', 'train_small']
            WHEN doc_id % 10 <= 7 THEN ['train'] WHEN doc_id % 10 = 8 THEN ['validation'] ELSE ['test'] END) AS split
            FROM documents WHERE doc_id % 97 <> 0)
        SELECT split, count(*) AS works, CAST(sum(doc_id) AS BIGINT) AS ids FROM s GROUP BY 1""",
    "prepared_read_back": rf"""SELECT CASE WHEN doc_id % 10 <= 7 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
            count(*) AS works, CAST(sum(length(regexp_replace(lower(text), '{DROPPED_SQL}', '', 'g'))) AS BIGINT) AS length, count(*) FILTER (doc_id % 4 = 0) AS unlabelled,
            CAST(sum(doc_id % 2) FILTER (doc_id % 4 > 0) AS BIGINT) AS first FROM documents GROUP BY 1""",
    "label_set_read_back": """WITH names AS (SELECT DISTINCT event_type AS name FROM events)
        SELECT user_id, string_agg(CASE WHEN has THEN '1' ELSE '0' END, '' ORDER BY name) AS labels FROM (
            SELECT user_id, name, bool_or(event_type = name) AS has FROM events CROSS JOIN names GROUP BY 1, 2) GROUP BY 1""",
    "vectorizer_read_back": features.ORACLES["tfidf_transform"],
    "file_stems": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '.v' || doc_id WHEN 1 THEN source ELSE doc_id::VARCHAR END AS stem
        FROM documents""",
}
