"""Readers with fixed schemas. Every reader is lazy and takes one file, a folder or a glob."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.scalars import file_stem, strip

WORK = ("work_id string, freeform array<string>, warnings_fine_open array<string>, "
        "warnings_coarse_open array<string>, n_words bigint, n_chapters int")
HYDRATED_WORK = WORK + ", text array<string>, notes string, endnotes string, summary string"
PREPARED = "work_id string, text string, labels array<int>"
PAGE = "work_id string, url string, html string"
# Labels of one prediction layout were stored as floats, so all vectors are read as doubles.
PREDICTION = ("work_id string, truth array<double>, predictions array<double>, "
              "labels array<double>, prediction array<double>")
SCORES = "work_id string, scores array<double>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines. Missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, WORK)


def read_hydrated(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, HYDRATED_WORK)


def _name(column: str) -> Column:
    """Name of what a file belongs to: of its folder `column=name` where a job wrote several files, else its stem."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"/{column}=([^/]+)/[^/]*$", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), file_stem(F.col("_metadata.file_name")))


def read_prepared(spark: SparkSession, **split_paths: str) -> DataFrame:
    """Prepared examples of several splits in one scan, with a `split` column told by the path of the file."""
    path = F.col("_metadata.file_path")
    split = F.lit(None).cast("string")
    # The longest path first, so that a folder inside another one keeps its own split.
    for name, wanted in sorted(split_paths.items(), key=lambda item: len(item[1])):
        inside = re.sub(r"^[a-z0-9]+:/+", "/", wanted.rstrip("/"))
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in inside)
        split = F.when(path.rlike(f"{pattern}(/|$)"), name).otherwise(split)
    return spark.read.schema(PREPARED).json(list(split_paths.values())).withColumn("split", split)


def read_predictions(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """All result files of a folder in one scan, or as a stream of growing files.

    A model is one file, named by it, or a folder `model=name` of files. Both layouts and rows without labels are
    read; missing fields are null.
    """
    source = spark.readStream if stream else spark.read
    files = source.schema(PREDICTION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(folder)
    return files.select("*", _name("model").alias("model"))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Id lists, one work per line; the file's stem names the split, or its folder `split=name`."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(folder)
        .select(strip(F.col("value")).alias("work_id"), _name("split").alias("split"))
        .filter(F.col("work_id") != "")
    )


def read_tag_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two-column `tag,warning` lines as a multimap in long form.

    Returns the good rows and the rejected lines, which do not have exactly two fields.
    """
    fields = F.split(strip(F.col("value")), ",")
    lines = spark.read.text(path).filter(strip(F.col("value")) != "").select("value", fields.alias("f"))
    good = lines.filter(F.size("f") == 2).select(
        strip(F.col("f")[0]).alias("tag"), strip(F.col("f")[1]).alias("warning"))
    return good, lines.filter(F.size("f") != 2).select(F.col("value").alias("line"))


def read_label_set(spark: SparkSession, path: str) -> list[str]:
    """Label names from a JSON array file. A vocabulary, so its size does not grow with the data."""
    row = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<string>").alias("labels")).first()
    return list(row["labels"])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
