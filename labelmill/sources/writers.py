"""Sinks. Each is one distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.hydrate import assign_splits


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    df.write.mode(mode).options(**options).json(path)


def write_hydrated(works: DataFrame, splits: DataFrame, folder: str,
                   mode: str = "errorifexists") -> None:
    """The full set, and the same works once more per split they belong to.

    The full set is written first and read back for the split copies, so pages are joined and parsed
    once and the second write does not depend on cached blocks that a lost executor takes along. With mode
    `overwrite` a job may be repeated: the full set is replaced, and of the split copies the splits it has works for.
    """
    spark = works.sparkSession
    full = f"{folder}/corpus"
    works.write.mode(mode).parquet(full)
    written = spark.read.schema(works.schema).parquet(full)
    assign_splits(written, splits).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("split").json(f"{folder}/splits")


def write_labels(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`work_id` with label names, one JSON line per work."""
    write_json(predictions.select("work_id", F.col("labels")), path, mode)


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Score rows (bounded by models x slices) as one JSON file."""
    write_json(scores.coalesce(1), path, mode)


def write_predictions(preds: DataFrame, folder: str, scored: bool = False) -> None:
    """Rows (work_id, model, truth, pred) as result files, a folder for each model.

    `scored` writes the layout of the neural models: `labels` and `prediction`, labels as floats.
    """
    names = ("labels", "prediction") if scored else ("truth", "predictions")
    kind = "array<double>" if scored else "array<int>"
    preds.select("work_id", "model", F.col("truth").cast(kind).alias(names[0]), F.col("pred").alias(names[1])).write.mode(
        "append").partitionBy("model").json(folder)
