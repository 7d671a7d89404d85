"""Hydrated works to training examples: cleaned text and label vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions import html, text
from labelmill.functions.labelsets import label_set
from labelmill.operators.labeling import encode


def clean_html(chapter):
    """Shown text of an HTML chapter, lower-cased, without unusual characters."""
    return text.clean(html.to_text(chapter))


def prepare_works(works: DataFrame, label_column: str) -> DataFrame:
    """`work_id`, one cleaned text over all chapters, and labels in label-set order.

    A narrow projection: no shuffle, and only the needed columns are read.
    """
    labels = label_set(label_column)
    return works.select(
        "work_id", text.join_chapters(F.col("text"), clean_html).alias("text"),
        encode(F.col(label_column), labels).alias("labels"))
