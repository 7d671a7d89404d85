"""Evaluation of a folder that result files are still added to.

The stream keeps confusion counts per model, combination of slices and label: their number depends on models, slices
and labels, not on predictions, and counts of new files are added to those of earlier ones. Each run reads the files
that came since the last one. Scores of all slices are then worked out from the few counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators import evaluate, scoring
from labelmill.sources.readers import read_predictions


def count_stream(spark: SparkSession, folder: str, records: DataFrame, labels: scoring.Labels, checkpoint: str,
                 name: str) -> StreamingQuery:
    """Adds the result files that are new in `folder` to the counts; stops when it has read all of them.

    The counts are the table `name`. Rows that cannot be scored - without labels, of a wrong width - and rows
    without a record take no part; `scoring.rejected` and `hydrate.without_metadata` list them.
    """
    preds = scoring.accepted(scoring.unify(read_predictions(spark, folder, stream=True)), labels)
    counts = scoring.confusion(evaluate.with_metadata(preds, records), labels, ["model", "slices"])
    return (counts.writeStream.format("memory").queryName(name).outputMode("complete")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def scores(counts: DataFrame, labels: scoring.Labels) -> DataFrame:
    """Scores per model and slice from the counts of `count_stream`."""
    return scoring.average(scoring.unfold_slices(counts, labels), ["model", "slice"])
