"""The per-work preparation on a growing folder of hydrated works.

Cleaning and encoding touch one work at a time, so the same projection runs on a stream and keeps no
state. A checkpoint folder makes each file count once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators.prepare import prepare_works
from labelmill.sources.readers import HYDRATED_WORK


def prepare_stream(spark: SparkSession, folder: str, target: str, checkpoint: str,
                   label_column: str) -> StreamingQuery:
    """Prepare every work file that is or will be in `folder`; stops when it has read all of them."""
    works = spark.readStream.schema(HYDRATED_WORK).json(folder)
    return (
        prepare_works(works, label_column).writeStream.format("json")
        .option("checkpointLocation", checkpoint).option("path", target)
        .trigger(availableNow=True).start()
    )
