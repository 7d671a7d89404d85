"""Tag support per label, and the row slices that depend on a work's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.labelsets import LabelSet
from labelmill.operators.labeling import only_closed, only_open

# Inclusive word-count ranges. Neighbours share their border on purpose.
LENGTH_RANGES = {
    "512": (0, 512), "4096": (512, 4096), "16k": (4096, 16000), "16k_plus": (16000, 93000),
}
# Minimum numbers of supporting tags.
SUPPORT_LEVELS = (2, 3, 5)


def length_slices(n_words: Column, ranges: dict[str, tuple[int, int]] = LENGTH_RANGES) -> Column:
    """Names of all ranges that hold the count; none for null or longer works.

    The ranges overlap, so a row may carry two names. Naming them in the row needs no range join.
    """
    return F.array_compact(F.array(*[
        F.when(n_words.between(low, high), name) for name, (low, high) in ranges.items()]))


def well_supported(support: Column, least: int) -> Column:
    """True unless some label has support above zero but below `least`."""
    return ~F.exists(support, lambda s: (s > 0) & (s < least))


def support_slices(support: Column, levels=SUPPORT_LEVELS) -> Column:
    return F.array_compact(F.array(*[
        F.when(well_supported(support, k), f"support_{k}") for k in levels]))


def tag_support(tags: DataFrame, tag_map: DataFrame, labels: LabelSet, unit: str = "work_id",
                coarse: LabelSet | None = None, keep=()) -> DataFrame:
    """Support vectors per unit: for each label, the number of the unit's tags mapped to it.

    `tags` has one array column `tags` per unit; repeated tags count each time, a tag with several
    warnings supports each, names outside the vocabulary drop out, units without a mapped tag get
    zeros. With `coarse`, the same counts rolled up to coarse labels come along. Columns to `keep` are
    carried through the aggregation, which spares a second scan and a join; give them a fixed width
    (numbers, booleans), so that Spark can fold them in a hash aggregation.

    Spark broadcasts the tag map while it is below the broadcast threshold and otherwise joins by tag,
    with adaptive splitting of frequent tags. Only mapped tags, and the first tag of each unit so that
    no unit gets lost, reach the counters. These are folded per task, so about one row per unit
    crosses the shuffle.
    """
    spark = tags.sparkSession
    dim = labels.dim(spark).select(F.col("label").alias("warning"), "idx", "coarse")
    mapped = tag_map.select("tag", "warning").join(F.broadcast(dim), "warning").drop("warning")
    rows = (
        tags.select(unit, *keep, F.posexplode_outer("tags").alias("pos", "tag"))
        .join(mapped, "tag", "left")
        .filter(F.col("idx").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    )
    counters = [F.count_if(F.col("idx") == i).alias(f"_f{i}") for i in range(len(labels.labels))]
    vectors = {"support_fine": F.array(*[F.col(f"_f{i}") for i in range(len(labels.labels))])}
    if coarse is not None:
        counters += [F.count_if(F.col("coarse") == name).alias(f"_c{i}")
                     for i, name in enumerate(coarse.labels)]
        vectors["support_coarse"] = F.array(*[F.col(f"_c{i}") for i in range(len(coarse.labels))])
    counted = rows.groupBy(unit).agg(*counters, *[F.first(c).alias(c) for c in keep])
    return counted.select(unit, *keep, *[vector.alias(name) for name, vector in vectors.items()])


def one_per_key(rows: DataFrame, key: str = "work_id") -> DataFrame:
    """The row with the smallest content hash of each key."""
    content = F.xxhash64(*rows.columns)
    first = Window.partitionBy(key).orderBy(content)
    return rows.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1).drop("_nth")


def work_records(works: DataFrame, tag_map: DataFrame, fine: LabelSet, coarse: LabelSet) -> DataFrame:
    """Work metadata with support vectors and the fine labels split by openness.

    Of works that share an id one row stays (`hydrate.duplicate_keys` lists them), so that neither
    counts nor joins by id multiply.
    """
    works = one_per_key(works)
    support = tag_support(works.select("work_id", F.col("freeform").alias("tags")), tag_map, fine,
                          coarse=coarse)
    return works.join(support, "work_id").select(
        "work_id", "freeform", "support_fine", "support_coarse",
        F.col("warnings_coarse_open").alias("coarse"),
        F.col("warnings_fine_open").alias("fine"),
        only_open(F.col("warnings_fine_open"), fine).alias("open"),
        only_closed(F.col("warnings_fine_open"), fine).alias("closed"),
        "n_words", "n_chapters")
