"""Works joined to page content and to split lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelmill.session import small_table

MISSING = "missing"


def attach_pages(works: DataFrame, pages: DataFrame, key: str = "work_id") -> DataFrame:
    """Every work with the content of its page; works without a page get status `missing`.

    Reduce `pages` to the extracted fields before the call: then those fields, not raw HTML, cross the
    shuffle.
    """
    return works.join(pages, key, "left").withColumn(
        "status", F.coalesce("status", F.lit(MISSING)))


def outcome(attached: DataFrame) -> DataFrame:
    """Number of works per status."""
    return attached.groupBy("status").agg(F.count("*").alias("works"))


#: What can become of a work: the states of its page, or none.
STATES = ("ok", "private", "error", "unrevealed", "malformed", MISSING)


def counted(attached: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and the number of works per state, counted by whatever job writes them.

    Read `outcome_of` after the write; nothing is read or joined a second time for the counts.
    """
    seen = Observation()
    known = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return attached.observe(seen, F.count("*").alias("works"), *known), seen


def outcome_of(seen: Observation, spark: SparkSession) -> DataFrame:
    """Rows (status, works) of the states that occur; works in an unknown state are counted as `other`."""
    counts = dict(seen.get)
    counts["other"] = counts.pop("works") - sum(counts.values())
    return small_table(spark, [(s, n) for s, n in counts.items() if n], "status string, works bigint")


def available(attached: DataFrame, text_fields=("notes", "endnotes", "summary")) -> DataFrame:
    """Works whose page could be read, with empty strings for absent text fields."""
    kept = attached.filter(F.col("status") == "ok").drop("status")
    return kept.withColumns({
        name: F.coalesce(name, F.lit("")) for name in text_fields if name in kept.columns})


def membership(splits: DataFrame, key: str = "work_id") -> DataFrame:
    """Sorted names of the splits of each work.

    A set of split names: the number of id lists bounds it, however often a list repeats an id.
    """
    return splits.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"))


def assign_splits(works: DataFrame, splits: DataFrame, key: str = "work_id") -> DataFrame:
    """One row per work and split it belongs to.

    Split lists are folded to one row per work before the join, so the wide work row crosses the
    shuffle once and is copied per split only behind it.
    """
    return (
        works.join(membership(splits, key), key, "inner")
        .withColumn("split", F.explode("splits")).drop("splits")
    )


def unassigned(works: DataFrame, splits: DataFrame, key: str = "work_id") -> DataFrame:
    """Works that no split list names."""
    return works.join(splits.select(key), key, "left_anti")


def without_metadata(predictions: DataFrame, works: DataFrame, key: str = "work_id") -> DataFrame:
    """Predictions for works that have no metadata; an inner join would drop them unseen."""
    return predictions.join(works.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str = "work_id") -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
