from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill.functions.labelsets import COARSE, FINE, LabelSet, label_set
from labelmill.operators import labeling
from labelmill.session import small_table

import pytest

ABC = LabelSet(["a", "b", "c"], {"a": "x", "b": "x"}, frozenset(["c"]), ["b", "a", "c"])


def test_published_vocabularies():
    assert len(FINE.labels) == 36 and len(FINE.closed_labels) == 29 and len(COARSE.labels) == 7
    assert set(FINE.coarse_of.values()) == set(COARSE.labels)
    assert sorted(FINE.by_frequency) == sorted(FINE.labels)
    assert sorted(COARSE.by_frequency) == sorted(COARSE.labels)
    # Label positions of the frequency thirds, as published.
    assert set(FINE.positions(l for l in FINE.labels if FINE.section_of(l) == "top")) == {
        33, 9, 32, 11, 35, 15, 14, 26, 24, 18, 29, 16}
    assert set(FINE.positions(l for l in FINE.labels if FINE.section_of(l) == "bot")) == {
        19, 3, 8, 4, 20, 17, 1, 21, 6, 5, 2, 7}


def test_unknown_label_set_is_refused():
    with pytest.raises(ValueError):
        label_set("warnings_unknown")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "unknown"]), max_size=5), min_size=1, max_size=5))
def test_decode_of_encode_is_the_known_part(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, names array<string>")
    out = df.select("id", labeling.decode(labeling.encode(F.col("names"), ABC), ABC).alias("n")).collect()
    for row in out:
        assert row["n"] == [x for x in ABC.labels if x in rows[row["id"]]]


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, ["zzz", "b", "b"]), (2, []), (3, None)], "id int, names array<string>")
    got = {r["id"]: r["v"] for r in df.select("id", labeling.encode(F.col("names"), ABC).alias("v")).collect()}
    assert got == {1: [0, 1, 0], 2: [0, 0, 0], 3: [0, 0, 0]}


def test_decode_names_exact_ones_only(spark):
    df = spark.createDataFrame([([0, 1, 2],)], "v array<int>")
    assert df.select(labeling.decode(F.col("v"), ABC)).first()[0] == ["b"]


def test_mask_roundtrip_and_openness(spark):
    df = small_table(spark, [("u", "a"), ("u", "c"), ("u", "other"), ("w", "other")], "unit string, label string")
    got = {r["unit"]: r for r in df.groupBy("unit").agg(
        F.bit_or(labeling.mask_of(F.col("label"), ABC)).alias("m")).select(
        "unit", labeling.unmask(F.col("m"), ABC).alias("v")).collect()}
    assert got["u"]["v"] == [1, 0, 1] and got["w"]["v"] == [0, 0, 0]
    names = spark.createDataFrame([(["c", "a", "zzz"],)], "n array<string>")
    row = names.select(labeling.only_open(F.col("n"), ABC), labeling.only_closed(F.col("n"), ABC)).first()
    assert row[0] == ["c"] and row[1] == ["a"]


def test_rollup_and_unmapped(spark):
    df = small_table(spark, [("u", "a"), ("u", "a"), ("u", "b"), ("u", "c"), ("u", "q")], "unit string, label string")
    rows = labeling.rollup(df, ABC, ["unit"]).collect()
    assert [(r["coarse"], r["fine_labels"]) for r in rows] == [("x", 2)]
    assert [r["label"] for r in labeling.unmapped(df, ABC).collect()] == ["q"]
