"""Removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import queries, suffix

DOCS = "doc_id long, text string, doc string, n long, start string"


def brute(rows, width):
    """Rows of the result; `rows` may repeat a row but not give an id two texts."""
    first, out = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - width + 1):
            window = data[at:at + width]
            if window in first:
                gone[at:at + width] = True
            first.setdefault(window, doc)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out += [(doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] * rows.count((doc, text))
    return sorted(out, key=str)


def check(spark, rows, width):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(5)
    got = sorted((tuple(r) for r in suffix.remove_repeats(docs, width).collect()), key=str)
    assert got == brute(rows, width)


@pytest.mark.parametrize("width", [12, 40, 100])
@pytest.mark.parametrize("batch", [10_000, 3])
def test_small_rows(spark, width, batch, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(width)
    passages = [" ".join(rng.choice(["the", "and", "où", "ß", "lorem", "xy"]) for _ in range(60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300), (5, "a" * 99), (None, passages[0]), (7, passages[0]),
            (7, passages[0]), (8, passages[0][:99]), (9, passages[1] * 3)]
    for i in range(10, 60):
        words = (rng.choice(passages) + " " + str(rng.random()) + " " + rng.choice(passages)).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    check(spark, rows, width)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [text.encode(), (text[:50] + "#" + text[50:]).encode()]
    monkeypatch.setattr(suffix, "PART_BYTES", 170)
    runs = [(rows[t], offsets[t] + s, n) for rows, offsets, parts in suffix._parts(texts, 100)
            for t, s, n, _, _ in zip(*suffix.runs_of(parts, 100))]
    for row, data in enumerate(texts):
        assert sorted(p for r, s, n in runs if r == row for p in range(s, s + n)) == list(range(len(data) - 99))


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op9_suffix(spark, folder).collect()), key=str)
    assert got == brute(rows, 100)
    docs = spark.createDataFrame([], DOCS)
    assert suffix.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("width", [3, 8, 20, 100])
def test_radix_groups(width):
    rng = np.random.default_rng(width)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    data[2000:2600] = data[100:700]
    data[3000:3300] = 97
    begin = np.arange(len(data) - width + 1)
    member, bucket = suffix.radix_groups(data, begin, width)
    groups = {}
    for i in begin.tolist():
        groups.setdefault(data[i:i + width].tobytes(), []).append(i)
    assert sorted(v for v in groups.values() if len(v) > 1) == sorted(sorted(member[bucket == b].tolist()) for b in set(bucket.tolist()))
    assert [data[m:m + width].tobytes() for m in member] == sorted(data[m:m + width].tobytes() for m in member)


def test_hot_passage(spark):
    """One passage in a third of the rows, each time between other words: borders of one anchor everywhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rng = random.Random(4)
    passage = " ".join(rng.choice(["the", "and", "xy", "lorem"]) for _ in range(60))
    rows = [(i, f"{rng.random()} {rng.random()} " + (passage if i % 3 == 0 else str(rng.random())) + f" {rng.random()} {rng.randrange(3)}")
            for i in range(240)]
    check(spark, rows, 100)
    runs = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc long, text binary").selectExpr("doc", "0L text_hash", "text")
    dealt = runs.mapInArrow(suffix._find_runs(100), suffix.RUN).filter("not settled")
    # No anchor brings more than two rows of a batch, or one of each body, to its task.
    assert dealt.groupBy("gram", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * 240 / 20
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
