"""Repeated lines against brute force: filters, hot lines, odd rows, and the way without filters."""

import random

import numpy as np
import pytest

from labelmill.llm import lines

DOCS = "doc_id long, text string, code string, key int, gone string, first long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, "g", 2) for i, t in rows], DOCS)


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least=10):
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(i)
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        kept = [line for line in split if len(key_of(line)) < least or min(holders[key_of(line)], key=rank) == i]
        out.append((i, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def found(spark, rows, **settings):
    got = lines.drop_repeats(docs_of(spark, rows).repartition(5), **settings).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "Hello World, again\n hello world, AGAIN\t\nshort"), (5, "hello world, again\r\n"),
       (6, "ÄÄÄÄÄÄÄÄÄÄ\nääääääääää\nÄÄÄÄÄÄÄÄÄ"), (7, "ÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄ\n\x0bhello world, again\x0c"), (7, "hello world, again\nown line of seven"),
       (None, "hello world, again\nno id at all here"), (None, "no id at all here\nx"), (8, "no id at all here"), (9, "\xa0hello world, again"),
       (10, "twice inside one document\ntwice inside one document"), (11, "hello world, again\nhello world, again\nlast line here"),
       (12, "same row, every bit\nb"), (12, "same row, every bit\nb"), (13, "same row, every bit"), (14, "x" * 500_000), (15, "y\n" + "x" * 500_000),
       (16, "line\x1fof sixteen, unit sign"), (17, "LINE\x1fof sixteen, unit sign"), (18, "\x1fline\x1fof sixteen, unit sign")]


@pytest.mark.parametrize("settings", [{}, {"filter_bytes": 0}, {"segment_bytes": 500}])
def test_odd_rows(spark, settings):
    assert found(spark, ODD, **settings) == brute(ODD)


def test_hot_line_and_random_texts(spark):
    """A line in a third of all rows is salted; many segments and both ways give the rows of brute force."""
    rng = random.Random(5)
    pool = [f"common line number {i} of the pool" for i in range(60)]
    rows = []
    for i in range(3000):
        own = [rng.choice(pool) if rng.random() < 0.3 else f"line {i} {rng.random()}" for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), "The hot line of a third")
        rows.append((i, "\n".join(own)))
    assert found(spark, rows) == brute(rows) == found(spark, rows, filter_bytes=0, segment_bytes=5000)


def test_filters_miss_nothing_and_let_few_through():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64))
    repeated, single = codes[:2000], codes[2000:]
    chunks = [(single[:30_000], repeated[:500]), (repeated[:1500], repeated[1500:1500]), (np.concatenate([single[30_000:], repeated[500:]]), repeated[1500:])]
    twice = lines.seen_twice(chunks)
    assert np.isin(repeated, twice).all() and len(twice) < len(repeated) + 0.02 * len(single)
    parts = [(s, lines.twice_filter(repeated[repeated % np.uint64(7) == s])) for s in range(6)]
    filters = lines.Filters(7, parts)
    inside = repeated % np.uint64(7) != 6
    assert filters.hold(repeated)[inside].all() and not filters.hold(repeated)[~inside].any()
    assert filters.hold(single).mean() < 0.02


def test_empty_table(spark):
    empty = lines.drop_repeats(docs_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_dropped"]
