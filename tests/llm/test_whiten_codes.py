"""Whitening against numpy's eigenvectors; vector codes against plain Lloyd rounds."""

import math

import numpy as np
import pytest

from labelmill.llm import queries, vectorcodes, whiten

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int, x string, ids int, component double"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 0.5) for i, v, label in rows], ROWS)


def random_rows(n, size, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, size))
    return [(i, (base[rng.integers(6)] + 0.3 * rng.standard_normal(size)).astype(np.float32).tolist(), int(rng.integers(4)) if i % 7 else None)
            for i in range(n)]


BROKEN = [(900, None, 1), (901, [math.nan] + [0.0] * 15, 1), (902, [None] + [0.0] * 15, 1), (903, [math.inf] + [0.0] * 15, 2), (904, [1.0], 1), (905, [], 1)]


def ints(rows, scale, shift=0):
    return np.floor(scale * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + shift


# --- whitening ---


def check_whitened(got, x, ids, k=8, repeated=()):
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * min(k, x.shape[1])
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, {})[r.vec_id] = r
    deviation = dict(zip(ids, ((n * x - sums) ** 2).sum(axis=1).tolist()))
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error <= 1e-9 for r in got)
    for c, own in by_component.items():
        assert [r.explained for r in own.values()] == pytest.approx([values[c - 1] / values.sum()] * n, rel=1e-10)
        if c not in repeated:
            mine = np.array([own[i].whitened for i in ids])
            want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            assert np.abs(mine - want * np.sign(mine @ want)).max() < 1e-8


def test_whitened_table(spark):
    table = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = ints([(r.vec_id, r.embedding) for r in table], 1024, 100_000)
    check_whitened(queries.op12_whiten(spark, SF).collect(), x, [r.vec_id for r in table])


def test_whitened_odd_rows(spark):
    rows = random_rows(300, 16)
    got = whiten.whiten(rows_of(spark, rows + BROKEN).repartition(5)).collect()
    check_whitened(got, ints(rows, 1024, 100_000), [r[0] for r in rows])
    flat = [(i, [1.0, float(i % 2), 0.0], 1) for i in range(8)] + [(None, [1.0, 1.0, 0.0], 1)]
    got = whiten.whiten(rows_of(spark, flat)).collect()
    assert len(got) == 27 and all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in got)
    same = whiten.whiten(rows_of(spark, [(1, [0.5, 0.5], 1)] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)
    for empty in ([], BROKEN[:4]):
        assert whiten.whiten(rows_of(spark, empty)).collect() == []
    large = whiten.whiten(rows_of(spark, [(i, [3e9 * i, 1.0], 1) for i in range(1, 4)])).collect()
    assert {r.deviation for r in large if r.vec_id != 2} == {None} and all(r.identity_error < 1e-9 for r in large)


def product_of(x):
    return lambda p, w: (x.T @ (x @ p), (x @ w).T @ (x @ p), float((x @ p) @ (x @ p)))


@pytest.mark.parametrize("values", [[9, 9, 9, 4, 4, 1, 1, 1, 0, 0, 0, 0], [5] * 12, [1e6, 1e3, 1, 1e-3] + [1e-4] * 8, list(range(12, 0, -1)), [3] + [0] * 11])
def test_bidiagonal_values_with_repeats(values):
    rng = np.random.default_rng(2)
    x = np.linalg.qr(rng.standard_normal((50, 12)))[0] * values @ np.linalg.qr(rng.standard_normal((12, 12)))[0]
    right, found, steps = whiten.bidiagonalise(product_of(x), 12, float((x ** 2).sum()), 6)
    assert found == pytest.approx(sorted(values)[::-1][:6], rel=1e-9, abs=1e-7 * max(values)) and steps <= 12
    assert np.abs(right.T @ right - np.eye(6)).max() < 1e-12
    assert np.abs(np.linalg.norm(x @ right, axis=0) - found).max() < 1e-7 * max(values)


def test_bidiagonal_stops_when_nothing_larger_can_be_left():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)) * [100, 90, 80, 70, 60, 50, 40, 30] @ rng.standard_normal((8, 60)) + 1e-3 * rng.standard_normal((400, 60))
    right, found, steps = whiten.bidiagonalise(product_of(x), 60, float((x ** 2).sum()), 8)
    assert steps < 20 and found == pytest.approx(np.linalg.svd(x)[1][:8], rel=1e-12)


# --- codes ---


def plain_lloyd(v, parts=8, entries=16, rounds=6):
    books, codes, error = [], [], 0
    edges = [i * v.shape[1] // parts for i in range(parts + 1)]
    for a, b in zip(edges, edges[1:]):
        x = v[:, a:b]
        book = x[:entries].copy()
        nearest = lambda: ((x[:, None] - book[None]) ** 2).sum(axis=2)  # noqa: E731,B023
        for _ in range(rounds):
            code = nearest().argmin(axis=1)
            for e in range(len(book)):
                if (code == e).any():
                    book[e] = x[code == e].sum(axis=0) // (code == e).sum()
        d = nearest()
        codes.append(d.argmin(axis=1))
        error = error + d.min(axis=1)
        books.append(book)
    return np.stack(codes, axis=1), error, books


def check_codes(spark, rows, kept, **settings):
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, error, books = plain_lloyd(ints(kept, 4096), **settings)
    coded, found = vectorcodes.compress(rows_of(spark, rows).repartition(5), **settings)
    assert all((a == b).all() for a, b in zip(found, books))
    none = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(((r.vec_id, r.label, r.codes, r.error) for r in coded.collect()), key=none)
    want = sorted(((r[0], r[2], c, e) for r, c, e in zip(kept, codes.tolist(), error.tolist())), key=none)
    assert got == want


def test_codes_on_odd_rows(spark):
    rows = random_rows(700, 16)
    check_codes(spark, rows + BROKEN, rows)
    check_codes(spark, rows, rows, parts=3, entries=20, rounds=3)
    ties = [(i, [float(i % 3)] * 16, 1) for i in range(200)] + [(None, [1.5] * 16, None), (5, [2.0] * 16, 2)]
    check_codes(spark, ties, ties)
    check_codes(spark, rows[:5], rows[:5])
    coded, books = vectorcodes.compress(rows_of(spark, []))
    assert coded.count() == 0 and all(len(b) == 0 for b in books)
    coded, _ = vectorcodes.compress(rows_of(spark, rows).drop("label"))
    assert coded.filter("label is null").count() == len(rows)


@pytest.mark.parametrize("kind", ["clusters", "same", "line", "one"])
def test_cover_tree_covers_and_separates(kind):
    rng = np.random.default_rng(1)
    points = {"clusters": rng.integers(0, 5, (900, 4)) * 1000 + rng.integers(0, 40, (900, 4)), "same": np.ones((500, 4), dtype=np.int64),
              "line": np.arange(400)[:, None] * np.ones((1, 4), dtype=np.int64), "one": np.ones((1, 4), dtype=np.int64)}[kind]
    tree = vectorcodes.CoverTree(points)
    assert (np.sort(tree.order) == np.arange(len(points))).all() and (tree.points == points[tree.order]).all()
    for node in range(len(tree.start)):
        own = tree.points[tree.start[node]:tree.end[node]]
        away = np.sqrt(((own - tree.centres[node]) ** 2).sum(axis=1))
        assert away.min() == 0 and away.max() == pytest.approx(tree.radius[node])
        kids = slice(tree.first[node], tree.first[node] + tree.children[node])
        if tree.children[node]:
            centres = tree.centres[kids]
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + 1e18 * np.eye(len(centres))
            assert gaps.min() > tree.radius[node] / 2 >= tree.radius[kids].max()
            assert tree.start[kids][0] == tree.start[node] and tree.end[kids][-1] == tree.end[node]
    book = points[rng.integers(0, len(points), 6)] + rng.integers(-9, 9, (6, 4))
    nearest = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    codes, error = tree.codes(book)
    assert (codes == nearest.argmin(axis=1)).all() and (error == nearest.min(axis=1)).all()
    count, total = tree.sums(book)
    assert (count == np.bincount(codes, minlength=6)).all()
    assert all((total[e] == points[codes == e].sum(axis=0)).all() for e in range(6))


def test_most_points_are_assigned_in_subtrees():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = np.repeat(centres, 500, axis=0) + rng.integers(-50, 50, (8000, 8))
    tree = vectorcodes.CoverTree(points)
    *_, places, _ = tree.assign(centres)
    assert len(places) < 0.02 * len(points)
