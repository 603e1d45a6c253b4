"""Nearest neighbours against all distances: clusters, outliers, copies and ties, over many cells and blocks."""

import math

import numpy as np
import pytest
from strandframe.operators import learning, nearest


def points(n=3000):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 8)) * 4
    x = np.concatenate([middle[rng.integers(0, 12, n - 160)] + rng.normal(size=(n - 160, 8)) * 0.5, rng.normal(size=(40, 8)) * 60, np.repeat(rng.normal(size=(2, 8)), 60, axis=0)])
    return x.round(6)


def truth(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i, int(j), r + 1): d[i, j] for i, row in enumerate(best) for r, j in enumerate(row)}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize(("block", "asking"), [(2048, 4096), (64, 100)])
def test_exact_neighbours_of_every_row(spark, monkeypatch, block, asking):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "ASKING", asking)
    x = points()
    out = nearest.nearest_neighbours(frame(spark, x), "id", 7, features="v").collect()
    got, want = {(r.src, r.dst, r["rank"]): r.distance for r in out}, truth(x, 7)
    assert len(got) == len(out) and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_recall_with_few_probes(spark):
    x = points()
    out = nearest.nearest_neighbours(frame(spark, x), "id", 7, features="v", probes=4).collect()
    want = {(a, b) for a, b, _ in truth(x, 7)}
    counts = np.bincount([r.src for r in out], minlength=len(x))
    assert (counts == 7).all() and sum((r.src, r.dst) in want for r in out) >= 0.95 * len(want)


def test_few_rows_nulls_and_vectors(spark):
    df = learning.with_vector(frame(spark, points()[:5]), "v")
    assert nearest.nearest_neighbours(df, "id", 15).count() == 20
    assert nearest.nearest_neighbours(df.where("id < 1"), "id").count() == 0 and nearest.nearest_neighbours(df.where("id < 0"), "id").count() == 0
    holes = df.selectExpr("id", "if(id = 2, null, v) AS v", "string(id) AS name")
    out = nearest.nearest_neighbours(holes, "name", 3, features="v").collect()
    assert len(out) == 12 and "2" not in {r.src for r in out} | {r.dst for r in out}


def test_neighbours_are_true_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    at = dict(rows)
    out = nearest.nearest_neighbours(learning.with_vector(spark.createDataFrame(rows, "id int, v array<double>"), "v"), "id", 3).collect()
    want = {i: set(sorted((j for j in at if j != i), key=lambda j: math.dist(at[i], at[j]))[:3]) for i in at}
    assert len(out) == 180 and all(r.dst in want[r.src] for r in out)
    assert all(abs(r.distance - math.dist(at[r.src], at[r.dst])) < 1e-9 for r in out)


def test_only_rows_within_the_limit_come_back():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + 1e4  # lengths beside which single precision loses the distances
    a, b = x[:300], x[300:]
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    limit = np.sort(d, axis=1)[:, 3]
    got = nearest._nearest(np.arange(300), a, np.arange(300, 900), b, 7, limit)
    assert set(zip(got["src"], got["dst"])) == {(i, j + 300) for i, j in zip(*np.nonzero(d <= limit[:, None]))} and len(got) == 1200
    assert (got["distance"].to_numpy() == d[got["src"], got["dst"] - 300]).all()
