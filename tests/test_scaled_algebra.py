"""The table-based SVD against numpy, and forest neighbours against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import dense, neighbours


def sparse(seed, shape, density=0.2):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape) * (rng.random(shape) < density)
    a[:, 3] = 0  # a column without entries
    return a


@pytest.mark.parametrize("drop", [0, 1])
def test_block_svd_equals_numpy(spark, monkeypatch, drop):
    a = sparse(2, (90, 40)) * np.linspace(3, 0.2, 40) ** 3
    coo = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col_idx int, value double")
    monkeypatch.setattr(dense, "BASIS_BYTES", 0)
    from strandlake.operators import blocksvd

    monkeypatch.setattr(blocksvd, "ENTRIES", 200)
    pcs, info = dense.truncated_svd(coo, 40, 90, components=6, oversamples=10, rounds=12, drop_first=drop)
    s = np.linalg.svd(a, compute_uv=False)[drop:6]
    assert np.allclose(info["singular_values"], s, rtol=1e-8)
    assert np.allclose(info["energy_ratio"], s**2 / (a**2).sum(), rtol=1e-8)
    parts = np.zeros((40, 6 - drop))
    for r in info["components"].collect():
        parts[r["col"]] = r["v"]
    assert np.allclose(parts.T @ parts, np.eye(6 - drop), atol=1e-8)
    assert (parts[np.abs(parts).argmax(axis=0), np.arange(6 - drop)] > 0).all()
    rows = {r["row"]: r["pcs"] for r in pcs.collect()}
    assert len(rows) == (a != 0).any(axis=1).sum() and all(np.allclose(v, a[i] @ parts, atol=1e-9) for i, v in rows.items())


def test_orthonormal_survives_a_bad_condition(spark):
    from strandlake.operators import blocksvd

    rng = np.random.default_rng(3)
    bad = rng.normal(size=(60, 8)) @ np.diag(10.0 ** -np.arange(8)) @ rng.normal(size=(8, 8))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(bad.tolist())], "col int, v array<double>")
    parts = blocksvd.Parts(spark.createDataFrame([(0, [0], [1.0])], "row long, cols array<int>, vals array<double>"), 1, "row")
    q = np.array([r["v"] for r in blocksvd.orthonormal(parts, table).orderBy("col").collect()])
    parts.close()
    assert np.allclose(q.T @ q, np.eye(8), atol=1e-10)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_forest_finds_near_all(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 3 * rng.integers(0, 3, (3000, 1))
    x[100:160] = x[100]  # copies
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    found, recall = neighbours.forest_neighbours(table, 10, metric, leaf=128)
    assert recall >= 0.95
    exact = dense.nearest_neighbours(table, 10, metric).groupBy("id").agg(F.max("distance").alias("limit"))
    got = found.join(exact, "id")
    assert got.where("distance <= limit + 1e-9").count() >= 0.93 * 10 * 3000
    assert found.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("neighbour").alias("d")).where("n <> 10 OR d <> 10").count() == 0
    assert found.where("id = neighbour").count() == 0
    row = found.where("id = 7 AND rank = 0").first()
    d = 1 - x[7] @ x[row["neighbour"]] / np.linalg.norm(x[7]) / np.linalg.norm(x[row["neighbour"]]) if metric == "cosine" else np.linalg.norm(x[7] - x[row["neighbour"]])
    assert abs(d - row["distance"]) < 1e-9


def test_forest_of_few_and_equal_vectors(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    found, recall = neighbours.forest_neighbours(few, 3)
    assert recall == 1.0 and found.count() == 15
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(700)], "id long, vector array<double>")
    found, recall = neighbours.forest_neighbours(same, 3, "euclidean", leaf=64)
    assert recall == 1.0 and found.where("distance > 0").count() == 0 and found.count() == 2100
