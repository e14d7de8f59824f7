"""The spanning tree over a kd-tree against the plain one, on ties and duplicates."""

import numpy as np
import pytest

from strandlake.operators import density


def made(kind: str, n: int = 700):
    rng = np.random.default_rng(4)
    if kind == "grid":  # all distances tie
        return np.stack(np.meshgrid(np.arange(28), np.arange(25)), -1).reshape(-1, 2)[:n].astype(float)
    if kind == "copies":
        return np.repeat(rng.integers(0, 30, (n // 20, 2)).astype(float), 20, axis=0)
    if kind == "apart":
        return np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.normal(200, 1, (n - n // 2, 3))])
    return rng.normal(size=(n, 2)).round(1)


@pytest.mark.parametrize("kind", ["grid", "copies", "apart", "rounded"])
def test_tree_has_the_weights_and_labels_of_the_plain_one(spark, monkeypatch, kind):
    x, k = made(kind), 5
    core = np.sort(np.sqrt(sum((x[:, c][:, None] - x[None, :, c]) ** 2 for c in range(x.shape[1]))), axis=1)[:, k - 1]
    plain, spread = density._spanning_tree(x, core), density.spread_spanning_tree(spark, x, k)
    assert len(spread) == len(x) - 1
    assert (plain == spread).all()
    monkeypatch.setattr(density, "SPREAD_FROM", 10)
    labels, strength = density.hdbscan_fit(x, 15, k, spark=spark)
    monkeypatch.setattr(density, "SPREAD_FROM", 10**9)
    want, power = density.hdbscan_fit(x, 15, k)
    assert (labels == want).all() and (strength == power).all()


def test_core_distances_and_gaps_are_exact():
    x = made("rounded")
    leaves = density.Leaves(x, 16)
    d = np.sqrt(sum((x[:, c][:, None] - x[None, :, c]) ** 2 for c in range(2)))
    for k in (1, 4, 40):
        got = np.concatenate([leaves.cores(i, k) for i in range(len(leaves))])
        assert (got == np.sort(d, axis=1)[leaves.order, k - 1]).all()
    for i in range(0, len(leaves), 7):
        at = leaves.members(np.arange(len(leaves)))
        nearest = np.minimum.reduceat(leaves.distances(i, at).min(axis=0), leaves.starts[:-1])
        assert (leaves.gaps(i) <= nearest).all()
