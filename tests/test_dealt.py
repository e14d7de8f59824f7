"""Values dealt anew by groups of blocks against the same deals as rows; and what they leave on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import dealt, novelty


def _bins(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(f"b{i:04d}", int(c), None if a == 5 else f"a{a}", None if p == 6 else f"p{p}", int(s)) for i, (c, a, p, s) in enumerate(zip(rng.choice(4, n, p=[0.7, 0.2, 0.08, 0.02]), rng.integers(0, 6, n), rng.integers(0, 7, n), rng.integers(-200, 400, n)))]
    return spark.createDataFrame(rows, "bin_uid string, cluster int, assembly string, chrom string, start long")


def _as_rows(bins, block, permutations, seed):
    moved = novelty.shuffled_within(bins, block, "chrom", permutations, seed)
    per = moved.groupBy("perm", "cluster", "assembly").agg(F.countDistinct("chrom").alias("k")).groupBy("perm", "cluster")
    return {tuple(r) for r in per.agg(F.sum("k"), F.sum((F.col("k") >= 2).cast("long"))).collect()}


@pytest.mark.parametrize("held", [1 << 24, 300, 60])
def test_deals_of_groups_are_those_of_rows(spark, monkeypatch, held):
    """Repeated numbers, missing names and values; blocks held together, alone, and cut by ranges of keys."""
    monkeypatch.setattr(dealt, "HELD_ROWS", held)
    monkeypatch.setattr(dealt, "UNIT_ROWS", 500)
    monkeypatch.setattr(dealt, "FILE_ROWS", 100)
    monkeypatch.setattr(dealt, "TASK_ROWS", 50)
    bins = _bins(spark)
    runs = dealt.sorted_runs(bins, ["cluster", "assembly", "chrom"], parts=5)
    assert runs.count() > 3 and runs.agg(F.sum("n")).first()[0] == 400
    for block, other in (("assembly", "cluster"), ("cluster", "assembly")):
        got = {tuple(r) for r in dealt.spread_of_deals(runs, block, other, "chrom", "cluster", 3, 21).collect()}
        assert got == _as_rows(bins, block, 3, 21)


def test_pairs_by_table_and_by_sorting(monkeypatch):
    rng = np.random.default_rng(2)
    cell, values = rng.integers(0, 30, 1000).astype(np.uint8), rng.integers(0, 9, 1000).astype(np.uint8)
    table = dealt._met(cell, 30, values, 9)
    monkeypatch.setattr(dealt, "SEEN_ENTRIES", 0)
    assert all((a == b).all() for a, b in zip(table, dealt._met(cell, 30, values, 9)))


@pytest.mark.parametrize("blocks", [1, 3])
def test_equal_numbers_and_equal_bits(blocks):
    """Equal numbers follow by place, equal bits of two keys by whole keys."""
    keys = np.array([9, 9, 9, 5, 5, 2, 8, 9, 4, 1 << 63], dtype=np.uint64)
    blk, val = np.arange(10) % blocks if blocks > 1 else None, np.array([3, 0, 2, 1, 0, 3, 1, 2, 0, 1], dtype=np.uint8)
    for spread in (1, 1 << 50):
        z = keys * np.uint64(spread)
        places = dealt._ties(np.sort(z), blk)
        own = [(k, b, v) for k, b, v in zip(z.tolist(), blk.tolist() if blk is not None else [0] * 10, val.tolist())]
        order = sorted(range(10), key=lambda i: (own[i][1], own[i][0], i))
        seen = {}
        place = np.array([seen.setdefault(o[:2], []).append(0) or len(seen[o[:2]]) - 1 for o in own])
        got = dealt._by_key(lambda: [(z, blk, val, place)], 10, blocks, 4, int(place.max()))  # noqa: B023
        assert got.tolist() == [own[i][2] for i in order] and places is not None


def test_shuffles_do_not_grow_with_the_permutations(spark):
    bins = _bins(spark, 20_000).cache()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    def of(permutations):
        before = written()
        assert novelty.sharing_null(bins, permutations).count() == 4
        return written() - before

    few, many = of(2), of(20)
    assert few > 0 and many < 1.5 * few


def test_sharing_is_held_against_a_hundred_deals(spark, data_dir):
    """The share of deals that reach what is seen goes in steps of 1 / 101."""
    import __spark_entry__ as entry

    p = [r.free_p for r in entry.queries()["sharing_null"](spark, data_dir).collect()]
    assert min(p) < 1 and all(abs(x * 101 - round(x * 101)) < 1e-3 for x in p)
