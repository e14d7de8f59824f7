"""Compositions of clusters by unit: transforms, distances, group tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_minimum_down, running_sum


def abundance(bins: DataFrame, unit: str) -> DataFrame:
    """unit, cluster, n (noise aside)."""
    return bins.where("cluster >= 0").groupBy(unit, "cluster").agg(F.count(F.lit(1)).alias("n"))


def clr(counts: DataFrame, unit: str, floor: float = 0.25, pseudo: float = 0.5) -> DataFrame:
    """unit, cluster, value: centred log-ratios over clusters that at least ``floor`` of the units have (all, if none)."""
    units = counts.select(unit).distinct()
    total = units.agg(F.count(F.lit(1)).alias("units"))
    common = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(total))
    kept = common.withColumn("ok", F.col("k") / F.col("units") >= floor).withColumn("any", F.max("ok").over(Window.partitionBy())).where("ok OR NOT any").select("cluster")
    # the grid of units and kept clusters is the composition itself
    grid = units.join(F.broadcast(kept)).join(counts, [unit, "cluster"], "left").withColumn("x", F.coalesce("n", F.lit(0)) + pseudo)
    logs = grid.withColumn("l", F.log("x"))
    means = logs.groupBy(unit).agg(F.avg("l").alias("m"))
    return logs.join(means, unit).select(unit, "cluster", (F.col("l") - F.col("m")).alias("value"))


def aitchison(values: DataFrame, unit: str) -> DataFrame:
    """a, b, distance for a < b: Euclidean distance of centred log-ratios."""
    x, y = values.toDF("a", "cluster", "x"), values.toDF("b", "cluster", "y")
    joined = x.join(y, "cluster").where("a < b")
    return joined.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))


def bray_curtis(counts: DataFrame, unit: str) -> DataFrame:
    """a, b, distance: 1 - the shared proportion (which needs the clusters that both have only)."""
    totals = counts.groupBy(unit).agg(F.sum("n").alias("t"))
    shares = counts.join(totals, unit).select(unit, "cluster", (F.col("n") / F.col("t")).alias("p"))
    units = counts.select(unit).distinct()
    pairs = units.select(F.col(unit).alias("a")).join(units.select(F.col(unit).alias("b")), F.col("a") < F.col("b"))
    x, y = shares.toDF("a", "cluster", "p"), shares.toDF("b", "cluster", "q")
    both = x.join(y, "cluster").where("a < b").groupBy("a", "b").agg(F.sum(F.least("p", "q")).alias("shared"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("shared", F.lit(0.0))).alias("distance"))


def pseudo_f(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """f, r2: PERMANOVA's statistic from pair distances (a, b, distance) and groups (unit, grp)."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    shape = sizes.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    ga, gb = groups.toDF("a", "ga"), groups.toDF("b", "gb")
    paired = distances.join(ga, "a").join(gb, "b").withColumn("sq", F.col("distance") ** 2)
    within = paired.where("ga = gb").join(sizes, F.col("ga") == F.col("grp")).agg(F.sum(F.col("sq") / F.col("m")).alias("ssw"))
    total = paired.agg(F.sum("sq").alias("sq")).join(F.broadcast(shape)).join(F.broadcast(within))
    sst, ssw = F.col("sq") / F.col("n"), F.col("ssw")
    return total.select((((sst - ssw) / (F.col("k") - 1)) / (ssw / (F.col("n") - F.col("k")))).alias("f"), ((sst - ssw) / sst).alias("r2"))


def anova_f(values: DataFrame, groups: DataFrame, unit: str, column: str = "cluster", value: str = "value") -> DataFrame:
    """column, f, eta2: one-way analysis of variance for each column."""
    joined = values.join(groups, unit)
    by_group = joined.groupBy(column, "grp").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("m"), F.sum(F.col(value) * F.col(value)).alias("q"))
    sums = by_group.groupBy(column).agg(F.sum("s").alias("s"), F.sum("m").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"), F.count(F.lit(1)).alias("k"))
    base = F.col("s") * F.col("s") / F.col("n")
    between, total = F.col("b") - base, F.col("q") - base
    return sums.select(column, ((between / (F.col("k") - 1)) / ((total - between) / (F.col("n") - F.col("k")))).alias("f"), (between / total).alias("eta2"))


def benjamini_hochberg(tests: DataFrame, key: str, p: str = "p") -> DataFrame:
    """key, p, q: the smallest p * m / rank at or above each rank, at most 1.

    Equal p have one q, that of their highest rank: only distinct p are ordered, by ranges.
    """
    size = tests.agg(F.count(F.lit(1)).alias("m"))
    distinct = tests.groupBy(p).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(distinct, p, "n", "rank").join(F.broadcast(size)).select(p, (F.col(p) * F.col("m") / F.col("rank")).alias("raw"))
    least = running_minimum_down(ranked, p, "raw", "least").select(p, F.least(F.lit(1.0), "least").alias("q"))
    return tests.select(key, p).join(least, p).select(key, p, "q")


def both_ways(distances: DataFrame) -> DataFrame:
    return distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """a, b, rank (0-based): the k nearest of each unit; ties by name."""
    order = Window.partitionBy("a").orderBy("distance", "b")
    return both_ways(distances).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("a", "b", "rank")


def knn_accuracy(distances: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """a, grp, predicted: the vote of the k nearest, of which nearer ones weigh a little more."""
    votes = nearest(distances, k).join(groups.toDF("b", "vote"), "b").groupBy("a", "vote").agg(F.sum(1 + 1e-6 * (k - F.col("rank"))).alias("w"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "vote"))).where("r = 1")
    return best.join(groups.toDF("a", "grp"), "a").select("a", "grp", F.col("vote").alias("predicted"))


def silhouette(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """a, silhouette: (other - own) / the larger; 0 in a group of one."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    joined = both_ways(distances).join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b")
    means = joined.groupBy("a", "ga", "gb").agg(F.avg("distance").alias("d"))
    out = means.groupBy("a", "ga").agg(F.max(F.when(F.col("ga") == F.col("gb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ga") != F.col("gb"), F.col("d"))).alias("other"))
    full = out.join(sizes, F.col("ga") == F.col("grp"))
    return full.select("a", F.when(F.col("m") <= 1, 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other")).alias("silhouette"))


def relation_means(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """relation, n, mean: distances within and between groups."""
    joined = distances.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b")
    return joined.groupBy(F.when(F.col("ga") == F.col("gb"), "same").otherwise("other").alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"))
