"""Group tests over units with permutation nulls: shuffled labels, PERMANOVA, dispersion, per-column tests, controls.

A permutation orders blocks (donors) by a mixed hash of (seed, permutation, block) and
deals them the labels in their own order, so every run gives the same null, each
permutation is a group of rows of its own, and nothing is gathered in one place.
Permutation 0 is the observation.  A null value counts as at least the observed one
also if it is smaller by rounding alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix64, unsigned_key, wrapping
from ..functions.names import is_satellite
from ..tables import materialised
from .population import benjamini_hochberg, both_ways
from .ranking import modal

ROUNDING = 1e-9


def units(bins: DataFrame, donors: DataFrame, level: str = "unit") -> tuple[DataFrame, DataFrame]:
    """Counts (unit, cluster, n) and groups (unit, block, grp) of labelled units: each assembly by itself, or the
    assemblies of a donor summed (``level`` 'block').  ``donors``: unit, block, grp; units without a group are left out."""
    labelled = donors.where(F.trim(F.coalesce(F.col("grp").cast("string"), F.lit(""))) != "")
    counts = bins.where("cluster >= 0").join(labelled.withColumnRenamed("unit", "assembly"), "assembly")
    name = F.col("block").cast("string") if level == "block" else F.col("assembly")
    groups = labelled if level != "block" else labelled.groupBy("block").agg(F.min("grp").alias("grp")).select(F.col("block").cast("string").alias("unit"), "block", "grp")
    return counts.groupBy(name.alias("unit"), "cluster").agg(F.count(F.lit(1)).alias("n")), groups


def drop_small_groups(groups: DataFrame, least: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """The units of groups with ``least`` units or more."""
    sizes = groups.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    return groups.join(sizes.drop("m"), [*keys, "grp"], "left_semi").select(groups.columns)


def permuted_labels(groups: DataFrame, permutations: int, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, perm, unit, grp: labels shuffled between blocks and copied to every unit of a block; perm 0 as they are."""
    blocks = groups.groupBy(*keys, "block").agg(F.min("grp").alias("grp"))
    coded = blocks.withColumn("code", F.row_number().over(Window.partitionBy(*keys).orderBy("block")).cast("long") - 1)
    with wrapping(groups.sparkSession):
        spread = coded.select(*keys, "block", "code", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(permutations).cast("long"))).alias("perm"))
        order = unsigned_key(mix64(F.lit(seed).cast("long").bitwiseXOR(F.col("perm") * 1_000_003 + F.col("code"))))
        placed = spread.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "perm").orderBy(order, "code")).cast("long") - 1)
    dealt = placed.select(*keys, "perm", "block", F.col("place").alias("code")).join(coded.select(*keys, "code", "grp"), [*keys, "code"])
    labels = dealt.select(*keys, "perm", "block", "grp").unionByName(coded.select(*keys, F.lit(0).cast("long").alias("perm"), "block", "grp"))
    return groups.select(*keys, "unit", "block").join(labels, [*keys, "block"]).select(*keys, "perm", "unit", "grp")


def empirical(values: DataFrame, statistic: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, observed, p = (1 + nulls at least as large) / (1 + permutations), null_mean, null_sd, null_p95."""
    seen = values.where("perm = 0").select(*keys, F.col(statistic).alias("observed"))
    null = values.where("perm > 0").select(*keys, F.col(statistic).alias("null"))
    joined = null.join(seen, list(keys)) if keys else null.join(F.broadcast(seen))
    reached = F.col("null") >= F.col("observed") - ROUNDING * F.abs("observed")
    return joined.groupBy(*keys, "observed").agg(((1 + F.sum(reached.cast("int"))) / (1 + F.count(F.lit(1)))).alias("p"), F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_sd"), F.percentile("null", 0.95).alias("null_p95"))


def _matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.join(F.broadcast(right))


#: Pairs of the largest cohort whose distance matrix is sent to every task (32 MB), and permutations that a task takes at once.
SHARED_PAIRS, CHUNK = 4_000_000, 64


def _pseudo_f_shared(pairs: DataFrame, labels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``pseudo_f_by`` over one distance matrix, which every task has: a labelling is a few products of it."""
    import numpy as np

    table = pairs.select("a", "b", (F.col("distance") ** 2).alias("sq")).toPandas()
    units = sorted({*table["a"], *table["b"]})
    place = {u: i for i, u in enumerate(units)}
    matrix = np.zeros((len(units) + 1, len(units) + 1))  # the last one: a unit without distances
    a, b = table["a"].map(place).to_numpy(dtype=int), table["b"].map(place).to_numpy(dtype=int)
    matrix[a, b] = matrix[b, a] = table["sq"].to_numpy(dtype=float)
    shared = pairs.sparkSession.sparkContext.broadcast((place, matrix))
    columns = [*keys, "perm", "f", "r2", "n", "k"]

    def fit(pdf):
        import pandas as pd

        place, matrix = shared.value
        made = []
        for perm, own in pdf.groupby("perm", sort=False):
            at = own["unit"].map(lambda u: place.get(u, len(place))).to_numpy()
            grp, names = pd.factorize(own["grp"])
            n, k = len(own), len(names)
            d = matrix[np.ix_(at, at)]
            held = np.zeros((n, k))
            held[np.arange(n), grp] = 1
            within = float((((d @ held) * held).sum(axis=0) / 2 / held.sum(axis=0)).sum())
            total = float(d.sum()) / 2 / n
            usable = within > 0 and n > k > 1
            made.append((*own[list(keys)].iloc[0], perm, ((total - within) / (k - 1)) / (within / (n - k)) if usable else None, (total - within) / total if usable else None, n, k))
        return pd.DataFrame(made, columns=columns)

    kinds = ", ".join(f"`{c}` {labels.schema[c].dataType.simpleString()}" for c in (*keys, "perm"))
    chunked = labels.withColumn("__chunk", F.floor(F.col("perm") / CHUNK))
    return chunked.groupBy(*keys, "__chunk").applyInPandas(lambda pdf: fit(pdf), f"{kinds}, f double, r2 double, n long, k long")


def pseudo_f_by(pairs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, perm, f, r2, n, k: PERMANOVA's statistic of each labelling of the pair distances (keys, a, b, distance).

    ``pairs`` without the keys are distances that all keys share, each of its own units.
    While they are at most ``SHARED_PAIRS``, tasks take them from one matrix; else they are joined.
    """
    k = list(keys)
    if not set(keys) & set(pairs.columns):
        if pairs.count() <= SHARED_PAIRS:
            return _pseudo_f_shared(pairs, labels, keys)
        if keys:
            own = labels.where("perm = 0")
            pairs = pairs.join(own.select(*k, F.col("unit").alias("a")), "a").join(own.select(*k, F.col("unit").alias("b")), [*k, "b"])
    sizes = labels.groupBy(*k, "perm", "grp").agg(F.count(F.lit(1)).alias("m"))
    shape = sizes.groupBy(*k, "perm").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    squared = pairs.select(*k, "a", "b", (F.col("distance") ** 2).alias("sq"))
    total = squared.groupBy(*k).agg(F.sum("sq").alias("all"))
    left = labels.select(*k, "perm", "grp", F.col("unit").alias("a"))
    right = labels.select(*k, "perm", "grp", F.col("unit").alias("b"))
    within = squared.join(left, [*k, "a"]).join(right, [*k, "b", "perm", "grp"]).join(sizes, [*k, "perm", "grp"]).groupBy(*k, "perm").agg(F.sum(F.col("sq") / F.col("m")).alias("ssw"))
    joined = _matching(shape.join(within, [*k, "perm"]), total, k).withColumn("sst", F.col("all") / F.col("n"))
    between = F.col("sst") - F.col("ssw")
    usable = (F.col("ssw") > 0) & (F.col("n") > F.col("k"))
    f = F.when(usable, (between / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
    return joined.select(*k, "perm", f.alias("f"), F.when(usable, between / F.col("sst")).alias("r2"), "n", "k")


def permanova(pairs: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, f, r2, p, r2_null_mean, r2_null_p95, r2_excess, n_units, n_groups: labels shuffled between blocks."""
    k = list(keys)
    found = materialised(pseudo_f_by(pairs, permuted_labels(groups, permutations, seed, keys), keys))
    p = empirical(found, "f", keys).select(*k, F.col("observed").alias("f"), "p")
    r2 = empirical(found, "r2", keys).select(*k, F.col("observed").alias("r2"), F.col("null_mean").alias("r2_null_mean"), F.col("null_p95").alias("r2_null_p95"))
    shape = found.where("perm = 0").select(*k, F.col("n").alias("n_units"), F.col("k").alias("n_groups"))
    return _matching(_matching(p, r2, k), shape, k).withColumn("r2_excess", F.col("r2") - F.col("r2_null_mean"))


def anova_by(values: DataFrame, labels: DataFrame, column: str = "cluster") -> DataFrame:
    """perm, column, f, eta2: one-way analysis of variance of ``values`` (unit, column, value) for each labelling."""
    by_group = values.join(labels, "unit").groupBy("perm", column, "grp").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("m"))
    between = by_group.groupBy("perm", column).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"), F.count(F.lit(1)).alias("k"))
    # deviations from the mean, so that large values lose nothing
    means = values.groupBy(column).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    total = values.join(means, column).groupBy(column, "n", "mean").agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("sst"))
    ssb = F.col("b") - F.col("n") * F.col("mean") * F.col("mean")
    joined = between.join(total, column).withColumn("ssb", ssb).withColumn("ssw", F.greatest(F.col("sst") - F.col("ssb"), F.lit(0.0)))
    f = (F.col("ssb") / (F.col("k") - 1)) / F.greatest(F.col("ssw") / (F.col("n") - F.col("k")), F.lit(1e-300))
    return joined.select("perm", column, f.alias("f"), F.when(F.col("sst") > 0, F.col("ssb") / F.col("sst")).otherwise(0.0).alias("eta2"))


def column_tests(values: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 7, column: str = "cluster") -> DataFrame:
    """column, f, eta2, p_perm, p_fwer (against each permutation's largest f), q_bh."""
    found = materialised(anova_by(values, permuted_labels(groups, permutations, seed), column))
    p = empirical(found, "f", (column,)).select(column, F.col("observed").alias("f"), F.col("p").alias("p_perm"))
    tops = found.where("perm > 0").groupBy("perm").agg(F.max("f").alias("top"))  # a row a permutation
    reached = p.join(F.broadcast(tops), F.col("top") >= F.col("f") - ROUNDING * F.abs("f"), "left").groupBy(column).agg(F.count("top").alias("reached"))
    tested = p.join(reached, column).withColumn("p_fwer", (1 + F.col("reached")) / F.lit(permutations + 1)).drop("reached")
    tested = tested.join(found.where("perm = 0").select(column, "eta2"), column)
    return tested.join(benjamini_hochberg(p, column, "p_perm").select(column, F.col("q").alias("q_bh")), column)


def contrast(values: DataFrame, groups: DataFrame, inside: DataFrame, permutations: int = 999, seed: int = 7, column: str = "cluster") -> DataFrame:
    """mean_eta2_in, mean_eta2_out, difference, null_mean, null_sd, z, p: do the columns of ``inside`` (column) carry more
    group signal than the rest?  Columns stay, labels are shuffled."""
    found = anova_by(values, permuted_labels(groups, permutations, seed), column).join(inside.select(column).distinct().withColumn("in", F.lit(True)), column, "left")
    means = materialised(found.groupBy("perm").agg(F.avg(F.when(F.col("in"), F.col("eta2"))).alias("mean_eta2_in"), F.avg(F.when(F.col("in").isNull(), F.col("eta2"))).alias("mean_eta2_out")).withColumn("difference", F.col("mean_eta2_in") - F.col("mean_eta2_out")))
    null = empirical(means, "difference")
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return means.where("perm = 0").drop("perm").join(F.broadcast(null)).select("mean_eta2_in", "mean_eta2_out", "difference", "null_mean", "null_sd", z.alias("z"), "p")


def dispersion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """perm, unit, grp, spread: each unit's distance from the centre of its group, from Euclidean pair distances alone.

    The squared distance is the mean squared distance to the group's units less half the mean over all its pairs.
    """
    sizes = labels.groupBy("perm", "grp").agg(F.count(F.lit(1)).alias("m"))
    squared = both_ways(pairs).select("a", "b", (F.col("distance") ** 2).alias("sq"))
    left, right = labels.select("perm", "grp", F.col("unit").alias("a")), labels.select("perm", "grp", F.col("unit").alias("b"))
    met = squared.join(left, "a").join(right, ["b", "perm", "grp"]).groupBy("perm", "grp", "a").agg(F.sum("sq").alias("sq"))
    own = left.join(sizes, ["perm", "grp"]).join(met, ["perm", "grp", "a"], "left").withColumn("mean", F.coalesce("sq", F.lit(0.0)) / F.col("m"))
    centres = own.groupBy("perm", "grp").agg((F.avg("mean") / 2).alias("half"))
    return own.join(centres, ["perm", "grp"]).select("perm", F.col("a").alias("unit"), "grp", F.sqrt(F.greatest(F.col("mean") - F.col("half"), F.lit(0.0))).alias("spread"))


def permdisp(pairs: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 7) -> DataFrame:
    """f, p: is one group more variable than another?"""
    spread = dispersion(pairs, permuted_labels(groups, permutations, seed))
    by_group = spread.groupBy("perm", "grp").agg(F.sum("spread").alias("s"), F.sum(F.col("spread") ** 2).alias("q"), F.count(F.lit(1)).alias("m"))
    sums = by_group.groupBy("perm").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"), F.count(F.lit(1)).alias("k"))
    within = F.col("q") - F.col("b")
    f = F.when((within > 0) & (F.col("n") > F.col("k")), ((F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k"))))
    return empirical(sums.select("perm", f.alias("f")), "f").select(F.col("observed").alias("f"), "p")


def pcoa(pairs: DataFrame, axes: int = 4, most_units: int = 5000) -> tuple[DataFrame, list[float]]:
    """unit, coordinates (falling variance, the largest entry positive), and the share that each axis explains.

    The units' distances go to the driver: a cohort, at most ``most_units`` (ValueError beyond).
    """
    import numpy as np

    names = sorted(r[0] for r in both_ways(pairs).select("a").distinct().limit(most_units + 1).collect())
    if len(names) > most_units:
        raise ValueError(f"more than {most_units} units")
    place, d = {u: i for i, u in enumerate(names)}, np.zeros((len(names), len(names)))
    for a, b, x in pairs.select("a", "b", "distance").toLocalIterator():
        d[place[a], place[b]] = d[place[b], place[a]] = x * x
    centred = -(d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()) / 2
    values, vectors = np.linalg.eigh(centred)
    order = [i for i in np.argsort(-values) if values[i] > 1e-9]
    coordinates = vectors[:, order] * np.sqrt(values[order])
    coordinates *= np.sign(coordinates[np.abs(coordinates).argmax(axis=0), np.arange(len(order))]) if len(order) else 1
    kind = dict(pairs.dtypes)["a"]
    rows = [(u, c[:axes].tolist()) for u, c in zip(names, coordinates)]
    return pairs.sparkSession.createDataFrame(rows, f"unit {kind}, coordinates array<double>"), (values[order] / values[order].sum()).tolist()[:axes] if len(order) else []


def descriptions(bins: DataFrame) -> DataFrame:
    """cluster, size, feature, feature_frac, chrom, chrom_purity, is_satellite, family: the modal labels of a cluster's
    bins; 'unannotated' and '' count for nothing unless there is nothing else."""
    real = bins.where("cluster >= 0")
    out = real.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    for value, share, empty in (("feature", "feature_frac", "unannotated"), ("chrom", "chrom_purity", "")):
        named = real.where(F.coalesce(F.col(value), F.lit("")).isin("", "unannotated") == F.lit(False)).select("cluster", value)
        top = modal(named, ["cluster"], value, "support").join(named.groupBy("cluster").agg(F.count(F.lit(1)).alias("named")), "cluster")
        out = out.join(top.select("cluster", value, (F.col("support") / F.col("named")).alias(share)), "cluster", "left").withColumn(value, F.coalesce(value, F.lit(empty)))
    return out.withColumns({"is_satellite": is_satellite(F.col("feature")), "family": F.substring_index("feature", "_", 1)})


def partner_ranks(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """n, mean_rank, chance_rank, top1: the place of the nearest unit of the same block among each unit's neighbours."""
    ranked = both_ways(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")))
    donor = groups.select("unit", "block")
    own = ranked.join(donor.toDF("a", "block"), "a").join(donor.toDF("b", "block"), ["b", "block"]).groupBy("a").agg(F.min("rank").alias("rank"))
    total = groups.agg(F.count(F.lit(1)).alias("units"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") == 1).cast("int")).alias("top1")).join(F.broadcast(total)).select("n", "mean_rank", (F.col("units") / 2).alias("chance_rank"), "top1")


def without_each(pairs: DataFrame, groups: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The pairs, and groups for a jackknife keyed by ``dropped``; drops that leave a group under ``least`` are not made."""
    dropped = groups.select(F.col("unit").alias("dropped"), F.col("grp").alias("lost")).join(F.broadcast(groups.groupBy(F.col("grp").alias("lost")).agg(F.count(F.lit(1)).alias("m"))), "lost").where(F.col("m") > least).select("dropped")
    kept = groups.join(dropped, F.col("unit") != F.col("dropped")).select("dropped", "unit", "block", "grp")
    return pairs, kept


def each_two_groups(pairs: DataFrame, groups: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The pairs, and groups for contrasts of two groups keyed by ``one`` < ``two``; small groups are left out."""
    names = drop_small_groups(groups, least).select("grp").distinct()
    both = names.toDF("one").join(names.toDF("two"), F.col("one") < F.col("two"))
    kept = groups.join(both, (F.col("grp") == F.col("one")) | (F.col("grp") == F.col("two"))).select("one", "two", "unit", "block", "grp")
    return pairs, kept


def residuals(values: DataFrame, covariate: DataFrame, column: str = "cluster") -> DataFrame:
    """unit, column, value: what a straight line over ``covariate`` (unit, x) leaves of each column."""
    joined = values.join(covariate, "unit")
    fits = joined.groupBy(column).agg(F.regr_slope("value", "x").alias("slope"), F.avg("value").alias("my"), F.avg("x").alias("mx"))
    return joined.join(fits, column).select("unit", column, (F.col("value") - F.col("my") - F.coalesce("slope", F.lit(0.0)) * (F.col("x") - F.col("mx"))).alias("value"))


def group_profile(counts: DataFrame, groups: DataFrame, values: DataFrame) -> DataFrame:
    """cluster, grp, mean_ppm, mean_clr, prevalence: over all units of a group, absent ones as 0, for the clusters of ``values``."""
    totals = counts.groupBy("unit").agg(F.sum("n").alias("total"))
    share = values.join(groups.select("unit", "grp"), "unit").join(totals, "unit", "left").join(counts, ["unit", "cluster"], "left")
    ppm = F.coalesce(F.col("n") / F.greatest(F.col("total"), F.lit(1)), F.lit(0.0)) * 1e6
    return share.groupBy("cluster", "grp").agg(F.avg(ppm).alias("mean_ppm"), F.avg("value").alias("mean_clr"), F.avg(F.col("n").isNotNull().cast("int")).alias("prevalence"))


def group_folds(profile: DataFrame, counts: DataFrame) -> DataFrame:
    """cluster, top_group, log2_max_over_min: with one bin of the median unit as the floor; ties go to the first group."""
    floor = counts.groupBy("unit").agg(F.sum("n").alias("t")).agg((1e6 / F.median("t")).alias("floor"))
    ends = profile.groupBy("cluster").agg(F.max("mean_ppm").alias("hi"), F.min("mean_ppm").alias("lo"), F.min_by("grp", F.struct(-F.col("mean_ppm"), F.col("grp"))).alias("top_group"))
    return ends.join(F.broadcast(floor)).select("cluster", "top_group", F.log2((F.col("hi") + F.col("floor")) / (F.col("lo") + F.col("floor"))).alias("log2_max_over_min"))


def size_matched(sizes: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """draw, target, cluster: for each target of ``sizes`` (cluster, size, is_target) one other cluster of the nearest
    log size, none twice; targets choose in a shuffled order.  Targets that find the pool empty draw from all of it,
    with replacement; without a pool there is nothing to draw.

    Each draw is a task of its own over the cluster table (one row a cluster).
    """
    import numpy as np
    import pandas as pd

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["draw"].iloc[0])
        pool = pdf[~pdf["is_target"]].sort_values(["size", "cluster"])
        targets = pdf[pdf["is_target"]].sort_values("cluster")
        logs = np.log1p(pool["size"].to_numpy(dtype=float))
        free = np.ones(len(pool), dtype=bool)
        rows = []
        rng = np.random.default_rng((seed, number))
        for t in rng.permutation(len(targets)):
            left = np.flatnonzero(free)
            if not len(pool):
                break
            if not len(left):
                rows.append((number, int(targets["cluster"].iloc[t]), int(pool["cluster"].iloc[int(rng.integers(len(pool)))])))
                continue
            gap = np.abs(logs[left] - np.log1p(float(targets["size"].iloc[t])))
            chosen = left[int(gap.argmin())]
            free[chosen] = False
            rows.append((number, int(targets["cluster"].iloc[t]), int(pool["cluster"].iloc[chosen])))
        return pd.DataFrame(rows, columns=["draw", "target", "cluster"]).astype("int64")

    each = sizes.select("cluster", "size", "is_target", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return each.groupBy("draw").applyInPandas(draw, "draw long, target long, cluster long")


def composition(counts: DataFrame, keys: tuple[str, ...], pseudo: float = 0.5) -> DataFrame:
    """keys, unit, cluster, value: centred log-ratios over all clusters of each key (no prevalence floor)."""
    k = list(keys)
    grid = counts.select(*k, "unit").distinct().join(counts.select(*k, "cluster").distinct(), k).join(counts, [*k, "unit", "cluster"], "left")
    logs = grid.withColumn("l", F.log(F.coalesce("n", F.lit(0)) + pseudo))
    return logs.withColumn("value", F.col("l") - F.avg("l").over(Window.partitionBy(*k, "unit"))).select(*k, "unit", "cluster", "value")


def euclidean(values: DataFrame, keys: tuple[str, ...] = (), column: str = "cluster") -> DataFrame:
    """keys, a, b, distance (a < b)."""
    k = list(keys)
    x = values.select(*k, column, F.col("unit").alias("a"), F.col("value").alias("x"))
    y = values.select(*k, column, F.col("unit").alias("b"), F.col("value").alias("y"))
    return x.join(y, [*k, column]).where("a < b").groupBy(*k, "a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))


def matched_control(counts: DataFrame, groups: DataFrame, sizes: DataFrame, draws: int = 100, permutations: int = 199, seed: int = 7) -> DataFrame:
    """draw (0: the targets themselves), r2_excess, p: PERMANOVA of the targets and of sets of other clusters of like sizes."""
    picked = size_matched(sizes, draws, seed).select("draw", "cluster").unionByName(sizes.where("is_target").select(F.lit(0).cast("long").alias("draw"), F.col("cluster").cast("long").alias("cluster")))
    drawn = materialised(picked)
    units_ = groups.select("unit").distinct().join(F.broadcast(drawn.select("draw").distinct()))
    full = units_.join(drawn, "draw").join(counts, ["unit", "cluster"], "left").select("draw", "unit", "cluster", F.coalesce("n", F.lit(0)).alias("n"))
    pairs = materialised(euclidean(composition(full, ("draw",)), ("draw",)))
    keyed = groups.select("unit", "block", "grp").join(F.broadcast(drawn.select("draw").distinct()))
    return permanova(pairs, keyed, permutations, seed, ("draw",)).select("draw", "r2_excess", "p")


def exceedance(control: DataFrame) -> DataFrame:
    """n_subsets, excess_mean, excess_max, frac_p_lt_05, target_excess, exceedance_p of ``matched_control``."""
    own = control.where("draw = 0").select(F.col("r2_excess").alias("target_excess"))
    rest = control.where("draw > 0").join(F.broadcast(own))
    return rest.groupBy("target_excess").agg(F.count(F.lit(1)).alias("n_subsets"), F.avg("r2_excess").alias("excess_mean"), F.max("r2_excess").alias("excess_max"), F.avg((F.col("p") < 0.05).cast("int")).alias("frac_p_lt_05"), ((1 + F.sum((F.col("r2_excess") >= F.col("target_excess")).cast("int"))) / (1 + F.count(F.lit(1)))).alias("exceedance_p"))


