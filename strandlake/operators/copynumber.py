"""Copy number of features by assembly and chromosome, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix64, unsigned_key, wrapping
from ..tables import materialised
from .ranking import running_sum

MEGABASE = 1_000_000.0


def feature_counts(bins: DataFrame) -> DataFrame:
    """assembly, chrom (null: all), feature, n_bins, covered: both scopes from one grouping-sets pass."""
    sized = bins.withColumn("width", F.col("end") - F.col("start"))
    return sized.groupingSets([["assembly", "chrom", "feature"], ["assembly", "feature"]], "assembly", "chrom", "feature").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("width").alias("covered"), F.grouping("chrom").alias("all_chroms"))


def long_table(bins: DataFrame) -> DataFrame:
    """scope ('assembly' or 'chrom'), assembly, chrom, feature, n_bins, mb, assembly_mb, frac_of_assembly."""
    counts = feature_counts(bins)
    totals = bins.groupBy("assembly").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    scope = F.when(F.col("all_chroms") == 1, "assembly").otherwise("chrom")
    return counts.join(totals, "assembly").select(scope.alias("scope"), "assembly", F.coalesce("chrom", F.lit("")).alias("chrom"), "feature", "n_bins", (F.col("covered") / MEGABASE).alias("mb"), (F.col("total") / MEGABASE).alias("assembly_mb"), (F.col("covered") / F.col("total")).alias("frac_of_assembly"))


def spread(values: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, cv (sd / mean), fold (max / min), robust_fold (p90 / p10); null where the denominator is 0."""
    v = F.col(value).cast("double")
    made = values.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(v).alias("hi"), F.min(v).alias("lo"), F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.1).alias("p10"))
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return made.select(group, "n", "mean", over("sd", "mean").alias("cv"), over("hi", "lo").alias("fold"), over("p90", "p10").alias("robust_fold"))


def completeness(values: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, r, slope, intercept, residual_cv: how far y follows x, and its spread without that."""
    fits = values.groupBy(group).agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(y).alias("mean"))
    residual = values.join(fits, group).withColumn("e", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    left = residual.groupBy(group).agg((F.stddev_samp("e") / F.first("mean")).alias("residual_cv"))
    return fits.join(left, group).select(group, "r", "slope", "intercept", "residual_cv")


def zero_filled_medians(counts: DataFrame, rows: str, columns: str, unit: str, value: str) -> DataFrame:
    """rows, columns, median over all units, absent combinations as 0.

    The grid isn't built: an absent combination is a zero, so the median follows
    from the sorted values and the number of zeros before them.
    """
    units = counts.select(F.countDistinct(unit).alias("units"))
    sorted_ = counts.groupBy(rows, columns).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))  # at most one value a unit
    joined = sorted_.join(F.broadcast(units))
    zeros = F.col("units") - F.size("v")
    at = lambda i: F.when(i < zeros, 0.0).otherwise(F.element_at("v", (F.greatest(i - zeros, F.lit(0)) + 1).cast("int")))
    low, high = F.floor((F.col("units") - 1) / 2), F.floor(F.col("units") / 2)
    return joined.select(rows, columns, ((at(low) + at(high)) / 2).alias("median"))


def reference_free(bins: DataFrame, least_bins: int = 5, least_purity: float = 0.5) -> DataFrame:
    """assembly, feature, n_bins: non-reference bins counted under the feature that their cluster's reference bins name."""
    from .transfer import infer

    named = infer(bins).where((F.col("support") >= least_bins) & (F.col("purity") >= least_purity) & (F.col("inferred_feature") != "")).select("cluster", "inferred_feature").distinct()
    return bins.where("NOT is_ref").join(named, "cluster").groupBy("assembly", F.col("inferred_feature").alias("feature")).agg(F.count(F.lit(1)).alias("n_bins"))


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties share their average; ranked over distinct values with their counts, by ranges."""
    keys = by or []
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sum(counted, value, "__n", "__sum", keys)
    return df.join(ranked.select(*keys, value, (F.col("__sum") - (F.col("__n") - 1) / 2).alias(name)), [*keys, value])


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (corrected for ties), groups, n: one row; the tail is ``stats.chi2_tail(h, groups - 1)``."""
    ranked = average_ranks(df, value, "rank")
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).cast("double").alias("m"))
    total = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"))
    ties = df.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return total.join(F.broadcast(ties)).select((raw / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "groups", n.cast("long").alias("n"))


def label_source(bins: DataFrame, annotated: str = "annotated", feature: str = "feature", inferred: str = "inferred_feature") -> DataFrame:
    """source, column, cohort, labelled, reference: labels of the assemblies' bins come from annotations if any of them has
    one there, else from what was inferred."""
    other = ~F.col("is_ref")
    named = F.col(annotated) & ~F.coalesce(F.col(feature), F.lit("")).isin("", "unannotated")
    guessed = F.coalesce(F.col(inferred), F.lit("")) != ""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    seen = bins.agg(count(other).alias("cohort"), count(named & other).alias("own"), count(guessed & other).alias("guessed"), count(F.col("is_ref")).alias("reference"))
    own = F.col("own") > 0
    return seen.select(F.when(own, "annotations").otherwise("inferred").alias("source"), F.when(own, feature).otherwise(inferred).alias("column"), "cohort", F.when(own, F.col("own")).otherwise(F.col("guessed")).alias("labelled"), "reference")


def phasing(haplotype):
    """How an assembly's haplotypes were told apart, by their names."""
    return F.when(haplotype.isin("mat", "pat"), "mat/pat").otherwise("hap1/hap2")


def concordance(values: DataFrame, units: DataFrame, permutations: int = 199, seed: int = 7) -> DataFrame:
    """feature, n_pairs, concordance, p_similar, p_different: do the two units of a donor agree?

    ``values``: unit, feature, value (absent: 0); ``units``: unit, block (donor), stratum.  The statistic
    enters each pair in both orders.  The null pairs units anew within strata, an odd one out;
    its order is a mixed hash of (seed, permutation, unit's place).
    """
    features = values.select("feature").distinct()
    grid = units.select("unit").join(F.broadcast(features)).join(values, ["unit", "feature"], "left").select("unit", "feature", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("x"))
    scale = grid.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.var_pop("x").alias("v")).where("sd > 0")
    centred = materialised(grid.join(scale, "feature").select("unit", "feature", ((F.col("x") - F.col("m")) / F.sqrt("v")).alias("z")))
    two = units.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b")).where("n = 2")
    coded = units.withColumn("code", F.row_number().over(Window.orderBy("unit")).cast("long") - 1)  # a row a unit
    with wrapping(values.sparkSession):
        spread = coded.withColumn("perm", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(permutations).cast("long"))))
        order = unsigned_key(mix64(F.lit(seed).cast("long").bitwiseXOR(F.col("perm") * 1_000_003 + F.col("code"))))
        placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("perm", "stratum").orderBy(order, "code")) - 1)
    drawn = placed.groupBy("perm", "stratum", F.floor(F.col("place") / 2).alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b")).where("n = 2")
    pairs = drawn.select("perm", "a", "b").unionByName(two.select(F.lit(0).cast("long").alias("perm"), "a", "b"))
    left, right = centred.toDF("a", "feature", "x"), centred.toDF("b", "feature", "y")
    means = materialised(pairs.join(left, "a").join(right, ["b", "feature"]).groupBy("perm", "feature").agg(F.avg(F.col("x") * F.col("y")).alias("r"), F.count(F.lit(1)).alias("n_pairs")))
    seen = means.where("perm = 0").select("feature", F.col("r").alias("concordance"), "n_pairs")
    null = means.where("perm > 0").select("feature", "r").join(seen, "feature")
    share = lambda c: F.avg(c.cast("int"))
    return null.groupBy("feature", "n_pairs", "concordance").agg(share(F.col("r") >= F.col("concordance") - 1e-9).alias("p_similar"), share(F.col("r") <= F.col("concordance") + 1e-9).alias("p_different"))


def donor_means(values: DataFrame, units: DataFrame) -> DataFrame:
    """block, grp, stratum, feature, value: the mean over a donor's units, absent values as 0."""
    grid = units.join(F.broadcast(values.select("feature").distinct())).join(values, ["unit", "feature"], "left")
    return grid.groupBy("block", "grp", "stratum", "feature").agg(F.avg(F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("value"))


def group_effects(rows: list[tuple[float, str, str]]) -> tuple[list[tuple], dict[str, float]]:
    """Least squares of y on a group and a covariate (rows: y, group, covariate), levels as deviations from the grand mean.

    Terms (name, effect, se, low, high, t, p), a covariate's name in brackets, for every level that
    the rows have; and f, p and dof of the groups after the covariate.
    """
    import numpy as np

    from ..functions.stats import f_tail, t_quantile, t_tail

    y = np.array([r[0] for r in rows], dtype=float)

    def coded(at):
        levels = sorted({r[at] for r in rows})
        which = np.array([levels.index(r[at]) for r in rows])
        return levels, np.vstack([np.eye(len(levels) - 1), -np.ones(len(levels) - 1)])[which]

    (groups, g), (covariates, c) = coded(1), coded(2)
    design = np.column_stack([np.ones(len(y)), g, c])
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    left = y - design @ beta
    dof = len(y) - int(np.linalg.matrix_rank(design))
    variance = float(left @ left) / max(dof, 1)
    critical = t_quantile(0.975, dof)
    terms = []
    one = np.zeros(len(beta))
    one[0] = 1
    wanted = [("(mean)", one)]
    for levels, first, shown in ((groups, 1, "{}"), (covariates, len(groups), "[{}]")):
        for i, level in enumerate(levels):
            vector = np.zeros(len(beta))
            vector[first : first + len(levels) - 1] = -1.0 if i == len(levels) - 1 else 0.0
            if i < len(levels) - 1:
                vector[first + i] = 1.0
            wanted.append((shown.format(level), vector))
    for name, vector in wanted:
        effect, se = float(vector @ beta), float(np.sqrt(max(0.0, vector @ inverse @ vector * variance)))
        t = effect / se if se > 0 else float("inf")
        terms.append((name, effect, se, effect - critical * se, effect + critical * se, t, t_tail(t, dof) if se > 0 else 0.0))
    reduced = np.column_stack([np.ones(len(y)), c])
    rest = y - reduced @ np.linalg.lstsq(reduced, y, rcond=None)[0]
    f = ((float(rest @ rest) - float(left @ left)) / max(len(groups) - 1, 1)) / max(variance, 1e-300)
    return terms, {"f": f, "p": f_tail(f, len(groups) - 1, dof), "dof": dof}


def _varied(means: DataFrame) -> DataFrame:
    """The features with more than one value and group: the others have nothing to fit."""
    ends = means.groupBy("feature").agg((F.min("value") < F.max("value")).alias("moves"), (F.min("grp") < F.max("grp")).alias("groups"))
    return means.join(ends.where("moves AND groups"), "feature", "left_semi")


def effect_terms(means: DataFrame) -> DataFrame:
    """feature, term, effect, se, ci_lo, ci_hi, t, p: the terms of ``group_effects`` for each feature of ``donor_means`` that varies."""
    columns = ["feature", "term", "effect", "se", "ci_lo", "ci_hi", "t", "p"]

    def fit(pdf):
        import pandas as pd

        terms, _ = group_effects(list(zip(pdf["value"], pdf["grp"], pdf["stratum"])))
        return pd.DataFrame([(pdf["feature"].iloc[0], *t) for t in terms], columns=columns)

    return _varied(means).groupBy("feature").applyInPandas(fit, "feature string, term string, effect double, se double, ci_lo double, ci_hi double, t double, p double")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """feature, n, pearson, spearman of two measures (assembly, feature, n_bins) over the assemblies that have either
    (absent: 0): how far labels of the reference alone give the counts that the assemblies' own annotations give."""
    named = lambda df, c: df.select("assembly", "feature", F.col("n_bins").cast("double").alias(c))
    assemblies = left.select("assembly").union(right.select("assembly")).distinct()
    grid = assemblies.join(F.broadcast(left.select("feature").distinct()))  # one row a feature of a vocabulary
    both = grid.join(named(left, "x"), ["assembly", "feature"], "left").join(named(right, "y"), ["assembly", "feature"], "left").fillna({"x": 0.0, "y": 0.0})
    ranked = average_ranks(average_ranks(both, "x", "rx", ["feature"]), "y", "ry", ["feature"])
    varied = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.when(varied, F.corr("x", "y")).alias("pearson"), F.when(varied, F.corr("rx", "ry")).alias("spearman"))


def adjusted_effects(means: DataFrame) -> DataFrame:
    """feature, grand_mean, f, p, p_bonferroni, dof: groups after the stratum, for each feature of ``donor_means`` that varies.

    A feature's donors are one group of rows (a cohort).
    """
    def fit(pdf):
        import pandas as pd

        _, found = group_effects(list(zip(pdf["value"], pdf["grp"], pdf["stratum"])))
        return pd.DataFrame([(pdf["feature"].iloc[0], float(pdf["value"].mean()), found["f"], found["p"], found["dof"])], columns=["feature", "grand_mean", "f", "p", "dof"])

    fitted = materialised(_varied(means).groupBy("feature").applyInPandas(fit, "feature string, grand_mean double, f double, p double, dof long"))
    tested = fitted.agg(F.count(F.lit(1)).alias("tests"))
    return fitted.join(F.broadcast(tested)).select("feature", "grand_mean", "f", "p", F.least(F.lit(1.0), F.col("p") * F.col("tests")).alias("p_bonferroni"), "dof")


def crossing(units: DataFrame) -> DataFrame:
    """stratum, grp, donors: how groups and strata cross."""
    return units.select("block", "grp", "stratum").distinct().groupBy("stratum", "grp").agg(F.count(F.lit(1)).alias("donors"))
