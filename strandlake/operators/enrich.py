"""Enrichment of features in clusters, and names of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import neg_log10_hypergeom_tail

LEAST_SUPPORT = 5


def carried(annotations: DataFrame, bins: DataFrame, min_frac: float = 0.25) -> DataFrame:
    """bin_uid, feature: the features that annotated bins carry (shares compared as floats)."""
    strong = annotations.where(F.col("frac").cast("float") >= F.lit(min_frac).cast("float")).select("bin_uid", "feature").distinct()
    return strong.join(bins.where("annotated").select("bin_uid"), "bin_uid", "left_semi")


def enrichment(bins: DataFrame, carries: DataFrame, min_cluster_size: int = 10) -> DataFrame:
    """cluster, feature, n_bins_cluster, n_bins_total, cluster_size, background_size, frac_cluster,
    frac_background, log2_enrichment, neg_log10_p - for clusters large enough (noise too) and features that occur.

    One grouped pass over (cluster, feature); totals come from it, so the bins are
    not read again for each cluster.
    """
    sizes = bins.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    counts = carries.join(bins.select("bin_uid", "cluster"), "bin_uid").groupBy("cluster", "feature").agg(F.count(F.lit(1)).alias("n_bins_cluster"))
    totals = counts.groupBy("feature").agg(F.sum("n_bins_cluster").alias("n_bins_total"))
    background = sizes.agg(F.sum("cluster_size").alias("background_size"))
    # clusters x features is the output itself: a few hundred features against the clusters
    grid = sizes.where(F.col("cluster_size") >= min_cluster_size).join(F.broadcast(totals)).join(F.broadcast(background))
    full = grid.join(counts, ["cluster", "feature"], "left").withColumn("n_bins_cluster", F.coalesce("n_bins_cluster", F.lit(0)).cast("long"))
    inside, outside = F.col("n_bins_cluster") / F.col("cluster_size"), F.col("n_bins_total") / F.col("background_size")
    smooth = 1.0 / F.col("background_size")
    return full.select("cluster", "feature", "n_bins_cluster", "n_bins_total", "cluster_size", "background_size", inside.alias("frac_cluster"), outside.alias("frac_background"), F.log2((inside + smooth) / (outside + smooth)).alias("log2_enrichment"), neg_log10_hypergeom_tail(F.col("n_bins_cluster"), F.col("background_size"), F.col("n_bins_total"), F.col("cluster_size")).alias("neg_log10_p"))


def cluster_names(bins: DataFrame, carries: DataFrame, tests: DataFrame, top_features: int = 3) -> DataFrame:
    """cluster, name, top_features, size, n_assemblies, n_chroms, purity.

    Named by the most enriched feature with at least five bins (ties by name);
    noise is never named.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("log2_enrichment"), "feature")
    ranked = tests.where((F.col("cluster") >= 0) & (F.col("log2_enrichment") > 0) & (F.col("n_bins_cluster") >= LEAST_SUPPORT)).withColumn("rank", F.row_number().over(order))
    tops = ranked.where(F.col("rank") <= top_features).groupBy("cluster").agg(
        F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s:%.3f", "feature", "log2_enrichment").alias("text")))), lambda s: s["text"]), ";").alias("top_features"),
        F.max(F.when(F.col("rank") == 1, F.col("n_bins_cluster"))).alias("support"),
    )
    groups = bins.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("assembly").alias("n_assemblies"), F.countDistinct(F.when(F.col("chrom") != "", F.col("chrom"))).alias("n_chroms"), F.sum(F.col("annotated").cast("long")).alias("annotated"))
    joined = groups.join(tops, "cluster", "left")
    name = F.when(F.col("cluster") < 0, "noise").when(F.col("top").isNull(), "unannotated").otherwise(F.format_string("C%d %s", F.col("cluster"), F.col("top")))
    purity = F.when(F.col("annotated") > 0, F.coalesce("support", F.lit(0)) / F.col("annotated")).otherwise(0.0)
    return joined.select("cluster", name.alias("name"), F.coalesce("top_features", F.lit("")).alias("top_features"), "size", "n_assemblies", "n_chroms", purity.alias("purity"))
