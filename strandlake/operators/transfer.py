"""Labels carried from reference bins to the rest of their clusters, and browser tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import dominant
from .ranking import modal

#: Fixed: the golden ratio's fraction, which spreads hues.
PHI = 0.6180339887498949


def colors(clusters: DataFrame, offset: float = 0.0) -> DataFrame:
    """cluster, hue, saturation, value, rgb ('r,g,b'); noise is grey."""
    hue = F.pmod(F.lit(offset) + F.col("cluster") * F.lit(PHI), F.lit(1.0))
    value, saturation = F.when(F.col("cluster") % 2 == 0, 0.95).otherwise(0.75), F.when(F.col("cluster") % 3 == 0, 0.60).otherwise(0.85)
    sector = F.floor(hue * 6).cast("int")
    part = hue * 6 - F.floor(hue * 6)
    p, q, t = value * (1 - saturation), value * (1 - part * saturation), value * (1 - (1 - part) * saturation)
    pick = lambda *six: F.element_at(F.array(*six), F.pmod(sector, F.lit(6)) + 1)
    channels = [pick(value, q, p, p, t, value), pick(t, value, value, q, p, p), pick(p, p, t, value, value, q)]
    rgb = F.concat_ws(",", *[F.rint(c * 255).cast("int").cast("string") for c in channels])
    return clusters.select("cluster", F.when(F.col("cluster") >= 0, hue).alias("hue"), F.when(F.col("cluster") < 0, "190,190,190").otherwise(rgb).alias("rgb"))


def bed_rows(bins: DataFrame, names: DataFrame, palette: DataFrame) -> DataFrame:
    """assembly, contig, start, end, name, score (0..1000, halves to even), strand, thick start and end, rgb."""
    joined = bins.join(names.select("cluster", "name"), "cluster").join(palette.select("cluster", "rgb"), "cluster")
    score = F.least(F.lit(1000), F.greatest(F.lit(0), F.rint(F.col("probability").cast("double") * 1000).cast("int")))
    return joined.select("assembly", "contig", "start", "end", "name", score.alias("score"), F.lit(".").alias("strand"), F.col("start").alias("thick_start"), F.col("end").alias("thick_end"), "rgb")


def infer(bins: DataFrame, unlabelled: str = "unannotated") -> DataFrame:
    """bin_uid, cluster, inferred_feature, support, cluster_ref_bins, purity, novel.

    Annotated reference bins vote in each cluster (ties by name); a cluster without
    any reference bin is novel; noise is neither labelled nor novel.
    """
    reference = bins.where("is_ref AND cluster >= 0")
    votes = modal(reference.where(F.col("annotated") & (F.col("feature") != unlabelled)), ["cluster"], "feature")
    totals = reference.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_ref_bins"), F.sum((F.col("annotated") & (F.col("feature") != unlabelled)).cast("long")).alias("voters"))
    joined = bins.select("bin_uid", "cluster").join(totals.join(votes.withColumnRenamed("feature", "top"), "cluster", "left"), "cluster", "left")
    return joined.select("bin_uid", "cluster", F.coalesce("top", F.lit("")).alias("inferred_feature"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("cluster_ref_bins", F.lit(0)).alias("cluster_ref_bins"), F.when(F.col("voters") > 0, F.col("support") / F.col("voters")).otherwise(0.0).alias("purity"), ((F.col("cluster") >= 0) & F.col("cluster_ref_bins").isNull()).alias("novel"))


def comparable(reference_tracks: list[str], assembly_tracks: list[str], tracks: dict[str, tuple[str, ...]], vocabulary: tuple[str, ...]) -> list[str]:
    """The features that both sides' tracks can show, in vocabulary order."""
    reach = lambda names: {f for n in names for f in tracks.get(n, ())}
    both = reach(reference_tracks) & reach(assembly_tracks)
    return [f for f in vocabulary if f in both]


def restricted(bins: DataFrame, coverage: DataFrame, features: list[str], vocabulary: tuple[str, ...], min_frac: float = 0.25) -> DataFrame:
    """``bins`` with ``feature`` chosen anew among ``features`` alone; unchanged if they are the whole vocabulary, or none."""
    if not features or len(features) == len(vocabulary):
        return bins
    top = dominant(coverage, bins, features, min_frac).select("bin_uid", F.col("dominant_feature").alias("feature"))
    return bins.drop("feature").join(top, "bin_uid")


def transfer_report(bins: DataFrame, unlabelled: str = "unannotated") -> DataFrame:
    """cluster, n_ref_bins, n_asm_bins, ref_top_feature, asm_top_feature, asm_agreement (null if untestable), asm_annotated_frac."""
    real = bins.where("cluster >= 0")
    voting = real.where(F.col("annotated") & (F.col("feature") != unlabelled))
    ref = modal(voting.where("is_ref"), ["cluster"], "feature").select("cluster", F.col("feature").alias("ref_top_feature"))
    asm = modal(voting.where("NOT is_ref"), ["cluster"], "feature").select("cluster", F.col("feature").alias("asm_top_feature"))
    joined = real.join(ref, "cluster", "left")
    mine = ~F.col("is_ref")
    sums = joined.groupBy("cluster", "ref_top_feature").agg(F.sum(F.col("is_ref").cast("long")).alias("n_ref_bins"), F.sum(mine.cast("long")).alias("n_asm_bins"), F.sum((mine & F.col("annotated")).cast("long")).alias("asm_annotated"), F.sum((mine & F.col("annotated") & (F.col("feature") == F.col("ref_top_feature"))).cast("long")).alias("agree"))
    agreement = F.when(F.col("ref_top_feature").isNotNull() & (F.col("asm_annotated") > 0), F.coalesce("agree", F.lit(0)) / F.col("asm_annotated"))
    return sums.join(asm, "cluster", "left").select("cluster", "n_ref_bins", "n_asm_bins", F.coalesce("ref_top_feature", F.lit("")).alias("ref_top_feature"), F.coalesce("asm_top_feature", F.lit("")).alias("asm_top_feature"), agreement.alias("asm_agreement"), F.when(F.col("n_asm_bins") > 0, F.col("asm_annotated") / F.col("n_asm_bins")).otherwise(0.0).alias("asm_annotated_frac"))


def level_counts(bins: DataFrame, column: str) -> DataFrame:
    """Levels by falling count, then name, with their place."""
    counted = bins.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)) - 1)


def quantised(df: DataFrame, column: str, bits: int = 16) -> DataFrame:
    """``column`` as integers 0..2**bits - 1 between its extremes, with offset and scale."""
    span = df.agg(F.min(column).alias("offset"), ((F.max(column) - F.min(column)) / float((1 << bits) - 1)).alias("scale"))
    step = F.when(F.col("scale") > 0, F.rint((F.col(column) - F.col("offset")) / F.col("scale"))).otherwise(0.0)
    return df.join(F.broadcast(span)).withColumn("code", step.cast("int"))
