"""Interval tracks over fixed bins: merging, coverage, dominant class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TILE = 1 << 20


def merge_intervals(track: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, start, end: overlapping and touching intervals of a key as one (gaps and islands).

    Intervals are taken by the tile of their start.  What reaches into a tile from the ones
    before, and how many islands those hold, comes from one row a tile; so no task sorts a whole key.
    """
    valid = track.select(*keys, F.greatest("start", F.lit(0)).alias("start"), "end").where("end > start")
    cut = valid.withColumn("tile", F.floor(F.col("start") / tile))
    earlier = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.groupBy(*keys, "tile").agg(F.max("end").alias("reach")).select(*keys, "tile", F.max("reach").over(earlier).alias("reached"))
    order = Window.partitionBy(*keys, "tile").orderBy("start", "end")
    before = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("reached"))
    marked = cut.join(reach, [*keys, "tile"]).withColumn("before", before).withColumn("new", F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0))
    islands = marked.groupBy(*keys, "tile").agg(F.sum("new").alias("islands")).select(*keys, "tile", F.coalesce(F.sum("islands").over(earlier), F.lit(0)).alias("base"))
    numbered = marked.withColumn("own", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(islands, [*keys, "tile"])
    return numbered.groupBy(*keys, (F.col("base") + F.col("own")).alias("island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def bin_coverage(bins: DataFrame, track: DataFrame, tile: int, contig: str = "contig", feature: str = "feature", bin_id: str = "bin_uid") -> DataFrame:
    """bin_uid, feature, frac (float): the share of each bin that merged intervals of a feature cover.

    Both sides are spread over tiles of ``tile`` bases, intervals clipped to
    theirs, so the join is an equality on (contig, tile) with a residual overlap.
    """
    merged = merge_intervals(track, [contig, feature])
    spread = merged.select(contig, feature, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("tile"))
    clipped = spread.select(contig, feature, "tile", F.greatest("start", F.col("tile") * tile).alias("i_start"), F.least("end", (F.col("tile") + 1) * tile).alias("i_end"))
    tiled = bins.select(contig, bin_id, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.greatest("end", F.col("start") + 1) - 1) / tile))).alias("tile"))
    met = tiled.join(clipped, [contig, "tile"]).where("i_end > start AND i_start < end")
    overlap = F.least("end", "i_end") - F.greatest("start", "i_start")
    covered = met.groupBy(bin_id, feature, (F.col("end") - F.col("start")).alias("width")).agg(F.sum(overlap).alias("covered"))
    return covered.select(bin_id, feature, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("covered") / F.col("width"))).cast("float").alias("frac"))


def prefix_coverage(points: DataFrame, track: DataFrame, keys: list[str], at: str = "at", tile: int = TILE) -> DataFrame:
    """points with ``below``: bases of merged intervals before each point (an as-of lookup by one ordered pass of each tile)."""
    merged = merge_intervals(track, keys, tile)
    lines = merged.select(*keys, F.col("start").alias(at), F.col("start").alias("s"), F.col("end").alias("e"), F.lit(None).cast("long").alias("point"))
    asked = points.select(*keys, F.col(at), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.col(at).alias("point"))
    run = lines.unionByName(asked).withColumn("tile", F.floor(F.col(at) / tile))
    earlier = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = run.groupBy(*keys, "tile").agg(F.sum(F.col("e") - F.col("s")).alias("n"), F.max("e").alias("last"))
    base = sums.select(*keys, "tile", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.max("last").over(earlier).alias("before"))
    order = Window.partitionBy(*keys, "tile").orderBy(at, F.col("point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    summed = run.join(base, [*keys, "tile"]).withColumn("own", F.coalesce(F.sum(F.col("e") - F.col("s")).over(order), F.lit(0))).withColumn("end", F.coalesce(F.last("e", True).over(order), "before", F.col(at)))
    over = F.greatest(F.col("end") - F.col(at), F.lit(0))
    return summed.withColumn("below", F.col("base") + F.col("own") - over).where("point is not null").select(*keys, at, "below").distinct()


def dominant(coverage: DataFrame, bins: DataFrame, vocabulary: list[str], min_frac: float = 0.25, feature: str = "feature", bin_id: str = "bin_uid") -> DataFrame:
    """bin_uid, dominant_feature, dominant_frac: the largest share; ties go to the vocabulary's order;
    'unannotated' below ``min_frac`` (the share is kept)."""
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col(feature))
    known = coverage.where(place > 0)
    best = known.groupBy(bin_id).agg(F.max(F.struct("frac", (-place).alias("order"), F.col(feature).alias("name"))).alias("best"))
    joined = bins.select(bin_id).join(best, bin_id, "left")
    share = F.coalesce(F.col("best.frac"), F.lit(0.0).cast("float"))
    floor = F.lit(max(min_frac, 1.1754943508222875e-38)).cast("float")
    return joined.select(bin_id, F.when(share >= floor, F.col("best.name")).otherwise("unannotated").alias("dominant_feature"), share.alias("dominant_frac"))


def wide(coverage: DataFrame, bins: DataFrame, vocabulary: list[str], feature: str = "feature", bin_id: str = "bin_uid") -> DataFrame:
    """One frac_* column for each word of the vocabulary; 0 where nothing covers."""
    pivoted = coverage.groupBy(bin_id).pivot(feature, list(vocabulary)).agg(F.max("frac"))
    joined = bins.select(bin_id).join(pivoted, bin_id, "left")
    return joined.select(bin_id, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).cast("float").alias(f"frac_{v}") for v in vocabulary])
