"""Queries: interval tracks, from events, over tiles of each user's time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as ops
from .mappings import INTERVALS_SQL, intervals, table
from .registry import query, rounded

TILE = 21_600
_ISLANDS = f"""{INTERVALS_SQL}, marked AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY contig, feature ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM intervals),
islands AS (SELECT *, sum(new) OVER (PARTITION BY contig, feature ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT contig, feature, min(start) AS start, max("end") AS "end" FROM islands GROUP BY contig, feature, island)"""
_BINS = f"""{_ISLANDS}, bins AS (SELECT DISTINCT contig, start // {TILE} * {TILE} AS bstart FROM intervals)"""
_COVER = f"""{_BINS}, met AS (SELECT b.contig, bstart, feature, sum(least(m."end", bstart + {TILE}) - greatest(m.start, bstart)) AS covered FROM bins b JOIN merged m ON m.contig = b.contig AND m.start < bstart + {TILE} AND m."end" > bstart GROUP BY ALL),
cover AS (SELECT contig, bstart, feature, (covered::DOUBLE / {TILE})::FLOAT AS frac FROM met)"""


def _bins(track):
    made = track.select("contig", (F.floor(F.col("start") / TILE) * TILE).alias("start")).distinct()
    return made.select("contig", "start", (F.col("start") + TILE).alias("end"), F.concat_ws("|", "contig", "start").alias("bin_uid"))


def _cover(spark, sf_dir):
    track = intervals(spark, sf_dir)
    bins = _bins(track)
    return bins, ops.bin_coverage(bins, track, TILE)


@query(f"WITH {_ISLANDS} SELECT contig, feature, start, \"end\" FROM merged")
def interval_merge(spark, sf_dir):
    return ops.merge_intervals(intervals(spark, sf_dir), ["contig", "feature"])


@query(f"WITH {_COVER} SELECT contig || '|' || bstart AS bin_uid, feature, round(frac::DOUBLE, 6) AS frac FROM cover")
def bin_coverage(spark, sf_dir):
    return rounded(_cover(spark, sf_dir)[1].withColumn("frac", F.col("frac").cast("double")))


@query(f"WITH {_COVER}, ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, bstart ORDER BY frac DESC, list_position(['click', 'error', 'purchase', 'signup', 'view'], feature)) AS r FROM cover WHERE list_position(['click', 'error', 'purchase', 'signup', 'view'], feature) > 0) SELECT b.contig || '|' || b.bstart AS bin_uid, CASE WHEN coalesce(frac, 0) >= 0.1::FLOAT THEN feature ELSE 'unannotated' END AS dominant_feature, round(coalesce(frac, 0)::DOUBLE, 6) AS dominant_frac FROM bins b LEFT JOIN ranked r ON r.contig = b.contig AND r.bstart = b.bstart AND r.r = 1")
def dominant_feature(spark, sf_dir):
    bins, cover = _cover(spark, sf_dir)
    found = ops.dominant(cover, bins, ["click", "error", "purchase", "signup", "view"], 0.1)
    return rounded(found.withColumn("dominant_frac", F.col("dominant_frac").cast("double")))


@query(f"WITH {_COVER} SELECT b.contig || '|' || b.bstart AS bin_uid, round(coalesce(max(frac) FILTER (feature = 'click'), 0)::DOUBLE, 6) AS frac_click, round(coalesce(max(frac) FILTER (feature = 'view'), 0)::DOUBLE, 6) AS frac_view FROM bins b LEFT JOIN cover c USING (contig, bstart) GROUP BY b.contig, b.bstart")
def coverage_wide(spark, sf_dir):
    bins, cover = _cover(spark, sf_dir)
    shares = ops.wide(cover, bins, ["click", "view"])
    return rounded(shares.select("bin_uid", *[F.col(c).cast("double").alias(c) for c in ("frac_click", "frac_view")]))


@query(f"WITH {_BINS} SELECT contig, feature, spot AS \"at\", coalesce(sum(greatest(0, least(\"end\", spot) - start)) FILTER (start < spot), 0)::BIGINT AS below FROM (SELECT DISTINCT i.contig, i.feature, i.start AS spot FROM intervals i) p JOIN merged m USING (contig, feature) GROUP BY ALL")
def prefix_coverage(spark, sf_dir):
    track = intervals(spark, sf_dir)
    points = track.select("contig", "feature", F.col("start").alias("at")).distinct()
    return ops.prefix_coverage(points, track, ["contig", "feature"])


@query(f"WITH {INTERVALS_SQL} SELECT contig, feature, greatest(start, 1704931200) - 1704931200 AS start, least(\"end\", 1705536000) - 1704931200 AS \"end\" FROM intervals WHERE least(\"end\", 1705536000) > greatest(start, 1704931200)")
def rebased_slice(spark, sf_dir):
    """Intervals clipped to a slice and moved to its frame."""
    lo, hi = 1704931200, 1705536000
    kept = intervals(spark, sf_dir).select("contig", "feature", F.greatest("start", F.lit(lo)).alias("start"), F.least("end", F.lit(hi)).alias("end")).where("end > start")
    return kept.select("contig", "feature", (F.col("start") - lo).alias("start"), (F.col("end") - lo).alias("end"))
