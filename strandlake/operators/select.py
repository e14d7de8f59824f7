"""Feature selection by prevalence across samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import at_most_unsigned, mix64, subsample_ceiling, wrapping
from .ranking import dense_index


def radix_bucket(hash_column, buckets: int):
    """The top log2(buckets) bits of a 64-bit hash."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    return F.lit(0).cast("long") if buckets == 1 else F.shiftrightunsigned(hash_column, 64 - (buckets.bit_length() - 1))


def prevalence_counts(sketch: DataFrame, hash: str = "hash", sample: str = "sample", assembly: str = "assembly", bin: str = "bin", partitions: int | None = None) -> DataFrame:
    """hash, n_samples, n_assemblies, n_bins; a bin holds a hash once.

    An assembly has one sample, so three nested partial sums replace two distinct
    counts (which would double every row).  One shuffle by hash, into ``partitions`` if given, serves them all.
    """
    bins = sketch.select(hash, sample, assembly, bin).repartition(*([partitions] if partitions else []), hash).distinct()
    by_assembly = bins.groupBy(hash, sample, assembly).agg(F.count(F.lit(1)).alias("n"))
    by_sample = by_assembly.groupBy(hash, sample).agg(F.count(F.lit(1)).alias("a"), F.sum("n").alias("n"))
    return by_sample.groupBy(hash).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("a").alias("n_assemblies"), F.sum("n").alias("n_bins"))


def prevalence_window(low: float, high: float, samples: int) -> tuple[int, int]:
    """Inclusive bounds of n_samples for prevalences of ``samples`` manifest samples."""
    lo = max(1, math.ceil(low * samples - 1e-9))
    hi = math.floor(high * samples + 1e-9)
    return lo, max(lo, hi)


def within_window(counts: DataFrame, low: float, high: float, samples: int, min_bins: int = 1) -> DataFrame:
    lo, hi = prevalence_window(low, high, samples)
    return counts.where((F.col("n_bins") >= max(1, min_bins)) & F.col("n_samples").between(lo, hi))


def prevalence_histogram(counts: DataFrame, low: float, high: float, samples: int) -> DataFrame:
    """n_samples (0..samples, all present), n_kmers, selected: over all hashes, before any filter."""
    lo, hi = prevalence_window(low, high, samples)
    axis = counts.sparkSession.range(samples + 1).select(F.col("id").alias("n_samples"))
    found = counts.groupBy("n_samples").agg(F.count(F.lit(1)).alias("n_kmers"))
    return axis.join(found, "n_samples", "left").select("n_samples", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"), F.col("n_samples").between(lo, hi).alias("selected"))


def subsample(features: DataFrame, wanted: int, seed: int, hash: str = "hash") -> DataFrame:
    """About ``wanted`` features, those whose mixed hash is lowest; all if there are no more (or wanted is 0)."""
    if wanted <= 0 or (found := features.count()) <= wanted:
        return features
    with wrapping(features.sparkSession):
        return features.where(at_most_unsigned(mix64(F.col(hash).bitwiseXOR(F.lit(seed).cast("long"))), subsample_ceiling(wanted, found)))


def feature_index(features: DataFrame, hash: str = "hash") -> DataFrame:
    """col_idx: the rank of a hash as an unsigned number."""
    return dense_index(features, hash, "col_idx", unsigned=True)


def select_features(sketch: DataFrame, low: float, high: float, samples: int, min_bins: int = 2, max_features: int = 0, seed: int = 7) -> DataFrame:
    """hash, col_idx, n_samples, n_assemblies, n_bins."""
    kept = within_window(prevalence_counts(sketch), low, high, samples, min_bins)
    return feature_index(subsample(kept, max_features, seed)).select("hash", "col_idx", "n_samples", "n_assemblies", "n_bins")
