"""Sparse bin x feature matrices as (row, col_idx, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialised, parts_of
from .ranking import grouped_index


def entries(sketch: DataFrame, features: DataFrame, row: str = "bin", hash: str = "hash", partitions: int | None = None) -> DataFrame:
    """row, col_idx: each selected feature of each bin once; other hashes fall out of the join, into ``partitions`` if given."""
    if not partitions:
        return sketch.select(row, hash).join(features.select(hash, "col_idx"), hash).select(row, "col_idx").distinct()
    met = sketch.select(row, hash).repartition(partitions, hash).join(features.select(hash, "col_idx"), hash)
    return met.select(row, "col_idx").repartition(partitions, "col_idx").distinct()


def checked_features(features: DataFrame) -> DataFrame:
    """``features``, if no col_idx is negative or given twice; ValueError else.  Gaps stand for columns without entries."""
    least, n, distinct = features.agg(F.min("col_idx"), F.count(F.lit(1)), F.countDistinct("col_idx")).first()
    if n and (least < 0 or n != distinct):
        raise ValueError("col_idx must not be negative, nor given twice")
    return features


def row_table(bins: DataFrame, coo: DataFrame, position: str, order: list, row: str = "bin") -> DataFrame:
    """The bins that have entries, with row_idx by (position, order)."""
    kept = bins.join(coo.select(row).distinct(), row, "left_semi")
    return grouped_index(kept, position, [F.col(c) for c in order], "row_idx")


def weigh(coo: DataFrame, how: str = "idf", row: str = "bin") -> DataFrame:
    """value = ln(rows / rows with the column), ln 2 or 1.

    Rows are those with entries: columns are counted after empty rows are gone.
    """
    if how == "none":
        return coo.withColumn("value", F.lit(1.0))
    if how == "log":
        return coo.withColumn("value", F.log1p(F.lit(1.0)))
    if how != "idf":
        raise ValueError(f"unknown weighting {how!r}")
    coo = materialised(coo)  # counted twice and weighed
    parts = parts_of(coo.count())
    rows = coo.select(row).repartition(parts, row).distinct().agg(F.count(F.lit(1)).alias("rows"))
    coo = coo.repartition(parts, "col_idx")
    df = coo.groupBy("col_idx").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(rows))
    return coo.join(df.select("col_idx", F.log(F.col("rows") / F.col("df")).alias("value")), "col_idx").select(row, "col_idx", "value")


def normalize(coo: DataFrame, how: str = "l2", row: str = "bin", partitions: int | None = None) -> DataFrame:
    """Values over their row's norm; rows of norm 0 stay as they are.  Rows meet in ``partitions`` if given."""
    if how == "none":
        return coo
    if how not in ("l1", "l2"):
        raise ValueError(f"unknown norm {how!r}")
    coo = coo.repartition(partitions, row) if partitions else coo
    # a bin's entries are bounded by its width: one shuffle by row, no join
    normed = coo.withColumn("norm", F.sum(F.abs("value")).over(Window.partitionBy(row)) if how == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(row))))
    return normed.select(row, "col_idx", (F.col("value") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("value"))


def shape_of(coo: DataFrame, n_columns: int | None = None, row: str = "bin") -> DataFrame:
    """n_rows, n_cols, nnz, per_row, density: one row of diagnostics."""
    coo = materialised(coo)
    parts = parts_of(coo.count())
    distinct = lambda c: coo.select(c).where(F.col(c).isNotNull()).repartition(parts, c).distinct().agg(F.count(F.lit(1)).alias("n"))
    found = distinct(row).withColumnRenamed("n", "n_rows").crossJoin(distinct("col_idx").withColumnRenamed("n", "used")).crossJoin(coo.agg(F.count(F.lit(1)).alias("nnz")))
    columns = F.col("used") if n_columns is None else F.lit(n_columns).cast("long")
    return found.select("n_rows", columns.alias("n_cols"), "nnz", (F.col("nnz") / F.col("n_rows")).alias("per_row"), (F.col("nnz") / (F.col("n_rows") * columns)).alias("density"))


def energy(coo: DataFrame) -> DataFrame:
    """The squared Frobenius norm, in double precision."""
    return coo.agg(F.sum(F.col("value").cast("double") * F.col("value").cast("double")).alias("energy"))
