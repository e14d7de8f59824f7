"""Dense indexes and deterministic picks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unsigned_key
from ..tables import materialised, parts_of


#: Rows of a range that one task sorts.
RANGE_ROWS = 500_000


def ranged(df: DataFrame, key: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df``, written once, with ``__range``: its number of the ranges of about ``rows`` rows that quantiles of ``key`` make."""
    df = materialised(df)
    ranges = min(4096, -(-df.count() // rows))
    bounds = df.withColumn("__key", F.col(key).cast("double")).approxQuantile("__key", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    return df.withColumn("__range", F.size(F.filter(cuts, lambda b: b <= F.col(key).cast("double"))))


def running_sum(df: DataFrame, key: str, value: str, name: str, by: list[str] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """``name`` = the sum of ``value`` up to and with each row, in ascending order of ``key``, unique within ``by``.

    Summed within ranges and moved by the sums of the ranges before (a row a range), so no task sorts all rows.
    """
    keys = by or []
    cut = ranged(df, key, rows)
    sums = cut.groupBy(*keys, "__range").agg(F.sum(value).alias("__s"))
    before = sums.select(*keys, "__range", (F.sum("__s").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__s")).alias("__base"))
    own = F.sum(value).over(Window.partitionBy(*keys, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(before, [*keys, "__range"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__range", "__base", "__own")


def running_minimum_down(df: DataFrame, key: str, value: str, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``name`` = the least ``value`` of the rows whose unique ``key`` is not smaller, by ranges as ``running_sum``."""
    cut = ranged(df, key, rows)
    least = cut.groupBy("__range").agg(F.min(value).alias("__m"))
    later = least.select("__range", F.min("__m").over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    own = F.min(value).over(Window.partitionBy("__range").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(later, "__range").withColumn(name, F.least("__own", "__later")).drop("__range", "__own", "__later")


def dense_index(df: DataFrame, key: str, name: str, unsigned: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """``name`` = the 0-based rank of a unique long key, in ascending order (of unsigned values, if so)."""
    numbered = df.withColumns({"__order": unsigned_key(F.col(key)) if unsigned else F.col(key), "__one": F.lit(1).cast("long")})
    return running_sum(numbered, "__order", "__one", name, rows=rows).withColumn(name, F.col(name) - 1).drop("__order", "__one")


def tiled_index(df: DataFrame, keys: list[str], position: str, order: list[str], name: str, tile: int = 1 << 24) -> DataFrame:
    """``name`` = the 0-based rank within ``keys`` by (position, order): ranked within tiles of positions and moved by
    the tiles before, so no task sorts a whole key."""
    cut = df.withColumn("__tile", F.floor(F.col(position) / tile))
    sizes = cut.groupBy(*keys, "__tile").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*keys, "__tile", (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__tile")) - F.col("__n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*keys, "__tile").orderBy(position, *order)) - 1
    return cut.withColumn("__own", own).join(before, [*keys, "__tile"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__tile", "__base", "__own")


def grouped_index(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``name`` = the 0-based rank by (group, order): ranked within each group, then moved by the groups before,
    which are summed within ranges of groups and moved by the ranges before."""
    df = materialised(df)
    parts = parts_of(df.count())
    df = df.repartition(parts, group)
    sizes = materialised(df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")))
    cut = materialised(sizes.repartitionByRange(parts_of(sizes.count()), "__g").withColumn("__range", F.spark_partition_id()))
    ranges = cut.groupBy("__range").agg(F.sum("__n").alias("__s"))
    ranges = ranges.select("__range", (F.sum("__s").over(Window.orderBy("__range")) - F.col("__s")).alias("__low"))
    within = F.sum("__n").over(Window.partitionBy("__range").orderBy("__g")) - F.col("__n")
    before = cut.withColumn("__within", within).join(F.broadcast(ranges), "__range").select("__g", (F.col("__low") + F.col("__within")).alias("__base"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.join(before, F.col(group) == F.col("__g")).withColumn(name, F.col("__base") + own).drop("__g", "__base")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def modal(df: DataFrame, keys: list[str], value: str, count: str = "support") -> DataFrame:
    """keys, value, count: the most frequent value of each group; ties go to the smallest value.

    Counted per (group, value) before anything is compared, so hot groups shrink
    to their distinct values.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))
    best = counted.groupBy(*keys).agg(F.max(count).alias("__top"))
    top = counted.join(best, keys).where(F.col(count) == F.col("__top"))
    return top.groupBy(*keys).agg(F.min(value).alias(value), F.max(count).alias(count))


def merge_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which the right side's columns replace those of the same name."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    return left.drop(*shared).join(right, keys, "left")
