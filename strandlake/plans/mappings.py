"""Projections of the driver's tables onto this engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import parts_of

ASCII = "".join(map(chr, range(1, 128)))
BASES = "".join("ACGT"[ord(c) % 4] for c in ASCII)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidence_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for tables of a row a line item (counted from the footers)."""
    return parts_of(table(spark, sf_dir, "lineitem").count())


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin (order), hash (part), assembly (customer), sample (nation), from lineitem, orders and customer.

    Both sides of the join by order are made distinct in its partitions, so what it makes is, too.
    """
    parts = incidence_parts(spark, sf_dir)
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    ordered = orders.select(F.col("o_orderkey").alias("bin"), F.col("o_custkey").alias("assembly"))
    owned = customers.select(F.col("c_custkey").alias("assembly"), F.col("c_nationkey").alias("sample"))
    placed = ordered.join(owned, "assembly").select("bin", "assembly", "sample").repartition(parts, "bin").distinct()
    held = lines.select(F.col("l_orderkey").alias("bin"), F.col("l_partkey").alias("hash")).repartition(parts, "bin").distinct()
    return held.join(placed, "bin").select("bin", "hash", "assembly", "sample")


INCIDENCE_SQL = "incidence AS (SELECT DISTINCT l_orderkey AS bin, l_partkey AS hash, o_custkey AS assembly, c_nationkey AS sample FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assembly (document), sample (source), chrom (language), seq: ASCII codes mod 4 as bases, else N."""
    bases = F.translate(F.regexp_replace("text", "[^\\x01-\\x7F]", "Ñ"), ASCII + "Ñ", BASES + "N")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("assembly"), F.col("source").alias("sample"), F.col("lang").alias("chrom"), bases.alias("seq"))


_QUOTED = ASCII.replace("'", "''")
SEQUENCES_SQL = f"sequences AS (SELECT doc_id AS assembly, source AS sample, lang AS chrom, translate(regexp_replace(text, '[^\\x01-\\x7F]', 'Ñ', 'g'), '{_QUOTED}Ñ', '{BASES}N') AS seq FROM documents)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig (user), start, end (seconds; the length follows the value), feature (event type)."""
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), start.alias("start"), (start + 600 + F.floor(F.abs("value") * 60)).alias("end"), F.col("event_type").alias("feature"))


INTERVALS_SQL = "intervals AS (SELECT user_id AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 600 + CAST(floor(abs(value) * 60) AS BIGINT) AS \"end\", event_type AS feature FROM events)"
