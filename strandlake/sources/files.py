"""Readers of track, alias and manifest files, and a writer of tables (sequences: ``fasta``, browser tracks: ``browser``).

All read through Spark's file sources, so any file system that Spark knows will
do; gzip is read by suffix.  Remote ranges and downloads are left to those file
systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import MANIFEST, conform
from ..functions.names import text_or_empty
from ..tables import qualified


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (as given in ``paths``), line (rises in file order, with gaps), value of text files, gzip by suffix."""
    named = spark.createDataFrame([(qualified(spark, p), p) for p in paths], "uri string, file string")
    lines = spark.read.text(paths).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("uri"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.join(named, "uri").select("file", "line", "value")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand, extra of one file."""
    return read_beds(spark, [path]).drop("file")


def read_beds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, chrom, start, end, name, score, strand, extra (array): ragged rows of 3 or more columns.

    Rows whose start or end is no number (headers, track lines) are left out; '#' is
    no comment, as names of contigs hold it.
    """
    parts = lines_of(spark, paths).select("file", F.split("value", "\t").alias("p"))
    field = lambda i: F.get("p", F.lit(i))
    rows = parts.select("file", field(0).alias("chrom"), field(1).try_cast("long").alias("start"), field(2).try_cast("long").alias("end"), F.coalesce(field(3), F.lit("")).alias("name"), F.coalesce(field(4).try_cast("double"), F.lit(0.0)).alias("score"), F.when(field(5).isin("+", "-", "."), field(5)).otherwise(".").alias("strand"), F.when(F.size("p") > 6, F.slice("p", 7, F.greatest(F.size("p") - 6, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("extra"))
    return rows.where("start IS NOT NULL AND end IS NOT NULL")


def read_gff_genes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, strand of one file."""
    return read_gffs(spark, [path]).drop("file")


def read_gffs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, chrom, start (0-based), end, name, strand of the gene rows of GFF3."""
    parts = lines_of(spark, paths).where(~F.col("value").startswith("#")).select("file", F.split("value", "\t").alias("p"))
    field = lambda i: F.get("p", F.lit(i))
    tag = lambda k: F.nullif(F.regexp_extract(field(8), f"(?:^|;){k}=([^;]*)", 1), F.lit(""))
    genes = parts.where(field(2) == "gene").select("file", field(0).alias("chrom"), F.greatest(field(3).try_cast("long") - 1, F.lit(0)).alias("start"), field(4).try_cast("long").alias("end"), F.coalesce(tag("gene_name"), tag("Name"), tag("gene_id"), tag("ID"), F.lit("")).alias("name"), F.when(field(6).isin("+", "-"), field(6)).otherwise(".").alias("strand"))
    return genes.where("start IS NOT NULL AND end IS NOT NULL")


def read_chrom_aliases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, alias, ucsc: every name of a row for its UCSC name, by file (as given in ``paths``); the first row wins, rows
    without one are left out.

    A header ('#' first) may say which column is the UCSC one.
    """
    lines = lines_of(spark, paths)
    names = F.split(F.regexp_replace("value", "^[# ]+", ""), "\t")
    header = lines.where(F.col("value").startswith("#")).groupBy("file").agg(F.min_by(F.array_position(names, "ucsc"), "line").alias("column"))
    parts = lines.where(~F.col("value").startswith("#")).join(header, "file", "left").select("file", "line", F.split("value", "\t").alias("p"), F.coalesce(F.nullif("column", F.lit(0)) - 1, F.lit(1)).cast("int").alias("at"))
    rows = parts.select("file", "line", F.trim(F.get("p", F.col("at"))).alias("ucsc"), F.posexplode("p").alias("column", "alias"))
    kept = rows.where((F.coalesce("ucsc", F.lit("")) != "") & (F.trim("alias") != ""))
    return kept.groupBy("file", F.trim("alias").alias("alias")).agg(F.min_by("ucsc", F.struct("line", "column")).alias("ucsc"))


def read_chrom_alias(spark: SparkSession, path: str) -> DataFrame:
    """alias, ucsc of one file."""
    return read_chrom_aliases(spark, [path]).select("alias", "ucsc")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's columns as text, missing ones ''; rows without a required value are left out."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    filled = raw.select(*[(text_or_empty(F.col(f"`{c}`")) if c in raw.columns else F.lit("")).alias(c) for c in MANIFEST.names])
    required = [F.col(c) != "" for c in ("assembly", "sample", "haplotype", "source", "fasta")]
    for r in required:
        filled = filled.where(r)
    return conform(filled, MANIFEST)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with ragged rows as text; spellings of missing values become ''."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[text_or_empty(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with 'NA' for missing values."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
