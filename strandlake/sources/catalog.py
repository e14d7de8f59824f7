"""Tables of a release as manifests need them: its index, its annotations, the reference's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import MANIFEST
from ..functions.names import s3_to_https, text_or_empty
from ..tables import exists

#: Fixed: how a release names haplotypes.
HAPLOTYPES = ("pat", "mat", "hap1", "hap2")


def haplotype_label(assembly: Column, number: Column) -> Column:
    """The haplotype that an assembly's name tells: its second '_' field, else its first field between '_' or '.' that is
    one, else hap1 or hap2 by the number, else ''."""
    second = F.lower(F.get(F.split(assembly, "_"), F.lit(1)))
    any_field = F.get(F.filter(F.transform(F.split(assembly, "[._]"), F.lower), lambda x: x.isin(*HAPLOTYPES)), F.lit(0))
    return F.when(second.isin(*HAPLOTYPES), second).otherwise(F.coalesce(any_field, F.when(number.isin("1", "2"), F.concat(F.lit("hap"), number)), F.lit("")))


def _first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n", order)


def _text(raw: DataFrame, column: str) -> Column:
    return text_or_empty(F.col(f"`{column}`")) if column in raw.columns else F.lit("")


def release_index(raw: DataFrame, order: str | None = None) -> DataFrame:
    """sample, haplotype, assembly, fasta, fai, gzi of each haplotype's assembly that has a sequence; an assembly's first row
    (by ``order``, or as read) counts, rows that are no haplotype (number other than 1 and 2) are left out.

    ValueError if a column is missing.
    """
    missing = [c for c in ("sample_id", "haplotype", "assembly_name", "assembly") if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    place = F.col(order) if order else F.monotonically_increasing_id()
    url = lambda c: s3_to_https(_text(raw, c))
    number = _text(raw, "haplotype")
    rows = raw.where(number.isin("1", "2")).select(_text(raw, "sample_id").alias("sample"), haplotype_label(_text(raw, "assembly_name"), number).alias("haplotype"), _text(raw, "assembly_name").alias("assembly"), url("assembly").alias("fasta"), url("assembly_fai").alias("fai"), url("assembly_gzi").alias("gzi"), place.alias("__place"))
    return _first_rows(rows.where("assembly <> '' AND sample <> '' AND fasta <> ''"), "assembly", "__place")


def annotation_index(raw: DataFrame, order: str | None = None) -> DataFrame:
    """sample, assembly, url of one kind of track; the first row of an assembly counts; nothing if the columns are not there."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = raw.select(_text(raw, "sample_id").alias("sample"), _text(raw, "assembly_name").alias("assembly"), s3_to_https(_text(raw, "location")).alias("url"), place.alias("__place"))
    return _first_rows(rows.where("assembly <> '' AND url <> ''"), "assembly", "__place")


def reference_row(spark: SparkSession, assembly: str, sample: str, fasta: str, fai: str = "", gzi: str = "", tracks: dict[str, str] | None = None) -> DataFrame:
    """The manifest's row of a reference, its tracks by the manifest's columns."""
    known = {"assembly": assembly, "sample": sample, "haplotype": "ref", "source": "t2t", "fasta": fasta, "fai": fai, "gzi": gzi, **(tracks or {})}
    return spark.createDataFrame([tuple(known.get(c, "") for c in MANIFEST.names)], MANIFEST)


def reachable(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Which of a catalog's paths are there."""
    return {p: exists(spark, p) for p in paths}


def read_contig_names(spark: SparkSession, path: str) -> DataFrame:
    """contig, ucsc: the first two columns of an alias file; the first row of a contig counts, a file that isn't there has none."""
    from .files import lines_of

    if not path or not exists(spark, path):
        return spark.createDataFrame([], "contig string, ucsc string")
    parts = lines_of(spark, [path]).where(~F.col("value").startswith("#")).select("line", F.split("value", "\t").alias("p"))
    rows = parts.where((F.size("p") > 1) & (F.col("p")[0] != "") & (F.col("p")[1] != "")).select(F.trim(F.col("p")[0]).alias("contig"), F.trim(F.col("p")[1]).alias("ucsc"), "line")
    return _first_rows(rows, "contig", "line")
