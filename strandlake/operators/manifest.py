"""Choice of assemblies: where they come from, filters, balanced order, caps."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import MANIFEST, conform
from ..functions.names import superpopulation
from ..sources.catalog import HAPLOTYPES, annotation_index, release_index
from ..sources.files import read_catalog, read_manifest

#: Suffixes of sequence files.
FASTA_SUFFIXES = (".fa.gz", ".fasta.gz", ".fa", ".fasta")


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One row a FASTA file of a folder: its stem is the assembly, a last ``_pat``, ``_mat``, ``_hap1`` or ``_hap2`` in it
    the haplotype (hap1 if there is none), what precedes that the sample; indexes beside a file are named."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target) or not system.getFileStatus(target).isDirectory():
        raise NotADirectoryError(folder)
    names = {s.getPath().getName() for s in system.listStatus(target) if s.isFile()}
    base = folder.rstrip("/")
    beside = lambda n, end: f"{base}/{n}{end}" if n + end in names else ""
    found = [(n, f"{base}/{n}", beside(n, ".fai"), beside(n, ".gzi")) for n in sorted(names) if n.endswith(FASTA_SUFFIXES)]
    rows = spark.createDataFrame(found, "name string, fasta string, fai string, gzi string")
    stem = F.regexp_replace("name", "[.](fa|fasta)([.]gz)?$", "")
    pattern = "(?i)^(.+)_(" + "|".join(HAPLOTYPES) + ")(_.*)?$"
    rows = rows.withColumn("assembly", stem).withColumns({"sample": F.regexp_extract("assembly", pattern, 1), "haplotype": F.lower(F.regexp_extract("assembly", pattern, 2))})
    named = rows.select("assembly", F.when(F.col("sample") == "", F.col("assembly")).otherwise(F.col("sample")).alias("sample"), F.when(F.col("haplotype") == "", "hap1").otherwise(F.col("haplotype")).alias("haplotype"), F.lit("local").alias("source"), "fasta", "fai", "gzi")
    return conform(named.select("*", *[F.lit("").alias(c) for c in MANIFEST.names if c not in named.columns]), MANIFEST)


def from_release(spark: SparkSession, index: str, annotations: dict[str, str], metadata: str) -> DataFrame:
    """The manifest of a release: its index, one table for each annotation column, and samples' metadata; the index and
    the tables as the release publishes them (``catalog.release_index``), or with the manifest's own names."""
    rows, tables = read_catalog(spark, index), {c: read_catalog(spark, p) for c, p in annotations.items()}
    if "assembly_name" in rows.columns:
        rows = release_index(rows).withColumn("source", F.lit("hprc"))
    joined = with_metadata(rows, {c: annotation_index(t) if "location" in t.columns else t for c, t in tables.items()}, read_catalog(spark, metadata))
    return conform(joined.select("*", *[F.lit("").alias(c) for c in MANIFEST.names if c not in joined.columns]), MANIFEST)


def build_manifest(spark: SparkSession, config, reference: DataFrame | None = None, complete: DataFrame | None = None) -> DataFrame:
    """The manifest that a configuration's section asks for, with ``ordinal``: source, filters, caps, reference first.

    ``complete``: the release's chromosome table (assembly, chrom, level, num_gaps), for ``require_complete``.
    """
    if config.source == "file":
        rows = read_manifest(spark, config.path)
    elif config.source == "folder":
        rows = from_folder(spark, config.path)
    elif config.source == "release":
        rows = from_release(spark, f"{config.path}/index.csv", {c: f"{config.path}/{c}.csv" for c in config.annotation_tables}, f"{config.path}/samples.csv")
    else:
        raise ValueError(f"unknown source of the manifest: {config.source}")
    rows = filtered(rows, list(config.samples), list(config.exclude_samples), list(config.populations), list(config.require_annotations))
    if config.require_complete and complete is not None:
        rows = complete_only(rows, complete, list(config.chroms))
    return finalized(capped(rows, config.max_samples, config.max_assemblies, config.seed), reference)


def with_metadata(index: DataFrame, annotations: dict[str, DataFrame], metadata: DataFrame) -> DataFrame:
    """index ⟕ one table (assembly, url) per annotation column ⟕ metadata by sample; missing values are ''."""
    out = index
    for column, urls in annotations.items():
        out = out.join(urls.select("assembly", F.col("url").alias(column)).dropDuplicates(["assembly"]), "assembly", "left")
    out = out.join(metadata.select("sample", "population", "sex").dropDuplicates(["sample"]), "sample", "left")
    out = out.withColumn("superpopulation", superpopulation(F.col("population")))
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in out.columns])


def filtered(rows: DataFrame, samples: list[str] = (), exclude: list[str] = (), populations: list[str] = (), required: list[str] = (), release_source: str = "hprc") -> DataFrame:
    """Allowed, not denied, of a population or superpopulation, with the annotations asked for (of the release's rows only)."""
    if samples:
        rows = rows.where(F.col("sample").isin(*samples))
    if exclude:
        rows = rows.where(~F.col("sample").isin(*exclude))
    if populations:
        wanted = [p.upper() for p in populations]
        rows = rows.where(F.upper("population").isin(*wanted) | F.upper("superpopulation").isin(*wanted))
    for column in required:
        rows = rows.where((F.col("source") != release_source) | (F.col(column) != ""))
    return rows


def complete_only(rows: DataFrame, chromosomes: DataFrame, wanted: list[str], release_source: str = "hprc") -> DataFrame:
    """Rows whose assembly has all wanted chromosomes without gaps; other sources pass."""
    have = chromosomes.where((F.col("level") == "contig") & (F.coalesce(F.col("num_gaps").try_cast("int"), F.lit(1)) == 0) & F.col("chrom").isin(*wanted))
    whole = have.groupBy("assembly").agg(F.countDistinct("chrom").alias("k")).where(F.col("k") == len(wanted)).select("assembly")
    return rows.where(F.col("source") != release_source).unionByName(rows.where(F.col("source") == release_source).join(whole, "assembly", "left_semi"))


def deduplicated(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each assembly, in manifest order."""
    w = Window.partitionBy("assembly").orderBy(ordinal)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sample_key(seed: int):
    """The first 8 bytes of BLAKE2b of ``seed:sample``: bytes order as the unsigned number does."""

    @F.pandas_udf("binary")
    def key(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: hashlib.blake2b(f"{seed}:{s}".encode(), digest_size=8).digest())

    return key(F.col("sample"))


def sample_order(rows: DataFrame, seed: int = 7) -> DataFrame:
    """sample, place: round-robin over superpopulations in order of name, within one samples with two or more
    haplotypes first, then by the seeded digest; samples without a superpopulation last.

    A sample's superpopulation is that of its first row (by ``ordinal`` if there is one, else by assembly).
    """
    first = "ordinal" if "ordinal" in rows.columns else "assembly"
    samples = rows.groupBy("sample").agg(F.coalesce(F.min_by("superpopulation", first), F.lit("")).alias("superpopulation"), F.countDistinct("haplotype").alias("haplotypes"))
    keyed = samples.withColumn("key", sample_key(seed))
    turn = F.row_number().over(Window.partitionBy("superpopulation").orderBy(F.desc(F.col("haplotypes") >= 2), "key", "sample"))
    dealt = keyed.withColumn("turn", turn)
    order = Window.orderBy(F.col("superpopulation") == "", "turn", "superpopulation")
    return dealt.select("sample", (F.row_number().over(order) - 1).alias("place"))


def capped(rows: DataFrame, max_samples: int = 0, max_assemblies: int = 0, seed: int = 7) -> DataFrame:
    """At most so many samples and assemblies, along the balanced order (0: no cap)."""
    ordered = rows.join(sample_order(rows, seed), "sample")
    if max_samples:
        ordered = ordered.where(F.col("place") < max_samples)
    if max_assemblies:
        w = Window.orderBy("place", "haplotype", "assembly")
        ordered = ordered.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_assemblies).drop("__n")
    return ordered.drop("place")


def finalized(rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """With the reference row added if its assembly is absent; ``ordinal`` has it first, then sample, haplotype, assembly."""
    if reference is not None:
        rows = rows.unionByName(reference.join(rows.select("assembly"), "assembly", "left_anti"), allowMissingColumns=True)
    first = F.col("assembly").isin(*[r[0] for r in reference.select("assembly").collect()]) if reference is not None else F.lit(False)
    return rows.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc(first), "sample", "haplotype", "assembly")) - 1)


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("superpopulation").agg(F.count(F.lit(1)).alias("assemblies"), F.countDistinct("sample").alias("samples"))


def sample_codes(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """sample codes by first appearance; a row without a sample is a sample of its own."""
    named = rows.withColumn("__s", F.when(F.col("sample") == "", F.concat(F.lit("\0"), "assembly")).otherwise(F.col("sample")))
    firsts = named.groupBy("__s").agg(F.min(ordinal).alias("__o"))
    codes = firsts.withColumn("sample_code", F.row_number().over(Window.orderBy("__o")) - 1).drop("__o")
    return named.join(codes, "__s").drop("__s")
