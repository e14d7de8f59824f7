"""Sketches of assemblies from a manifest of files, one restartable unit an assembly.

Contigs are planned as a table, placed on chromosomes by each assembly's own alias
file (whose answer is authoritative) or else by their names, filtered, and only then
read.  A bin lies whole in one row of bases, so bins and their hashes come from one
pass without a shuffle.

Tables under the folder are partitioned by assembly, and a run overwrites just the
assemblies it made.  A mark is written last; it holds a digest of the settings and of
the input files, and rows of bins count only if their digest is their assembly's.  A
file that cannot be read fails its assembly alone.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_chrom, ucsc_chrom, ucsc_placed
from ..sources import fasta
from ..sources.files import read_chrom_aliases
from ..tables import exists, materialised, status_of
from .sketch import bin_sketch, contig_filter, kept_bins

MARK = "assembly string, params string, status string, error string, n_bins long, n_hashes long, n_contigs long, seconds double"

BINS = "bin_idx int, bin_uid string, sample string, haplotype string, source string, contig string, chrom string, placed boolean, start long, end long, n_acgt long, n_kmers long, n_sketch int, gc float, nfrac float, params string, hashes array<bigint>, assembly string"


def placement(contigs: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``contigs`` with chrom ('' if unknown) and placed, by the alias table (assembly, alias, ucsc) or else the contig's name."""
    if aliases is None:
        named = contigs.withColumn("__name", F.col("contig"))
    else:
        keyed = aliases.select(F.col("assembly").alias("__a"), F.col("alias").alias("__alias"), "ucsc")
        named = contigs.join(keyed, (F.col("assembly") == F.col("__a")) & (F.col("contig") == F.col("__alias")), "left")
        named = named.withColumn("__name", F.coalesce("ucsc", "contig")).drop("__a", "__alias", "ucsc")
    return named.withColumns({"chrom": ucsc_chrom(F.col("__name")), "placed": ucsc_placed(F.col("__name"))}).drop("__name")


def contig_of(contigs: DataFrame, aliases: DataFrame | None, chrom: str) -> str:
    """The first contig whose alias is ``chrom``, or else the one of that name; KeyError if there is neither."""
    hits = contigs.withColumn("rank", F.when(F.col("contig") == chrom, 1))
    if aliases is not None:
        found = aliases.where(F.col("ucsc") == chrom).select(F.col("alias").alias("contig"), F.lit(0).alias("by_alias")).distinct()
        hits = hits.join(found, "contig", "left").withColumn("rank", F.coalesce("by_alias", "rank"))
    first = hits.where("rank IS NOT NULL").orderBy("rank", "ordinal").select("contig").take(1)
    if not first:
        raise KeyError(chrom)
    return first[0][0]


def wanted_contigs(chroms: list[str], include_unplaced: bool = False) -> Column:
    """Contigs of the chromosomes, by chromosome name or by the contig's own; none given means all."""
    literal = [c.strip() for c in chroms if c.strip()]
    if not literal:
        return F.lit(True)
    spark = SparkSession.getActiveSession()
    known = spark.createDataFrame([(c,) for c in literal], "c string").select(normalize_chrom(F.col("c"))).collect()
    names = [r[0] for r in known if r[0]]
    return contig_filter(F.col("chrom"), F.col("contig"), [*literal, *names], include_unplaced)


def _params(spark: SparkSession, row, settings: dict) -> str:
    """Digest of the settings and of the assembly's files by path, size and time."""
    files = [(c, row[c], status_of(spark, row[c])) for c in ("fasta", "fai", "gzi", "chrom_alias") if row[c]]
    return hashlib.sha256(json.dumps([settings, files], sort_keys=True).encode()).hexdigest()


def _aliases(spark: SparkSession, rows: list) -> DataFrame | None:
    """assembly, alias, ucsc of the rows that name an alias file."""
    named = [(r["assembly"], r["chrom_alias"]) for r in rows if r["chrom_alias"]]
    if not named:
        return None
    read = read_chrom_aliases(spark, sorted({p for _, p in named}))
    return read.join(spark.createDataFrame(named, "assembly string, file string"), "file").select("assembly", "alias", "ucsc")


def sketch_manifest(manifest: DataFrame, folder: str, k: int = 31, bin_size: int = 10_000, scaled: int = 200, min_acgt: float = 0.5, min_sketch: int = 5, drop_partial: bool = True, chroms: list[str] = (), include_unplaced: bool = False, force: bool = False, block_size: int = fasta.RANGE) -> DataFrame:
    """Sketch each row of ``manifest`` into ``folder``; returns ordinal, MARK's columns and ``cached`` in manifest order.

    The manifest (assembly, sample, haplotype, source, fasta, fai, gzi, chrom_alias;
    an ``ordinal`` if it has one) is a table of hundreds of rows and held by the driver.
    """
    spark, began = manifest.sparkSession, time.time()
    missing = [c for c in ("assembly", "fasta") if c not in manifest.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    fill = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in manifest.columns else F.lit("")).alias(c) for c in ("assembly", "sample", "haplotype", "source", "fasta", "fai", "gzi", "chrom_alias")]
    listed = manifest.orderBy("ordinal").select(*fill).collect() if "ordinal" in manifest.columns else manifest.select(*fill).collect()
    rows = list({r["assembly"]: r for r in reversed(listed)}.values())[::-1]  # the first row of an assembly counts
    settings = dict(k=k, bin_size=bin_size, scaled=scaled, min_acgt=min_acgt, min_sketch=min_sketch, drop_partial=drop_partial, chroms=sorted(chroms), include_unplaced=include_unplaced, format=1)
    params = {r["assembly"]: _params(spark, r, settings) for r in rows}
    before = {} if force else {m["assembly"]: m for m in marks(spark, folder).collect()}
    cached = {a for a in params if a in before and before[a]["params"] == params[a] and before[a]["status"] == "ok"}
    pending = [r for r in rows if r["assembly"] not in cached]
    made: dict = {}
    failed = {r["assembly"]: f"FileNotFoundError: {r['chrom_alias']}" for r in pending if r["chrom_alias"] and not exists(spark, r["chrom_alias"])}
    failed |= {r["assembly"]: "ValueError: no assembly name" if not r["assembly"] else "ValueError: no fasta" for r in pending if not r["assembly"] or not r["fasta"]}
    able = [r for r in pending if r["assembly"] not in failed]
    if able:
        made, broken = _sketch(spark, able, params, folder, settings, block_size)
        failed |= broken
    seconds = round(time.time() - began, 3)
    told = [(r["assembly"], params[r["assembly"]], "failed", failed[r["assembly"]], 0, 0, 0, seconds) if r["assembly"] in failed else (r["assembly"], params[r["assembly"]], "ok", "", *made.get(r["assembly"], (0, 0, 0)), seconds) for r in pending]
    kept = [t for t in told if t[0]]
    if kept:
        spark.createDataFrame(kept, MARK).repartition("assembly").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assembly").parquet(f"{folder}/marks")
    told = {t[0]: (*t, False) for t in told} | {a: (*(before[a][c] for c in ("assembly", "params", "status", "error", "n_bins", "n_hashes", "n_contigs")), 0.0, True) for a in cached}
    return spark.createDataFrame([(i, *told[r["assembly"]]) for i, r in enumerate(rows)], f"ordinal int, {MARK}, cached boolean")


def _sketch(spark: SparkSession, rows: list, params: dict, folder: str, settings: dict, block_size: int):
    """Write bins and hashes of the rows; returns ({assembly: counts}, {assembly: error})."""
    k, bin_size = settings["k"], settings["bin_size"]
    size = bin_size * max(1, block_size // bin_size)
    files = spark.createDataFrame([(*(r[c] for c in ("assembly", "sample", "haplotype", "source", "fasta", "fai", "gzi")), params[r["assembly"]]) for r in rows], "assembly string, sample string, haplotype string, source string, fasta string, fai string, gzi string, params string")
    aliases = _aliases(spark, rows)
    if aliases is not None:
        aliases = materialised(aliases)
    keep = F.col("contig").isNull() | wanted_contigs(settings["chroms"], settings["include_unplaced"])
    contigs = placement(fasta.contig_table(files), aliases).where(keep).drop("chrom", "placed")
    bases = fasta.read_bases(fasta.base_ranges(contigs, size), size, k - 1)
    # an error travels as a bin without bases, so that the files are read once
    bases = bases.withColumn("block", F.coalesce("block", F.lit(b"N")))
    binned = materialised(bin_sketch(bases, k, bin_size, settings["scaled"], size, ["assembly", "contig", "ordinal", "error"]))
    broken = {r[0]: r[1] for r in binned.where("error IS NOT NULL").groupBy("assembly").agg(F.min("error")).collect()}
    whole = binned.where("error IS NULL").where(~F.col("assembly").isin(*broken)) if broken else binned
    placed = placement(whole, aliases).where(keep)  # streamed contigs are placed only now
    kept = kept_bins(placed, bin_size, settings["min_acgt"], settings["min_sketch"], settings["drop_partial"])
    bins = bin_columns(kept.join(files.select("assembly", "sample", "haplotype", "source", "params"), "assembly"), "ordinal", "params")
    bins.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assembly").parquet(f"{folder}/bins")
    written = spark.read.schema(BINS).parquet(f"{folder}/bins").where(F.col("assembly").isin(*[r["assembly"] for r in rows]))
    fresh = written.join(files.select("assembly", "params"), ["assembly", "params"], "left_semi")
    counts = fresh.groupBy("assembly").agg(F.count(F.lit(1)), F.sum("n_sketch"), F.countDistinct("contig")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in counts}, broken


def bin_columns(binned: DataFrame, ordinal: str = "contig", *more: str) -> DataFrame:
    """Kept rows of ``bin_sketch`` as the table of bins: bin_idx is dense within an assembly, by contig (``ordinal``) and start."""
    order = Window.partitionBy("assembly").orderBy(ordinal, "contig", "start")  # an assembly has as many bins as its bases allow
    end, indexed = F.col("start") + F.col("span"), binned.withColumn("bin_idx", F.row_number().over(order) - 1)
    return indexed.select("assembly", "bin_idx", F.concat_ws("|", "assembly", "contig", "start").alias("bin_uid"), "sample", "haplotype", "source", "contig", "chrom", "placed", "start", end.alias("end"), "n_acgt", "n_kmers", F.size("hashes").alias("n_sketch"), F.when(F.col("n_acgt") > 0, F.col("n_gc") / F.col("n_acgt")).cast("float").alias("gc"), (1 - F.col("n_acgt") / F.col("span")).cast("float").alias("nfrac"), *more, "hashes")


def marks(spark: SparkSession, folder: str) -> DataFrame:
    if not exists(spark, f"{folder}/marks"):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).parquet(f"{folder}/marks")


def read_bins(spark: SparkSession, folder: str) -> DataFrame:
    """The bins of assemblies that are done, with their ``hashes``."""
    done = marks(spark, folder).where("status = 'ok'").select("assembly", "params")
    bins = spark.read.schema(BINS).parquet(f"{folder}/bins") if exists(spark, f"{folder}/bins") else spark.createDataFrame([], BINS)
    return bins.join(done, ["assembly", "params"], "left_semi").drop("params")


def read_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """assembly, sample, bin_uid, hash: a bin's hashes as rows."""
    return read_bins(spark, folder).select("assembly", "sample", "bin_uid", F.explode("hashes").alias("hash"))
