"""Annotation tracks of assemblies: which apply, reading them by kind, and a table of parsed tracks that outlives a run.

Tracks of a kind are read together in one job; if that fails, each is read by itself,
so one that cannot be read gives a status row and leaves the others.  Parsed tracks
are partitioned by a digest of kind, path, size, time and contigs, and read again only
if that changes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import EXTRA_CLASSES, censat_class, repeat_class, text_or_empty
from ..sources.files import read_beds, read_gffs
from ..tables import exists, status_of

#: Fixed: the manifest's column of each kind of an assembly's tracks.
TRACK_COLUMNS = {"censat": "censat_bed", "repeatmasker": "repeatmasker_bed", "segdup": "segdup_bed"}
STATUS = "kind string, path string, digest string, status string, error string, intervals long"
INTERVALS = "contig string, start long, end long, feature string, digest string"


def is_reference() -> Column:
    return (F.lower("source") == "t2t") | (F.col("haplotype") == "ref")


def track_plan(manifest: DataFrame, reference_tracks: list[str], assembly_tracks: list[str], catalog: dict[str, str] | None = None, annotate_assemblies: bool = False) -> DataFrame:
    """assembly, kind, path: the tracks of each row of the manifest.

    A reference takes the manifest's own path before the catalog's; other assemblies
    take theirs only if ``annotate_assemblies``.
    """
    own = lambda kind: text_or_empty(F.col(TRACK_COLUMNS[kind])) if TRACK_COLUMNS.get(kind) in manifest.columns else F.lit("")
    given = lambda kind: F.lit((catalog or {}).get(kind, ""))
    listed = lambda kinds, path: F.array(*[F.struct(F.lit(k).alias("kind"), path(k).alias("path")) for k in kinds]) if kinds else F.array().cast("array<struct<kind:string,path:string>>")
    reference = listed(reference_tracks, lambda k: F.when(own(k) != "", own(k)).otherwise(given(k)))
    others = listed(assembly_tracks if annotate_assemblies else [], own)
    planned = manifest.select("assembly", F.inline(F.when(is_reference(), reference).otherwise(others)))
    return planned.where("path <> ''")


def parsed(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """path, contig, start, end, feature of tracks of one kind; GFF by its suffix, intervals without a feature left out.

    ValueError if the kind is not known.
    """
    genes = [p for p in paths if kind == "gene" or p.lower().removesuffix(".gz").endswith((".gff", ".gff3"))]
    beds = [p for p in paths if p not in genes]
    if beds and kind not in ("censat", "repeatmasker", *EXTRA_CLASSES):
        raise ValueError(f"unknown kind of track: {kind}")
    parts = [read_gffs(spark, genes).withColumn("feature", F.lit("gene"))] if genes else []
    if beds:
        extra = lambda i: F.coalesce(F.get("extra", F.lit(i)), F.lit(""))
        feature = censat_class(F.col("name")) if kind == "censat" else repeat_class(extra(0), extra(1)) if kind == "repeatmasker" else F.lit(kind)
        parts.append(read_beds(spark, beds).withColumn("feature", feature))
    columns = ["file", "chrom", "start", "end", "feature"]
    rows = parts[0].select(*columns) if len(parts) == 1 else parts[0].select(*columns).unionByName(parts[1].select(*columns))
    return rows.where("feature <> ''").select(F.col("file").alias("path"), F.col("chrom").alias("contig"), "start", "end", "feature")


def load_tracks(plan: DataFrame, contigs: DataFrame, folder: str) -> DataFrame:
    """assembly and STATUS's columns for each planned track, with the intervals of all that could be read under ``folder``.

    ``contigs`` (assembly, contig): only their intervals are kept.  The plan is a table of
    a few rows an assembly, and held by the driver.
    """
    spark = plan.sparkSession
    wanted = plan.join(contigs.select("assembly", "contig").distinct(), "assembly", "left").groupBy("kind", "path").agg(F.sort_array(F.collect_set("contig")).alias("contigs"))
    hashed = {(r["kind"], r["path"]): r["h"] for r in wanted.select("kind", "path", F.sha1(F.concat_ws("\n", "contigs")).alias("h")).collect()}
    digest = {(k, p): hashlib.sha1(repr((k, p, status_of(spark, p), h)).encode()).hexdigest()[:20] for (k, p), h in hashed.items()}
    marks = f"{folder}/marks"
    known = {r["digest"]: r for r in spark.read.schema(STATUS).parquet(marks).where("status = 'ok'").collect()} if exists(spark, marks) else {}
    told, by_kind = {}, {}
    for key, d in digest.items():
        if d in known:
            told[key] = (*key, d, "ok", "", known[d]["intervals"])
        elif not exists(spark, key[1]):
            told[key] = (*key, d, "failed", f"FileNotFoundError: {key[1]}", 0)
        else:
            by_kind.setdefault(key[0], []).append(key[1])

    def load(kind: str, paths: list[str]) -> None:
        keyed = spark.createDataFrame([(p, digest[kind, p]) for p in paths], "path string, digest string")
        places = wanted.where(F.col("kind") == kind).select("path", F.explode("contigs").alias("contig"))
        rows = parsed(spark, kind, paths).join(places, ["path", "contig"], "left_semi").join(keyed, "path")
        rows.select(*[f"`{f.split()[0]}`" for f in INTERVALS.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest").parquet(f"{folder}/intervals")
        found = intervals(spark, folder).where(F.col("digest").isin(*[digest[kind, p] for p in paths])).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["digest"]: r["n"] for r in found.collect()}
        for p in paths:
            told[kind, p] = (kind, p, digest[kind, p], "ok", "", counts.get(digest[kind, p], 0))

    for kind, paths in sorted(by_kind.items()):
        try:
            load(kind, paths)
        except Exception:  # one of them: each by itself
            for p in paths:
                try:
                    load(kind, [p])
                except Exception as error:  # told as a row: the other tracks go on
                    told[kind, p] = (kind, p, digest[kind, p], "failed", f"{type(error).__name__}: {error}"[:500].replace("\n", " "), 0)
    status = spark.createDataFrame(list(told.values()), STATUS)
    fresh = [t for t in told.values() if t[3] == "ok" and t[2] not in known]
    if fresh:
        spark.createDataFrame(fresh, STATUS).repartition("digest").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest").parquet(marks)
    return plan.join(status, ["kind", "path"]).select("assembly", *[f.split()[0] for f in STATUS.split(", ")])


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    if not exists(spark, f"{folder}/intervals"):
        return spark.createDataFrame([], INTERVALS)
    return spark.read.schema(INTERVALS).parquet(f"{folder}/intervals")


def loaded(status: DataFrame, folder: str) -> DataFrame:
    """assembly, contig, start, end, feature of the tracks that could be read."""
    good = status.where("status = 'ok'").select("assembly", "digest").distinct()
    return intervals(status.sparkSession, folder).join(good, "digest").select("assembly", "contig", "start", "end", "feature")
