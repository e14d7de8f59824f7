"""The staged run: manifest, sketch, select, matrix, decompose, embed, cluster, annotate, enrich, transfer, report.

A run starts from a manifest of files, or from a table of sequences.  Each stage
writes its tables under ``outdir`` beside a mark: a digest of the settings that it and
the stages before it used and of the inputs (files by path, size and time), the
stage's figures and its time.  A stage whose digest still holds is not run again, and
keeps the figures and the time of the run that made it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import html
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import FEATURES, TRACK_FEATURES
from ..operators import assemblies, dense, density, enrich, intervals, matrix, report, select, sketch, tracks, transfer
from ..operators.manifest import build_manifest, summary
from ..operators.ranking import merge_left
from ..sources import browser
from ..sources.files import write_tsv
from ..tables import drop, exists, status_of
from .config import Config

STAGES = ("manifest", "sketch", "select", "matrix", "decompose", "embed", "cluster", "annotate", "enrich", "transfer", "report")
#: Selected features of a bin under which cosine geometry is mostly ties.
LEAST_FEATURES = 10.0


class Run:
    """sequences: assembly, sample, contig, is_ref, seq, or None to start from the configured manifest (or ``manifest``);
    tracks: contig, assembly, start, end, feature, or None to take the manifest's; reference: a manifest row to come first."""

    def __init__(self, spark: SparkSession, config: Config, sequences: DataFrame | None = None, tracks: DataFrame | None = None, manifest: DataFrame | None = None, reference: DataFrame | None = None):
        self.spark, self.config, self.sequences, self.tracks, self.given, self.reference = spark, config, sequences, tracks, manifest, reference
        self.summary: dict[str, dict] = {}
        self._known: str | None = None

    # tables -------------------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.config.outdir.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def write_text(self, text: str, name: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(self.path(name))

    def _inputs(self) -> str:
        """Digest of what the run reads: files by path, size and time, tables that have none by their plan."""
        if self._known is None:
            said: list = []
            for df in (self.sequences, self.tracks, self.given, self.reference):
                files = sorted(df.inputFiles()) if df is not None else []
                said.append([[f, *status_of(self.spark, f)] for f in files] or (None if df is None else df.semanticHash()))
            said.append(status_of(self.spark, self.config.manifest.path) if self.config.manifest.path else None)
            self._known = hashlib.sha256(json.dumps(said).encode()).hexdigest()
        return self._known

    def _digest(self, stage: str) -> str:
        before = STAGES[: STAGES.index(stage) + 1]
        used = [dataclasses.asdict(getattr(self.config, s)) for s in before if hasattr(self.config, s)]
        return hashlib.sha256(json.dumps([stage, self._inputs(), used], sort_keys=True, default=str).encode()).hexdigest()

    def _mark(self, stage: str):
        path = self.path(f"_done/{stage}")
        return self.spark.read.schema("digest string, detail string, seconds double").json(path).first() if exists(self.spark, path) else None

    def run_stage(self, stage: str, forced: bool = False) -> dict:
        mark = None if forced else self._mark(stage)
        if mark is not None and mark["digest"] == self._digest(stage):
            self.summary[stage] = {"seconds": mark["seconds"], "cached": True, **json.loads(mark["detail"])}
            return self.summary[stage]
        drop(self.spark, self.path(f"_done/{stage}"))  # a stage that breaks off is not done
        began = time.time()
        detail = getattr(self, stage)() or {}
        seconds = round(time.time() - began, 3)
        self.spark.createDataFrame([(self._digest(stage), json.dumps(detail, default=str), seconds)], "digest string, detail string, seconds double").coalesce(1).write.mode("overwrite").json(self.path(f"_done/{stage}"))
        self.summary[stage] = {"seconds": seconds, "cached": False, **detail}
        return self.summary[stage]

    def run(self, force_from: str | None = None) -> dict[str, dict]:
        forced = False
        for stage in STAGES:
            forced = forced or stage == force_from
            forced = not self.run_stage(stage, forced)["cached"] or forced
        return self.summary

    # stages -------------------------------------------------------------------

    def manifest(self) -> dict:
        if self.sequences is not None:
            rows = self.sequences.groupBy("assembly").agg(F.min("sample").alias("sample"), F.max("is_ref").alias("is_ref"))
            rows = rows.select("assembly", "sample", F.when(F.col("is_ref"), "ref").otherwise("").alias("haplotype"), F.when(F.col("is_ref"), "t2t").otherwise("table").alias("source"), F.lit("").alias("superpopulation"))
        else:
            rows = self.given if self.given is not None else build_manifest(self.spark, self.config.manifest, self.reference)
        rows = self.write(rows, "manifest")
        return {"assemblies": rows.count(), "groups": {r["superpopulation"]: r["assemblies"] for r in summary(rows).collect()}}

    def sketch(self) -> dict:
        c, chroms, failed = self.config.sketch, list(self.config.manifest.chroms), 0
        if self.sequences is None:
            status = assemblies.sketch_manifest(self.read("manifest"), self.path("sketch"), c.k, c.bin_size, c.scaled, c.min_bin_acgt_frac, c.min_bin_sketch, c.drop_partial_terminal_bin, chroms, c.include_unplaced)
            failed = self.write(status, "sketch_status").where("status <> 'ok'").count()
            binned = assemblies.read_bins(self.spark, self.path("sketch"))
        else:
            size = c.bin_size * max(1, sketch.BLOCK // c.bin_size)
            keys = ["assembly", "sample", "contig"]
            made = sketch.bin_sketch(sketch.blocks(self.sequences.where(F.length("seq") > 0), c.k, size, keys), c.k, c.bin_size, c.scaled, size, keys)
            placed = assemblies.placement(made, None).where(assemblies.wanted_contigs(chroms, c.include_unplaced))
            kept = sketch.kept_bins(placed, c.bin_size, c.min_bin_acgt_frac, c.min_bin_sketch, c.drop_partial_terminal_bin)
            about = self.read("manifest").select("assembly", "haplotype", "source")
            binned = assemblies.bin_columns(kept.join(about, "assembly"))
        binned = self.write(binned.withColumn("is_ref", tracks.is_reference()), "binned")
        return {"bins": binned.count(), "failed": failed}

    def _rows(self) -> DataFrame:
        """The bins, without their hashes."""
        return self.read("binned").drop("hashes")

    def _sketch(self) -> DataFrame:
        return self.read("binned").select(F.col("bin_uid").alias("bin"), F.explode("hashes").alias("hash"), "assembly", "sample")

    def select(self) -> dict:
        c = self.config.select
        samples = self.read("manifest").select("sample").distinct().count()  # also those without a bin
        counts = self.write(select.prevalence_counts(self._sketch()), "prevalence_counts")
        self.write(select.prevalence_histogram(counts, c.min_sample_prevalence, c.max_sample_prevalence, samples), "prevalence")
        kept = select.within_window(counts, c.min_sample_prevalence, c.max_sample_prevalence, samples, c.min_bins)
        found = select.feature_index(select.subsample(kept, c.max_features, c.seed)).select("hash", "col_idx", "n_samples", "n_assemblies", "n_bins")
        return {"features": self.write(found, "features").count()}

    def matrix(self) -> dict:
        c = self.config.matrix
        coo = self.write(matrix.entries(self._sketch(), matrix.checked_features(self.read("features"))), "entries")
        rows = matrix.row_table(self._rows().withColumn("bin", F.col("bin_uid")), coo, "assembly", ["contig", "start"])
        rows = self.write(rows.drop("bin"), "rows")
        weighed = matrix.normalize(matrix.weigh(coo, c.weighting), c.row_norm)
        self.write(weighed.join(rows.select(F.col("bin_uid").alias("bin"), "row_idx"), "bin").select(F.col("row_idx").alias("row"), "col_idx", "value"), "matrix")
        shape = matrix.shape_of(coo, self.read("features").count()).first()
        per_row = round(shape["per_row"] or 0.0, 3)
        return {"rows": rows.count(), "nnz": shape["nnz"], "per_row": per_row, "density": shape["density"], "too_sparse": bool(shape["n_rows"]) and per_row < LEAST_FEATURES}

    def decompose(self) -> dict:
        c = self.config.decompose
        pcs, info = dense.truncated_svd(self.read("matrix"), self.read("features").count(), self.read("rows").count(), c.n_components, c.n_oversamples, c.n_iter, c.drop_first, c.seed)
        self.write(pcs, "pcs")
        self.write_text(json.dumps({k: info[k] for k in ("singular_values", "energy_ratio")}), "svd.json")
        return {"energy": round(sum(info["energy_ratio"]), 6)}

    def embed(self) -> dict:
        c = self.config.embed
        odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        pcs = self.read("pcs")
        zeroed = pcs.agg(F.sum(F.size(F.filter("pcs", odd)))).first()[0] or 0
        clean = F.transform("pcs", lambda x: F.when(odd(x), 0.0).otherwise(x))
        vectors = pcs.select(F.col("row").alias("id"), clean.alias("vector"))
        placed = dense.layout(vectors, c.n_neighbors, min(1.0, max(0.0, c.min_dist)), c.metric, c.n_components, seed=c.seed, max_fit_rows=c.max_fit_rows)
        return {"points": self.write(placed, "layout").count(), "zeroed": zeroed}

    def cluster(self) -> dict:
        c = self.config.cluster
        points = self.read("layout").select("id", F.col("position").alias("p")) if c.space == "embedding" else self.read("pcs").select(F.col("row").alias("id"), F.col("pcs").alias("p"))
        if c.method == "hdbscan":
            found = density.hdbscan(points, c.min_cluster_size, c.min_samples, c.cluster_selection_method, c.cluster_selection_epsilon, c.max_fit_rows, c.seed)
        else:
            found = density.dbscan(points, c.eps, c.min_samples, self.config.embed.n_components)
        rows = self.read("rows").select("row_idx", "bin_uid")
        out = self.write(found.withColumnRenamed("id", "row_idx").join(rows, "row_idx"), "clusters")
        sizes = density.size_histogram(out).collect()  # one row a cluster
        noise = sizes[0]["noise_frac"] if sizes else 0.0
        return {"clusters": sum(s["cluster"] >= 0 for s in sizes), "noise": round(noise, 6), "mostly_noise": noise >= 0.5}

    def annotate(self) -> dict:
        c = self.config.annotate
        bins = self.read("rows").select("bin_uid", "assembly", "start", "end", F.concat_ws("\t", "assembly", "contig").alias("contig"))
        loaded, failed = self.tracks, 0
        if loaded is None and self.sequences is None:
            plan = tracks.track_plan(self.read("manifest"), list(c.reference_tracks), list(c.assembly_tracks), dict(x.split("=", 1) for x in c.catalog), c.annotate_assemblies)
            status = self.write(tracks.load_tracks(plan, self.read("rows").select("assembly", "contig"), self.path("tracks")), "track_status")
            failed = status.where("status <> 'ok'").count()
            loaded = tracks.loaded(status, self.path("tracks"))
            looked = status.where("status = 'ok'").select("assembly").distinct()
        elif loaded is not None:
            looked = loaded.select("assembly").distinct()
        if loaded is None:
            cover = self.spark.createDataFrame([], "bin_uid string, feature string, frac float")
            annotated = bins.select("bin_uid", F.lit(False).alias("annotated"))
        else:
            keyed = loaded.where(F.col("feature").isin(*FEATURES)).select(F.concat_ws("\t", "assembly", "contig").alias("contig"), "feature", "start", "end")
            cover = intervals.bin_coverage(bins, keyed, self.config.sketch.bin_size)
            annotated = bins.join(looked.withColumn("annotated", F.lit(True)), "assembly", "left").select("bin_uid", F.coalesce("annotated", F.lit(False)).alias("annotated"))
        cover = self.write(cover, "coverage")
        top = intervals.dominant(cover, bins, list(FEATURES), c.min_frac_for_dominant)
        made = self.write(top.join(annotated, "bin_uid"), "annotations")
        return {"bins": made.count(), "annotated": made.where("annotated").count(), "failed_tracks": failed}

    def _bins(self) -> DataFrame:
        """One row a bin of the matrix with its cluster and annotation; what a bin lacks is neutral (-1, 0, 'unannotated', false)."""
        notes = self.read("annotations").withColumnRenamed("dominant_feature", "feature")
        placed = merge_left(self.read("rows"), self.read("clusters").select("bin_uid", "cluster", "probability"), ["bin_uid"])
        joined = merge_left(placed, notes, ["bin_uid"])
        return joined.fillna({"cluster": -1, "probability": 0.0, "feature": "unannotated", "annotated": False, "dominant_frac": 0.0})

    def enrich(self) -> dict:
        c, bins = self.config.enrich, self._bins()
        carries = enrich.carried(self.read("coverage"), bins, c.min_frac)
        tests = self.write(enrich.enrichment(bins, carries, c.min_cluster_size).orderBy("cluster", F.desc("log2_enrichment"), "feature"), "enrichment")
        return {"names": self.write(enrich.cluster_names(bins, carries, tests, c.top_features), "cluster_names").count()}

    def transfer(self) -> dict:
        c, bins = self.config.annotate, self._bins()
        self.write(transfer.infer(bins), "inferred")
        both = transfer.comparable(list(c.reference_tracks), list(c.assembly_tracks), TRACK_FEATURES, FEATURES)
        again = transfer.restricted(bins, self.read("coverage"), both, FEATURES, c.min_frac_for_dominant)
        found = self.write(transfer.transfer_report(again), "transfer")
        write_tsv(found.orderBy("cluster"), self.path("transfer.tsv"))
        self.write_text(json.dumps({"reference_tracks": c.reference_tracks, "assembly_tracks": c.assembly_tracks, "comparable_features": both, "excluded_features": [f for f in FEATURES if f not in both]}), "transfer_features.json")
        names = self.read("cluster_names")
        rows = transfer.bed_rows(bins, names, transfer.colors(names.select("cluster")))
        browser.write_beds(rows, self.path("beds"), self.config.run_name)
        browser.write_track(rows, self.path("clusters.all.bed.gz"), self.config.run_name)
        return {"clusters": found.count()}

    def payload(self) -> dict:
        """The map's points, packed; their number is bounded by ``report.max_points``."""
        c, bins = self.config.report, self._bins()
        placed = self.read("layout").select(F.col("id").alias("row_idx"), F.col("position")[0].alias("x"), F.col("position")[1].alias("y"))
        points = report.thinned(bins.join(placed, "row_idx", "left"), c.max_points, c.seed)
        levels = {"assembly": report.ordered_levels(bins, "assembly"), "chrom": report.chromosome_levels(bins), "feature": report.ordered_levels(bins, "feature", [*FEATURES, "unannotated"]), "cluster": [x for x in report.ordered_levels(bins, "cluster") if x != "-1"]}
        packed = report.packed_columns(points, ["row_idx"], {"x": 16, "y": 16, "gc": 8, "probability": 8, "dominant_frac": 8}, levels, ["start", "end"])
        total, shown = bins.count(), packed["start"]["n"]
        note = [] if shown == total else [f"The map shows {shown:,} of {total:,} bins: every reference bin and a seeded choice of the others (seed {c.seed}). Counts are of all bins."]
        return {"reference": report.pick_reference(bins), "points": shown, "levels": levels, "columns": packed, "notes": note}

    def report(self) -> dict:
        """summary.json, payload.json and a self-contained page: headline numbers, findings, the clusters, the packed points."""
        bins, c = self._bins(), self.config.report
        head = bins.agg(F.count(F.lit(1)).alias("bins"), F.countDistinct("assembly").alias("assemblies"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.avg((F.col("cluster") < 0).cast("int")).alias("noise"), F.avg(F.col("annotated").cast("int")).alias("annotated")).first().asDict()
        table = self.read("cluster_names").join(self.read("transfer"), "cluster", "left").orderBy(F.desc("size"), "cluster").collect()
        cell = lambda v: html.escape("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
        columns = table[0].__fields__ if table else []
        rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in table)
        cards = json.loads("\n".join(r[0] for r in self.spark.read.text(c.findings, wholetext=True).collect())) if c.findings else []
        packed, title = self.payload(), html.escape(c.title or self.config.run_name)
        self.write_text(json.dumps(packed), "payload.json")
        page = f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><ul>{''.join(f'<li>{k}: {cell(v)}</li>' for k, v in head.items())}</ul>{report.findings_html(cards)}<table><tr>{''.join(f'<th>{x}</th>' for x in columns)}</tr>{rows}</table><p>{cell(' '.join(packed['notes']))}</p><script type='application/json' id='points'>{report.embedded(packed)}</script>"
        self.write_text(page, "report.html")
        self.write_text(json.dumps({**head, "reference": packed["reference"]}), "summary.json")
        return head
