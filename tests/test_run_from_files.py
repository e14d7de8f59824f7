"""The staged run from a folder of files: tracks, restarts, changed inputs, the browser track and the report's columns."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import __main__ as command
from strandlake.operators import manifest, report, tracks
from strandlake.plans import config
from strandlake.plans.stages import STAGES, Run
from strandlake.sources import browser, fasta


def bases(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Four assemblies of a common backbone with an array of monomers, and a broken file; tracks and a manifest."""
    where = tmp_path_factory.mktemp("assemblies")
    rnd, backbone, unit = random.Random(5), bases(5, 60_000), bases(6, 171)
    array = "".join("".join(rnd.choice("ACGT") if rnd.random() < 0.03 else c for c in unit) for _ in range(100))[:15_000]
    rows = []
    for name, source, hap in (("REF", "t2t", "ref"), ("A_pat", "local", "pat"), ("A_mat", "local", "mat"), ("B_pat", "local", "pat")):
        body = "".join(rnd.choice("ACGT") if rnd.random() < 0.003 else c for c in backbone[:20_000] + array + backbone[35_000:])
        path = where / f"{name}.fa"
        path.write_text(f">{name}#1#c1\n" + "\n".join(body[i : i + 70] for i in range(0, len(body), 70)) + "\n")
        (where / f"{name}.alias.tsv").write_text(f"# ucsc\tgenbank\nchr21\t{name}#1#c1\n")
        censat = where / f"{name}.censat.bed"
        censat.write_text(f"track name=x\n{name}#1#c1\t20000\t35000\thor_1_1(S1C1H1L)\n{name}#1#c1\t0\t5000\tct_1\n")
        rows.append((name, name[0] if source == "local" else "REF", hap, source, str(path), str(where / f"{name}.alias.tsv"), str(censat), str(where / "none.bed") if name == "B_pat" else ""))
    rows.append(("C_pat", "C", "pat", "local", str(where / "gone.fa"), "", "", ""))
    fasta.build_indexes(spark, [r[4] for r in rows[:4]])
    columns = ["assembly", "sample", "haplotype", "source", "fasta", "chrom_alias", "censat_bed", "repeatmasker_bed"]
    (where / "manifest.tsv").write_text("\t".join(columns) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    return where


SETTINGS = {"sketch": {"k": 21, "bin_size": 1000, "scaled": 20}, "select": {"min_sample_prevalence": 0.0, "min_bins": 2}, "decompose": {"n_components": 6, "n_iter": 4}, "embed": {"n_neighbors": 12}, "cluster": {"min_cluster_size": 15, "min_samples": 4}, "enrich": {"min_cluster_size": 5}, "annotate": {"annotate_assemblies": True}}


@pytest.fixture(scope="module")
def done(spark, folder, tmp_path_factory):
    settings = config.from_dict({**SETTINGS, "outdir": str(tmp_path_factory.mktemp("out")), "manifest": {"path": str(folder / "manifest.tsv"), "require_annotations": []}})
    run = Run(spark, settings)
    return run, run.run()


def test_run_from_a_manifest_of_files(spark, done):
    run, summary = done
    assert list(summary) == list(STAGES) and not any(s["cached"] for s in summary.values())
    assert summary["manifest"]["assemblies"] == 5 and summary["sketch"] == {**summary["sketch"], "bins": 240, "failed": 1}
    assert {r["assembly"]: r["status"] for r in run.read("sketch_status").collect()} == {"REF": "ok", "A_pat": "ok", "A_mat": "ok", "B_pat": "ok", "C_pat": "failed"}
    bins = run._bins()
    assert {r["chrom"] for r in bins.collect()} == {"chr21"} and bins.where("is_ref").select("assembly").distinct().collect()[0][0] == "REF"
    status = {(r["assembly"], r["kind"]): r["status"] for r in run.read("track_status").collect()}
    assert status == {("REF", "censat"): "ok", ("A_pat", "censat"): "ok", ("A_mat", "censat"): "ok", ("B_pat", "censat"): "ok", ("B_pat", "repeatmasker"): "failed"}
    labelled = {r["start"]: r["feature"] for r in bins.where("assembly = 'A_mat'").collect()}
    assert labelled[25_000] == "asat_hor_active" and labelled[3000] == "ct" and labelled[50_000] == "unannotated"
    clusters = bins.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.expr("start >= 20000 AND start < 35000").cast("int")).alias("own")).collect()
    assert sum(r["own"] for r in clusters if r["own"] >= 0.8 * r["n"]) >= 0.8 * 60  # the array's bins lie in clusters of their own
    assert report.windows_by_feature(bins, "REF").where("feature = 'ct'").count() == 5


def test_restart_and_changed_inputs(spark, done, folder, tmp_path):
    run, _ = done
    again = Run(spark, run.config)
    summary = again.run()
    assert all(s["cached"] for s in summary.values()) and summary["sketch"]["bins"] == 240 and summary["sketch"]["seconds"] > 0
    other = Run(spark, config.from_dict({**SETTINGS, "outdir": run.config.outdir, "manifest": {"path": str(folder / "manifest.tsv"), "require_annotations": []}, "enrich": {"min_cluster_size": 6}}))
    assert [other._mark(s)["digest"] == other._digest(s) for s in STAGES] == [s in STAGES[: STAGES.index("enrich")] for s in STAGES]
    table = spark.createDataFrame([("a", "s", "chr21", True, bases(1, 3000))], "assembly string, sample string, contig string, is_ref boolean, seq string")
    table.write.parquet(str(tmp_path / "seq"))
    settings = config.from_dict({**SETTINGS, "outdir": str(tmp_path / "o")})
    first = Run(spark, settings, spark.read.parquet(str(tmp_path / "seq")))
    assert first.run_stage("manifest")["assemblies"] == 1 and Run(spark, settings, spark.read.parquet(str(tmp_path / "seq"))).run_stage("manifest")["cached"]
    table.withColumn("assembly", F.lit("b")).write.mode("append").parquet(str(tmp_path / "seq"))
    assert Run(spark, settings, spark.read.parquet(str(tmp_path / "seq"))).run_stage("manifest") == {**first.summary["manifest"], "assemblies": 2, "cached": False, "seconds": pytest.approx(10, abs=10), "groups": {"": 2}}


def test_tracks_are_parsed_once(spark, done, folder):
    run, _ = done
    plan = tracks.track_plan(run.read("manifest"), ["censat", "segdup"], ["censat"], {"segdup": str(folder / "sd.bed")}, False)
    assert {(r["assembly"], r["kind"]) for r in plan.collect()} == {("REF", "censat"), ("REF", "segdup")}
    status = tracks.load_tracks(plan, run.read("rows").select("assembly", "contig"), run.path("tracks"))
    assert {r["kind"]: (r["status"], r["intervals"]) for r in status.collect()} == {"censat": ("ok", 2), "segdup": ("failed", 0)}
    with pytest.raises(ValueError):
        tracks.parsed(spark, "colour", [str(folder / "x.bed")])


def test_one_bad_file_fails_alone(spark, folder, tmp_path):
    (tmp_path / "bad.bed.gz").write_bytes(b"not gzip at all")
    (tmp_path / "good.bed").write_text("c\t0\t5\tct_1\n")
    plan = spark.createDataFrame([("a", "censat", str(tmp_path / "bad.bed.gz")), ("b", "censat", str(tmp_path / "good.bed")), ("b", "odd", str(tmp_path / "good.bed"))], "assembly string, kind string, path string")
    contigs = spark.createDataFrame([("a", "c"), ("b", "c")], "assembly string, contig string")
    status = tracks.load_tracks(plan, contigs, str(tmp_path / "tracks"))
    assert {(r["assembly"], r["kind"]): r["status"] for r in status.collect()} == {("a", "censat"): "failed", ("b", "censat"): "ok", ("b", "odd"): "failed"}
    assert [tuple(r) for r in tracks.loaded(status, str(tmp_path / "tracks")).collect()] == [("b", "c", 0, 5, "ct")]


def test_browser_track_is_the_same_bytes(spark, done, tmp_path):
    run, _ = done
    with open(run.path("clusters.all.bed.gz"), "rb") as f:
        first = f.read()
    lines = gzip.decompress(first).decode().splitlines()
    assert lines[0].startswith('track name="run all assemblies"') and len(lines) == 1 + run.read("rows").count()
    places = [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[1:]]
    assert places == sorted(places) and first.endswith(browser.END)
    rows = spark.createDataFrame([(f"a{i % 3}", f"c{i % 5}", i * 10, i * 10 + 10, f"n{i}", 5, ".", i * 10, i * 10 + 10, "1,2,3") for i in range(500)], "assembly string, contig string, start long, end long, name string, score int, strand string, thick_start long, thick_end long, rgb string")
    made = []
    for n in (1, 7):
        browser.write_track(rows.repartition(n), str(tmp_path / "t.gz"), "x", tile=1000)
        made.append((tmp_path / "t.gz").read_bytes())
    assert made[0] == made[1] and len(gzip.decompress(made[0]).decode().splitlines()) == 501
    per = [r[0] for r in spark.read.text(f"{run.path('beds')}/assembly=REF").collect()]
    assert per[0] == 'track name="run REF" description="cluster assignments (run, REF)" itemRgb="On" visibility=1' and len(per) == 61


def test_payload_is_packed(spark, done):
    run, _ = done
    payload, bins = json.loads("".join(r[0] for r in run.spark.read.text(run.path("payload.json")).collect())), run._bins().orderBy("row_idx").toPandas()
    assert payload["reference"] == "REF" and payload["points"] == len(bins)
    assert (report.unpacked(payload["columns"]["start"]) == bins["start"]).all()
    gc = payload["columns"]["gc"]
    assert gc["d"] == "u1" and np.abs(report.unpacked(gc) - bins["gc"]).max() <= gc["s"] / 2 + 1e-7
    for c in ("cluster", "feature", "assembly"):
        codes = report.unpacked(payload["columns"][c])
        want = [payload["levels"][c].index(str(v)) if str(v) in payload["levels"][c] else -1 for v in bins[c]]
        assert payload["columns"][c]["d"] == "i1" and codes.tolist() == want
    page = "".join(r[0] for r in run.spark.read.text(run.path("report.html")).collect())
    assert page.count("</script>") == 1 and "application/json" in page


def test_thinning_keeps_the_reference(spark):
    rows = spark.range(5000).select(F.concat(F.lit("b"), "id").alias("bin_uid"), (F.col("id") % 10 == 0).alias("is_ref"))
    kept = report.thinned(rows, 2000)
    assert kept.count() == 2000 and kept.where("is_ref").count() == 500
    assert sorted(r[0] for r in kept.select("bin_uid").collect()) == sorted(r[0] for r in report.thinned(rows.repartition(7), 2000).select("bin_uid").collect())
    assert report.thinned(rows, 0).count() == report.thinned(rows, 9000).count() == 5000
    few = report.thinned(rows.withColumn("is_ref", F.lit(True)), 1200)
    assert few.count() == 1200
    assert report.embedded({"x": "</script><b>"}).count("<") == 0 and "&lt;b&gt;" in report.findings_html([{"title": "<b>"}])


def test_sources_of_manifests(spark, folder, tmp_path):
    import hashlib

    local = {r["assembly"]: r for r in manifest.from_folder(spark, str(folder)).collect()}
    assert local["A_pat"]["sample"] == "A" and local["A_pat"]["haplotype"] == "pat" and local["REF"]["haplotype"] == "hap1" and local["REF"]["fai"].endswith("REF.fa.fai")
    with pytest.raises(NotADirectoryError):
        manifest.from_folder(spark, str(folder / "none"))
    (tmp_path / "index.csv").write_text("assembly,sample,haplotype,source,fasta\n" + "".join(f"{s}_{h},{s},{h},hprc,s3://b/{s}\n" for s in "ABCD" for h in ("pat", "mat") if (s, h) != ("D", "mat")))
    for t in ("censat_bed", "chrom_alias"):
        (tmp_path / f"{t}.csv").write_text("assembly,url\nA_pat,u1\nA_pat,u2\nB_pat,NA\n")
    (tmp_path / "samples.csv").write_text("sample,population,sex\nA,ACB,male\nB,CHB,n/a\nC,ASW,\n")
    m = config.from_dict({"manifest": {"source": "release", "path": str(tmp_path), "annotation_tables": ["censat_bed", "chrom_alias"], "require_annotations": []}}).manifest
    rows = manifest.build_manifest(spark, m).orderBy("ordinal").collect()
    assert [r["assembly"] for r in rows] == sorted(r["assembly"] for r in rows) and len(rows) == 7
    by = {r["assembly"]: r for r in rows}
    assert by["A_pat"]["censat_bed"] in ("u1", "u2") and by["B_pat"]["censat_bed"] == "" and by["A_mat"]["superpopulation"] == "AFR" and by["B_pat"]["sex"] == ""
    order = [r["sample"] for r in manifest.sample_order(manifest.build_manifest(spark, m), 7).orderBy("place").collect()]
    key = lambda s: hashlib.blake2b(f"7:{s}".encode(), digest_size=8).digest()
    african = sorted("AC", key=key)
    assert order == [african[0], "B", african[1], "D"]
    complete = spark.createDataFrame([("A_pat", "chr21", "contig", "0"), ("B_pat", "chr21", "contig", "x"), ("C_pat", "chr21", "scaffold", "0")], "assembly string, chrom string, level string, num_gaps string")
    m2 = config.from_dict({"manifest": {**{"source": "release", "path": str(tmp_path), "annotation_tables": [], "require_annotations": []}, "require_complete": True}}).manifest
    assert [r["assembly"] for r in manifest.build_manifest(spark, m2, complete=complete).collect()] == ["A_pat"]
    codes = manifest.sample_codes(manifest.build_manifest(spark, m)).orderBy("ordinal").collect()
    assert [r["sample_code"] for r in codes] == [0, 0, 1, 1, 2, 2, 3]
    twice = manifest.build_manifest(spark, m).unionByName(manifest.build_manifest(spark, m).withColumn("ordinal", F.col("ordinal") + 100))
    assert manifest.deduplicated(twice).agg(F.max("ordinal")).first()[0] < 100


def test_catalogs_of_a_release(spark, tmp_path):
    from strandlake.sources import catalog

    (tmp_path / "index.csv").write_text("sample_id,haplotype,assembly_name,assembly,assembly_fai\nA,1,A_pat_r2,s3://b/a.fa,s3://b/a.fai\nA,2,A.x.mat,s3://b/m.fa,\nR,0,GRCh38,s3://b/r.fa,\nB,1,B_v1,n/a,\nC,2,C_v1,https://c/c.fa,\n")
    (tmp_path / "censat_bed.csv").write_text("assembly_name,location\nA_pat_r2,s3://t/a.bed\n")
    (tmp_path / "samples.csv").write_text("sample,population,sex\nA,ACB,male\n")
    m = config.from_dict({"manifest": {"source": "release", "path": str(tmp_path), "annotation_tables": ["censat_bed"], "require_annotations": []}}).manifest
    reference = catalog.reference_row(spark, "REF", "R", "r.fa", tracks={"censat_bed": "r.bed"})
    rows = manifest.build_manifest(spark, m, reference).orderBy("ordinal").collect()
    assert [(r["assembly"], r["haplotype"], r["source"], r["censat_bed"]) for r in rows] == [("REF", "ref", "t2t", "r.bed"), ("A.x.mat", "mat", "hprc", ""), ("A_pat_r2", "pat", "hprc", "https://t.s3.amazonaws.com/a.bed"), ("C_v1", "hap2", "hprc", "")]
    with pytest.raises(ValueError):
        catalog.release_index(spark.createDataFrame([("x",)], "assembly string"))
    (tmp_path / "a.tsv").write_text("# assembly\tucsc\nc1\tchr1\nc1\tchr2\nc2\t\nc3\n")
    assert [tuple(r) for r in catalog.read_contig_names(spark, str(tmp_path / "a.tsv")).collect()] == [("c1", "chr1")]
    assert catalog.read_contig_names(spark, str(tmp_path / "none")).count() == 0
    assert catalog.reachable(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "none")]) == {str(tmp_path / "a.tsv"): True, str(tmp_path / "none"): False}


def test_commands(spark, done, folder, capsys, tmp_path):
    run, _ = done
    (tmp_path / "c.json").write_text(json.dumps({**SETTINGS, "outdir": run.config.outdir, "manifest": {"path": str(folder / "manifest.tsv"), "require_annotations": []}}))
    assert command.main(["info", str(tmp_path / "c.json")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert all(told[s]["current"] for s in STAGES)
    assert command.main(["select", str(tmp_path / "c.json")]) == 0 and json.loads(capsys.readouterr().out)["cached"]
    assert command.main(["fetch", str(folder / "REF.fa"), "REF#1#c1", "5", "15"]) == 0 and len(capsys.readouterr().out.strip()) == 10
    assert command.main(["init-config"]) == 0 and json.loads(capsys.readouterr().out)["sketch"]["k"] == 31
