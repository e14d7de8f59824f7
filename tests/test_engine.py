"""Properties, hand-made goldens, files, and a planted signal from end to end."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.contracts import ENRICHMENT, MANIFEST, conform, empty
from strandlake.functions import hashing, stats
from strandlake.operators import copynumber, dense, density, intervals, manifest, positioned, select, sketch
from strandlake.plans import config
from strandlake.plans.stages import Run
from strandlake.sources import files
from strandlake.streaming.ingest import sketch_new


def _sequence(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def _complement(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def test_prevalence_goldens(spark):
    h = [5, 17, 1 << 40, -3, -(1 << 60), 99]
    shards = {("p1", "s1"): [[0, 1, 2], [0, 3]], ("m1", "s1"): [[0, 1], [4]], ("p2", "s2"): [[0, 2], [2, 5]]}
    rows = [(f"{a}{b}", h[i], a, s) for (a, s), bins in shards.items() for b, xs in enumerate(bins) for i in xs]
    counts = {r.hash: (r.n_samples, r.n_assemblies, r.n_bins) for r in select.prevalence_counts(spark.createDataFrame(rows * 2, "bin string, hash long, assembly string, sample string")).collect()}
    assert counts == {h[0]: (2, 3, 4), h[1]: (1, 2, 2), h[2]: (2, 2, 3), h[3]: (1, 1, 1), h[4]: (1, 1, 1), h[5]: (1, 1, 1)}
    assert select.prevalence_window(0.4, 1.0, 2) == (1, 2) and select.prevalence_window(0.9, 0.1, 10) == (9, 9)
    assert hashing.subsample_ceiling(1, 2) == (1 << 63) - 1 and hashing.subsample_ceiling(0, 5) == hashing.MAX_U64


def test_mix64_matches_integers(spark):
    values = [0, 1, -1, 2**62 - 1, -(2**63), 12345]
    with hashing.wrapping(spark):
        df = spark.createDataFrame([(v,) for v in values], "x long").select("x", hashing.mix64(F.col("x")).alias("h"))
    assert {r.x: r.h for r in df.collect()} == {v: hashing.signed(hashing.mix64_int(v & hashing.MAX_U64)) for v in values}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("size", [40, 97, 1000])
def test_sketch_does_not_depend_on_blocks_or_strand(spark, size):
    seq = _sequence(1, 600) + "N" * 7 + _sequence(2, 300).lower() + "N"
    one = spark.createDataFrame([("a", seq)], "assembly string, seq string")
    want = {(r.start, r.hash) for r in sketch.sketch(one, 15, 100, 4, ["assembly"]).collect()}
    assert want == {(r.start, r.hash) for r in sketch.sketch(one, 15, 100, 4, ["assembly"], block_size=size).collect()}
    back = spark.createDataFrame([("a", _complement(seq.upper()))], "assembly string, seq string")
    assert {h for _, h in want} == {r.hash for r in sketch.sketch(back, 15, 100, 4, ["assembly"]).collect()}


def test_kernel_against_expressions(spark):
    seq = _sequence(3, 200)
    at, hashes = sketch.canonical_hashes(seq.encode(), 9)
    rows = spark.createDataFrame([(i, seq[i : i + 9]) for i in range(192)], "at int, kmer string")
    with hashing.wrapping(spark):
        made = rows.select("at", hashing.mix64(hashing.canonical_code(F.col("kmer"))).alias("h"))
    assert {r.at: r.h for r in made.collect()} == dict(zip(at.tolist(), hashes.view(np.int64).tolist()))


def test_coverage_against_bases(spark):
    rnd = random.Random(7)
    track = [("c", s, s + rnd.randint(0, 90), rnd.choice("xy")) for s in (rnd.randint(-20, 900) for _ in range(80))]
    bins = [("c", i, min(i + 64, 1000), f"b{i}") for i in range(0, 1000, 64)]
    got = {(r.bin_uid, r.feature): r.frac for r in intervals.bin_coverage(spark.createDataFrame(bins, "contig string, start long, end long, bin_uid string"), spark.createDataFrame(track, "contig string, start long, end long, feature string"), 50).collect()}
    for _, s, e, uid in bins:
        for f in "xy":
            bases = {b for _, a, z, g in track if g == f for b in range(max(a, 0), z)}
            want = len(bases & set(range(s, e))) / (e - s)
            assert got.get((uid, f), 0.0) == pytest.approx(want, abs=1e-6)


def test_tails():
    assert stats.f_tail(4.0, 3, 20) == pytest.approx(0.0221, abs=2e-4)
    assert stats.t_tail(2.0, 10) == pytest.approx(0.0734, abs=1e-4)
    assert stats.chi2_tail(7.81, 3) == pytest.approx(0.0501, abs=1e-4)


def test_spearman_ranks_share_ties(spark):
    rows = copynumber.average_ranks(spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0)], "v double"), "v", "r").collect()
    assert sorted((r.v, r.r) for r in rows) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_peaks_and_period():
    peaks = positioned.top_peaks([(171 * i, 100 - i) for i in range(1, 6)] + [(200, 1)], 5, 100)
    assert positioned.fundamental(peaks) == 171


def test_svd_against_numpy(spark):
    a = np.random.default_rng(0).normal(size=(40, 12)) * (np.random.default_rng(1).random((40, 12)) < 0.5)
    coo = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col_idx int, value double")
    pcs, info = dense.truncated_svd(coo, 12, 40, components=4, rounds=30)
    want = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(info["singular_values"], want, rtol=1e-6)
    assert np.allclose(sum(info["energy_ratio"]), (want**2).sum() / (a**2).sum())
    rows = {r.row: r.pcs for r in pcs.collect()}
    assert all(np.allclose(rows[i], a[i] @ info["components"].T) for i in rows)


def test_density_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [rng.uniform(-8, 12, (12, 2))])
    points = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "id long, p array<double>")
    for found in (density.dbscan(points, 0.3, 5), density.hdbscan(points, 20, 5), density.hdbscan(points, 20, 5, max_fit_rows=120)):
        label = {r.id: r.cluster for r in found.collect()}
        groups = [[label[i] for i in range(60 * g, 60 * g + 60)] for g in range(3)]
        tops = [max(set(g), key=g.count) for g in groups]
        assert len(set(tops)) == 3 and -1 not in tops and all(g.count(t) >= 50 for g, t in zip(groups, tops))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_by_blocks_and_layout_of_the_rest(spark, monkeypatch, metric):
    """Several blocks, with repeated vectors; and a layout fitted on a part of the rows that places all of them."""
    monkeypatch.setattr(dense, "BLOCK", 20)
    x = np.random.default_rng(8).normal(size=(90, 6))
    x[60:] = x[:30]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.array([[max(1 - float((a * b).sum()), 0) if metric == "cosine" else float(np.sqrt(((p - q) ** 2).sum())) for b, q in zip(unit, x)] for a, p in zip(unit, x)]).round(9)
    found = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in dense.nearest_neighbours(table, 4, metric).collect()}
    assert len(found) == 360
    for i in range(90):
        want = sorted((d[i, j], j) for j in range(90) if j != i)[:4]
        assert sorted(j for _, j in want) == sorted(found[i, r][0] for r in range(4)) and np.allclose([found[i, r][1] for r in range(4)], [w for w, _ in want])
    if metric == "cosine":
        placed = dense.layout(table, 5, epochs=5, max_fit_rows=50).collect()
        assert sorted(r.id for r in placed) == list(range(90)) and all(np.isfinite(r.position).all() and len(r.position) == 2 for r in placed)


def test_hdbscan_fits_every_row(spark, monkeypatch):
    """Twelve points of 300 are a cluster of their own; no sample decides, and the tree in tasks is Prim's."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.1, (n, 2)) for c, n in (((0, 0), 150), ((3, 3), 138), ((9, 0), 12))])
    points = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "id long, p array<double>")
    assert config.Cluster().max_fit_rows == 0
    label = {r.id: r.cluster for r in density.hdbscan(points, 10, 5, max_fit_rows=0).collect()}
    small = [label[i] for i in range(288, 300)]
    assert len(label) == 300 and small.count(max(set(small), key=small.count)) >= 10 and max(small) >= 0
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 4]
    monkeypatch.setattr(density, "LEAF", 16)
    tree = density.spread_spanning_tree(spark, x, 5)
    assert len(tree) == 299 and np.allclose(tree[:, 2], density._spanning_tree(x, core)[:, 2])
    monkeypatch.setattr(density, "SPREAD_FROM", 2)
    assert {r.id: r.cluster for r in density.hdbscan(points, 10, 5).collect()} == label


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "t.bed.gz", "wt") as f:
        f.write("track name=x\nc#1\t5\t9\nc#1\t1\t4\thor\t7\t?\t1\t4\t0,0,0\n")
    bed = sorted(files.read_bed(spark, str(tmp_path / "t.bed.gz")).collect(), key=lambda r: r.start)
    assert [(r.chrom, r.start, r.end, r.name, r.strand, r.extra) for r in bed] == [("c#1", 1, 4, "hor", ".", ["1", "4", "0,0,0"]), ("c#1", 5, 9, "", ".", [])]
    (tmp_path / "g.gff").write_text("##gff\nchr1\ts\tgene\t1\t9\t.\t-\t.\tID=x;gene_name=AB\nchr1\ts\texon\t1\t9\t.\t-\t.\tID=y\n")
    assert [tuple(r) for r in files.read_gff_genes(spark, str(tmp_path / "g.gff")).collect()] == [("chr1", 0, 9, "AB", "-")]
    (tmp_path / "alias.txt").write_text("# assembly\tgenbank\tucsc\nctg1\tGB1\tchr1\nctg2\tGB2\t\nctg1\tGB9\tchr9\n")
    assert {r.alias: r.ucsc for r in files.read_chrom_alias(spark, str(tmp_path / "alias.txt")).collect()} == {"ctg1": "chr1", "GB1": "chr1", "chr1": "chr1", "GB9": "chr9", "chr9": "chr9"}
    (tmp_path / "m.tsv").write_text("assembly\tsample\thaplotype\tsource\tfasta\tsex\nA\tS\tpat\thprc\tf\tNA\nB\t\tpat\thprc\tf\tmale\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.tsv")).collect()
    assert [(r.assembly, r.sex, r.fai) for r in rows] == [("A", "", "")] and list(rows[0].__fields__) == MANIFEST.names


def test_manifest_order_and_caps(spark):
    rows = [(f"{s}_{h}", s, h, "hprc", pop, sup) for s, pop, sup in (("A", "ACB", "AFR"), ("B", "ASW", "AFR"), ("C", "CHB", "EAS"), ("D", "", ""), ("E", "GBR", "EUR")) for h in ("pat", "mat")]
    df = spark.createDataFrame(rows, "assembly string, sample string, haplotype string, source string, population string, superpopulation string")
    order = [r["sample"] for r in manifest.sample_order(df).orderBy("place").collect()]
    assert order[-1] == "B" or order[-1] == "A" or order[-1] == "D"
    assert set(order[:3]) & {"C", "E"} == {"C", "E"} and order.index("D") == 4
    assert manifest.capped(df, max_samples=3).select("sample").distinct().count() == 3 and manifest.capped(df, max_assemblies=5).count() == 5
    assert {r["sample"] for r in manifest.filtered(df, populations=["eas", "gbr"]).collect()} == {"C", "E"}


def test_contracts(spark):
    assert empty(spark, ENRICHMENT).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        conform(spark.range(1), MANIFEST)


def test_config_reports_all_problems():
    with pytest.raises(ValueError) as e:
        config.from_dict({"sketch": {"k": 4, "nope": 1}, "other": {}})
    assert all(x in str(e.value) for x in ("sketch.nope", "other", "sketch.k"))
    made = config.from_dict(config.overridden({"seed": 11}, ["select.seed=3", "sketch.k=21", "run_name=x"]))
    assert (made.embed.seed, made.select.seed, made.sketch.k, made.run_name) == (11, 3, 21, "x")


def test_streamed_ingest_equals_batch(spark, tmp_path):
    made = spark.createDataFrame([(f"a{i}", "s", "c", _sequence(i, 3000)) for i in range(3)], "assembly string, sample string, contig string, seq string")
    made.write.parquet(str(tmp_path / "in"))
    sketch_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 15, 1000, 8).awaitTermination()
    want = {tuple(r) for r in sketch.sketch(made, 15, 1000, 8, ["assembly", "sample", "contig"]).select("assembly", "start", "hash").collect()}
    assert want == {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("assembly", "start", "hash").collect()}


def test_planted_satellites_share_a_cluster(spark, tmp_path):
    rnd = random.Random(17)
    backbone = _sequence(17, 300_000)
    monomers = []
    base = _sequence(18, 171)
    for _ in range(48):
        monomers.append("".join(rnd.choice("ACGT") if rnd.random() < 0.04 else c for c in base))
    spots = [(100_000, 140_000), (220_000, 250_000)]
    sequences, tracks = [], []
    for i in range(6):
        name = f"s{i // 2}_{'pm'[i % 2]}"
        body = list("".join(rnd.choice("ACGT") if rnd.random() < 0.004 else c for c in backbone))
        for a, b in spots:
            fill = "".join(rnd.choice(monomers) for _ in range((b - a) // 171 + 1))[: b - a]
            body[a:b] = fill
            tracks.append((name, "chr21", a, b, "asat_hor_active"))
        sequences.append((name, f"s{i // 2}", "chr21", i == 0, "".join(body)))
    settings = config.from_dict({"outdir": str(tmp_path / "run"), "sketch": {"scaled": 50}, "select": {"min_sample_prevalence": 0.0}, "decompose": {"n_components": 8}, "embed": {"n_neighbors": 15}, "cluster": {"min_cluster_size": 20, "min_samples": 5}, "enrich": {"min_cluster_size": 5}})
    run = Run(spark, settings, spark.createDataFrame(sequences, "assembly string, sample string, contig string, is_ref boolean, seq string"), spark.createDataFrame(tracks, "assembly string, contig string, start long, end long, feature string"))
    summary = run.run()
    assert all(not s["cached"] for s in summary.values())
    bins = run._bins().toPandas()
    planted = bins["start"].map(lambda s: any(a <= s < b for a, b in spots))
    top = bins[planted & (bins["cluster"] >= 0)]["cluster"].mode()[0]
    inside = bins["cluster"] == top
    assert (inside & planted).sum() >= 0.8 * planted.sum() and (inside & planted).sum() >= 0.8 * inside.sum()
    assert (inside & ~planted).sum() < 0.1 * (~planted).sum() and bins[bins["cluster"] >= 0]["cluster"].nunique() >= 2
    names = {r.cluster: r.name for r in run.read("cluster_names").collect()}
    assert names[top] == f"C{top} asat_hor_active"
    assert all(s["cached"] for s in run.run().values())


def test_profile_takes_time_in_proportion(spark):
    """Bases are cut from bytes: four times the contig takes about four times as long, not sixteen times."""
    import time

    unit = _sequence(5, 1 << 20)
    seconds = []
    for copies in (1, 8, 32):
        one = spark.createDataFrame([("a", copies)], "assembly string, copies int").select("assembly", F.expr(f"repeat('{unit}', copies)").alias("seq"))
        began = time.time()
        found = sketch.bin_profile(one, 31, 10_000, ["assembly"]).agg(F.count(F.lit(1)), F.sum("n_acgt"), F.sum("n_kmers")).first()
        seconds.append(time.time() - began)
        total = copies << 20
        assert list(found) == [-(-total // 10_000), total, total - 30]
    assert seconds[2] < 8 * max(seconds[1], 1.0), seconds


def test_hypergeometric_tails_of_small_and_huge_counts(spark):
    import math
    from fractions import Fraction

    def exact(k, total, marked, drawn):
        tail = sum(math.comb(marked, j) * math.comb(total - marked, drawn - j) for j in range(max(k, drawn + marked - total, 0), min(marked, drawn) + 1))
        p = Fraction(tail, math.comb(total, drawn))
        return max(0.0, -(math.log10(p.numerator) - math.log10(p.denominator))) if p else 307.6526555685887

    small = [(3, 50, 10, 12), (0, 20, 5, 5), (5, 20, 5, 5), (6, 20, 5, 5), (40, 5000, 300, 200), (12, 5000, 300, 200), (9, 10, 9, 10), (700, 9000, 3000, 2000)]
    # wide distributions, against sums of all terms by their logs
    huge = [(250_000, 10**6, 500_000, 500_000), (252_000, 10**6, 500_000, 500_000), (248_500, 10**6, 500_000, 500_000), (400_000, 10**6, 500_000, 500_000), (26_000, 10**6, 50_000, 500_000)]

    def by_logs(k, total, marked, drawn):
        x = np.arange(max(k, drawn + marked - total, 0), min(marked, drawn) + 1, dtype=float)
        lg = np.vectorize(math.lgamma)
        terms = lg(marked + 1.0) - lg(x + 1) - lg(marked - x + 1) + lg(total - marked + 1.0) - lg(drawn - x + 1) - lg(total - marked - drawn + x + 1) - (lg(total + 1.0) - lg(drawn + 1.0) - lg(total - drawn + 1.0))
        return max(0.0, -(terms.max() + math.log(np.exp(terms - terms.max()).sum())) / math.log(10))

    rows = [(*c, exact(*c)) for c in small] + [(*c, float(by_logs(*c))) for c in huge] + [(5 * 10**8 + 10**6, 2 * 10**9, 10**9, 10**9, None)]
    df = spark.createDataFrame(rows, "k long, total long, marked long, drawn long, want double")
    for r in df.withColumn("got", stats.neg_log10_hypergeom_tail(*(F.col(c) for c in ("k", "total", "marked", "drawn")))).collect():
        assert r.got > 0 if r.want is None else r.got == pytest.approx(r.want, rel=1e-6, abs=1e-6), r


def test_merging_over_tiles(spark):
    rnd = random.Random(3)
    rows = [("c", rnd.choice("xy"), s, s + rnd.choice([0, 1, 5, 40, 700])) for s in (rnd.randint(-5, 3000) for _ in range(150))]
    track = spark.createDataFrame(rows, "contig string, feature string, start long, end long")
    want = {f: set() for f in "xy"}
    for _, f, s, e in rows:
        want[f] |= set(range(max(s, 0), max(e, 0)))
    for tile in (7, 100, 1 << 20):
        found = [(r.feature, r.start, r.end) for r in intervals.merge_intervals(track, ["contig", "feature"], tile).collect()]
        assert sum(e - s for _, s, e in found) == sum(map(len, want.values()))
        assert all({b for g, s, e in found if g == f for b in range(s, e)} == want[f] for f in "xy")
        points = track.select("contig", "feature", F.col("start").alias("at")).distinct()
        for r in intervals.prefix_coverage(points, track, ["contig", "feature"], tile=tile).collect():
            assert r.below == sum(b < r.at for b in want[r.feature])


def test_ranks_over_ranges(spark):
    from strandlake.operators import population, ranking

    rnd = random.Random(9)
    keys = [rnd.getrandbits(64) - (1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys], "hash long")
    for unsigned in (True, False):
        order = sorted(keys, key=lambda k: k % (1 << 64) if unsigned else k)
        got = {r.hash: r.i for r in ranking.dense_index(df, "hash", "i", unsigned, rows=37).collect()}
        assert got == {k: i for i, k in enumerate(order)}
    assert [r.col_idx for r in select.feature_index(spark.createDataFrame([(-3,), (5,), (7,)], "hash long")).orderBy(F.col("hash") < 0, "hash").collect()] == [0, 1, 2]
    p = [rnd.choice([0.001, 0.2, 0.2, 0.04, rnd.random()]) for _ in range(200)]
    tests = spark.createDataFrame(list(enumerate(p)), "t int, p double")
    got = {r.t: r.q for r in population.benjamini_hochberg(tests, "t").collect()}
    falling = sorted(range(200), key=lambda i: -p[i])
    least = 1.0
    for place, i in enumerate(falling):
        least = min(least, p[i] * 200 / sum(x <= p[i] for x in p))
        assert got[i] == pytest.approx(least)


def test_principal_coordinates_keep_distances(spark):
    from strandlake.operators import grouptests

    x = np.random.default_rng(4).normal(size=(9, 3)) * [3, 2, 1]
    pairs = spark.createDataFrame([(f"u{i}", f"u{j}", float(np.linalg.norm(x[i] - x[j]))) for i in range(9) for j in range(i + 1, 9)], "a string, b string, distance double")
    rows, explained = grouptests.pcoa(pairs, 3)
    c = {r.unit: np.array(r.coordinates) for r in rows.collect()}
    assert all(np.linalg.norm(c[r.a] - c[r.b]) == pytest.approx(r.distance) for r in pairs.collect())
    variance = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert explained == pytest.approx((variance / variance.sum()).tolist())
    with pytest.raises(ValueError, match="more than 4 units"):
        grouptests.pcoa(pairs, 3, most_units=4)


def test_size_matched_draws(spark):
    from strandlake.operators import grouptests

    rnd = random.Random(2)
    rows = [(i, rnd.randint(1, 500), i % 5 == 0) for i in range(60)]
    sizes = spark.createDataFrame(rows, "cluster long, size long, is_target boolean")
    size = {c: s for c, s, _ in rows}
    draws = {}
    for r in grouptests.size_matched(sizes, 4, 3).collect():
        draws.setdefault(r.draw, {})[r.target] = r.cluster
    assert set(draws) == {1, 2, 3, 4}
    for number, chosen in draws.items():
        assert set(chosen) == {c for c, _, t in rows if t} and len(set(chosen.values())) == len(chosen) and not any(c % 5 == 0 for c in chosen.values())
        free = sorted((c for c, _, t in rows if not t), key=lambda c: (size[c], c))
        targets = sorted(chosen)
        for t in np.random.default_rng((3, number)).permutation(len(targets)):
            best = min(free, key=lambda c: abs(np.log1p(size[c]) - np.log1p(size[targets[t]])))
            assert chosen[targets[t]] == best
            free.remove(best)
    few = spark.createDataFrame([(0, 5, True), (1, 5, True), (2, 7, False)], "cluster long, size long, is_target boolean")
    drawn = grouptests.size_matched(few, 1).collect()  # one of the pool for the first target, and for the second once more
    assert sorted(r.target for r in drawn) == [0, 1] and {r.cluster for r in drawn} == {2}
    assert grouptests.size_matched(few.where("is_target"), 1).count() == 0


def test_planted_groups_are_significant(spark, monkeypatch):
    from strandlake.operators import grouptests

    rng = np.random.default_rng(5)
    units = [(f"u{i:02d}", f"d{i // 2:02d}", "ab"[i // 2 % 2]) for i in range(24)]
    values = [(u, c, float(rng.normal() + (3 if g == "a" and c < 3 else 0))) for u, _, g in units for c in range(8)]
    groups = spark.createDataFrame(units, "unit string, block string, grp string")
    table = spark.createDataFrame(values, "unit string, cluster long, value double")
    pairs = grouptests.euclidean(table)
    labels = grouptests.permuted_labels(groups, 30, 1)
    by = {}
    for r in labels.collect():
        by.setdefault(r.perm, {})[r.unit] = r.grp
    blocks = {u: b for u, b, _ in units}
    assert len(by) == 31 and all(sorted(x.values()) == sorted(g for _, _, g in units) for x in by.values())
    assert all(len({(blocks[u], g) for u, g in x.items()}) == 12 for x in by.values()) and len({tuple(sorted(x.items())) for x in by.values()}) > 25
    shared, joined = grouptests.pseudo_f_by(pairs, labels).orderBy("perm").collect(), None
    monkeypatch.setattr(grouptests, "SHARED_PAIRS", 0)
    joined = grouptests.pseudo_f_by(pairs, labels).orderBy("perm").collect()
    drops = grouptests.without_each(pairs, groups)[1].where("dropped IN ('u00', 'u07')")
    dropped = [grouptests.pseudo_f_by(pairs, grouptests.permuted_labels(drops, 5, 1, ("dropped",)), ("dropped",)).orderBy("dropped", "perm").collect()]
    monkeypatch.undo()
    dropped.append(grouptests.pseudo_f_by(pairs, grouptests.permuted_labels(drops, 5, 1, ("dropped",)), ("dropped",)).orderBy("dropped", "perm").collect())
    for one, two in ((shared, joined), dropped):
        assert len(one) == len(two) and all((x.perm, x.n, x.k) == (y.perm, y.n, y.k) and x.f == pytest.approx(y.f) and x.r2 == pytest.approx(y.r2) for x, y in zip(one, two))
    found = grouptests.permanova(pairs, groups, 99, 1).first()
    assert found.p <= 0.02 and found.r2_excess > 0.1 and (found.n_units, found.n_groups) == (24, 2)
    tested = {r.cluster: r for r in grouptests.column_tests(table, groups, 99, 1).collect()}
    assert all((tested[c].p_fwer <= 0.05) == (c < 3) for c in range(8)) and all(r.p_fwer >= r.p_perm for r in tested.values())


def test_group_effects_against_plain_sums_of_squares(spark):
    from strandlake.operators import copynumber

    rng = np.random.default_rng(6)
    rows = [("f", f"d{i}", "xyz"[i % 3], "pq"[i // 3 % 2], float(rng.normal() + (i % 3) + 0.5 * (i // 3 % 2))) for i in range(40)] + [("flat", f"d{i}", "xyz"[i % 3], "p", 1.0) for i in range(9)]
    means = spark.createDataFrame(rows, "feature string, block string, grp string, stratum string, value double")
    own = [r for r in rows if r[0] == "f"]
    y, g, c = (np.array([r[i] for r in own]) for i in (4, 2, 3))
    dummy = lambda v: np.stack([(v == x).astype(float) for x in sorted(set(v))], axis=1)
    full, small = np.hstack([dummy(g), dummy(c)[:, 1:]]), np.hstack([np.ones((40, 1)), dummy(c)[:, 1:]])
    rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    f = ((rss(small) - rss(full)) / 2) / (rss(full) / 36)
    found = {r.feature: r for r in copynumber.adjusted_effects(means).collect()}
    assert set(found) == {"f"} and found["f"].f == pytest.approx(f) and found["f"].dof == 36 and found["f"].p == found["f"].p_bonferroni
    terms = {r.term: r for r in copynumber.effect_terms(means).collect()}
    assert set(terms) == {"(mean)", "x", "y", "z", "[p]", "[q]"}
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [terms[t].effect for t in "xyz"] == pytest.approx((beta[:3] - beta[:3].mean()).tolist())
    assert sum(terms[t].effect for t in "xyz") == pytest.approx(0) and terms["[q]"].effect == pytest.approx(beta[3] / 2)
    assert all(r.ci_lo < r.effect < r.ci_hi and 0 <= r.p <= 1 for r in terms.values())
