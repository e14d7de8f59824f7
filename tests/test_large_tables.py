"""What larger tables ask of operators and queries, on small ones."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from strandlake import tables
from strandlake.operators import dense, density, neighbours, novelty, ranking, report, sketch
from strandlake.plans import mappings, q_manifest


def _dbscan(x, eps, least):
    """Brute force: labels and probabilities."""
    near = sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1])) <= eps * eps
    core = near.sum(axis=1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            n += 1
    touch = [min(label[near[i] & core], default=-1) for i in range(len(x))]
    return [(int(a if c else t), 1.0 if c else 0.5 if t >= 0 else 0.0) for a, c, t in zip(label, core, touch)]


def test_dbscan_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(density, "epsilon_neighbours", None)
    monkeypatch.setattr(density, "PART", 16)
    rng = np.random.default_rng(4)
    for dimensions, eps in ((1, 0.05), (2, 0.15), (3, 0.5)):
        x = np.concatenate([rng.normal(size=(250, dimensions)), rng.normal(0.2, 0.05, size=(150, dimensions))])
        x[-20:] = x[0]  # copies
        x[:40] = np.round(x[:40] / eps) * eps
        points = spark.createDataFrame([*enumerate(x.tolist()), (len(x), None)], "id long, p array<double>")
        found = density.dbscan(points, eps, 5, dimensions).orderBy("id").collect()
        assert [(r.cluster, r.probability) for r in found] == [*_dbscan(x, eps, 5), (-1, 0.0)]


def test_forest_that_falls_short_is_made_up_for(spark):
    x = np.random.default_rng(6).normal(size=(900, 48))
    table = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>")
    found, recall = neighbours.forest_neighbours(table, 5, leaf=32, trees=2, most_trees=4)
    assert recall >= 0.95 and found.groupBy("id").agg(F.count("*").alias("n")).where("n = 5").count() == 900


def test_counts_are_of_all_bins(spark, tmp_path):
    spark.range(0, 100_000, 1, 2).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert tuple(q_manifest.thinned_points(spark, str(tmp_path)).first()) == (1200, 2000)


def test_partitions_follow_the_rows(spark, data_dir, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{data_dir}/lineitem.parquet").count()
    made = mappings.incidence(spark, data_dir)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert made.rdd.getNumPartitions() == -(-rows // 500) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    group = F.concat(F.lit("g"), (F.col("id") * 7919 % 1300).cast("string"))
    ranked = ranking.grouped_index(spark.range(4000).withColumn("g", group), "g", [F.desc("id")], "i").collect()
    assert [r.i for r in sorted(ranked, key=lambda r: (r.g, -r.id))] == list(range(4000))


def test_kmers_are_handed_on_in_pieces(monkeypatch):
    """A task never holds the k-mers of a whole batch of blocks."""
    import pyarrow as pa

    class Cut:
        schema = {"assembly": StructField("assembly", StringType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(2)
    blocks = ["".join(rng.choice(list("ACGTN"), 400, p=[0.24, 0.24, 0.24, 0.24, 0.04])).encode() for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(50)]), pa.array(range(0, 50 * 390, 390)), pa.array(blocks)], names=["assembly", "pos0", "block"])
    whole = pa.Table.from_batches(sketch.positioned_sketch(Cut(), 11, 1, ["assembly"])([batch]))
    monkeypatch.setattr(sketch, "HANDED", 1000)
    parts = list(sketch.positioned_sketch(Cut(), 11, 1, ["assembly"])([batch]))
    assert max(p.num_rows for p in parts) <= 1000 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert whole.num_rows == sum(len(sketch.canonical_hashes(b, 11)[0]) for b in blocks)


def test_headline_of_missing_and_repeated_values(spark):
    rows = [("a", "s", 1, True, 2.0), ("a", "s", 1, None, 2.0), ("b", "t", -1, False, None), ("b", "t", 2, True, 9.0), ("b", "t", 2, True, 5.0)]
    got = report.headline(spark.createDataFrame(rows, "assembly string, sample string, cluster int, annotated boolean, amount double"), "amount").first()
    assert tuple(got) == (5, 2, 2, 2, 0.2, 0.75, 3.5)


def test_shuffle_keeps_repeated_names(spark):
    """Bins of one name are dealt a value each, not the product."""
    bins = spark.range(60).select(F.lit("x").alias("bin_uid"), (F.col("id") % 3).cast("int").alias("cluster"), (F.col("id") % 2).cast("string").alias("assembly"), F.col("id").cast("string").alias("chrom"), (F.col("id") * 10).alias("start"))
    got = novelty.shuffled_within(bins, "assembly", "chrom", 3, 5)
    assert got.count() == 180 and got.groupBy("perm").agg(F.countDistinct("chrom").alias("n")).where("n = 60").count() == 3


def test_rows_are_multiplied_by_slices():
    import pyarrow as pa

    made = list(dense._slices([pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["row"])]))
    assert max(b.num_rows for b in made) <= dense.ROWS_AT_ONCE and [x for b in made for x in b.column(0).to_pylist()] == list(range(1000))


def test_neighbours_hand_on_k_rows_a_vector(spark, monkeypatch):
    """However many partitions there are: each vector's best of a run of blocks, not of each partition."""
    x = np.random.default_rng(5).normal(size=(90, 6))
    table = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>")
    made, run = [], type(table).mapInArrow
    monkeypatch.setattr(dense, "BLOCK", 12)
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, *a: made.append(run(self, *a)) or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dense.nearest_neighbours(table, 4).count() == 360
        assert made[-1].count() <= 2 * 360
        assert dense.nearest_neighbours(table.where("id < 0"), 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_graph_of_points_with_fewer_neighbours(spark):
    """Memberships of whole batches are those of each point by itself."""
    rng = np.random.default_rng(7)
    near = {i: np.sort(np.round(rng.random(n), 3)) for i, n in enumerate((5, 5, 3, 1, 5))}
    near[4][:2] = 0
    rows = [(i, 100 + 10 * i + r, float(v), r) for i, d in near.items() for r, v in enumerate(d)]
    got = {(r.a, r.b): r.weight for r in dense.fuzzy_graph(spark.createDataFrame(rows, "id long, neighbour long, distance double, rank int"), 5).collect()}
    assert len(got) == len(rows)
    for i, d in near.items():
        rho, low, high, scale = d[d > 0].min(), 0.0, np.inf, 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / scale).sum()
            if abs(total - np.log2(5)) < 1e-6:
                break
            low, high = (low, scale) if total > np.log2(5) else (scale, high)
            scale = (low + high) / 2 if np.isfinite(high) else scale * 2
        want = np.exp(-np.maximum(d - rho, 0) / max(scale, 1e-3 * d.mean()))
        assert np.allclose([got[i, 100 + 10 * i + r] for r in range(len(d))], want)


def test_layout_fits_every_row(spark, monkeypatch):
    """No number of rows turns the fit into one on a part of them, unless it is asked for; ids need not be dense."""
    import inspect

    assert inspect.signature(dense.layout).parameters["max_fit_rows"].default == 0
    x = np.random.default_rng(9).normal(size=(40, 5))
    table = spark.createDataFrame([(7 * i - 50, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    fitted, start = [], dense.spectral_start
    monkeypatch.setattr(dense, "spectral_start", lambda n, *a: fitted.append(n) or start(n, *a))
    placed = dense.layout(table, 5, epochs=3)
    assert fitted == [40] and sorted(r.id for r in placed.collect()) == [7 * i - 50 for i in range(40)]
    assert placed.dtypes == [("id", "bigint"), ("position", "array<double>")] and np.isfinite([r.position for r in placed.collect()]).all()
