"""Queries: clusters, features and references, from line items, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators import report
from ..operators import transfer as tr
from ..operators.ranking import tiled_index
from ..tables import materialised
from .mappings import table
from .registry import query, rounded

CLUSTERED_SQL = """clustered AS (SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(floor(epoch(l_shipdate)) AS BIGINT) || '|' || CAST(l_quantity AS BIGINT) AS bin_uid, CAST(p_size % 12 - 1 AS INTEGER) AS cluster, n_name AS assembly, r_name AS sample, c_custkey AS contig,
 l_returnflag || l_linestatus AS chrom, lower(split_part(p_type, ' ', 1)) AS feature, CAST(l_quantity / 50 AS FLOAT) AS frac, r_regionkey = 3 AND p_size <> 7 AS is_ref, l_discount >= 0.02 AS annotated,
 l_orderkey * 100 + l_linenumber * 10 AS start, l_orderkey * 100 + l_linenumber * 10 + 10 AS "end", l_tax * 10 AS probability, l_extendedprice AS amount
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


def clustered(spark, sf_dir):
    """One bin for each line item: cluster by part size (-1 is noise), assembly by nation, reference by region."""
    lines, orders, customers, nations, regions, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    # orders meet customers before line items: these are shuffled by order and by part alone
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    return joined.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")), F.col("l_quantity").cast("long")).alias("bin_uid"), (F.col("p_size") % 12 - 1).cast("int").alias("cluster"), F.col("n_name").alias("assembly"), F.col("r_name").alias("sample"), F.col("c_custkey").alias("contig"), F.concat("l_returnflag", "l_linestatus").alias("chrom"), F.lower(F.substring_index("p_type", " ", 1)).alias("feature"), (F.col("l_quantity") / 50).cast("float").alias("frac"), ((F.col("r_regionkey") == 3) & (F.col("p_size") != 7)).alias("is_ref"), (F.col("l_discount") >= 0.02).alias("annotated"), start.alias("start"), (start + 10).alias("end"), (F.col("l_tax") * 10).alias("probability"), F.col("l_extendedprice").alias("amount"))


_CARRIED = f"""{CLUSTERED_SQL}, carried AS (SELECT DISTINCT bin_uid, cluster, feature FROM clustered WHERE frac >= 0.25::FLOAT AND annotated)"""
_HYPER = "(lgamma(n_bins_total + 1) - lgamma(j + 1) - lgamma(n_bins_total - j + 1) + lgamma(background_size - n_bins_total + 1) - lgamma(cluster_size - j + 1) - lgamma(background_size - n_bins_total - cluster_size + j + 1) - lgamma(background_size + 1) + lgamma(cluster_size + 1) + lgamma(background_size - cluster_size + 1))"
_TESTS = f"""{_CARRIED}, sizes AS (SELECT cluster, count(*) AS cluster_size FROM clustered GROUP BY cluster), totals AS (SELECT feature, count(*) AS n_bins_total FROM carried GROUP BY feature),
counts AS (SELECT cluster, feature, count(*) AS k FROM carried GROUP BY ALL),
grid AS (SELECT cluster, feature, coalesce(k, 0) AS n_bins_cluster, n_bins_total, cluster_size, (SELECT count(*) FROM clustered) AS background_size FROM sizes CROSS JOIN totals LEFT JOIN counts USING (cluster, feature) WHERE cluster_size >= 10),
terms AS (SELECT cluster, feature, {_HYPER} AS t FROM grid, range(greatest(n_bins_cluster, cluster_size + n_bins_total - background_size, 0), least(cluster_size, n_bins_total) + 1) r(j)),
tops AS (SELECT cluster, feature, max(t) AS m FROM terms GROUP BY ALL), tails AS (SELECT cluster, feature, greatest(0, -(m + ln(sum(exp(t - m)))) / ln(10)) AS p FROM terms JOIN tops USING (cluster, feature) GROUP BY cluster, feature, m),
tests AS (SELECT grid.*, n_bins_cluster::DOUBLE / cluster_size AS frac_cluster, n_bins_total::DOUBLE / background_size AS frac_background, log2((n_bins_cluster::DOUBLE / cluster_size + 1.0::DOUBLE / background_size) / (n_bins_total::DOUBLE / background_size + 1.0::DOUBLE / background_size)) AS log2_enrichment, p AS neg_log10_p FROM grid JOIN tails USING (cluster, feature))"""


def _tests(spark, sf_dir):
    bins = materialised(clustered(spark, sf_dir).select("bin_uid", "cluster", "assembly", "chrom", "feature", "frac", "annotated"))
    carries = en.carried(bins.select("bin_uid", "feature", "frac"), bins)
    return bins, carries, en.enrichment(bins, carries)


@query(f"WITH {_TESTS} SELECT cluster, feature, n_bins_cluster, n_bins_total::BIGINT AS n_bins_total, cluster_size, background_size, round(frac_cluster, 6) AS frac_cluster, round(frac_background, 6) AS frac_background, round(log2_enrichment, 6) AS log2_enrichment, round(neg_log10_p, 3) AS neg_log10_p FROM tests")
def enrichment(spark, sf_dir):
    return rounded(rounded(_tests(spark, sf_dir)[2]), 3, ["neg_log10_p"])


@query(f"""WITH {_TESTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY log2_enrichment DESC, feature) AS r FROM tests WHERE cluster >= 0 AND log2_enrichment > 0 AND n_bins_cluster >= 5),
tops3 AS (SELECT cluster, max(feature) FILTER (r = 1) AS top, string_agg(format('{{}}:{{:.3f}}', feature, log2_enrichment), ';' ORDER BY r) AS top_features, max(n_bins_cluster) FILTER (r = 1) AS support FROM ranked WHERE r <= 3 GROUP BY cluster)
SELECT cluster, CASE WHEN cluster < 0 THEN 'noise' WHEN top IS NULL THEN 'unannotated' ELSE 'C' || cluster || ' ' || top END AS name, coalesce(top_features, '') AS top_features, count(*) AS size, count(DISTINCT assembly) AS n_assemblies, count(DISTINCT nullif(chrom, '')) AS n_chroms, round(CASE WHEN count(*) FILTER (annotated) > 0 THEN coalesce(support, 0)::DOUBLE / count(*) FILTER (annotated) ELSE 0 END, 6) AS purity
FROM clustered LEFT JOIN tops3 USING (cluster) GROUP BY cluster, top, top_features, support""")
def cluster_names(spark, sf_dir):
    return rounded(en.cluster_names(*_tests(spark, sf_dir)))


_VOTES = f"""{CLUSTERED_SQL}, votes AS (SELECT cluster, is_ref, feature, count(*) AS n FROM clustered WHERE cluster >= 0 AND annotated GROUP BY ALL),
best AS (SELECT cluster, is_ref, feature, n, row_number() OVER (PARTITION BY cluster, is_ref ORDER BY n DESC, feature) AS r FROM votes)"""


@query(f"""WITH {_VOTES}, refs AS (SELECT cluster, count(*) AS cluster_ref_bins, count(*) FILTER (annotated) AS voters FROM clustered WHERE is_ref AND cluster >= 0 GROUP BY cluster)
SELECT bin_uid, c.cluster, coalesce(b.feature, '') AS inferred_feature, coalesce(b.n, 0) AS support, coalesce(cluster_ref_bins, 0) AS cluster_ref_bins, round(CASE WHEN voters > 0 THEN b.n::DOUBLE / voters ELSE 0 END, 6) AS purity, c.cluster >= 0 AND cluster_ref_bins IS NULL AS novel
FROM clustered c LEFT JOIN refs USING (cluster) LEFT JOIN best b ON b.cluster = c.cluster AND b.is_ref AND b.r = 1""")
def inferred_labels(spark, sf_dir):
    return rounded(tr.infer(clustered(spark, sf_dir)))


@query(f"""WITH {_VOTES}, joined AS (SELECT c.*, rb.feature AS ref_top FROM clustered c LEFT JOIN best rb ON rb.cluster = c.cluster AND rb.is_ref AND rb.r = 1 WHERE c.cluster >= 0)
SELECT j.cluster, count(*) FILTER (j.is_ref) AS n_ref_bins, count(*) FILTER (NOT j.is_ref) AS n_asm_bins, coalesce(ref_top, '') AS ref_top_feature, coalesce(ab.feature, '') AS asm_top_feature,
round(CASE WHEN ref_top IS NOT NULL AND count(*) FILTER (NOT j.is_ref AND annotated) > 0 THEN count(*) FILTER (NOT j.is_ref AND annotated AND j.feature = ref_top)::DOUBLE / count(*) FILTER (NOT j.is_ref AND annotated) END, 6) AS asm_agreement,
round(CASE WHEN count(*) FILTER (NOT j.is_ref) > 0 THEN count(*) FILTER (NOT j.is_ref AND annotated)::DOUBLE / count(*) FILTER (NOT j.is_ref) ELSE 0 END, 6) AS asm_annotated_frac
FROM joined j LEFT JOIN best ab ON ab.cluster = j.cluster AND NOT ab.is_ref AND ab.r = 1 GROUP BY j.cluster, ref_top, ab.feature""")
def transfer_report(spark, sf_dir):
    return rounded(tr.transfer_report(clustered(spark, sf_dir)))


@query(f"WITH {CLUSTERED_SQL} SELECT assembly, contig, start, \"end\", 'C' || cluster AS name, least(1000, greatest(0, round_even(probability * 1000, 0)))::INTEGER AS score FROM clustered")
def bed_scores(spark, sf_dir):
    bins = clustered(spark, sf_dir)
    names = bins.select("cluster").distinct().select("cluster", F.format_string("C%d", "cluster").alias("name"))
    palette = tr.colors(names.select("cluster"))
    return tr.bed_rows(bins, names, palette).select("assembly", "contig", "start", "end", "name", "score")


@query("SELECT p_size AS cluster, round((0.25 + p_size * 0.6180339887498949) % 1.0, 6) AS hue FROM (SELECT DISTINCT p_size FROM part)")
def palette(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_size").alias("cluster")).distinct()
    return rounded(tr.colors(ids, 0.25).select("cluster", "hue"))


@query(f"WITH {CLUSTERED_SQL} SELECT feature, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, feature) - 1 AS place FROM clustered GROUP BY feature")
def level_counts(spark, sf_dir):
    return tr.level_counts(clustered(spark, sf_dir), "feature")


@query(f"WITH {CLUSTERED_SQL}, span AS (SELECT min(amount) AS o, (max(amount) - min(amount)) / 65535.0::DOUBLE AS s FROM clustered) SELECT bin_uid, round_even((amount - o) / s, 0)::INTEGER AS code FROM clustered, span")
def quantised_amounts(spark, sf_dir):
    return tr.quantised(clustered(spark, sf_dir), "amount").select("bin_uid", "code")


@query(f"""WITH {CLUSTERED_SQL} SELECT count(*) AS n_bins, count(DISTINCT assembly) AS n_assemblies, count(DISTINCT sample) AS n_samples, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, round(avg((cluster < 0)::INTEGER), 6) AS noise_frac, round(avg(annotated::INTEGER), 6) AS annotated_frac, round(median(amount), 4) AS median_amount FROM clustered""")
def headline_stats(spark, sf_dir):
    return rounded(report.headline(clustered(spark, sf_dir), "amount"))


@query(f"""WITH {_TESTS}, big AS (SELECT cluster FROM sizes WHERE cluster >= 0 ORDER BY cluster_size DESC, cluster LIMIT 6), cells AS (SELECT cluster, feature, log2_enrichment AS z FROM tests WHERE cluster IN (SELECT cluster FROM big))
SELECT cluster, feature, round(z, 6) AS z, round((SELECT greatest(1, quantile_cont(abs(z), 0.98)) FROM cells), 6) AS z_range FROM cells""")
def heatmap(spark, sf_dir):
    """Enrichment of the largest clusters, with the range of its colours (a top-k report)."""
    bins, _, tests = _tests(spark, sf_dir)
    big = bins.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(6).select("cluster")
    cells = tests.join(F.broadcast(big), "cluster").select("cluster", "feature", F.col("log2_enrichment").alias("z"))
    span = cells.agg(F.greatest(F.lit(1.0), F.percentile(F.abs("z"), 0.98)).alias("z_range"))
    return rounded(cells.join(F.broadcast(span)))


@query(f"""WITH {CLUSTERED_SQL} SELECT chrom, bin_uid, start, row_number() OVER (PARTITION BY chrom ORDER BY start, bin_uid) - 1 AS place FROM clustered WHERE is_ref""")
def ribbon(spark, sf_dir):
    reference = clustered(spark, sf_dir).where("is_ref").select("chrom", "bin_uid", "start")
    return tiled_index(reference, ["chrom"], "start", ["bin_uid"], "place", tile=100_000)
