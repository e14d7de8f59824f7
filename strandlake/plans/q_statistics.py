"""Queries: copy number, novelty, sharing, populations and positioned hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import copynumber as cn
from ..operators import novelty as nv
from ..operators import population as pop
from ..operators import positioned as po
from .mappings import incidence_parts, table
from .q_clusters import CLUSTERED_SQL, clustered
from .q_features import mix_sql
from .registry import query, rounded

_C = f"WITH {CLUSTERED_SQL}"


@query(f"""{_C}, totals AS (SELECT assembly, sum("end" - start) AS total FROM clustered GROUP BY assembly), both_scopes AS (
SELECT 'assembly' AS scope, assembly, '' AS chrom, feature, count(*) AS n_bins, sum("end" - start) AS covered FROM clustered GROUP BY assembly, feature UNION ALL
SELECT 'chrom', assembly, chrom, feature, count(*), sum("end" - start) FROM clustered GROUP BY assembly, chrom, feature)
SELECT scope, assembly, chrom, feature, n_bins, round(covered / 1000000.0::DOUBLE, 6) AS mb, round(total / 1000000.0::DOUBLE, 6) AS assembly_mb, round(covered::DOUBLE / total, 6) AS frac_of_assembly FROM both_scopes JOIN totals USING (assembly)""")
def copy_number(spark, sf_dir):
    return rounded(cn.long_table(clustered(spark, sf_dir)))


_PER = f"{_C}, per AS (SELECT assembly, feature, count(*) AS n, (SELECT count(*) FROM clustered b WHERE b.assembly = a.assembly) AS total FROM clustered a GROUP BY assembly, feature)"


def _per(bins):
    counts = bins.groupBy("assembly", "feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(bins.groupBy("assembly").agg(F.count(F.lit(1)).alias("total")), "assembly")


@query(f"{_PER} SELECT feature, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n) / avg(n), 6) AS cv, round(max(n)::DOUBLE / min(n), 6) AS fold, round(quantile_cont(n, 0.9) / quantile_cont(n, 0.1), 6) AS robust_fold FROM per GROUP BY feature")
def copy_number_spread(spark, sf_dir):
    return rounded(cn.spread(_per(clustered(spark, sf_dir)), "feature", "n"))


@query(f"{_PER}, fits AS (SELECT feature, corr(total, n) AS r, regr_slope(n, total) AS slope, regr_intercept(n, total) AS intercept, avg(n) AS mean FROM per GROUP BY feature) SELECT feature, round(r, 5) AS r, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(stddev_samp(n - slope * total - intercept) / mean, 5) AS residual_cv FROM per JOIN fits USING (feature) GROUP BY feature, r, slope, intercept, mean")
def completeness(spark, sf_dir):
    per = _per(clustered(spark, sf_dir)).select("feature", F.col("n").cast("double").alias("n"), F.col("total").cast("double").alias("total"))
    return rounded(cn.completeness(per, "feature", "total", "n"), 5)


@query(f"{_C}, per AS (SELECT assembly, chrom, feature, count(*) AS n FROM clustered GROUP BY ALL), grid AS (SELECT a.assembly, c.chrom, c.feature FROM (SELECT DISTINCT assembly FROM per) a CROSS JOIN (SELECT DISTINCT chrom, feature FROM per) c) SELECT chrom, feature, round(median(coalesce(n, 0)), 6) AS median FROM grid LEFT JOIN per USING (assembly, chrom, feature) GROUP BY chrom, feature")
def per_chrom_median(spark, sf_dir):
    counts = clustered(spark, sf_dir).groupBy("assembly", "chrom", "feature").agg(F.count(F.lit(1)).alias("n"))
    return rounded(cn.zero_filled_medians(counts, "chrom", "feature", "assembly", "n"))


@query("WITH r AS (SELECT l_returnflag, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rk FROM lineitem), g AS (SELECT l_returnflag, sum(rk) AS r, count(*) AS m FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_extendedprice)), s AS (SELECT sum(r * r / m) AS s, sum(m)::DOUBLE AS n, count(*) AS groups FROM g) SELECT round((12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, groups, n::BIGINT AS n FROM s, t")
def kruskal(spark, sf_dir):
    return rounded(cn.kruskal_wallis(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice"), 4)


@query(f"{_C} SELECT cluster, assembly, count(*) AS n FROM clustered WHERE cluster >= 0 GROUP BY ALL")
def presence(spark, sf_dir):
    return nv.presence(clustered(spark, sf_dir))


@query(f"{_C}, sizes AS (SELECT cluster, count(*) AS size, count(*) FILTER (is_ref) AS n_ref FROM clustered WHERE cluster >= 0 GROUP BY cluster), t AS (SELECT sum(size) AS n, sum(n_ref) AS r FROM sizes) SELECT cluster, size, n_ref, round(CASE WHEN size > n - r THEN 0 ELSE exp(lgamma(n - r + 1) - lgamma(n - r - size + 1) + lgamma(n - size + 1) - lgamma(n + 1)) END, 6) AS p_no_reference FROM sizes, t")
def novelty_expectation(spark, sf_dir):
    return rounded(nv.expected_absence(clustered(spark, sf_dir)))


@query("WITH held AS (SELECT DISTINCT o_custkey % 40 AS assembly, l_partkey AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey), per AS (SELECT cluster, count(*) AS k FROM held GROUP BY cluster), units AS (SELECT DISTINCT assembly FROM held), a AS (SELECT u.assembly, (SELECT count(*) FROM per) - count(h.cluster) AS absent, (SELECT count(*) FROM per WHERE k = (SELECT count(*) FROM units) - 1) - count(h.cluster) FILTER (per.k = (SELECT count(*) FROM units) - 1) AS sole FROM units u LEFT JOIN held h USING (assembly) LEFT JOIN per USING (cluster) GROUP BY u.assembly) SELECT assembly, absent, (SELECT count(*) FROM a b WHERE b.absent <= a.absent) AS rank, sole FROM a")
def leave_one_out_absence(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bins = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 40).alias("assembly"), F.col("l_partkey").alias("cluster"))
    return nv.absence_by_unit(bins)


@query(f"""{_C}, marked AS (SELECT cluster, CASE WHEN start = lag("end") OVER (PARTITION BY cluster, assembly ORDER BY start, "end") THEN 0 ELSE 1 END AS new FROM clustered WHERE cluster >= 0) SELECT cluster, count(*) AS n_bins, sum(new)::BIGINT AS n_segments, round(count(*)::DOUBLE / sum(new), 6) AS ratio FROM marked GROUP BY cluster""")
def segment_ratio(spark, sf_dir):
    return rounded(nv.segments(clustered(spark, sf_dir), ["assembly"]))


@query(f"{_C}, c AS (SELECT cluster, chrom, count(*)::DOUBLE AS n FROM clustered WHERE cluster >= 0 GROUP BY ALL) SELECT cluster, round(sum(n) * sum(n) / sum(n * n), 6) AS effective FROM c GROUP BY cluster")
def effective_chromosomes(spark, sf_dir):
    return rounded(nv.effective_number(clustered(spark, sf_dir)))


_PLACES = ["AF", "AO", "NF", "NO", "RF", "RO"]
_MASK = f"{_C}, sets AS (SELECT cluster, assembly, bit_or(CASE WHEN list_position({_PLACES!r}, chrom) > 0 THEN 1::BIGINT << (list_position({_PLACES!r}, chrom) - 1)::BIGINT ELSE 0 END) AS mask FROM clustered WHERE cluster >= 0 AND amount < 30000 GROUP BY ALL)"


def _sets(spark, sf_dir):
    return nv.chromosome_sets(clustered(spark, sf_dir).where("amount < 30000"), _PLACES)


@query(f"{_MASK} SELECT * FROM sets")
def chromosome_sets(spark, sf_dir):
    return _sets(spark, sf_dir)


@query(f"{_MASK}, m AS (SELECT cluster, mask, count(*) AS c FROM sets GROUP BY ALL), pairs AS (SELECT x.cluster, sum(w * bit_count(x.mask & y.mask) / greatest(bit_count(x.mask | y.mask), 1)::DOUBLE) AS num, sum(w) AS den FROM (SELECT x.cluster, x.mask AS xm, x.c, y.mask AS ym, CASE WHEN x.mask = y.mask THEN x.c * (x.c - 1) ELSE x.c * y.c END AS w FROM m x JOIN m y USING (cluster)) q JOIN m x ON x.cluster = q.cluster AND x.mask = xm JOIN m y ON y.cluster = q.cluster AND y.mask = ym GROUP BY x.cluster), best AS (SELECT cluster, mask, c::DOUBLE / sum(c) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, mask) AS r FROM m) SELECT cluster, mask AS modal_mask, round(share, 6) AS modal_share, round(CASE WHEN den > 0 THEN num / den END, 6) AS jaccard FROM best JOIN pairs USING (cluster) WHERE r = 1")
def set_jaccard(spark, sf_dir):
    return rounded(nv.set_consistency(_sets(spark, sf_dir)))


@query(f"{_C}, seen AS (SELECT DISTINCT cluster, assembly, chrom FROM clustered WHERE cluster >= 0) SELECT x.chrom AS a, y.chrom AS b, count(*) AS n FROM seen x JOIN seen y USING (cluster, assembly) WHERE x.chrom < y.chrom GROUP BY ALL")
def place_pairs(spark, sf_dir):
    return nv.place_pairs(clustered(spark, sf_dir))


def _shuffle_sql(source: str, block: str, seed: int, permutations: int, name: str) -> str:
    """CTE ``name``: perm and the bins of ``source`` with chrom dealt anew within ``block``."""
    key = mix_sql(f"xor({seed}::UHUGEINT, (perm * 1000000007 + start)::UHUGEINT)")
    return f"""{name}_m AS (SELECT {block}, perm, chrom, row_number() OVER (PARTITION BY {block}, perm ORDER BY key, bin_uid) AS i FROM (SELECT *, {key} AS key FROM {source}, range(1, {permutations + 1}) r(perm))),
{name}_p AS (SELECT bin_uid, cluster, assembly, row_number() OVER (PARTITION BY {block} ORDER BY start, bin_uid) AS i FROM {source}), {name} AS (SELECT perm, p.cluster, p.assembly, chrom FROM {name}_m m JOIN (SELECT i, bin_uid, cluster, assembly, {block} AS blk FROM {name}_p) p ON p.i = m.i AND p.blk = m.{block})"""


_TOTALS = "SELECT {k}cluster, count(*) AS pairs, sum(k) AS total, sum((k >= 2)::INT) AS multi FROM (SELECT {k}cluster, assembly, count(DISTINCT chrom) AS k FROM {t} GROUP BY ALL) GROUP BY ALL"
_REAL = "real_ AS (SELECT * FROM clustered WHERE cluster >= 0)"
_DEALS = 100


@query(f"""{_C}, {_REAL}, {_shuffle_sql('real_', 'assembly', 11, _DEALS, 'fr')}, {_shuffle_sql('real_', 'cluster', 12, _DEALS, 'fx')}, seen AS ({_TOTALS.format(k='', t='real_')}), ft AS ({_TOTALS.format(k='perm, ', t='fr')}), xt AS ({_TOTALS.format(k='perm, ', t='fx')}),
fs AS (SELECT cluster, avg(f.total) AS m, stddev_pop(f.total) AS sd, sum((f.total >= s.total)::INT) AS r, avg(f.multi) AS mu FROM ft f JOIN seen s USING (cluster) GROUP BY cluster), xs AS (SELECT cluster, avg(total) AS m, stddev_pop(total) AS sd FROM xt GROUP BY cluster)
SELECT cluster, pairs AS n_pairs, round(total / pairs, 6) AS chrom_per_asm, round(multi / pairs, 6) AS frac_asm_multi, round(fs.m / pairs, 6) AS free_mean, round(CASE WHEN fs.sd > 1e-9 THEN (total - fs.m) / fs.sd END, 6) AS free_z, round((1 + r) / {_DEALS + 1}.0::DOUBLE, 6) AS free_p, round(mu / pairs, 6) AS free_multi, round(xs.m / pairs, 6) AS fixed_mean, round(CASE WHEN xs.sd > 1e-9 THEN (total - xs.m) / xs.sd END, 6) AS fixed_z FROM seen JOIN fs USING (cluster) JOIN xs USING (cluster)""")
def sharing_null(spark, sf_dir):
    return rounded(nv.sharing_null(clustered(spark, sf_dir), permutations=_DEALS, parts=incidence_parts(spark, sf_dir)))


_EXPECTED = f"{_C}, sizes AS (SELECT cluster, count(*) AS size, count(*) FILTER (is_ref) AS n_ref FROM clustered WHERE cluster >= 0 GROUP BY cluster), t AS (SELECT sum(size) AS n, sum(n_ref) AS r FROM sizes), ex AS (SELECT cluster, size, n_ref, CASE WHEN size > n - r THEN 0 ELSE exp(lgamma(n - r + 1) - lgamma(n - r - size + 1) + lgamma(n - size + 1) - lgamma(n + 1)) END AS p FROM sizes, t)"


@query(f"{_EXPECTED} SELECT CASE WHEN size >= 1000 THEN 1000 WHEN size >= 400 THEN 400 WHEN size >= 200 THEN 200 WHEN size >= 120 THEN 120 WHEN size >= 80 THEN 80 WHEN size >= 60 THEN 60 WHEN size >= 50 THEN 50 ELSE 0 END::BIGINT AS size_from, count(*) AS clusters, count(*) FILTER (n_ref = 0) AS observed, round(sum(p), 6) AS expected, round(count(*) FILTER (n_ref = 0) - sum(p), 6) AS excess FROM ex GROUP BY 1")
def novelty_by_size(spark, sf_dir):
    return rounded(nv.novelty_by_size(nv.expected_absence(clustered(spark, sf_dir))))


@query(f"{_C}, {_REAL.replace('SELECT *', 'SELECT bin_uid, start, is_ref, cluster * 1000 + CAST(floor(amount) AS BIGINT) % 97 AS cluster')}, w AS (SELECT count(*) FILTER (is_ref) AS wanted, count(DISTINCT cluster) AS clusters FROM real_), sp AS (SELECT perm, cluster, row_number() OVER (PARTITION BY perm ORDER BY {mix_sql('xor(7::UHUGEINT, (perm * 1000000007 + start)::UHUGEINT)')}, bin_uid) AS r FROM real_, range(1, 5) q(perm)) SELECT perm, clusters - count(DISTINCT cluster) AS novel FROM (SELECT perm, cluster FROM sp, w WHERE r <= wanted UNION ALL SELECT 0, cluster FROM real_ WHERE is_ref), w GROUP BY perm, clusters")
def label_null(spark, sf_dir):
    """Novel clusters when the reference's labels are dealt anew; clusters are split further, so that some are small."""
    bins = clustered(spark, sf_dir).where("cluster >= 0").withColumn("cluster", F.col("cluster") * 1000 + F.floor("amount") % 97)
    return nv.label_null(bins, 4, 7)


_HELD = "WITH held AS (SELECT DISTINCT o_custkey % 40 AS assembly, l_partkey AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey), per AS (SELECT cluster, count(*) AS k FROM held GROUP BY cluster), us AS (SELECT DISTINCT assembly FROM held)"


def _held(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 40).alias("assembly"), F.col("l_partkey").alias("cluster"))


@query(f"{_HELD}, fl AS (SELECT DISTINCT ceil(s * ((SELECT count(*) FROM us) - 1))::BIGINT AS floor FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (0.95)) v(s)), l AS (SELECT floor, u.assembly, (SELECT count(*) FROM per WHERE k >= floor) - (SELECT count(*) FROM held h JOIN per USING (cluster) WHERE h.assembly = u.assembly AND k >= floor) AS lacks FROM fl CROSS JOIN us u), r AS (SELECT floor, lacks AS reference FROM l WHERE assembly = 1) SELECT floor, reference, round(median(lacks) FILTER (assembly <> 1), 6) AS others_median, max(lacks) FILTER (assembly <> 1) AS others_max, count(*) FILTER (lacks <= reference) AS rank FROM l JOIN r USING (floor) GROUP BY floor, reference")
def recurrence_floors(spark, sf_dir):
    return rounded(nv.recurrence_floors(_held(spark, sf_dir), 1))


_FLAGS = f"{_C}, flags AS (SELECT DISTINCT cluster, cluster % 3 = 0 AS novel FROM clustered WHERE cluster >= 0)"


def _flags(bins):
    """Clusters taken for novel ones, as the driver's tables hold no cluster without a reference bin."""
    return bins.where("cluster >= 0").select("cluster").distinct().withColumn("novel", F.col("cluster") % 3 == 0)


@query(f"{_C} SELECT cluster, NOT bool_or(is_ref) AS novel FROM clustered WHERE cluster >= 0 GROUP BY cluster")
def novel_flags(spark, sf_dir):
    return nv.novel_flags(clustered(spark, sf_dir))


@query(f"{_FLAGS} SELECT novel, count(*) AS n_bins, round(median(amount), 4) AS median_amount, round(avg(annotated::INT), 6) AS share_annotated FROM clustered JOIN flags USING (cluster) WHERE NOT is_ref GROUP BY novel")
def describe_novel(spark, sf_dir):
    bins = clustered(spark, sf_dir)
    return rounded(rounded(nv.describe_novel(bins, _flags(bins), ["amount"], ["annotated"]), 4, ["median_amount"]))


@query(f"{_FLAGS}, c AS (SELECT chrom, count(*) FILTER (novel) AS novel, count(*) FILTER (NOT novel) AS supported FROM clustered JOIN flags USING (cluster) WHERE NOT is_ref GROUP BY chrom) SELECT chrom, novel, supported, round(100.0::DOUBLE * novel / sum(novel) OVER (), 6) AS novel_pct, round(100.0::DOUBLE * supported / sum(supported) OVER (), 6) AS supported_pct FROM c")
def novel_places(spark, sf_dir):
    bins = clustered(spark, sf_dir)
    return rounded(nv.novel_places(bins, _flags(bins)))


@query("WITH bins AS (SELECT o_custkey % 40 AS assembly, l_partkey AS cluster, lower(split_part(p_type, ' ', 1)) AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), top AS (SELECT DISTINCT cluster, feature FROM bins), sz AS (SELECT feature, count(*) AS clusters FROM top GROUP BY feature HAVING count(*) >= 5), h AS (SELECT feature, assembly, count(DISTINCT cluster) AS own FROM bins GROUP BY ALL), g AS (SELECT feature, clusters, u.assembly, 1 - coalesce(own, 0)::DOUBLE / clusters AS rate FROM sz CROSS JOIN (SELECT DISTINCT assembly FROM bins) u LEFT JOIN h USING (feature, assembly)), r AS (SELECT feature, rate AS reference FROM g WHERE assembly = 1) SELECT feature, clusters, round(reference, 6) AS reference, round(median(rate) FILTER (assembly <> 1), 6) AS others_median, round(max(rate) FILTER (assembly <> 1), 6) AS others_max, count(*) FILTER (rate <= reference) AS rank FROM g JOIN r USING (feature) GROUP BY feature, clusters, reference")
def feature_dropout(spark, sf_dir):
    """Parts as clusters, so that many of a type's clusters are missing from a customer group."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster"), F.lower(F.substring_index("p_type", " ", 1)).alias("feature"))
    return rounded(nv.feature_dropout(_held(spark, sf_dir).join(parts, "cluster"), 1))


@query(f"{_C} SELECT cluster, count(*) AS n, round(median(amount), 4) AS median FROM clustered GROUP BY cluster")
def group_medians(spark, sf_dir):
    return rounded(nv.group_medians(clustered(spark, sf_dir), "cluster", "amount"), 4)


@query(f"""{_C}, e AS (SELECT chrom, max("end") AS edge FROM clustered WHERE is_ref AND feature LIKE 'small%' AND amount < 3000 GROUP BY chrom) SELECT cluster, count(*) AS n_ref, round(avg((start < coalesce(edge, 0))::INT), 6) AS proximal FROM clustered LEFT JOIN e USING (chrom) WHERE is_ref AND cluster >= 0 GROUP BY cluster""")
def proximal_fraction(spark, sf_dir):
    cheap = F.when((F.col("feature") == "small") & (F.col("amount") < 3000), "small").when(F.col("feature").startswith("small"), "other").otherwise(F.col("feature"))
    return rounded(nv.proximal_fraction(clustered(spark, sf_dir).withColumn("feature", cheap), "small"))


_SOME = f"{_C}, real_ AS (SELECT * FROM clustered WHERE cluster BETWEEN 0 AND 4), {_shuffle_sql('real_', 'assembly', 29, 4, 'fr')}, seen AS (SELECT DISTINCT cluster, assembly, chrom FROM real_), dr AS (SELECT DISTINCT perm, cluster, assembly, chrom FROM fr), singles AS (SELECT chrom, observed, expected, observed / expected AS ratio FROM (SELECT chrom, count(*) AS observed FROM seen GROUP BY chrom) LEFT JOIN (SELECT chrom, count(*) / 4.0::DOUBLE AS expected FROM dr GROUP BY chrom) USING (chrom))"


@query(f"{_SOME}, ob AS (SELECT x.chrom AS a, y.chrom AS b, (SELECT count(*) FROM seen p JOIN seen q USING (cluster, assembly) WHERE p.chrom = x.chrom AND q.chrom = y.chrom) AS observed, x.ratio AS ra, y.ratio AS rb FROM singles x JOIN singles y ON x.chrom < y.chrom), nl AS (SELECT perm, p.chrom AS a, q.chrom AS b, count(*) AS n FROM dr p JOIN dr q USING (perm, cluster, assembly) WHERE p.chrom < q.chrom GROUP BY ALL), ex AS (SELECT a, b, sum(n) / 4.0::DOUBLE AS expected, sum((n >= observed)::INT) AS reached FROM nl JOIN ob USING (a, b) GROUP BY a, b) SELECT a, b, observed, round(coalesce(expected, 0), 6) AS expected, round(observed / expected, 6) AS ratio, round((1 + CASE WHEN observed = 0 THEN 4 ELSE coalesce(reached, 0) END) / 5.0::DOUBLE, 6) AS p_enriched, round(observed / expected / (ra * rb), 6) AS pair_only, round(observed::DOUBLE / greatest(sum(observed) OVER (), 1), 6) AS share FROM ob LEFT JOIN ex USING (a, b)")
def place_pair_table(spark, sf_dir):
    return rounded(nv.place_pair_table(clustered(spark, sf_dir).where("cluster BETWEEN 0 AND 4"), 4)[0])


@query(f"{_SOME} SELECT chrom, observed, round(expected, 6) AS expected, round(ratio, 6) AS ratio FROM singles")
def place_marginals(spark, sf_dir):
    return rounded(nv.place_pair_table(clustered(spark, sf_dir).where("cluster BETWEEN 0 AND 4"), 4)[1])


@query(f"{_FLAGS}, p AS (SELECT cluster, count(*) AS size, sum(\"end\" - start)::BIGINT AS bp, count(DISTINCT assembly) AS n_assemblies FROM clustered JOIN flags USING (cluster) WHERE novel GROUP BY cluster), u AS (SELECT count(DISTINCT assembly) AS u FROM clustered WHERE cluster >= 0), fl AS (SELECT DISTINCT unnest([1, 2, 3, greatest(1, u // 4), greatest(1, 2 * u // 4), greatest(1, 3 * u // 4), u - 1]) AS floor FROM u) SELECT floor, count(cluster) AS clusters, coalesce(sum(size), 0)::BIGINT AS bins, coalesce(sum(bp), 0)::BIGINT AS bp FROM fl LEFT JOIN p ON n_assemblies >= floor GROUP BY floor")
def recurrence(spark, sf_dir):
    bins = clustered(spark, sf_dir)
    return nv.recurrence(bins, _flags(bins))


@query(f"{_FLAGS}, p AS (SELECT cluster, count(*) AS size, sum(\"end\" - start)::BIGINT AS bp, count(DISTINCT assembly) AS n_assemblies, count(DISTINCT sample) AS n_samples FROM clustered JOIN flags USING (cluster) WHERE novel GROUP BY cluster), r AS (SELECT 'sequence' AS ranking, row_number() OVER (ORDER BY bp DESC, cluster) AS place, * FROM p UNION ALL SELECT 'recurrence', row_number() OVER (ORDER BY n_samples DESC, n_assemblies DESC, bp DESC, cluster), * FROM p) SELECT * FROM r WHERE place <= 3")
def novel_rankings(spark, sf_dir):
    bins = clustered(spark, sf_dir)
    return nv.novel_rankings(bins, _flags(bins), 3)


_DONORS = "SELECT n_name AS assembly, concat('D', CAST(floor(n_nationkey / 2.0) AS INT)) AS block FROM nation"


@query(f"{_MASK.replace(' AND amount < 30000', '')}, s AS (SELECT cluster, assembly, block, mask FROM sets JOIN ({_DONORS}) USING (assembly)), pr AS (SELECT x.block = y.block AS same, bit_count(x.mask & y.mask)::DOUBLE / greatest(bit_count(x.mask | y.mask), 1) AS j FROM s x JOIN s y ON x.cluster = y.cluster AND x.assembly < y.assembly) SELECT count(*) FILTER (same) AS same_n, round(avg(j) FILTER (same), 6) AS same_mean, count(*) FILTER (NOT same) AS other_n, round(avg(j) FILTER (NOT same), 6) AS other_mean FROM pr")
def donor_agreement(spark, sf_dir):
    sets = nv.chromosome_sets(clustered(spark, sf_dir), _PLACES).select("assembly", "cluster", "mask")
    donors = table(spark, sf_dir, "nation").selectExpr("n_name AS assembly", "concat('D', CAST(floor(n_nationkey / 2.0) AS INT)) AS block")
    return rounded(nv.donor_agreement(sets, donors))


@query(f"{_C}, c AS (SELECT count(*) FILTER (NOT is_ref) AS cohort, count(*) FILTER (annotated AND feature <> '' AND NOT is_ref) AS own, count(*) FILTER (is_ref) AS reference FROM clustered) SELECT CASE WHEN own > 0 THEN 'annotations' ELSE 'inferred' END AS source, CASE WHEN own > 0 THEN 'feature' ELSE 'inferred_feature' END AS \"column\", cohort, own AS labelled, reference FROM c")
def label_source(spark, sf_dir):
    return cn.label_source(clustered(spark, sf_dir).withColumn("inferred_feature", F.lit("")))


_UNITS = "u AS (SELECT n_name AS unit, concat('D', CAST(floor(n_nationkey / 2.0) AS INT)) AS block, concat('G', CAST(floor(n_nationkey / 2.0) AS INT) % 3) AS grp, CASE WHEN CAST(floor(n_nationkey / 2.0) AS INT) % 2 = 0 THEN 'mat/pat' ELSE 'hap1/hap2' END AS stratum FROM nation)"


def _units(spark, sf_dir):
    haplotype = F.expr("CASE WHEN CAST(floor(n_nationkey / 2.0) AS INT) % 2 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'mat' ELSE 'pat' END ELSE 'hap1' END")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("unit"), F.expr("concat('D', CAST(floor(n_nationkey / 2.0) AS INT))").alias("block"), F.expr("concat('G', CAST(floor(n_nationkey / 2.0) AS INT) % 3)").alias("grp"), cn.phasing(haplotype).alias("stratum"))


_VALUES = f"{_C}, {_UNITS}, fe AS (SELECT DISTINCT feature FROM clustered), xs AS (SELECT unit, block, grp, stratum, feature, (SELECT count(*) FROM clustered c WHERE c.assembly = u.unit AND c.feature = fe.feature)::DOUBLE AS x FROM u CROSS JOIN fe)"


def _values(spark, sf_dir):
    return clustered(spark, sf_dir).groupBy(F.col("assembly").alias("unit"), "feature").agg(F.count(F.lit(1)).alias("value"))


@query(f"""{_VALUES}, z AS (SELECT unit, feature, (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS z FROM xs), cd AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS code FROM u), pl AS (SELECT perm, stratum, unit, row_number() OVER (PARTITION BY perm, stratum ORDER BY {mix_sql('xor(7::UHUGEINT, (perm * 1000003 + code)::UHUGEINT)')}, code) - 1 AS place FROM cd, range(1, 50) r(perm)),
pr AS (SELECT perm, min(unit) AS a, max(unit) AS b FROM pl GROUP BY perm, stratum, place // 2 HAVING count(*) = 2 UNION ALL SELECT 0, min(unit), max(unit) FROM u GROUP BY block HAVING count(*) = 2), ms AS (SELECT perm, x.feature, avg(x.z * y.z) AS r, count(*) AS n FROM pr JOIN z x ON x.unit = a JOIN z y ON y.unit = b AND y.feature = x.feature GROUP BY ALL)
SELECT o.feature, o.n AS n_pairs, round(o.r, 6) AS concordance, round(avg((q.r >= o.r - 1e-9::DOUBLE)::INT), 6) AS p_similar, round(avg((q.r <= o.r + 1e-9::DOUBLE)::INT), 6) AS p_different FROM ms q JOIN ms o ON o.perm = 0 AND o.feature = q.feature WHERE q.perm > 0 GROUP BY o.feature, o.n, o.r""")
def concordance(spark, sf_dir):
    return rounded(cn.concordance(_values(spark, sf_dir), _units(spark, sf_dir), 49, 7))


@query(f"{_VALUES} SELECT block, grp, stratum, feature, round(avg(x), 6) AS value FROM xs GROUP BY ALL")
def donor_means(spark, sf_dir):
    return rounded(cn.donor_means(_values(spark, sf_dir), _units(spark, sf_dir)))


@query()
def effect_terms(spark, sf_dir):
    """Every term of the two-factor fits with its interval; held against a plain fit in the tests."""
    return rounded(cn.effect_terms(cn.donor_means(_values(spark, sf_dir), _units(spark, sf_dir))))


_COUNTS = "SELECT concat('C', o_custkey % 40) AS assembly, l_returnflag AS feature, count(*) FILTER (l_linestatus = 'F' OR l_linenumber < 3) AS x, count(*) FILTER (l_discount > 0.03) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"""WITH c AS ({_COUNTS}), g AS (SELECT assembly, feature, coalesce(x, 0)::DOUBLE AS x, coalesce(y, 0)::DOUBLE AS y FROM (SELECT DISTINCT assembly FROM c) a CROSS JOIN (SELECT DISTINCT feature FROM c) f LEFT JOIN c USING (assembly, feature)),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM g)
SELECT feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY feature""")
def copy_agreement(spark, sf_dir):
    """Two counts of the same families by assembly: their linear and rank correlation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.select(F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("assembly"), F.col("l_returnflag").alias("feature"), "l_linestatus", "l_linenumber", "l_discount")
    count = lambda rows: rows.groupBy("assembly", "feature").agg(F.count(F.lit(1)).alias("n_bins"))
    return rounded(cn.agreement(count(named.where("l_linestatus = 'F' OR l_linenumber < 3")), count(named.where("l_discount > 0.03"))))


@query()
def adjusted_effects(spark, sf_dir):
    """Least squares of two factors; the tests hold it against plain sums of squares."""
    return rounded(cn.adjusted_effects(cn.donor_means(_values(spark, sf_dir), _units(spark, sf_dir))))


@query(f"WITH {_UNITS} SELECT stratum, grp, count(DISTINCT block) AS donors FROM u GROUP BY ALL")
def crossing(spark, sf_dir):
    return cn.crossing(_units(spark, sf_dir))


_CLR = f"{_C}, n AS (SELECT assembly, cluster, count(*) AS n FROM clustered WHERE cluster >= 0 GROUP BY ALL), grid AS (SELECT a.assembly, c.cluster, ln(coalesce(n, 0) + 0.5::DOUBLE) AS l FROM (SELECT DISTINCT assembly FROM n) a CROSS JOIN (SELECT cluster FROM n GROUP BY cluster HAVING count(*) >= 0.25 * (SELECT count(DISTINCT assembly) FROM n)) c LEFT JOIN n USING (assembly, cluster)), clr AS (SELECT assembly, cluster, l - avg(l) OVER (PARTITION BY assembly) AS value FROM grid)"
_AIT = f"{_CLR}, d AS (SELECT x.assembly AS a, y.assembly AS b, sqrt(sum((x.value - y.value) ** 2)) AS distance FROM clr x JOIN clr y USING (cluster) WHERE x.assembly < y.assembly GROUP BY ALL)"
_GRP = f"{_AIT}, g AS (SELECT DISTINCT assembly AS unit, sample AS grp FROM clustered), d2 AS (SELECT a, b, distance FROM d UNION ALL SELECT b, a, distance FROM d)"


def _counts(spark, sf_dir):
    return pop.abundance(clustered(spark, sf_dir), "assembly")


def _distances(spark, sf_dir):
    return pop.aitchison(pop.clr(_counts(spark, sf_dir), "assembly"), "assembly")


def _groups(spark, sf_dir):
    return clustered(spark, sf_dir).select(F.col("assembly").alias("unit"), F.col("sample").alias("grp")).distinct()


@query(f"{_CLR} SELECT assembly, cluster, round(value, 6) AS value FROM clr")
def clr(spark, sf_dir):
    return rounded(pop.clr(_counts(spark, sf_dir), "assembly"))


@query(f"{_AIT} SELECT a, b, round(distance, 6) AS distance FROM d")
def aitchison(spark, sf_dir):
    return rounded(_distances(spark, sf_dir))


@query(f"{_C}, s AS (SELECT assembly, cluster, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY assembly) AS p FROM clustered WHERE cluster >= 0 GROUP BY assembly, cluster) SELECT x.assembly AS a, y.assembly AS b, round(1 - sum(least(x.p, y.p)), 6) AS distance FROM s x JOIN s y USING (cluster) WHERE x.assembly < y.assembly GROUP BY ALL")
def bray_curtis(spark, sf_dir):
    return rounded(pop.bray_curtis(_counts(spark, sf_dir), "assembly"))


@query(f"{_GRP}, z AS (SELECT grp, count(*) AS m FROM g GROUP BY grp), p AS (SELECT ga.grp AS ga, gb.grp AS gb, distance * distance AS sq FROM d JOIN g ga ON ga.unit = a JOIN g gb ON gb.unit = b), t AS (SELECT sum(sq) / (SELECT count(*) FROM g) AS sst, (SELECT sum(sq / m) FROM p JOIN z ON z.grp = p.ga WHERE ga = gb) AS ssw, (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM z) AS k FROM p) SELECT round(((sst - ssw) / (k - 1)) / (ssw / (n - k)), 6) AS f, round((sst - ssw) / sst, 6) AS r2 FROM t")
def permanova_f(spark, sf_dir):
    return rounded(pop.pseudo_f(_distances(spark, sf_dir), _groups(spark, sf_dir)))


@query(f"{_GRP}, j AS (SELECT cluster, grp, sum(value) AS s, count(*) AS m, sum(value * value) AS q FROM clr JOIN g ON unit = assembly GROUP BY ALL), k AS (SELECT cluster, sum(s) AS s, sum(m) AS n, sum(q) AS q, sum(s * s / m) AS b, count(*) AS k FROM j GROUP BY cluster) SELECT cluster, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f, round((b - s * s / n) / (q - s * s / n), 6) AS eta2 FROM k")
def anova(spark, sf_dir):
    found = pop.anova_f(pop.clr(_counts(spark, sf_dir), "assembly").withColumnRenamed("assembly", "unit"), _groups(spark, sf_dir), "unit")
    return rounded(rounded(found, 5, ["f"]), 6, ["eta2"])


@query("WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS m FROM p) SELECT p_partkey, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def benjamini_hochberg(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 10007) / 10007.0).alias("p"))
    return rounded(pop.benjamini_hochberg(tests, "p_partkey"))


@query(f"{_GRP}, near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY distance, b) - 1 AS r FROM d2), v AS (SELECT a, grp, sum(1 + 1e-6::DOUBLE * (5 - r)) AS w FROM near JOIN g ON unit = b WHERE r < 5 GROUP BY ALL), t AS (SELECT a, grp, row_number() OVER (PARTITION BY a ORDER BY w DESC, grp) AS r FROM v) SELECT a, g.grp, t.grp AS predicted FROM t JOIN g ON unit = a WHERE r = 1")
def knn_accuracy(spark, sf_dir):
    return pop.knn_accuracy(_distances(spark, sf_dir), _groups(spark, sf_dir), 5)


@query(f"{_GRP}, m AS (SELECT a, ga.grp AS ga, gb.grp AS gb, avg(distance) AS d FROM d2 JOIN g ga ON ga.unit = a JOIN g gb ON gb.unit = b GROUP BY ALL), o AS (SELECT a, ga, max(d) FILTER (ga = gb) AS own, min(d) FILTER (ga <> gb) AS other FROM m GROUP BY a, ga) SELECT a, round(CASE WHEN (SELECT count(*) FROM g WHERE grp = ga) <= 1 THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM o")
def silhouette(spark, sf_dir):
    return rounded(pop.silhouette(_distances(spark, sf_dir), _groups(spark, sf_dir)))


@query(f"{_GRP} SELECT CASE WHEN ga.grp = gb.grp THEN 'same' ELSE 'other' END AS relation, count(*) AS n, round(avg(distance), 6) AS mean FROM d JOIN g ga ON ga.unit = a JOIN g gb ON gb.unit = b GROUP BY 1")
def relation_means(spark, sf_dir):
    return rounded(pop.relation_means(_distances(spark, sf_dir), _groups(spark, sf_dir)))


# --- positioned hashes: events of a user in order of time ---------------------

_STREAM = "WITH stream AS (SELECT user_id AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id % 97 AS hash FROM events)"


def _stream(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), F.unix_timestamp("ts").alias("pos"), (F.col("event_id") % 97).alias("hash"))


_LAGS = f"{_STREAM}, lags AS (SELECT b.pos - a.pos AS lag, count(*) AS n FROM stream a JOIN stream b USING (contig, hash) WHERE b.pos - a.pos BETWEEN 60 AND 40000 GROUP BY 1)"


@query(f"{_LAGS} SELECT * FROM lags")
def pair_correlation(spark, sf_dir):
    return po.pair_correlation(_stream(spark, sf_dir), ["contig"], 60, 40_000)


@query(f"{_LAGS}, axis AS (SELECT i AS lag, coalesce(n, 0) AS n FROM range(60, 40001) r(i) LEFT JOIN lags ON lag = i) SELECT lag, n, round(sum(n) OVER (ORDER BY lag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE, 6) AS smoothed FROM axis")
def smooth_peaks(spark, sf_dir):
    return rounded(po.smooth(po.pair_correlation(_stream(spark, sf_dir), ["contig"], 60, 40_000), 60, 40_000))


_M = "18446744073709551616::UHUGEINT"


def _raw_sql(x: str) -> str:
    """The mixer without its increment: SplitMix64 of the value less the increment."""
    return mix_sql(f"(({x}) + {(1 << 64) - hashing.GAMMA}::UHUGEINT) % {_M}")


def _token_sql(d: int) -> str:
    return f"SELECT contig, pos, {d} AS step, hash AS h1, lead(hash, {d}) OVER w AS h2 FROM stream WINDOW w AS (PARTITION BY contig ORDER BY pos, hash)"


_TOKENS = f"{_STREAM}, landmarks AS ({' UNION ALL '.join(_token_sql(d) for d in (1, 2))}), tokens AS (SELECT contig, pos, step, xor(xor({_raw_sql(f'(h1::UHUGEINT * {hashing.GAMMA}::UHUGEINT) % {_M}')}, {_raw_sql(f'(h2::UHUGEINT * {hashing.PAIR_2}::UHUGEINT) % {_M}')}), {_raw_sql('step::UHUGEINT + 40503::UHUGEINT')}) AS token FROM landmarks WHERE h2 IS NOT NULL)"


def _tokens(spark, sf_dir):
    with hashing.wrapping(spark):
        return po.pair_tokens(_stream(spark, sf_dir), ["contig"], fanout=2)


@query(f"{_TOKENS} SELECT contig, pos, step, (token % 9223372036854775808::UHUGEINT)::BIGINT AS low63 FROM tokens")
def pair_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("contig", "pos", "step", F.col("token").bitwiseAND(F.lit((1 << 63) - 1)).alias("low63"))


@query(f"{_TOKENS}, m AS (SELECT token, count(*) AS m FROM tokens GROUP BY token) SELECT count(*) AS distinct_tokens, round(avg((m = 1)::INTEGER), 6) AS frac_unique, round(median(m), 6) AS median, round(quantile_cont(m, 0.99), 6) AS p99, max(m) AS most FROM m")
def token_specificity(spark, sf_dir):
    return rounded(po.specificity(_tokens(spark, sf_dir)))


_MATCH = f"{_STREAM}, a AS (SELECT pos, hash * 1000 + contig % 50 AS token FROM stream WHERE contig % 2 = 0), b AS (SELECT pos, hash * 1000 + contig % 50 AS token FROM stream WHERE contig % 2 = 1 OR contig % 3 = 0), ra AS (SELECT token FROM a GROUP BY token HAVING count(*) <= 4), rb AS (SELECT token FROM b GROUP BY token HAVING count(*) <= 4), matches AS (SELECT a.pos AS a_pos, b.pos AS b_pos FROM a JOIN b USING (token) WHERE token IN (SELECT token FROM ra) AND token IN (SELECT token FROM rb))"


def _matches(spark, sf_dir):
    tokens = _stream(spark, sf_dir).withColumn("token", F.col("hash") * 1000 + F.col("contig") % 50)
    return po.match(tokens.where("contig % 2 = 0"), tokens.where("contig % 2 = 1 OR contig % 3 = 0"))


@query(f"{_MATCH} SELECT a_pos, b_pos FROM matches")
def token_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"{_MATCH}, m AS (SELECT *, a_pos // 100000 AS w, b_pos - a_pos AS o, min(b_pos - a_pos) OVER (PARTITION BY a_pos // 100000) AS least, count(*) OVER (PARTITION BY a_pos // 100000) AS total FROM matches), c AS (SELECT w, (o - least) // 10000 AS k, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT w, k, row_number() OVER (PARTITION BY w ORDER BY n DESC, k) AS r FROM c) SELECT a_pos, b_pos, total >= 10 AND abs(o - least - p.k * 10000) <= 10000 AS collinear FROM m JOIN p ON p.w = m.w AND p.r = 1")
def collinear(spark, sf_dir):
    return po.collinear(_matches(spark, sf_dir))
