"""Queries: group tests over nations as units, in donors of two and three groups, with permutation nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouptests as gt
from ..operators import population as pop
from ..tables import materialised
from .mappings import table
from .q_clusters import CLUSTERED_SQL, clustered
from .q_features import mix_sql
from .q_statistics import _AIT, _CLR
from .registry import query, rounded

PERMUTATIONS, SEED = 49, 7
_COHORT = "SELECT n_name AS unit, concat('D', CAST(floor(n_nationkey / 2) AS INT)) AS block, concat('G', CAST(floor(n_nationkey / 2) AS INT) % 3) AS grp FROM nation"
_G = f"g AS ({_COHORT.replace('n_nationkey / 2', 'n_nationkey / 2.0')} WHERE n_name IN (SELECT assembly FROM clustered WHERE cluster >= 0))"


def labels_sql(groups: str, keys: tuple[str, ...] = (), seed: int = SEED) -> str:
    """blocks, spread and labels (keys, perm, unit, grp) of the CTE ``groups``."""
    k, on = "".join(f"{x}, " for x in keys), "".join(f" AND s.{x} = b.{x}" for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    same = "".join(f" AND g.{x} = s.{x}" for x in keys)
    return f"""blocks AS (SELECT *, row_number() OVER ({part} ORDER BY block) - 1 AS code FROM (SELECT {k}block, min(grp) AS grp FROM {groups} GROUP BY {k}block)),
spread AS (SELECT {k}perm, block, row_number() OVER (PARTITION BY {k}perm ORDER BY {mix_sql(f'xor({seed}::UHUGEINT, (perm * 1000003 + code)::UHUGEINT)')}, code) - 1 AS place FROM blocks, range(1, {PERMUTATIONS + 1}) r(perm)),
labels AS (SELECT {"".join(f"s.{x}, " for x in keys)}s.perm, g.unit, b.grp FROM spread s JOIN blocks b ON b.code = s.place{on} JOIN {groups} g ON g.block = s.block{same} UNION ALL SELECT {k}0, unit, grp FROM {groups})"""


def permanova_sql(pairs: str, groups: str, keys: tuple[str, ...] = (), seed: int = SEED) -> str:
    """CTEs up to res: the result of ``permanova`` for the CTEs ``pairs`` and ``groups``."""
    k = "".join(f"{x}, " for x in keys)
    using = f"({', '.join([*keys, 'perm'])})"
    eq = lambda l, r: "".join(f" AND {l}.{x} = {r}.{x}" for x in keys)
    total = f"JOIN (SELECT {k}sum(distance * distance) AS alls FROM {pairs} GROUP BY {', '.join(keys)}) USING ({', '.join(keys)})" if keys else f"CROSS JOIN (SELECT sum(distance * distance) AS alls FROM {pairs})"
    return f"""{labels_sql(groups, keys, seed)}, sz AS (SELECT {k}perm, grp, count(*) AS m FROM labels GROUP BY ALL), shape AS (SELECT {k}perm, sum(m)::BIGINT AS n, count(*) AS k FROM sz GROUP BY {k}perm),
within AS (SELECT {"".join(f"x.{c}, " for c in keys)}x.perm, sum(d.distance * d.distance / m) AS ssw FROM {pairs} d JOIN labels x ON x.unit = d.a{eq('x', 'd')} JOIN labels y ON y.unit = d.b AND y.perm = x.perm AND y.grp = x.grp{eq('y', 'x')} JOIN sz z ON z.perm = x.perm AND z.grp = x.grp{eq('z', 'x')} GROUP BY {"".join(f"x.{c}, " for c in keys)}x.perm),
fs AS (SELECT {k}perm, n, k, CASE WHEN ssw > 0 AND n > k THEN ((alls / n - ssw) / (k - 1)) / (ssw / (n - k)) END AS f, CASE WHEN ssw > 0 AND n > k THEN (alls / n - ssw) / (alls / n) END AS r2 FROM shape JOIN within USING {using} {total}),
res AS (SELECT {"".join(f"o.{c}, " for c in keys)}o.f, o.r2, (1 + count(*) FILTER (q.f >= o.f - 1e-9::DOUBLE * abs(o.f)))::DOUBLE / (1 + count(*)) AS p, avg(q.r2) AS r2_null_mean, quantile_cont(q.r2, 0.95) AS r2_null_p95, o.r2 - avg(q.r2) AS r2_excess, o.n AS n_units, o.k AS n_groups FROM fs q JOIN fs o ON o.perm = 0{eq('o', 'q')} WHERE q.perm > 0 GROUP BY {"".join(f"o.{c}, " for c in keys)}o.f, o.r2, o.n, o.k)"""


def _result(keys: tuple[str, ...] = ()) -> str:
    return f"SELECT {''.join(f'{x}, ' for x in keys)}round(f, 5) AS f, round(r2, 6) AS r2, round(p, 6) AS p, round(r2_null_mean, 6) AS r2_null_mean, round(r2_null_p95, 6) AS r2_null_p95, round(r2_excess, 6) AS r2_excess, n_units, n_groups FROM res"


def _shown(df):
    return rounded(rounded(df, 5, ["f"]))


def _cohort(spark, sf_dir, bins):
    named = table(spark, sf_dir, "nation").selectExpr("n_name AS unit", "concat('D', CAST(floor(n_nationkey / 2) AS INT)) AS block", "concat('G', CAST(floor(n_nationkey / 2) AS INT) % 3) AS grp")
    return materialised(named.join(bins.where("cluster >= 0").select(F.col("assembly").alias("unit")).distinct(), "unit", "left_semi"))


def _bins(spark, sf_dir):
    return materialised(clustered(spark, sf_dir).select("assembly", "cluster", "feature", "chrom", "annotated"))


def _values(bins, floor=0.25, pseudo=0.5):
    return materialised(pop.clr(pop.abundance(bins, "assembly"), "assembly", floor, pseudo).withColumnRenamed("assembly", "unit"))


def _all(spark, sf_dir):
    bins = _bins(spark, sf_dir)
    values = _values(bins)
    return bins, _cohort(spark, sf_dir, bins), values, materialised(gt.euclidean(values))


def _alone(groups):
    """Every unit a block of its own."""
    return groups.select("unit", F.col("unit").alias("block"), "grp")


@query(f"{_AIT}, {_G}, h AS (SELECT unit, unit AS block, grp FROM g), {permanova_sql('d', 'h')} {_result()}")
def permanova(spark, sf_dir):
    _, groups, _, pairs = _all(spark, sf_dir)
    return _shown(gt.permanova(pairs, _alone(groups), PERMUTATIONS, SEED))


@query(f"{_AIT}, {_G}, {permanova_sql('d', 'g')} {_result()}")
def permanova_by_donor(spark, sf_dir):
    """Labels are shuffled between donors, so that both units of a donor stay in one group."""
    _, groups, _, pairs = _all(spark, sf_dir)
    return _shown(gt.permanova(pairs, groups, PERMUTATIONS, SEED))


@query(f"WITH {CLUSTERED_SQL}, {_G}, {labels_sql('g')} SELECT perm, unit, grp FROM labels")
def permuted_labels(spark, sf_dir):
    return gt.permuted_labels(_cohort(spark, sf_dir, _bins(spark, sf_dir)), PERMUTATIONS, SEED)


@query(f"WITH {CLUSTERED_SQL}, {_G} SELECT block AS unit, cluster, count(*) AS n FROM clustered JOIN g ON unit = assembly WHERE cluster >= 0 GROUP BY ALL")
def donor_counts(spark, sf_dir):
    bins = _bins(spark, sf_dir)
    return gt.units(bins, _cohort(spark, sf_dir, bins), "block")[0]


@query("WITH g AS (SELECT n_name AS unit, n_name AS block, 'G' || (n_nationkey % 9) AS grp FROM nation) SELECT * FROM g WHERE grp IN (SELECT grp FROM g GROUP BY grp HAVING count(*) >= 3)")
def without_small_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").selectExpr("n_name AS unit", "n_name AS block", "concat('G', n_nationkey % 9) AS grp")
    return gt.drop_small_groups(groups, 3)


_DESC = f"""WITH {CLUSTERED_SQL}, fv AS (SELECT cluster, feature, count(*) AS n FROM clustered WHERE cluster >= 0 AND feature NOT IN ('', 'unannotated') GROUP BY ALL), cv AS (SELECT cluster, chrom, count(*) AS n FROM clustered WHERE cluster >= 0 AND chrom NOT IN ('', 'unannotated') GROUP BY ALL),
fb AS (SELECT cluster, feature, n::DOUBLE / sum(n) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, feature) AS r FROM fv), cb AS (SELECT cluster, chrom, n::DOUBLE / sum(n) OVER (PARTITION BY cluster) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, chrom) AS r FROM cv),
descriptions AS (SELECT s.cluster, size, coalesce(fb.feature, 'unannotated') AS feature, fb.share AS feature_frac, coalesce(cb.chrom, '') AS chrom, cb.share AS chrom_purity, regexp_matches(coalesce(fb.feature, ''), '^(asat|hsat|bsat|gsat|rdna)') AS is_satellite, split_part(coalesce(fb.feature, 'unannotated'), '_', 1) AS family FROM (SELECT cluster, count(*) AS size FROM clustered WHERE cluster >= 0 GROUP BY cluster) s LEFT JOIN fb ON fb.cluster = s.cluster AND fb.r = 1 LEFT JOIN cb ON cb.cluster = s.cluster AND cb.r = 1)"""


@query(f"{_DESC} SELECT cluster, size, feature, round(feature_frac, 6) AS feature_frac, chrom, round(chrom_purity, 6) AS chrom_purity, is_satellite, family FROM descriptions")
def cluster_descriptions(spark, sf_dir):
    return rounded(gt.descriptions(_bins(spark, sf_dir)))


@query(f"""{_AIT}, {_G}, {labels_sql('g')}, d2 AS (SELECT a, b, distance * distance AS sq FROM d UNION ALL SELECT b, a, distance * distance FROM d), zs AS (SELECT perm, grp, count(*) AS m FROM labels GROUP BY ALL), own AS (SELECT x.perm, x.grp, x.unit, coalesce(sum(sq), 0) / m AS mean FROM labels x JOIN zs ON zs.perm = x.perm AND zs.grp = x.grp LEFT JOIN (SELECT a, sq, y.perm, y.grp FROM d2 JOIN labels y ON y.unit = b) q ON q.a = x.unit AND q.perm = x.perm AND q.grp = x.grp GROUP BY x.perm, x.grp, x.unit, m),
sp AS (SELECT perm, grp, sqrt(greatest(mean - avg(mean) OVER (PARTITION BY perm, grp) / 2, 0)) AS s FROM own), bg AS (SELECT perm, grp, sum(s) AS s, sum(s * s) AS q, count(*) AS m FROM sp GROUP BY ALL), t AS (SELECT perm, sum(s) AS s, sum(q) AS q, sum(m) AS n, sum(s * s / m) AS b, count(*) AS k FROM bg GROUP BY perm), fs AS (SELECT perm, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS f FROM t)
SELECT round(o.f, 4) AS f, round((1 + count(*) FILTER (x.f >= o.f - 1e-9::DOUBLE * abs(o.f)))::DOUBLE / (1 + count(*)), 6) AS p FROM fs x JOIN fs o ON o.perm = 0 WHERE x.perm > 0 GROUP BY o.f""")
def permdisp(spark, sf_dir):
    _, groups, _, pairs = _all(spark, sf_dir)
    return rounded(rounded(gt.permdisp(pairs, groups, PERMUTATIONS, SEED), 4, ["f"]))


@query()
def pcoa_axes(spark, sf_dir):
    """Eigenvectors have no SQL twin; the tests hold their distances against the given ones."""
    return rounded(gt.pcoa(_all(spark, sf_dir)[3])[0].select("unit", F.posexplode("coordinates").alias("axis", "value")), 4)


def _anova_sql(values: str, column: str) -> str:
    return f"""{labels_sql('g')}, bg AS (SELECT perm, {column}, grp, sum(value) AS s, count(*) AS m FROM {values} JOIN labels USING (unit) GROUP BY ALL), bb AS (SELECT perm, {column}, sum(s * s / m) AS b, count(*) AS k FROM bg GROUP BY ALL), tt AS (SELECT {column}, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS sst FROM {values} GROUP BY {column}),
fs AS (SELECT perm, {column}, ((b - n * mean * mean) / (k - 1)) / greatest(greatest(sst - (b - n * mean * mean), 0) / (n - k), 1e-300::DOUBLE) AS f, CASE WHEN sst > 0 THEN (b - n * mean * mean) / sst ELSE 0 END AS eta2 FROM bb JOIN tt USING ({column})),
tops AS (SELECT perm, max(f) AS top FROM fs WHERE perm > 0 GROUP BY perm), tested AS (SELECT o.{column}, o.f, o.eta2, (1 + count(*) FILTER (x.f >= o.f - 1e-9::DOUBLE * abs(o.f)))::DOUBLE / (1 + count(*)) AS p_perm, (1 + (SELECT count(*) FROM tops WHERE top >= o.f - 1e-9::DOUBLE * abs(o.f)))::DOUBLE / {PERMUTATIONS + 1} AS p_fwer FROM fs x JOIN fs o ON o.perm = 0 AND o.{column} = x.{column} WHERE x.perm > 0 GROUP BY o.{column}, o.f, o.eta2),
ranked AS (SELECT *, count(*) OVER (ORDER BY p_perm RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER () AS m FROM tested), done AS (SELECT {column}, f, eta2, p_perm, p_fwer, least(1, min(p_perm * m / r) OVER (ORDER BY p_perm DESC RANGE UNBOUNDED PRECEDING)) AS q_bh FROM ranked)"""


_TESTED = "SELECT {}, round(f, 4) AS f, round(eta2, 6) AS eta2, round(p_perm, 6) AS p_perm, round(p_fwer, 6) AS p_fwer, round(q_bh, 6) AS q_bh FROM done"


@query(f"{_CLR}, {_G}, v AS (SELECT assembly AS unit, cluster, value FROM clr), {_anova_sql('v', 'cluster')} {_TESTED.format('cluster')}")
def cluster_tests(spark, sf_dir):
    _, groups, values, _ = _all(spark, sf_dir)
    return rounded(rounded(gt.column_tests(values, groups, PERMUTATIONS, SEED), 4, ["f"]))


@query(f"{_CLR}, {_G}, v AS (SELECT assembly AS unit, cluster, value FROM clr), {_anova_sql('v', 'cluster')}, c AS (SELECT perm, avg(eta2) FILTER (cluster % 3 = 0) AS i, avg(eta2) FILTER (cluster % 3 <> 0) AS o FROM fs GROUP BY perm), nul AS (SELECT avg(i - o) AS mean, stddev_samp(i - o) AS sd FROM c WHERE perm > 0) SELECT round(i, 6) AS mean_eta2_in, round(o, 6) AS mean_eta2_out, round(i - o, 6) AS difference, round(mean, 6) AS null_mean, round(sd, 6) AS null_sd, round((i - o - mean) / sd, 4) AS z, round((1 + (SELECT count(*) FROM c x WHERE x.perm > 0 AND x.i - x.o >= c.i - c.o - 1e-9::DOUBLE * abs(c.i - c.o)))::DOUBLE / {PERMUTATIONS + 1}, 6) AS p FROM c, nul WHERE perm = 0")
def signal_contrast(spark, sf_dir):
    _, groups, values, _ = _all(spark, sf_dir)
    inside = values.select("cluster").distinct().where("cluster % 3 = 0")
    return rounded(rounded(gt.contrast(values, groups, inside, PERMUTATIONS, SEED), 4, ["z"]))


_CONFOUNDERS = "v AS (SELECT assembly AS unit, unnest(['annotated fraction', 'noise fraction', 'total bins']) AS name, unnest([avg(annotated::INT), avg((cluster < 0)::INT), count(*)::DOUBLE]) AS value FROM clustered WHERE assembly IN (SELECT unit FROM g) GROUP BY assembly)"


@query(f"WITH {CLUSTERED_SQL}, {_G}, {_CONFOUNDERS}, {_anova_sql('v', 'name')} {_TESTED.format('name')}")
def confounders(spark, sf_dir):
    """Do completeness, noise and annotation differ between groups?"""
    bins = _bins(spark, sf_dir)
    sums = bins.groupBy(F.col("assembly").alias("unit")).agg(F.avg(F.col("annotated").cast("int")).alias("a"), F.avg((F.col("cluster") < 0).cast("int")).alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    groups = _cohort(spark, sf_dir, bins)
    values = sums.join(groups, "unit", "left_semi").selectExpr("unit", "stack(3, 'annotated fraction', a, 'noise fraction', b, 'total bins', c) AS (name, value)")
    return rounded(rounded(gt.column_tests(materialised(values), groups, PERMUTATIONS, SEED, "name"), 4, ["f"]))


@query(f"{_AIT}, {_G}, d2 AS (SELECT a, b, distance FROM d UNION ALL SELECT b, a, distance FROM d), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d2), o AS (SELECT a, min(r) AS r FROM r JOIN g x ON x.unit = a JOIN g y ON y.unit = b AND y.block = x.block GROUP BY a) SELECT count(*) AS n, round(avg(r), 6) AS mean_rank, (SELECT count(*) FROM g) / 2.0::DOUBLE AS chance_rank, round(avg((r = 1)::INT), 6) AS top1 FROM o")
def partner_ranks(spark, sf_dir):
    _, groups, _, pairs = _all(spark, sf_dir)
    return rounded(gt.partner_ranks(pairs, groups))


_GRID = """WITH {0}, n AS (SELECT assembly, cluster, count(*) AS n FROM clustered WHERE cluster >= 0 GROUP BY ALL), cells(fl, ps) AS (VALUES (0.0::DOUBLE, 0.5::DOUBLE), (0.0, 1.0), (0.9, 0.5), (0.9, 1.0)), kept AS (SELECT fl, ps, cluster FROM cells, n GROUP BY fl, ps, cluster HAVING count(*) >= fl * (SELECT count(DISTINCT assembly) FROM n)),
lg AS (SELECT fl, ps, a.assembly AS unit, k.cluster, ln(coalesce(n, 0) + ps) AS l FROM kept k CROSS JOIN (SELECT DISTINCT assembly FROM n) a LEFT JOIN n ON n.assembly = a.assembly AND n.cluster = k.cluster), v AS (SELECT fl, ps, unit, cluster, l - avg(l) OVER (PARTITION BY fl, ps, unit) AS value FROM lg),
dd AS (SELECT x.fl, x.ps, x.unit AS a, y.unit AS b, sqrt(sum((x.value - y.value) ** 2)) AS distance FROM v x JOIN v y ON x.fl = y.fl AND x.ps = y.ps AND x.cluster = y.cluster AND x.unit < y.unit GROUP BY ALL), {1}, gg AS (SELECT fl, ps, unit, block, grp FROM g, cells)"""


@query(f"{_GRID.format(CLUSTERED_SQL, _G)}, {permanova_sql('dd', 'gg', ('fl', 'ps'))} {_result(('fl', 'ps'))}")
def permanova_grid(spark, sf_dir):
    """The test over a grid of prevalence floors and pseudocounts."""
    bins = _bins(spark, sf_dir)
    groups = _cohort(spark, sf_dir, bins)
    pairs = keyed = None
    for floor in (0.0, 0.9):
        for pseudo in (0.5, 1.0):
            cell = {"fl": F.lit(floor), "ps": F.lit(pseudo)}
            one, own = gt.euclidean(_values(bins, floor, pseudo)).withColumns(cell), groups.withColumns(cell)
            pairs, keyed = (one, own) if pairs is None else (pairs.unionByName(one), keyed.unionByName(own))
    return _shown(gt.permanova(materialised(pairs), keyed, PERMUTATIONS, SEED, ("fl", "ps")))


@query(f"WITH {CLUSTERED_SQL}, s AS (SELECT assembly, cluster, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY assembly) AS p FROM clustered WHERE cluster >= 0 GROUP BY assembly, cluster), bc AS (SELECT x.assembly AS a, y.assembly AS b, 1 - sum(least(x.p, y.p)) AS distance FROM s x JOIN s y USING (cluster) WHERE x.assembly < y.assembly GROUP BY ALL), {_G}, {permanova_sql('bc', 'g')} {_result()}")
def permanova_bray(spark, sf_dir):
    bins = _bins(spark, sf_dir)
    pairs = materialised(pop.bray_curtis(pop.abundance(bins, "assembly"), "assembly"))
    return _shown(gt.permanova(pairs, _cohort(spark, sf_dir, bins), PERMUTATIONS, SEED))


@query(f"{_CLR}, x AS (SELECT assembly, ln(count(*)) AS x FROM clustered WHERE cluster >= 0 GROUP BY assembly), fit AS (SELECT cluster, regr_slope(value, x) AS slope, avg(value) AS my, avg(x) AS mx FROM clr JOIN x USING (assembly) GROUP BY cluster), left_ AS (SELECT assembly AS unit, cluster, value - my - slope * (x - mx) AS value FROM clr JOIN x USING (assembly) JOIN fit USING (cluster)), dr AS (SELECT p.unit AS a, q.unit AS b, sqrt(sum((p.value - q.value) ** 2)) AS distance FROM left_ p JOIN left_ q USING (cluster) WHERE p.unit < q.unit GROUP BY ALL), {_G}, {permanova_sql('dr', 'g')} {_result()}")
def permanova_residual(spark, sf_dir):
    """After a straight line over the log of a unit's bins is taken out of each cluster."""
    bins, groups, values, _ = _all(spark, sf_dir)
    totals = bins.where("cluster >= 0").groupBy(F.col("assembly").alias("unit")).agg(F.log(F.count(F.lit(1))).alias("x"))
    return _shown(gt.permanova(materialised(gt.euclidean(gt.residuals(values, totals))), groups, PERMUTATIONS, SEED))


@query(f"{_AIT}, {_G}, drops AS (SELECT unit AS dropped FROM g WHERE (SELECT count(*) FROM g h WHERE h.grp = g.grp) > 2), gj AS (SELECT dropped, unit, block, grp FROM g JOIN drops ON unit <> dropped), dj AS (SELECT dropped, a, b, distance FROM d JOIN drops ON a <> dropped AND b <> dropped), {permanova_sql('dj', 'gj', ('dropped',))} {_result(('dropped',))}")
def jackknife(spark, sf_dir):
    """The test without each unit in turn."""
    _, groups, _, pairs = _all(spark, sf_dir)
    left, kept = gt.without_each(pairs, groups)
    return _shown(gt.permanova(left, kept, PERMUTATIONS, SEED, ("dropped",)))


@query(f"{_AIT}, {_G}, two AS (SELECT x.grp AS one, y.grp AS two FROM (SELECT DISTINCT grp FROM g) x JOIN (SELECT DISTINCT grp FROM g) y ON x.grp < y.grp), gc AS (SELECT one, two, unit, block, grp FROM g JOIN two ON grp IN (one, two)), dc AS (SELECT one, two, a, b, distance FROM d JOIN g x ON x.unit = a JOIN g y ON y.unit = b JOIN two ON x.grp IN (one, two) AND y.grp IN (one, two)), {permanova_sql('dc', 'gc', ('one', 'two'))} {_result(('one', 'two'))}")
def pairwise_contrasts(spark, sf_dir):
    _, groups, _, pairs = _all(spark, sf_dir)
    left, kept = gt.each_two_groups(pairs, groups)
    return _shown(gt.permanova(left, kept, PERMUTATIONS, SEED, ("one", "two")))


_FAMILIES = """fams AS (SELECT feature AS family FROM descriptions GROUP BY feature HAVING count(*) >= 2), nf AS (SELECT fams.family, assembly AS unit, c.cluster, count(*) AS n FROM clustered c JOIN descriptions s ON s.cluster = c.cluster JOIN fams ON fams.family = s.feature GROUP BY ALL),
lf AS (SELECT k.family, u.unit, k.cluster, ln(coalesce(n, 0) + 0.5::DOUBLE) AS l FROM (SELECT DISTINCT family, cluster FROM nf) k JOIN (SELECT DISTINCT family, unit FROM nf) u USING (family) LEFT JOIN nf ON nf.family = k.family AND nf.cluster = k.cluster AND nf.unit = u.unit), vf AS (SELECT family, unit, cluster, l - avg(l) OVER (PARTITION BY family, unit) AS value FROM lf),
df AS (SELECT x.family, x.unit AS a, y.unit AS b, sqrt(sum((x.value - y.value) ** 2)) AS distance FROM vf x JOIN vf y ON x.family = y.family AND x.cluster = y.cluster AND x.unit < y.unit GROUP BY ALL)"""


@query(f"{_DESC}, {_FAMILIES}, {_G}, gf AS (SELECT family, unit, block, grp FROM g JOIN (SELECT DISTINCT family, unit FROM nf) USING (unit)), {permanova_sql('df', 'gf', ('family',))} {_result(('family',))}")
def family_tests(spark, sf_dir):
    """The test within each family of two clusters or more that share their modal feature."""
    bins = _bins(spark, sf_dir)
    named = gt.descriptions(bins).select("cluster", F.col("feature").alias("family"))
    families = named.groupBy("family").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("family")
    counts = materialised(pop.abundance(bins, "assembly").withColumnRenamed("assembly", "unit").join(named.join(families, "family"), "cluster"))
    pairs = materialised(gt.euclidean(gt.composition(counts, ("family",)), ("family",)))
    keyed = counts.select("family", "unit").distinct().join(_cohort(spark, sf_dir, bins), "unit").select("family", "unit", "block", "grp")
    return _shown(gt.permanova(pairs, keyed, PERMUTATIONS, SEED, ("family",)))


_PROFILE = f"{_CLR}, {_G}, tn AS (SELECT assembly, sum(n) AS t FROM n GROUP BY assembly), prof AS (SELECT cluster, grp, avg(coalesce(n.n / t, 0)::DOUBLE) * 1e6 AS mean_ppm, avg(value) AS mean_clr, avg((n.n IS NOT NULL)::INT) AS prevalence FROM clr JOIN g ON unit = assembly JOIN tn USING (assembly) LEFT JOIN n USING (assembly, cluster) GROUP BY ALL)"


@query(f"{_PROFILE} SELECT cluster, grp, round(mean_ppm, 4) AS mean_ppm, round(mean_clr, 6) AS mean_clr, round(prevalence, 6) AS prevalence FROM prof")
def group_profile(spark, sf_dir):
    bins, groups, values, _ = _all(spark, sf_dir)
    counts = pop.abundance(bins, "assembly").withColumnRenamed("assembly", "unit")
    return rounded(rounded(gt.group_profile(counts, groups, values), 4, ["mean_ppm"]))


@query(f"{_PROFILE}, fl AS (SELECT 1e6::DOUBLE / median(t) AS fl FROM tn) SELECT cluster, arg_max(grp, mean_ppm) AS top_group, round(log2((max(mean_ppm) + fl) / (min(mean_ppm) + fl)), 6) AS log2_max_over_min FROM prof, fl GROUP BY cluster, fl")
def group_folds(spark, sf_dir):
    bins, groups, values, _ = _all(spark, sf_dir)
    counts = materialised(pop.abundance(bins, "assembly").withColumnRenamed("assembly", "unit"))
    return rounded(gt.group_folds(gt.group_profile(counts, groups, values), counts))


def _sizes(bins):
    return bins.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("is_target", F.col("cluster") % 4 == 0)


@query()
def size_matched(spark, sf_dir):
    """Greedy choices without replacement have no SQL twin; the tests hold them against plain ones."""
    return gt.size_matched(_sizes(_bins(spark, sf_dir)), 5, SEED)


@query()
def matched_control(spark, sf_dir):
    """Rests on the draws of ``size_matched``; the tests hold its parts against the others."""
    bins = _bins(spark, sf_dir)
    counts = pop.abundance(bins, "assembly").withColumnRenamed("assembly", "unit")
    return rounded(gt.exceedance(gt.matched_control(counts, _cohort(spark, sf_dir, bins), _sizes(bins), 5, 19, SEED)))
