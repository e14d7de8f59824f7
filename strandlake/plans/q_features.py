"""Queries: feature selection and the weighted matrix, on order x part incidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix, select
from .mappings import INCIDENCE_SQL, incidence, incidence_parts
from .registry import query, rounded

LOW, HIGH, SAMPLES, MIN_BINS, WANTED, SEED = 0.12, 0.9, 25, 2, 300, 7
LO, HI = select.prevalence_window(LOW, HIGH, SAMPLES)
COUNTS_SQL = f"{INCIDENCE_SQL}, counts AS (SELECT hash, count(DISTINCT sample) AS n_samples, count(DISTINCT assembly) AS n_assemblies, count(*) AS n_bins FROM incidence GROUP BY hash)"
KEPT_SQL = f"{COUNTS_SQL}, kept AS (SELECT * FROM counts WHERE n_bins >= {MIN_BINS} AND n_samples BETWEEN {LO} AND {HI})"
FEATURES_SQL = f"{KEPT_SQL}, features AS (SELECT *, row_number() OVER (ORDER BY hash) - 1 AS col_idx FROM kept)"
COO_SQL = f"{FEATURES_SQL}, coo AS (SELECT DISTINCT bin, col_idx FROM incidence JOIN features USING (hash))"
IDF_SQL = f"{COO_SQL}, dfs AS (SELECT col_idx, count(*) AS df FROM coo GROUP BY col_idx), idf AS (SELECT bin, col_idx, ln((SELECT count(DISTINCT bin) FROM coo)::DOUBLE / df) AS value FROM coo JOIN dfs USING (col_idx))"


def mix_sql(x: str) -> str:
    """SplitMix64 of a UHUGEINT expression, modulo 2**64."""
    m = "18446744073709551616::UHUGEINT"
    z = f"(({x}) + 11400714819323198485::UHUGEINT) % {m}"
    step = lambda z, s, c: f"(SELECT (xor(z, z >> {s}) * {c}::UHUGEINT) % {m} FROM (SELECT {z} AS z))"
    z = step(z, 30, 13787848793156543929)
    z = step(z, 27, 10723151780598845931)
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {z} AS z))"


def _counts(spark, sf_dir):
    return select.prevalence_counts(incidence(spark, sf_dir), partitions=incidence_parts(spark, sf_dir))


def _features(spark, sf_dir):
    return select.feature_index(select.within_window(_counts(spark, sf_dir), LOW, HIGH, SAMPLES, MIN_BINS))


def _coo(spark, sf_dir):
    return matrix.entries(incidence(spark, sf_dir), _features(spark, sf_dir), partitions=incidence_parts(spark, sf_dir))


@query(f"WITH {COUNTS_SQL} SELECT * FROM counts")
def prevalence_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {KEPT_SQL} SELECT hash, n_samples, n_bins FROM kept")
def prevalence_window(spark, sf_dir):
    return select.within_window(_counts(spark, sf_dir), LOW, HIGH, SAMPLES, MIN_BINS).select("hash", "n_samples", "n_bins")


@query(f"WITH {COUNTS_SQL} SELECT r.i AS n_samples, count(counts.hash) AS n_kmers, r.i BETWEEN {LO} AND {HI} AS selected FROM range({SAMPLES + 1}) r(i) LEFT JOIN counts ON n_samples = r.i GROUP BY r.i")
def prevalence_histogram(spark, sf_dir):
    return select.prevalence_histogram(_counts(spark, sf_dir), LOW, HIGH, SAMPLES)


@query(f"WITH {FEATURES_SQL} SELECT hash, col_idx, n_samples, n_assemblies, n_bins FROM features")
def feature_index(spark, sf_dir):
    return _features(spark, sf_dir).select("hash", "col_idx", "n_samples", "n_assemblies", "n_bins")


@query(f"WITH {KEPT_SQL} SELECT hash FROM kept WHERE (SELECT count(*) FROM kept) <= {WANTED} OR {mix_sql(f'xor(hash::UHUGEINT, {SEED}::UHUGEINT)')} <= ({WANTED}::UHUGEINT * 18446744073709551616::UHUGEINT) // (SELECT count(*) FROM kept)::UHUGEINT - 1::UHUGEINT")
def feature_subsample(spark, sf_dir):
    return select.subsample(select.within_window(_counts(spark, sf_dir), LOW, HIGH, SAMPLES, MIN_BINS), WANTED, SEED).select("hash")


@query(f"WITH {COO_SQL} SELECT bin, col_idx FROM coo")
def coo_join(spark, sf_dir):
    return _coo(spark, sf_dir)


@query(f"WITH {IDF_SQL} SELECT bin, col_idx, round(value, 6) AS value FROM idf")
def idf_weight(spark, sf_dir):
    return rounded(matrix.weigh(_coo(spark, sf_dir), "idf"))


@query(f"WITH {COO_SQL} SELECT bin, col_idx, round(ln(2.0), 6) AS value FROM coo")
def log_weight(spark, sf_dir):
    return rounded(matrix.weigh(_coo(spark, sf_dir), "log"))


def _norm_sql(norm: str) -> str:
    return f"WITH {IDF_SQL}, norms AS (SELECT bin, {norm} AS norm FROM idf GROUP BY bin) SELECT bin, col_idx, round(value / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS value FROM idf JOIN norms USING (bin)"


@query(_norm_sql("sqrt(sum(value * value))"))
def idf_l2_matrix(spark, sf_dir):
    return rounded(matrix.normalize(matrix.weigh(_coo(spark, sf_dir), "idf"), "l2", partitions=incidence_parts(spark, sf_dir)))


@query(_norm_sql("sum(abs(value))"))
def idf_l1_matrix(spark, sf_dir):
    return rounded(matrix.normalize(matrix.weigh(_coo(spark, sf_dir), "idf"), "l1", partitions=incidence_parts(spark, sf_dir)))


@query(f"WITH {COO_SQL}, pos AS (SELECT DISTINCT bin, assembly FROM incidence) SELECT bin, assembly, row_number() OVER (ORDER BY assembly, bin) - 1 AS row_idx FROM pos WHERE bin IN (SELECT bin FROM coo)")
def row_table(spark, sf_dir):
    bins = incidence(spark, sf_dir).select("bin", "assembly").distinct()
    return matrix.row_table(bins, _coo(spark, sf_dir), "assembly", ["bin"]).select("bin", "assembly", "row_idx")


@query(f"WITH {COO_SQL}, s AS (SELECT count(DISTINCT bin) AS n_rows, count(DISTINCT col_idx) AS n_cols, count(*) AS nnz FROM coo) SELECT *, round(nnz / n_rows, 6) AS per_row, round(nnz / (n_rows * n_cols), 9) AS density FROM s")
def matrix_density(spark, sf_dir):
    return rounded(rounded(matrix.shape_of(_coo(spark, sf_dir)), 6, ["per_row"]), 9, ["density"])


@query(f"WITH {IDF_SQL} SELECT round(sum(value * value), 3) AS energy FROM idf")
def matrix_energy(spark, sf_dir):
    return rounded(matrix.energy(matrix.weigh(_coo(spark, sf_dir), "idf")), 3)


@query("SELECT n_nationkey::BIGINT AS bin, n_nationkey::BIGINT * 1000003 AS hash, (n_nationkey::BIGINT * 1000003 * 274877906944) >> 60 AS bucket FROM nation")
def radix_buckets(spark, sf_dir):
    from .mappings import table

    hashed = F.col("n_nationkey").cast("long") * 1000003
    spread = hashed * F.lit(274877906944)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bin"), hashed.alias("hash"), select.radix_bucket(spread, 16).alias("bucket"))
