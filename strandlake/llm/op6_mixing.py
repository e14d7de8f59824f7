"""Mix sources to target weights, with DataFrame functions alone.

Each document is emitted floor(rate) times plus one Bernoulli copy whose
probability is the rate's fraction; rate = its source's target / its source's
size.  The draw is a hash of the document's id and a seed.  So that a source's
total comes near its target even when it has few or very long documents, the
same aggregation that sums the sources also totals ``SEEDS`` candidate draws,
and each source takes the seed whose total is nearest (ties: the lowest).

Targets fill up as water does: a source's target is weight * level, at most
``cap`` times its size.  Sorted by cap * size / weight, the sources that reach
their cap are a prefix, so the level follows from running sums over the small
table of sources - the same fixed point as resharing the excess by weight until
no target is above its cap.

Defined cases: null text has size 0; null source is a source of its own, last;
a null doc_id hashes as the empty text; repeated rows are emitted alike; a source
whose documents have no words has target 0 and rate 0; an empty table gives no
rows; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Shared, all_of, free_name, read

#: Fixed: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Candidate seeds; eight hexadecimal digits of a digest make one draw.
SEEDS = 32


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _draws(doc_id: Column) -> list[Column]:
    """Uniform 32-bit draws, one for each seed."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    digests = [F.md5(F.concat(F.lit(f"{i}:"), key).cast("binary")) for i in range(SEEDS // 4)]
    return [F.conv(F.substring(digests[k // 4], 1 + 8 * (k % 4), 8), 16, 10).cast("long") for k in range(SEEDS)]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
    weighed = weighed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") + 1).cast("long"))
    order = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("heavy"),
    )
    # a source is capped if, with all before it capped, its share would pass its cap
    capped = F.col("left") * F.col("weight") > F.lit(cap) * F.col("source_size") * F.col("heavy")
    level = F.max_by(F.struct("left", "heavy"), F.when(~F.col("capped"), F.col("heavy"))).over(everything)
    marked = filled.withColumn("capped", capped).withColumn("level", level)
    share = F.col("level.left").cast("double") / F.col("level.heavy").cast("double") * F.col("weight").cast("double")
    return marked.select("source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _draw(doc_id: Column, seed: Column) -> Column:
    """The draw of one seed column; equals ``_draws(doc_id)[seed]``."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.floor(seed / 4).cast("string"), F.lit(":"), key).cast("binary"))
    return F.conv(F.substring(digest, F.lit(1) + F.lit(8) * (seed % 4), F.lit(8)), 16, 10).cast("long")


def mixing_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    return _rates(docs, weights, cap)[0]


def _rates(docs: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """One row per source: source, source_size, target, whole (copies of every document), bar (the
    fraction of 2**32 below which a draw gives one more) and seed; and each document's doc_id, source, size.

    Both are written to the shared folder, so that texts are read once.  The
    rates are a table whose size is known: Spark broadcasts it in joins while it
    is small and otherwise joins by sort-merge, splitting hot sources.
    """
    shared = Shared(docs.sparkSession, "mixing")
    sized = shared.write(docs.select("doc_id", "source", document_size(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.withColumn("rate", rate).select(F.col("source").alias("of"), "source_size", "target", F.floor("rate").alias("whole"), ((F.col("rate") - F.floor("rate")) * F.lit(4294967296.0)).alias("bar"))
    rated = shared.write(rated.coalesce(1), "rates")
    drawn = sized.join(rated.select("of", "bar"), F.col("source").eqNullSafe(F.col("of")))
    extra = drawn.groupBy("of").agg(*[F.sum(F.when(draw < F.col("bar"), F.col("size")).otherwise(0)).alias(f"t{k}") for k, draw in enumerate(_draws(F.col("doc_id")))])
    aim = F.col("target") - F.col("whole") * F.col("source_size")
    errors = F.array(*[F.struct(F.abs(F.col(f"t{k}") - aim).alias("error"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    other = extra.withColumnRenamed("of", "of_extra")
    chosen = rated.join(other, F.col("of").eqNullSafe(F.col("of_extra"))).select(F.col("of").alias("source"), "source_size", "target", "whole", "bar", F.array_min(errors)["seed"].alias("seed"))
    return shared.write(chosen.coalesce(1), "seeds"), sized


def _copies(doc_id: Column, whole: Column, bar: Column, seed: Column) -> Column:
    return (whole + F.when(_draw(doc_id, seed) < bar, 1).otherwise(0)).cast("int")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    rates, sized = _rates(docs, weights, cap)
    joined = sized.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id"), F.col("whole"), F.col("bar"), F.col("seed")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as its source's rate says."""
    names = [free_name(docs, f"mix_{n}") for n in ("source", "whole", "bar", "seed", "copy")]
    of, whole, bar, seed, copy = names
    rates = mixing_rates(docs, weights, cap).select("source", "whole", "bar", "seed").toDF(of, whole, bar, seed)
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col(of)))
    copies = _copies(F.col("doc_id"), F.col(whole), F.col(bar), F.col(seed))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*all_of(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _oracle() -> str:
    chunk = "CAST('0x' || substr(md5('{i}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS BIGINT)"
    draws = [chunk.format(i=k // 4, at=1 + 8 * (k % 4)) for k in range(SEEDS)]
    sums = ", ".join(f"sum(CASE WHEN {d} < bar THEN size ELSE 0 END) AS t{k}" for k, d in enumerate(draws))
    best = "list_aggregate([" + ", ".join(f"{{'e': abs(t{k} - aim), 's': {k}}}" for k in range(SEEDS)) + "], 'min').s"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
filled AS (SELECT *,
  (sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER o, 0) AS unspent,
  (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS heavy
  FROM weighed WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, unspent * weight > 3 * source_size * heavy AS capped FROM filled),
level AS (SELECT CAST(unspent AS DOUBLE) / CAST(heavy AS DOUBLE) AS each FROM marked WHERE NOT capped ORDER BY heavy DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE (SELECT each FROM level) * CAST(weight AS DOUBLE) END AS target FROM marked),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
barred AS (SELECT *, floor(rate) AS whole, (rate - floor(rate)) * 4294967296.0 AS bar FROM rated),
drawn AS (SELECT s.doc_id, s.size, b.* FROM sized s JOIN barred b ON s.source IS NOT DISTINCT FROM b.source),
totals AS (SELECT source, any_value(target - whole * source_size) AS aim, {sums} FROM drawn GROUP BY source),
seeds AS (SELECT source, {best} AS seed FROM totals),
final AS (SELECT d.*, CASE s.seed {' '.join(f'WHEN {k} THEN {d}' for k, d in enumerate(draws))} END AS draw FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN draw < bar THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM final"""


ORACLE = _oracle()
