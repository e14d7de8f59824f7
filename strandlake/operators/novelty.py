"""Clusters without the reference, and what assemblies share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix64, unsigned_key, wrapping
from ..functions.stats import log_no_reference
from ..tables import materialised
from .dealt import occurring, sorted_runs, spread_of_deals
from .ranking import modal, tiled_index


def presence(bins: DataFrame, unit: str = "assembly") -> DataFrame:
    """cluster, unit, n: where a cluster occurs (noise aside)."""
    return bins.where("cluster >= 0").groupBy("cluster", unit).agg(F.count(F.lit(1)).alias("n"))


def expected_absence(bins: DataFrame) -> DataFrame:
    """cluster, size, n_ref, p_no_reference: the chance that a cluster of its size holds no reference bin."""
    real = bins.where("cluster >= 0")
    sizes = real.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("is_ref").cast("long")).alias("n_ref"))
    totals = sizes.agg(F.sum("size").alias("total"), F.sum("n_ref").alias("reference"))
    return sizes.join(F.broadcast(totals)).select("cluster", "size", "n_ref", log_no_reference(F.col("total"), F.col("reference"), F.col("size")).alias("p_no_reference"))


def absence_by_unit(bins: DataFrame, unit: str = "assembly") -> DataFrame:
    """unit, absent (clusters that it lacks), rank (units lacking no more), sole (clusters that only it lacks)."""
    where = presence(bins, unit).select("cluster", unit)
    clusters = where.select(F.countDistinct("cluster").alias("clusters"))
    units = where.select(unit).distinct()
    held = where.groupBy(unit).agg(F.count(F.lit(1)).alias("held"))
    per = where.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    nearly = per.join(F.broadcast(units.agg(F.count(F.lit(1)).alias("units")))).where(F.col("k") == F.col("units") - 1).select("cluster")
    met = where.join(nearly, "cluster", "left_semi").groupBy(unit).agg(F.count(F.lit(1)).alias("met"))
    out = held.join(met, unit, "left").join(F.broadcast(clusters)).join(F.broadcast(nearly.agg(F.count(F.lit(1)).alias("nearly"))))
    counted = out.select(unit, (F.col("clusters") - F.col("held")).alias("absent"), (F.col("nearly") - F.coalesce("met", F.lit(0))).alias("sole"))
    levels = counted.groupBy("absent").agg(F.count(F.lit(1)).alias("n"))
    ranks = levels.select("absent", F.sum("n").over(Window.orderBy("absent")).alias("rank"))
    return counted.join(ranks, "absent").select(unit, "absent", "rank", "sole")


def segments(bins: DataFrame, keys: list[str]) -> DataFrame:
    """cluster, n_bins, n_segments, ratio: bins over runs of bins that touch within ``keys``."""
    order = Window.partitionBy("cluster", *keys).orderBy("start", "end")
    marked = bins.where("cluster >= 0").withColumn("new", F.when(F.col("start") == F.lag("end").over(order), 0).otherwise(1))
    return marked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("new").alias("n_segments")).withColumn("ratio", F.col("n_bins") / F.col("n_segments"))


def effective_number(bins: DataFrame, column: str = "chrom") -> DataFrame:
    """cluster, effective: 1 / sum of squared shares of ``column``."""
    counts = bins.where("cluster >= 0").groupBy("cluster", column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy("cluster").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective"))


def chromosome_sets(bins: DataFrame, places: list[str]) -> DataFrame:
    """cluster, assembly, mask: bit i is set if the assembly's bins of the cluster lie on places[i]."""
    bit = F.lit(0).cast("long")
    for i, place in enumerate(places):
        bit = F.when(F.col("chrom") == place, F.lit(1 << i).cast("long")).otherwise(bit)
    return bins.where("cluster >= 0").groupBy("cluster", "assembly").agg(F.bit_or(bit).alias("mask"))


def set_consistency(sets: DataFrame) -> DataFrame:
    """cluster, modal_mask, modal_share, jaccard: mean Jaccard over pairs of assemblies, from the distinct masks.

    A cluster has few distinct masks (bounded by the places), so pairs are of
    masks, weighted by how many assemblies have them.
    """
    masks = sets.groupBy("cluster", "mask").agg(F.count(F.lit(1)).alias("c"))
    a, b = masks.toDF("cluster", "x", "cx"), masks.toDF("cluster", "y", "cy")
    weight = F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") - 1)).otherwise(F.col("cx") * F.col("cy"))
    both, either = F.bit_count(F.col("x").bitwiseAND(F.col("y"))), F.bit_count(F.col("x").bitwiseOR(F.col("y")))
    pairs = a.join(b, "cluster").groupBy("cluster").agg(F.sum(weight * both / F.greatest(either, F.lit(1))).alias("num"), F.sum(weight).alias("den"))
    top = masks.groupBy("cluster").agg(F.max(F.struct("c", (-F.col("mask")).alias("order"))).alias("best"), F.sum("c").alias("total"))
    return pairs.join(top, "cluster").select("cluster", (-F.col("best.order")).alias("modal_mask"), (F.col("best.c") / F.col("total")).alias("modal_share"), F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("jaccard"))


def place_pairs(bins: DataFrame) -> DataFrame:
    """a, b, n: clusters of an assembly that occur on both places (a < b)."""
    seen = bins.where("cluster >= 0").select("cluster", "assembly", "chrom").distinct()
    left, right = seen.withColumnRenamed("chrom", "a"), seen.withColumnRenamed("chrom", "b")
    return left.join(right, ["cluster", "assembly"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def places_per_unit(bins: DataFrame) -> DataFrame:
    """cluster, chrom_per_asm: the mean number of places in the assemblies that have the cluster."""
    per = bins.where("cluster >= 0").groupBy("cluster", "assembly").agg(F.countDistinct("chrom").alias("k"))
    return per.groupBy("cluster").agg(F.avg("k").alias("chrom_per_asm"))


def draw_order(permutations: int, seed: int, number: str = "start"):
    """perm and the unsigned-ordered key by which a permutation orders rows: a mixed hash of (seed, perm, number)."""
    perm = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(permutations).cast("long")))
    key = unsigned_key(mix64(F.lit(seed).cast("long").bitwiseXOR(F.col("perm") * 1_000_000_007 + F.col(number))))
    return perm, key


def shuffled_within(bins: DataFrame, block: str, value: str, permutations: int, seed: int, number: str = "start") -> DataFrame:
    """perm, the bins' other columns and ``value``: dealt anew among the bins of each block, perm 1 up; bins are ordered by
    (number, bin_uid).

    Keys of equal numbers are equal and of others are not, so the order of the names decides alike in each
    permutation: names are ordered once, and a permutation moves numbers only.
    """
    others = [c for c in bins.columns if c not in (block, value)]
    plain = materialised(tiled_index(bins, [block], number, ["bin_uid"], "i"))
    perm, key = draw_order(permutations, seed, number)
    with wrapping(bins.sparkSession):
        spread = plain.select(block, value, number, "i").withColumn("perm", perm).withColumn("key", key).drop(number)
    mixed = tiled_index(spread, [block, "perm"], "key", ["i"], "to", tile=1 << 57).select(block, "perm", F.col("to").alias("i"), value)
    return mixed.join(plain.select(block, "i", *others), [block, "i"]).select("perm", block, *others, value)


def sharing_null(bins: DataFrame, permutations: int = 100, seed: int = 11, parts: int | None = None) -> DataFrame:
    """cluster, n_pairs, chrom_per_asm, frac_asm_multi, and for the free null (places shuffled within assemblies) its mean,
    z, p and multi share, for the fixed null (within clusters) its mean and z.

    ``parts``: partitions in which bins are sorted; by default they are written and counted first.
    """
    runs = sorted_runs(bins.where("cluster >= 0").select("bin_uid", "cluster", "assembly", "chrom", "start"), ["cluster", "assembly", "chrom"], parts=parts)
    per = occurring(runs, ["cluster", "assembly", "chrom"]).groupBy("cluster", "assembly").agg(F.countDistinct("chrom").alias("k"))
    seen = materialised(per.groupBy("cluster").agg(F.count(F.lit(1)).alias("pairs"), F.sum("k").alias("total"), F.sum((F.col("k") >= 2).cast("long")).alias("multi")))
    out = seen
    for name, block, other, own in (("free", "assembly", "cluster", seed), ("fixed", "cluster", "assembly", seed + 1)):
        null = spread_of_deals(runs, block, other, "chrom", "cluster", permutations, own).join(seen.select("cluster", F.col("total").alias("seen")), "cluster")
        sums = null.groupBy("cluster").agg(F.avg("total").alias(f"{name}_total"), F.stddev_pop("total").alias(f"{name}_sd"), F.sum((F.col("total") >= F.col("seen")).cast("int")).alias(f"{name}_reached"), F.avg("multi").alias(f"{name}_multi"))
        out = out.join(sums, "cluster")
    z = lambda name: F.when(F.col(f"{name}_sd") > 1e-9, (F.col("total") - F.col(f"{name}_total")) / F.col(f"{name}_sd"))
    share = lambda c: F.col(c) / F.col("pairs")
    return out.select("cluster", F.col("pairs").alias("n_pairs"), share("total").alias("chrom_per_asm"), share("multi").alias("frac_asm_multi"), share("free_total").alias("free_mean"), z("free").alias("free_z"), ((1 + F.col("free_reached")) / (1 + permutations)).alias("free_p"), share("free_multi").alias("free_multi"), share("fixed_total").alias("fixed_mean"), z("fixed").alias("fixed_z"))


def sharing_class(per_assembly, z_fixed):
    return F.when(per_assembly < 1.25, "chromosome-specific").when((per_assembly >= 1.5) & (z_fixed < -3), "cohort-shared, haplotype-pure").when(per_assembly >= 1.5, "within-haplotype shared").otherwise("mixed")


def novelty_by_size(expected: DataFrame, edges: tuple[int, ...] = (50, 60, 80, 120, 200, 400, 1000)) -> DataFrame:
    """size_from, clusters, observed, expected, excess: novel clusters (without reference bins) by size, from ``expected_absence``."""
    bound = F.lit(0)
    for e in edges:
        bound = F.when(F.col("size") >= e, e).otherwise(bound)
    out = expected.groupBy(bound.cast("long").alias("size_from")).agg(F.count(F.lit(1)).alias("clusters"), F.sum((F.col("n_ref") == 0).cast("long")).alias("observed"), F.sum("p_no_reference").alias("expected"))
    return out.withColumn("excess", F.col("observed") - F.col("expected"))


#: Ranges of keys among which a permutation finds its smallest ones.
KEY_RANGES_LOG2 = 12


def label_null(bins: DataFrame, permutations: int = 20, seed: int = 7, number: str = "start") -> DataFrame:
    """perm, novel: clusters without a reference bin; perm 0 as seen, else with the reference labels dealt anew to all bins.

    A permutation marks the bins of the smallest keys: whole ranges of keys by their
    counts, and bins one by one in the range in which the last one lies; so no task sorts all bins.
    """
    real = materialised(bins.where("cluster >= 0").select("bin_uid", "cluster", "is_ref", number))
    wanted = real.agg(F.sum(F.col("is_ref").cast("long")).alias("wanted"), F.countDistinct("cluster").alias("clusters"))
    perm, key = draw_order(permutations, seed, number)
    with wrapping(bins.sparkSession):
        spread = real.withColumn("perm", perm).withColumn("key", key)
    spread = spread.withColumn("range", F.shiftright("key", 64 - KEY_RANGES_LOG2))
    counts = spread.groupBy("perm", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("perm").orderBy("range")) - F.col("n")).join(F.broadcast(wanted)).where("before < wanted")
    placed = spread.join(before, ["perm", "range"])
    whole = placed.where("before + n <= wanted").select("perm", "cluster")
    order = Window.partitionBy("perm", "range").orderBy("key", "bin_uid")
    part = placed.where("before + n > wanted").withColumn("r", F.row_number().over(order)).where("before + r <= wanted").select("perm", "cluster")
    marked = whole.unionByName(part).unionByName(real.where("is_ref").select(F.lit(0).cast("long").alias("perm"), "cluster"))
    held = marked.groupBy("perm").agg(F.countDistinct("cluster").alias("held"))
    return held.join(F.broadcast(wanted)).select("perm", (F.col("clusters") - F.col("held")).alias("novel"))


def recurrence_floors(bins: DataFrame, reference, unit: str = "assembly", shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """floor, reference, others_median, others_max, rank: clusters that a unit lacks although ``floor`` others or more hold them."""
    held = materialised(presence(bins, unit).select("cluster", unit))
    units = held.select(unit).distinct()
    total = units.agg(F.count(F.lit(1)).alias("units"))
    floors = total.select(F.explode(F.array(*[F.ceil(F.lit(s) * (F.col("units") - 1)) for s in shares])).alias("floor")).distinct()
    per = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    wide = per.join(F.broadcast(floors), F.col("k") >= F.col("floor"))
    all_ = floors.join(wide.groupBy("floor").agg(F.count(F.lit(1)).alias("clusters")), "floor", "left")
    own = held.join(wide, "cluster").groupBy("floor", unit).agg(F.count(F.lit(1)).alias("own"))
    grid = units.join(F.broadcast(all_)).join(own, ["floor", unit], "left")
    lacking = grid.select("floor", unit, (F.coalesce("clusters", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("lacks"))
    named = lacking.where(F.col(unit) == F.lit(reference)).select("floor", F.col("lacks").alias("reference"))
    others = lacking.join(F.broadcast(named), "floor")
    rest = F.when(F.col(unit) != F.lit(reference), F.col("lacks"))
    return others.groupBy("floor", "reference").agg(F.median(rest).alias("others_median"), F.max(rest).alias("others_max"), F.sum((F.col("lacks") <= F.col("reference")).cast("long")).alias("rank"))


def novel_flags(bins: DataFrame) -> DataFrame:
    """cluster, novel: no reference bin."""
    return bins.where("cluster >= 0").groupBy("cluster").agg((~F.max("is_ref")).alias("novel"))


def describe_novel(bins: DataFrame, flags: DataFrame, medians: list[str], shares: list[str]) -> DataFrame:
    """novel, n_bins, the medians and the mean shares of the assemblies' bins in novel and in supported clusters."""
    own = bins.where("NOT is_ref").join(flags, "cluster")
    return own.groupBy("novel").agg(F.count(F.lit(1)).alias("n_bins"), *[F.median(c).alias(f"median_{c}") for c in medians], *[F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in shares])


def novel_places(bins: DataFrame, flags: DataFrame) -> DataFrame:
    """chrom, novel, supported and their percentages, over the assemblies' bins."""
    own = bins.where("NOT is_ref").join(flags, "cluster").groupBy("chrom").agg(F.sum(F.col("novel").cast("long")).alias("novel"), F.sum((~F.col("novel")).cast("long")).alias("supported"))
    sums = own.agg(F.greatest(F.sum("novel"), F.lit(1)).alias("n"), F.greatest(F.sum("supported"), F.lit(1)).alias("s"))
    return own.join(F.broadcast(sums)).select("chrom", "novel", "supported", (100 * F.col("novel") / F.col("n")).alias("novel_pct"), (100 * F.col("supported") / F.col("s")).alias("supported_pct"))


def feature_dropout(bins: DataFrame, reference, unit: str = "assembly", least: int = 5) -> DataFrame:
    """feature, clusters, reference, others_median, others_max, rank: the share of a feature's clusters that each unit lacks.

    A cluster's feature is the modal one of its bins; features of fewer than ``least`` clusters are left out.
    """
    real = bins.where("cluster >= 0")
    top = modal(real, ["cluster"], "feature").select("cluster", "feature")
    sizes = top.groupBy("feature").agg(F.count(F.lit(1)).alias("clusters")).where(F.col("clusters") >= least)
    held = presence(bins, unit).join(top, "cluster").groupBy("feature", unit).agg(F.count(F.lit(1)).alias("own"))
    grid = real.select(unit).distinct().join(F.broadcast(sizes)).join(held, ["feature", unit], "left").withColumn("rate", 1 - F.coalesce("own", F.lit(0)) / F.col("clusters"))
    named = grid.where(F.col(unit) == F.lit(reference)).select("feature", F.col("rate").alias("reference"))
    rest = F.when(F.col(unit) != F.lit(reference), F.col("rate"))
    joined = grid.join(F.broadcast(named), "feature")
    return joined.groupBy("feature", "clusters", "reference").agg(F.median(rest).alias("others_median"), F.max(rest).alias("others_max"), F.sum((F.col("rate") <= F.col("reference")).cast("long")).alias("rank"))


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, median: exact."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))


def proximal_fraction(bins: DataFrame, prefix: str = "asat_hor") -> DataFrame:
    """cluster, n_ref, proximal: the share of a cluster's reference bins before the last reference bin of ``prefix``
    features on their chromosome (0 where there is none)."""
    reference = bins.where("is_ref")
    edges = reference.where(F.col("feature").startswith(prefix)).groupBy("chrom").agg(F.max("end").alias("edge"))
    placed = reference.where("cluster >= 0").join(edges, "chrom", "left")
    return placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_ref"), F.avg((F.col("start") < F.coalesce("edge", F.lit(0))).cast("int")).alias("proximal"))


def _pairs_of(seen: DataFrame, keys: list[str]) -> DataFrame:
    left, right = seen.withColumnRenamed("chrom", "a"), seen.withColumnRenamed("chrom", "b")
    return left.join(right, [*keys, "cluster", "assembly"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def place_pair_table(bins: DataFrame, permutations: int = 20, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """For the clusters of ``bins``: a, b, observed, expected, ratio, p_enriched, pair_only, share of pairs of places that
    one assembly's bins of a cluster lie on; and of single places chrom, observed, expected, ratio.

    Places are shuffled within assemblies, among these clusters alone.  ``pair_only`` is the
    ratio without what the two places have by themselves.
    """
    real = materialised(bins.where("cluster >= 0").select("bin_uid", "cluster", "assembly", "chrom", "start"))
    moved = shuffled_within(real, "assembly", "chrom", permutations, seed)
    seen, drawn = real.select("cluster", "assembly", "chrom").distinct(), materialised(moved.select("perm", "cluster", "assembly", "chrom").distinct())
    singles = seen.groupBy("chrom").agg(F.count(F.lit(1)).alias("observed")).join(drawn.groupBy("chrom").agg((F.count(F.lit(1)) / permutations).alias("expected")), "chrom", "left")
    singles = materialised(singles.withColumn("ratio", F.col("observed") / F.col("expected")))
    names = singles.select("chrom")
    grid = names.toDF("a").join(names.toDF("b"), F.col("a") < F.col("b"))
    observed = grid.join(_pairs_of(seen, []), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("observed"))
    null = _pairs_of(drawn, ["perm"]).join(observed, ["a", "b"]).groupBy("a", "b").agg((F.sum("n") / permutations).alias("expected"), F.sum((F.col("n") >= F.col("observed")).cast("int")).alias("reached"))
    joined = observed.join(null, ["a", "b"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    # a permutation without the pair reaches an observation of none
    reached = F.when(F.col("observed") == 0, F.lit(permutations)).otherwise(F.coalesce("reached", F.lit(0)))
    ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected"))
    total = observed.agg(F.greatest(F.sum("observed"), F.lit(1)).alias("all"))
    alone = lambda c: singles.select(F.col("chrom").alias(c), F.col("ratio").alias(f"r{c}"))
    full = joined.join(alone("a"), "a").join(alone("b"), "b").join(F.broadcast(total))
    return full.select("a", "b", "observed", "expected", ratio.alias("ratio"), ((1 + reached) / (1 + permutations)).alias("p_enriched"), (ratio / (F.col("ra") * F.col("rb"))).alias("pair_only"), (F.col("observed") / F.col("all")).alias("share")), singles


def donor_agreement(sets: DataFrame, donors: DataFrame) -> DataFrame:
    """same_n, same_mean, other_n, other_mean: the Jaccard index of places of two assemblies of one donor, and of the rest.

    ``sets``: cluster, assembly, mask; ``donors``: assembly, block.  Pairs of a donor are few; those of
    all assemblies come from the distinct masks and their counts.
    """
    owned = sets.join(donors, "assembly")
    x, y = owned.toDF("a", "cluster", "x", "block"), owned.toDF("b", "cluster", "y", "block")
    jaccard = F.bit_count(F.col("x").bitwiseAND(F.col("y"))) / F.greatest(F.bit_count(F.col("x").bitwiseOR(F.col("y"))), F.lit(1))
    same = x.join(y, ["cluster", "block"]).where("a < b").agg(F.count(F.lit(1)).alias("same_n"), F.coalesce(F.sum(jaccard), F.lit(0.0)).alias("same_sum"))
    masks = owned.groupBy("cluster", "mask").agg(F.count(F.lit(1)).alias("c"))
    weight = F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") - 1) / 2).otherwise(F.col("cx") * F.col("cy") / 2)
    all_ = masks.toDF("cluster", "x", "cx").join(masks.toDF("cluster", "y", "cy"), "cluster").agg(F.sum(weight).alias("n"), F.sum(weight * jaccard).alias("s"))
    rest = F.col("n") - F.col("same_n")
    return same.join(F.broadcast(all_)).select("same_n", F.when(F.col("same_n") > 0, F.col("same_sum") / F.col("same_n")).alias("same_mean"), rest.cast("long").alias("other_n"), F.when(rest > 0, (F.col("s") - F.col("same_sum")) / rest).alias("other_mean"))


def recurrence(bins: DataFrame, flags: DataFrame) -> DataFrame:
    """floor, clusters, bins, bp: novel clusters that so many assemblies or more carry."""
    total = bins.where("cluster >= 0").agg(F.countDistinct("assembly").alias("units"))
    per = novel_table(bins, flags)
    part = lambda q: F.greatest(F.lit(1), F.floor(F.lit(q) * F.col("units") / 4).cast("long"))
    floors = total.select(F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), part(1), part(2), part(3), F.col("units") - 1))).alias("floor"))
    met = floors.join(per, F.col("n_assemblies") >= F.col("floor"), "left")
    return met.groupBy("floor").agg(F.count("cluster").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("bins"), F.coalesce(F.sum("bp"), F.lit(0)).alias("bp"))


def novel_table(bins: DataFrame, flags: DataFrame) -> DataFrame:
    """cluster, size, bp, n_assemblies, n_samples of the novel clusters."""
    real = bins.join(flags.where("novel").select("cluster"), "cluster", "left_semi")
    return real.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("end") - F.col("start")).alias("bp"), F.countDistinct("assembly").alias("n_assemblies"), F.countDistinct("sample").alias("n_samples"))


def novel_rankings(bins: DataFrame, flags: DataFrame, most: int = 15) -> DataFrame:
    """ranking ('sequence' or 'recurrence'), place, cluster, size, bp, n_assemblies, n_samples: the first of the novel clusters (a top-k report)."""
    per = materialised(novel_table(bins, flags))
    out = None
    for name, order in (("sequence", ["bp"]), ("recurrence", ["n_samples", "n_assemblies", "bp"])):
        first = per.orderBy(*[F.desc(c) for c in order], "cluster").limit(most)
        ranked = first.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order], "cluster"))).select(F.lit(name).alias("ranking"), "place", *per.columns)
        out = ranked if out is None else out.unionByName(ranked)
    return out
