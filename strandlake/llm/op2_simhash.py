"""SimHash near-duplicates through an inverted index of fingerprint bytes.

Two fingerprints that differ in at most 4 bits agree in at least 4 of their 8
bytes.  The index lists fingerprints by the bytes at three positions: twenty
triples are chosen so that any four positions hold one of them (a covering
design), so every such pair meets in a list, and lists stay short.  In a list,
each pair's shared positional bytes are tallied, pairs with fewer than 4 are
dropped, and the rest are verified bit by bit.

Equal fingerprints are one entry.  A list of n entries is dealt into
ceil(n / ``BLOCK``) blocks by a hash, and each pair of blocks is a cell of its
own, so no task holds a long list; a cell returns a spanning forest of its
links, never all pairs.  Components come from alternating stars.

Defined cases: null and empty texts have fingerprint zero and link as any other;
a null doc_id takes part, but names no component unless all of it are null;
rows are nodes, so repeated doc_ids are judged row by row; very long texts are
fingerprinted whole, in parts; an empty table gives no rows; ``deduplicate``
keeps all columns, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, all_of, free_name, read, words_of
from .components import UnionFind, connected_components
from .fingerprints import fingerprint

MAX_BITS = 4
#: Bytes that a linked pair must share: 8 less one for each differing bit.
LEAST_BYTES = 8 - MAX_BITS
BLOCK = 512


def covering_triples() -> list[tuple[int, ...]]:
    """Twenty triples of 8 positions such that any 4 positions hold one.

    Positions 0..7 fall into three groups around a ring.  Taken are the triples
    within a group and those with two positions in a group and one in the next;
    four positions over three groups always hold such a triple.
    """
    group = {p: p % 3 for p in range(8)}
    chosen = []
    for t in combinations(range(8), 3):
        g = [group[p] for p in t]
        if len(set(g)) == 1:
            chosen.append(t)
        elif len(set(g)) == 2:
            double = max(set(g), key=g.count)
            single = min(set(g), key=g.count)
            if (double + 1) % 3 == single:
                chosen.append(t)
    return chosen


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, fp (long: the 64 bits) and the ``carried`` long columns for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(words_of(t)) for t in batch.column("text").to_pylist()]
            signed = [x - (1 << 64) if x >> 63 else x for x in fps]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.int64()), *map(batch.column, carried)], names=["doc_id", "fp", *carried])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return kept.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in carried)]))


def _byte(fp, position: int):
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _index(entries: DataFrame) -> DataFrame:
    """key, fp: each fingerprint in the list of each triple."""
    fp = F.col("fp")
    keys = []
    for number, (p, q, r) in enumerate(covering_triples()):
        keys.append(F.lit(number << 24).cast("long").bitwiseOR(F.shiftleft(_byte(fp, p), 16)).bitwiseOR(F.shiftleft(_byte(fp, q), 8)).bitwiseOR(_byte(fp, r)))
    return entries.select(F.explode(F.array(*keys)).alias("key"), "fp")


def cells(listed: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, lo, hi, fp: entries of lists with two or more, dealt into cells of at most two blocks."""
    n = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = listed.join(counts, "key").select("key", "fp", own.alias("own"), n.alias("blocks"))
    spread = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")


def _linked(group: list[int]) -> list[tuple[int, int]]:
    """Links among the fingerprints of a cell, as a spanning forest."""
    forest = UnionFind()
    if len(group) <= 12:
        for i, x in enumerate(group):
            for y in group[i + 1 :]:
                differ = (x ^ y) & 0xFFFFFFFFFFFFFFFF
                if sum(not differ >> s & 255 for s in range(0, 64, 8)) >= LEAST_BYTES and differ.bit_count() <= MAX_BITS:
                    forest.link(x, y)
        return forest.stars()
    import numpy as np

    values = np.array(group, dtype=np.int64)
    for i in range(0, len(values), 256):
        differ = values[i : i + 256, None] ^ values[None, :]
        tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
        x, y = np.nonzero(tally >= LEAST_BYTES)
        near = np.bitwise_count(differ[x, y].view(np.uint64)) <= MAX_BITS
        for a, b in zip(x[near].tolist(), y[near].tolist()):
            if a + i < b:
                forest.link(group[a + i], group[b])
    return forest.stars()


def _verify(batches):
    """Runs over sorted cells; a run may pass from one batch to the next."""
    import pyarrow as pa

    key, group = None, []

    def table(links):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        links = []
        for k, lo, hi, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "fp"))):
            if (k, lo, hi) != key:
                links += _linked(group) if len(group) > 1 else []
                key, group = (k, lo, hi), []
            group.append(fp)
        yield table(links)
    yield table(_linked(group) if len(group) > 1 else [])


def _groups(entries: DataFrame, shared: Shared) -> DataFrame:
    """node, component (the smallest fingerprint reachable by links) of the distinct fingerprints ``entries`` (fp) that have links."""
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = _index(entries)
    counts = shared.write(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    dealt = cells(listed, counts).repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return connected_components(shared, dealt.mapInArrow(_verify, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the rows reachable by links) for every row."""
    shared = Shared(docs.sparkSession, "simhash")
    rows = shared.write(fingerprints(docs), "rows")
    entries = shared.write(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "entries")
    stars = _groups(entries, shared)
    stars = shared.write(stars.join(entries, stars["node"] == entries["fp"]).select("node", "component", "rep"), "stars")
    named = stars.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = shared.write(stars.join(named, "component").select(F.col("node").alias("fp"), "component_id"), "named")
    final = shared.write(entries.join(linked, "fp", "left").select(F.col("fp").alias("entry"), F.coalesce("component_id", "rep").alias("component_id")), "final")
    return rows.join(final, F.col("fp") == F.col("entry")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: of its rows the one with the smallest doc_id (a null id comes
    last), among rows that share it the first by a hash of the text, of equal rows the first by a hash of all columns."""
    h1, h2, order = (free_name(docs, c) for c in ("kept_h1", "kept_h2", "kept_order"))
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # 128 bits of hash stand for an id and a text
    keyed = docs.withColumns({h1: F.xxhash64(ident, text), h2: F.xxhash64(F.lit(1), text, ident)})
    shared = Shared(docs.sparkSession, "kept")
    rows = fingerprints(keyed.select("doc_id", "text", F.col(h1).alias("h1"), F.col(h2).alias("h2")), "h1", "h2")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h1", "h2")
    entries = shared.write(rows.groupBy("fp").agg(F.min(place).alias("first")), "entries")
    linked = entries.join(_groups(entries, shared), F.col("fp") == F.col("node"), "left")
    chosen = linked.groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    chosen = shared.write(chosen.select(F.col("first.h1").alias(f"{h1}_"), F.col("first.h2").alias(f"{h2}_")), "chosen")
    found = keyed.join(chosen, (F.col(h1) == F.col(f"{h1}_")) & (F.col(h2) == F.col(f"{h2}_")), "left_semi")
    # maps have no hash; a row's other columns order rows that are equal in id and text
    columns = [c for c, f in zip(all_of(docs), docs.schema) if "map<" not in f.dataType.simpleString()]
    found = found.withColumn(order, F.row_number().over(Window.partitionBy(h1, h2).orderBy(F.xxhash64(*columns))))
    return found.where(F.col(order) == 1).select(*all_of(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
