"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

Several rotations are learned by iterative quantisation (alternating sign codes
and an orthogonal Procrustes step) on at most ``SAMPLE`` vectors, the smallest
by a hash of their id; each gives a balanced binary code of up to 64 bits.  A
code's 16-bit substrings are keys of hash tables, 24 in all; vectors of one
label and one length that share a key are compared by cosine in double
precision.  A pair is judged only in the first table where it meets, so links
are counted once.  At an angle of cosine 0.93 a bit differs with probability
0.12, so 24 tables miss 4 % of such pairs, and fewer above it.

Equal vectors of a label are one entry with a multiplicity.  A bucket of n
entries is dealt into ceil(n / ``BLOCK``) blocks, each pair of blocks a cell of
its own; a cell returns link counts and a spanning forest, never pairs.  Only
entries of buckets with two or more carry their vectors through the shuffle.

Defined cases: null labels, null, empty or zero vectors and vectors with null or
non-finite components link with nothing and keep their own component; a null
vec_id takes part but names no component unless all of it are null; repeated
rows are vectors of their own; vectors of different lengths never link; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, read
from .components import UnionFind, connected_components

LEAST_COSINE = 0.93
SAMPLE = 10_000
ROTATIONS, SUBSTRING = 6, 16
BLOCK = 512
ENTRY = "entry long, label long, weight long, vector array<double>, codes array<long>"


def learn_rotations(sample, rotations: int = ROTATIONS, bits: int = 64, rounds: int = 20, seed: int = 11) -> list:
    """Matrices (dimension x bits) whose signs are codes; each starts at another random rotation."""
    import numpy as np

    dimension = sample.shape[1]
    bits = min(bits, dimension)
    _, _, principal = np.linalg.svd(sample, full_matrices=False) if len(sample) >= bits else (0, 0, np.eye(dimension))
    principal = principal[:bits].T
    projected, learned = sample @ principal, []
    for r in range(rotations):
        rotation = np.linalg.qr(np.random.default_rng(seed + r).normal(size=(bits, bits)))[0]
        for _ in range(rounds if len(sample) >= bits else 0):
            u, _, vt = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = (u @ vt).T
        learned.append(principal @ rotation)
    return learned


def substrings(unit, learned: list, width: int = SUBSTRING):
    """Keys (vectors x tables): the codes' substrings of ``width`` bits."""
    import numpy as np

    keys = []
    for matrix in learned:
        signs = unit @ matrix >= 0
        for at in range(0, signs.shape[1], width):
            part = signs[:, at : at + width]
            keys.append(part @ (1 << np.arange(part.shape[1], dtype=np.int64)))
    return np.stack(keys, axis=1) if keys else np.zeros((len(unit), 0), dtype=np.int64)


def _coder(learned: list, width: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        extra: dict = {}
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            codes: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                unit = np.array([vectors[i] for i in at])
                scale = np.abs(unit).max(axis=1, keepdims=True)
                unit = unit / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                if not learned or learned[0].shape[0] != size:  # a length that the sample doesn't have: random rotations
                    extra.setdefault(size, learn_rotations(np.zeros((0, size))))
                keys = substrings(unit, extra.get(size, learned), width)
                for i, k, u in zip(at, keys.tolist(), unit.tolist()):
                    codes[i] = k
                    vectors[i] = u
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("entry", "label", "weight")] + [pa.array(vectors, pa.list_(pa.float64())), pa.array(codes, pa.list_(pa.int64()))], names=["entry", "label", "weight", "vector", "codes"])

    return run


def _judge(least: float):
    """Cells to (a, b, links): link counts of entry a (b null), or an edge of the forest (links null)."""

    def links_of(table: int, across: bool, group: list, counts: dict, edges: list) -> None:
        import numpy as np

        ids = [g[0] for g in group]
        block, label, weights, vectors, codes = (np.array([g[i] for g in group]) for i in range(1, 6))
        cosine = vectors @ vectors.T
        near = np.triu(cosine >= least, 1)
        near &= label[:, None] == label[None, :]
        if across:  # a cell of two blocks judges the pairs across them
            near &= block[:, None] != block[None, :]
        x, y = np.nonzero(near)
        first = (codes[x, :table] != codes[y, :table]).all(axis=1)
        x, y = x[first], y[first]
        got = np.bincount(x, weights[y], len(ids)) + np.bincount(y, weights[x], len(ids))
        for i in np.flatnonzero(got).tolist():
            counts[ids[i]] = counts.get(ids[i], 0) + int(got[i])
        forest = UnionFind()
        for a, b in zip(x.tolist(), y.tolist()):
            forest.link(ids[a], ids[b])
        edges += forest.stars()

    def run(batches):
        import pyarrow as pa

        key, group = None, []

        def table(counts, edges):
            rows = [(a, None, n) for a, n in counts.items()] + [(a, b, None) for a, b in edges]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        for batch in batches:
            counts, edges = {}, []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "table", "lo", "hi", "own", "entry", "label", "weight", "vector", "codes"))):
                if row[:4] != key:
                    if len(group) > 1:
                        links_of(key[1], key[2] != key[3], group, counts, edges)
                    key, group = row[:4], []
                group.append((row[5], row[4], *row[6:]))
            yield table(counts, edges)
        counts, edges = {}, []
        if len(group) > 1:
            links_of(key[1], key[2] != key[3], group, counts, edges)
        yield table(counts, edges)

    return run


def link_embeddings(vectors: DataFrame, least: float = LEAST_COSINE, sample: int = SAMPLE, rotations: int = ROTATIONS, width: int = SUBSTRING, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    import numpy as np

    spark = vectors.sparkSession
    shared = Shared(spark, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fit) & F.exists("embedding", lambda x: x != 0)
    fraction = vectors.schema["label"].dataType.typeName() in ("float", "double")
    label = F.col("label") + F.lit(0.0).cast(vectors.schema["label"].dataType) if fraction else F.col("label")
    rows = vectors.select("vec_id", F.xxhash64(label).alias("label"), vector.alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # labels are compared in their own type, a negative zero as zero; 128 bits of hash stand for a label and vector
    rows = rows.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label"))
    grouped = rows.where("usable").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep"))
    grouped = shared.write(grouped.withColumn("entry", F.xxhash64("h1", "h2")), "entries")
    chosen = [r[0] for r in grouped.orderBy(F.xxhash64("rep"), "entry").select("vector").limit(sample).collect()]
    sizes = [len(v) for v in chosen]
    common = max(set(sizes), key=lambda n: (sizes.count(n), -n)) if sizes else 0
    learned = []
    if common:
        fitted = np.array([v for v in chosen if len(v) == common])
        fitted /= np.abs(fitted).max(axis=1, keepdims=True)
        learned = learn_rotations(fitted / np.linalg.norm(fitted, axis=1, keepdims=True), rotations)
    coded = shared.write(grouped.select("entry", "label", "weight", "vector").mapInArrow(_coder(learned, width), ENTRY), "coded")
    listed = coded.select("entry", F.posexplode("codes").alias("table", "code"), "label", F.size("vector").alias("length"))
    listed = listed.select("entry", "table", F.xxhash64("table", "code", "label", "length").alias("key"))
    counts = listed.groupBy("key", "table").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = listed.join(counts, ["key", "table"]).select("entry", "key", "table", blocks.alias("blocks"), F.pmod(F.xxhash64("entry"), blocks).cast("int").alias("own"))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("entry", "key", "table", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = spread.join(coded.select("entry", "label", "weight", "vector", "codes"), "entry")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = full.select("key", "table", "lo", "hi", "own", "entry", "label", "weight", "vector", "codes").repartition(partitions, "key", "table", "lo", "hi").sortWithinPartitions("key", "table", "lo", "hi")
    judged = shared.write(judged.mapInArrow(_judge(least), "a long, b long, links long"), "judged")
    links = judged.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    stars = connected_components(shared, judged.where("b is not null").select("a", "b"), "links")
    stars = shared.write(stars.join(grouped.select("entry", "rep"), F.col("node") == F.col("entry")).select("node", "component", "rep"), "stars")
    named = stars.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = stars.join(named, "component").select("node", "smallest")
    entries = grouped.select("h1", "h2", "entry", "rep", "weight").join(links, F.col("entry") == F.col("a"), "left").join(named, F.col("entry") == F.col("node"), "left")
    entries = shared.write(entries.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component_id")), "final")
    joined = rows.where("usable").select("vec_id", "h1", "h2").join(entries, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(read(spark, sf_dir, "embeddings"))
