"""Consistent samples of canonical k-mers per fixed bin.

A sequence is cut into blocks that overlap by k - 1 bases; a block owns the
k-mers whose first base lies in it, so blocks are independent rows and the
result does not depend on their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import GAMMA, MIX_1, MIX_2, hash_ceiling
from .ranking import grouped_index


#: First bases of a block, and bins that a task hands on at once.
BLOCK, OUT = 1 << 20, 4096
#: k-mers that a task hands on at once.
HANDED = 1 << 17


def blocks(sequences: DataFrame, k: int, size: int, keys: list[str], *more: str) -> DataFrame:
    """keys, pos0, block (binary), more: pieces of ``size`` first bases each with the k - 1 bases that follow.

    Cut from bytes, whose offsets are known, so a sequence is cut in linear time; a
    character that isn't ASCII counts as one unknown base.
    """
    ascii_ = F.when(F.length("seq") == F.octet_length("seq"), F.col("seq")).otherwise(F.regexp_replace("seq", "[^\\x00-\\x7F]", "N"))
    raw = sequences.select(*keys, *more, ascii_.cast("binary").alias("bytes"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("bytes") - 1, F.lit(0)), F.lit(size))
    cut = raw.select(*keys, *more, "bytes", F.explode(starts).alias("pos0"))
    return cut.select(*keys, *more, F.col("pos0").cast("long").alias("pos0"), F.substring("bytes", F.col("pos0") + 1, F.lit(size + k - 1)).alias("block"))


def canonical_hashes(block: bytes, k: int):
    """Positions of valid k-mers and the mixed hash of each one's canonical code (uint64)."""
    import numpy as np

    codes = np.full(256, 255, dtype=np.uint8)
    for letters, code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
        codes[[ord(x) for x in letters]] = code
    base = codes[np.frombuffer(block, dtype=np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    bad = np.concatenate([[0], np.cumsum(base == 255)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    wide = np.minimum(base, 3).astype(np.uint64)
    forward, backward = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(k):
        forward = forward << np.uint64(2) | wide[i : i + n]
        backward |= (np.uint64(3) - wide[i : i + n]) << np.uint64(2 * i)
    z = np.minimum(forward, backward)[at] + np.uint64(GAMMA)
    z = (z ^ z >> np.uint64(30)) * np.uint64(MIX_1)
    z = (z ^ z >> np.uint64(27)) * np.uint64(MIX_2)
    return at, z ^ z >> np.uint64(31)


def positioned_sketch(cut: DataFrame, k: int, scaled: int, keys: list[str]) -> DataFrame:
    """keys, pos, hash for every kept k-mer of the blocks (a bin size of one base)."""
    ceiling = hash_ceiling(scaled)
    kinds = [cut.schema[c] for c in keys]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def made(batch, row, position, value):
            which = pa.array(np.concatenate(row).astype(np.int64))
            columns = [batch.column(c).take(which) for c in keys]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(position).astype(np.int64)), pa.array(np.concatenate(value).view(np.int64))], names=[*keys, "pos", "hash"])

        for batch in batches:
            row, position, value, held = [], [], [], 0
            for i in range(batch.num_rows):
                at, hashes = canonical_hashes(batch.column("block")[i].as_py() or b"", k)
                kept = hashes <= np.uint64(ceiling)
                n = int(kept.sum())
                if row and held + n > HANDED:
                    yield made(batch, row, position, value)
                    row, position, value, held = [], [], [], 0
                row.append(np.full(n, i))
                position.append(at[kept] + batch.column("pos0")[i].as_py())
                value.append(hashes[kept])
                held += n
            if row:
                yield made(batch, row, position, value)

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*kinds, StructField("pos", LongType()), StructField("hash", LongType())])
    return cut.select(*keys, "pos0", "block").mapInArrow(run, schema)


def sketch(sequences: DataFrame, k: int, bin_size: int, scaled: int, keys: list[str], block_size: int = BLOCK) -> DataFrame:
    """keys, start, hash: the set of kept hashes of each bin (a bin holds a hash once)."""
    placed = positioned_sketch(blocks(sequences, k, block_size, keys), k, scaled, keys)
    return placed.select(*keys, (F.floor(F.col("pos") / bin_size) * bin_size).alias("start"), "hash").distinct()


def _profile(k: int, bin_size: int, size: int, keys: list[str]):
    """Per bin of a block of whole bins: bases, G and C, and valid k-mers by their first base."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, gc = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        known[list(b"ACGTUacgtu")] = 1
        gc[list(b"GCgc")] = 1
        for batch in batches:
            row, parts = [], []
            for i, (block, total, pos0) in enumerate(zip(batch.column("block").to_pylist(), batch.column("total").to_pylist(), batch.column("pos0").to_pylist())):
                raw = np.frombuffer(block or b"", dtype=np.uint8)
                own = raw[:size]
                if not len(own):
                    continue
                begin = np.arange(0, len(own), bin_size)
                valid = np.concatenate([[0], np.cumsum(known[raw])])
                ends = np.arange(k, len(raw) + 1)
                whole = np.flatnonzero(valid[ends] - valid[ends - k] == k) if len(ends) else np.zeros(0, dtype=np.int64)
                kmers = np.bincount(whole // bin_size, minlength=len(begin))[: len(begin)]
                parts.append(np.stack([np.full(len(begin), total), pos0 + begin, np.minimum(pos0 + begin + bin_size, total), np.add.reduceat(known[own], begin), np.add.reduceat(gc[own], begin), kmers]))
                row.append(np.full(len(begin), i))
            made = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), dtype=np.int64)
            which = pa.array(np.concatenate(row).astype(np.int64) if row else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in keys), *(pa.array(x.astype(np.int64)) for x in made)], names=[*keys, *PROFILE])

    return run


def bin_rows(block: bytes, size: int, k: int, bin_size: int, ceiling: int):
    """start, span, n_acgt, n_gc, n_kmers and sorted distinct hashes of each bin that the first ``size`` bases hold."""
    import numpy as np

    raw = np.frombuffer(block, dtype=np.uint8)
    own = raw[:size]
    if not len(own):
        return []
    known, gc = np.isin(raw, np.frombuffer(b"ACGTUacgtu", np.uint8)), np.isin(own, np.frombuffer(b"GCgc", np.uint8))
    begin = np.arange(0, len(own), bin_size)
    at, hashes = canonical_hashes(block, k)
    at, hashes = at[at < size], hashes[at < size]
    kmers = np.bincount(at // bin_size, minlength=len(begin))
    kept = hashes <= np.uint64(ceiling)
    where, found = at[kept] // bin_size, hashes[kept]
    order = np.lexsort((found, where))
    where, found = where[order], found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (found[1:] != found[:-1])
    where, found = where[new], found[new].view(np.int64)
    cuts = np.searchsorted(where, np.arange(len(begin) + 1))
    acgt, strong = np.add.reduceat(known[: len(own)].astype(np.int64), begin), np.add.reduceat(gc.astype(np.int64), begin)
    spans = np.minimum(begin + bin_size, len(own)) - begin
    return [(int(b), int(s), int(a), int(g), int(n), found[cuts[i] : cuts[i + 1]]) for i, (b, s, a, g, n) in enumerate(zip(begin, spans, acgt, strong, kmers))]


def bin_sketch(bases: DataFrame, k: int, bin_size: int, scaled: int, size: int, keys: list[str]) -> DataFrame:
    """keys, start, span, n_acgt, n_gc, n_kmers, hashes: one row a bin, in one pass and without a shuffle.

    ``bases`` has keys, pos0 and block: ``size`` bases that the row owns, a multiple of
    ``bin_size`` (so no bin lies in two rows), and the k - 1 that follow.  Hashes are a
    bin's set, sorted.  Rows without a block are left out.
    """
    if size % bin_size:
        raise ValueError("the bases of a row must be whole bins")
    ceiling = hash_ceiling(scaled)
    fields = "start bigint, span bigint, n_acgt bigint, n_gc bigint, n_kmers bigint, hashes array<bigint>"
    kept = bases.where("block IS NOT NULL").select(*keys, "pos0", "block")
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keys), fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(batch, which, starts, made):
            columns = [pa.array([r[j] for r in made], pa.int64()) for j in range(1, 5)]
            flat = np.concatenate([r[5] for r in made]) if made else np.zeros(0, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum([len(r[5]) for r in made])]).astype(np.int32)
            own = [batch.column(c).take(pa.array(which, pa.int64())) for c in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int64()), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*keys, "start", "span", "n_acgt", "n_gc", "n_kmers", "hashes"])

        for batch in batches:
            which, starts, made = [], [], []
            for i, pos0 in enumerate(batch.column("pos0").to_pylist()):
                rows = bin_rows(batch.column("block")[i].as_py(), size, k, bin_size, ceiling)
                which += [i] * len(rows)
                starts += [pos0 + r[0] for r in rows]
                made += rows
                if len(made) >= OUT:
                    yield table(batch, which, starts, made)
                    which, starts, made = [], [], []
            yield table(batch, which, starts, made)

    return kept.mapInArrow(run, schema)


def kept_bins(binned: DataFrame, bin_size: int, min_acgt: float = 0.5, min_sketch: int = 5, drop_partial: bool = True) -> DataFrame:
    """The rows of ``bin_sketch`` that hold enough bases and hashes, and (if so asked) are whole."""
    full = F.col("span") == bin_size if drop_partial else F.lit(True)
    return binned.where(full & (F.col("n_acgt") >= min_acgt * F.col("span")) & (F.size("hashes") >= min_sketch))


PROFILE = ("total", "start", "end", "n_acgt", "n_gc", "n_kmers")


def bin_profile(sequences: DataFrame, k: int, bin_size: int, keys: list[str], block_size: int = BLOCK) -> DataFrame:
    """keys, total, start, end, n_acgt, n_gc, n_kmers for every bin, in one pass over the bases."""
    from pyspark.sql.types import LongType, StructField, StructType

    size = bin_size * max(1, block_size // bin_size)
    cut = blocks(sequences.where(F.length("seq") > 0).withColumn("total", F.length("seq").cast("long")), k, size, keys, "total")
    schema = StructType([*(cut.schema[c] for c in keys), *(StructField(c, LongType()) for c in PROFILE)])
    return cut.mapInArrow(_profile(k, bin_size, size, keys), schema)


def bin_stats(sequences: DataFrame, bin_size: int, keys: list[str], k: int = 1, block_size: int = BLOCK) -> DataFrame:
    """keys, total, start, end, n_acgt, gc, nfrac, n_kmers for every bin; gc is null in a bin without bases."""
    made = bin_profile(sequences, k, bin_size, keys, block_size)
    return made.select(*keys, "total", "start", "end", "n_acgt", F.when(F.col("n_acgt") > 0, F.col("n_gc") / F.col("n_acgt")).alias("gc"), (1 - F.col("n_acgt") / (F.col("end") - F.col("start"))).alias("nfrac"), "n_kmers")


def kmer_counts(sequences: DataFrame, k: int, bin_size: int, keys: list[str], block_size: int = BLOCK) -> DataFrame:
    """keys, start, n_kmers: valid k-mers by the bin of their first base, for bins that have any."""
    return bin_profile(sequences, k, bin_size, keys, block_size).where("n_kmers > 0").select(*keys, "start", "n_kmers")


def keep_bins(stats: DataFrame, sketched: DataFrame, bin_size: int, keys: list[str], min_acgt: float = 0.5, min_sketch: int = 5, drop_partial: bool = True, k: int | None = None) -> DataFrame:
    """The bins that hold enough bases and hashes, with n_sketch and row_idx: their rank over all groups (``assemblies.bin_columns`` has a
    bin_idx within each assembly)."""
    sizes = sketched.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("n_sketch"))
    joined = stats.join(sizes, [*keys, "start"], "left").withColumn("n_sketch", F.coalesce("n_sketch", F.lit(0)))
    whole = (F.col("start") + bin_size <= F.col("total")) if drop_partial else F.lit(True)
    kept = joined.where(whole & (F.col("n_acgt") / (F.col("end") - F.col("start")) >= min_acgt) & (F.col("n_sketch") >= min_sketch))
    return grouped_index(kept, keys[0], [*[F.col(c) for c in keys[1:]], F.col("start")], "row_idx")


def contig_filter(chrom: Column, contig: Column, wanted: list[str], include_unplaced: bool = False) -> Column:
    """Contigs of wanted chromosomes, wanted by name, or unplaced; no wish means all."""
    if not wanted:
        return F.lit(True)
    keep = chrom.isin(*wanted) | contig.isin(*wanted)
    return keep | (chrom == "") if include_unplaced else keep
