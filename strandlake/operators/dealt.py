"""Values dealt anew within blocks, many times over: how each permutation spreads them, without a shuffle of its rows.

Bins are sorted once by (number, name) and cut into runs, whose columns are codes of short lists.  The runs' pieces
of a block are written side by side; a task reads those of one group of blocks, draws the keys of its permutations
again and gives the bin of a place the value whose key has that place.  So disk follows the bins, however many permutations.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import GAMMA, MIX_1, MIX_2
from ..tables import TASK_ROWS, materialised, parts_of

#: Rows of a group of blocks that a task holds; a block of more is cut by ranges of its keys, and one above an eighth is a group.
HELD_ROWS = 1 << 25
#: Rows times permutations of a task, at least (where cores are left) and at most: reading a row takes as long as some permutations of it.
LEAST_ROWS, UNIT_ROWS = 1 << 22, 1 << 26
#: Rows of a file of pieces.
FILE_ROWS = 1 << 22
#: Entries of a table of what occurs; beyond it, the pairs are sorted.
SEEN_ENTRIES = 1 << 26
#: Rows that are paired at once.
STEP = 1 << 18


def _kind(n: int):
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _read(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"u{len(blob) // n}")


def _offsets(numbers: np.ndarray) -> bytes:
    """What lies between the first of ascending numbers and each."""
    far = numbers.astype(np.uint64) - numbers[:1].astype(np.uint64)
    return (far.astype(np.uint32) if far[-1] < 1 << 32 else far).tobytes()


def mixed(first: int, offsets: np.ndarray, seed: int, perm: int) -> np.ndarray:
    """The unsigned keys of ``novelty.draw_order``."""
    with np.errstate(over="ignore"):
        z = offsets.astype(np.uint64)
        z += np.uint64((first + perm * 1_000_000_007) % (1 << 64))
        z ^= np.uint64(seed % (1 << 64))
        z += np.uint64(GAMMA)
        z ^= z >> np.uint64(30)
        z *= np.uint64(MIX_1)
        z ^= z >> np.uint64(27)
        z *= np.uint64(MIX_2)
        z ^= z >> np.uint64(31)
    return z


def sorted_runs(bins: DataFrame, columns: list[str], number: str = "start", name: str = "bin_uid", parts: int | None = None) -> DataFrame:
    """part (ascending by (number, name)), n, first, offsets, and for each column its codes and values: a run a row, written once.

    Bins of one number are in one run; those without a number are left out.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    placed = bins.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("__number"), F.col(name).alias("__name"), *columns)
    if parts is None:
        placed = materialised(placed)
        parts = parts_of(placed.count())
    kinds = {c: bins.schema[c].dataType for c in columns}
    made = T.StructType([T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("offsets", T.BinaryType())])
    for c in columns:
        made = made.add(f"{c}_codes", T.BinaryType()).add(f"{c}_values", T.ArrayType(kinds[c]))

    def packed(table, k):
        numbers = table.column("__number").to_numpy()
        out = {"part": pa.array([(TaskContext.get().partitionId() << 32) + k]), "n": pa.array([len(numbers)]), "first": pa.array([int(numbers[0])]), "offsets": pa.array([_offsets(numbers)], pa.binary())}
        for c in columns:
            found = pc.dictionary_encode(pa.concat_arrays(table.column(c).chunks), null_encoding="encode")
            codes = found.indices.to_numpy(zero_copy_only=False).astype(_kind(len(found.dictionary)))
            out[f"{c}_codes"] = pa.array([codes.tobytes()], pa.binary())
            out[f"{c}_values"] = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def run(batches):
        held, rows, k = [], 0, 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= TASK_ROWS:
                table = pa.Table.from_batches(held)
                numbers = table.column("__number").to_numpy()
                cut = int(np.searchsorted(numbers, numbers[-1]))
                if cut:
                    yield packed(table.slice(0, cut), k)
                    held, rows, k = table.slice(cut).to_batches(), rows - cut, k + 1
        if rows:
            yield packed(pa.Table.from_batches(held), k)

    order = placed.repartitionByRange(parts, "__number").sortWithinPartitions("__number", "__name")
    return materialised(order.select("__number", *columns).mapInArrow(run, made))


def occurring(runs: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n: what occurs together in a run, and how often."""
    import pyarrow as pa

    made = T.StructType([T.StructField(c, runs.schema[f"{c}_values"].dataType.elementType) for c in columns]).add("n", T.LongType())

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                place = np.zeros(row["n"], dtype=np.int64)
                for c in columns:
                    place = place * len(row[f"{c}_values"]) + _read(row[f"{c}_codes"], row["n"])
                met, counts = np.unique(place, return_counts=True)
                out = [pa.array(counts)]
                for c in reversed(columns):
                    met, codes = np.divmod(met, len(row[f"{c}_values"]))
                    out.append(pa.array([row[f"{c}_values"][i] for i in codes], batch.schema.field(f"{c}_values").type.value_type))
                yield pa.RecordBatch.from_arrays(out[::-1], names=[*columns, "n"])

    return runs.mapInArrow(run, made)


def _pieces(runs: DataFrame, block: str, other: str, value: str) -> tuple[DataFrame, dict[int, int]]:
    """group, part, n, first, offsets, and codes and values of the three columns: a run's rows of a group's blocks; and each
    group's rows.  Blocks without a name are left out.  A block above an eighth of ``HELD_ROWS`` is a group by itself."""
    import pyarrow as pa

    columns = [block, other, value]
    sizes = occurring(runs, [block]).where(F.col(block).isNotNull()).groupBy(block).agg(F.sum("n").alias("n"))
    sizes = materialised(sizes)
    large = sizes.where(F.col("n") > HELD_ROWS // 8).collect()
    own, small = {r[0]: i for i, r in enumerate(large)}, sizes.where(F.col("n") <= HELD_ROWS // 8).agg(F.sum("n")).first()[0] or 0
    shared = max(1, -(-4 * small // HELD_ROWS))
    made = T.StructType([T.StructField("group", T.IntegerType()), *[f for f in runs.schema if f.name in ("part", "n", "first", "offsets") or f.name.removesuffix("_codes").removesuffix("_values") in columns]])

    def group_of(v):
        return -1 if v is None else own[v] if v in own else len(own) + zlib.crc32(repr(v).encode()) % shared

    def run(batches):
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            for row in batch.to_pylist():
                n = row["n"]
                codes, far = {c: _read(row[f"{c}_codes"], n) for c in columns}, _read(row["offsets"], n)
                to = np.array([group_of(v) for v in row[f"{block}_values"]])[codes[block]]
                order = np.argsort(to, kind="stable")
                ends = np.flatnonzero(np.diff(to[order], append=len(own) + shared)) + 1
                out = []
                for low, high in zip([0, *ends[:-1]], ends):
                    at = order[low:high]
                    if to[at[0]] < 0:
                        continue
                    numbers = far[at]
                    piece = {"group": int(to[at[0]]), "part": row["part"], "n": len(at), "first": row["first"] + int(numbers[0]), "offsets": _offsets(numbers)}
                    for c in columns:
                        held = np.bincount(codes[c][at], minlength=len(row[f"{c}_values"])) > 0
                        piece[f"{c}_codes"] = (np.cumsum(held) - 1)[codes[c][at]].astype(_kind(int(held.sum()))).tobytes()
                        piece[f"{c}_values"] = [row[f"{c}_values"][i] for i in np.flatnonzero(held)]
                    out.append(piece)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([p[f] for p in out], kinds.get(f, pa.int32())) for f in made.names], names=made.names)

    largest = max((r["n"] for r in large), default=0)
    files = max(1, -(-max(largest, min(small, HELD_ROWS)) // FILE_ROWS))
    tasks = max(1, -(-(sum(r["n"] for r in large) + small) // FILE_ROWS))
    dealt = runs.select(*[f for f in made.names if f != "group"]).mapInArrow(run, made).repartition(tasks, "group", F.pmod(F.xxhash64("part"), F.lit(files)))
    table = materialised(dealt, "group")
    return table, {r["group"]: r["n"] for r in table.groupBy("group").agg(F.sum("n").alias("n")).collect()}


def _coded(values: list, known: dict) -> np.ndarray:
    return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.uint32)


def _ties(far: np.ndarray, blk: np.ndarray | None) -> np.ndarray | None:
    """The place of each bin among those of its number and block before it in a run, where numbers are repeated."""
    same = far[1:] == far[:-1]
    if not same.any():
        return None
    at = np.flatnonzero(np.append(False, same) | np.append(same, False))
    of = np.cumsum(np.append(True, far[at][1:] != far[at][:-1]))
    if blk is not None:
        of = of * (int(blk.max()) + 1) + blk[at]
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    place = np.zeros(len(far), dtype=np.uint32)
    place[at[order]] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return place.astype(_kind(int(place.max()) + 1))


def _by_key(parts, n: int, blocks: int, values: int, deepest: int) -> np.ndarray:
    """The values' codes by (block, key, place), where ``parts()`` gives keys, blocks' codes or None, values' codes, and
    places among equal numbers (up to ``deepest``) or None.

    Keys are sorted with the block's code before, and place and value instead of their last bits.  Equal numbers then
    follow by place; rows that follow otherwise after equal bits may be of two numbers, and all are sorted by whole keys.
    """
    b, v = (blocks - 1).bit_length(), max(1, (values - 1).bit_length())
    low = np.uint64((1 << v + deepest.bit_length()) - 1)
    packed, at = np.empty(n, dtype=np.uint64), 0
    for keys, blk, val, place in parts():
        z = keys >> np.uint64(b) if b else keys
        z = (z & ~low) | val.astype(np.uint64)
        if b:
            z |= blk.astype(np.uint64) << np.uint64(64 - b)
        if place is not None:
            z |= place.astype(np.uint64) << np.uint64(v)
        packed[at : at + len(z)] = z
        at += len(z)
    packed.sort()
    for s in range(0, n - 1, STEP):
        some = packed[s : s + STEP + 1]
        met = np.flatnonzero((some[1:] ^ some[:-1]) <= low)
        if ((some[met + 1] & low) >> np.uint64(v) != ((some[met] & low) >> np.uint64(v)) + np.uint64(1)).any():
            break
    else:
        return (packed & np.uint64((1 << v) - 1)).astype(_kind(values))
    del packed, some
    held = list(parts())
    keys = np.concatenate([h[0] for h in held])
    order = np.argsort(keys, kind="stable")
    del keys
    if b:
        order = order[np.argsort(np.concatenate([h[1] for h in held])[order], kind="stable")]
    return np.concatenate([h[2] for h in held])[order]


def _met(cell: np.ndarray, cells: int, values: np.ndarray, n_values: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values that fall together, each pair once."""
    if cells * n_values <= SEEN_ENTRIES:
        seen = np.zeros(cells * n_values, dtype=bool)
        for s in range(0, len(cell), STEP):
            seen[cell[s : s + STEP].astype(np.int64) * n_values + values[s : s + STEP]] = True
        found = np.flatnonzero(seen)
    else:
        found = np.unique(cell.astype(np.int64) * n_values + values)
    return np.divmod(found, n_values)


def _whole(rows, perms: list[int], seed: int, block: str, other: str, value: str, by: str):
    """perm, by, total, multi of permutations of a group's blocks, all of whose pieces are held."""
    rows = sorted(rows, key=lambda r: r["part"])
    known = {c: {} for c in (block, other, value)}
    tables = [{c: _coded(r[f"{c}_values"], known[c]) for c in known} for r in rows]
    n, n_blocks, n_others, n_values = sum(r["n"] for r in rows), *(len(known[c]) for c in known)

    def column(c):
        kind = _kind(len(known[c]))
        return [t[c].astype(kind)[_read(r[f"{c}_codes"], r["n"])] for r, t in zip(rows, tables)]

    blk, val = column(block) if n_blocks > 1 else [None] * len(rows), column(value)
    far = [(r["first"], _read(r["offsets"], r["n"])) for r in rows]
    places = [_ties(x, b) for (_, x), b in zip(far, blk)]
    deepest = max((int(x.max()) for x in places if x is not None), default=0)
    cell = np.concatenate(column(other))
    if n_blocks > 1:
        whole = np.concatenate(blk)
        cell = whole.astype(np.uint32 if n_blocks * n_others < 1 << 32 else np.uint64) * n_others + cell
        cell = cell[np.argsort(whole, kind="stable")]
    for perm in perms:
        values = _by_key(lambda: ((mixed(first, x, seed, perm), b, v, p) for (first, x), b, v, p in zip(far, blk, val, places)), n, n_blocks, n_values, deepest)  # noqa: B023
        cells, codes = _met(cell, n_blocks * n_others, values, n_values)
        cells, k = np.unique(cells[codes != known[value].get(None, -1)], return_counts=True)
        owner = cells // n_others if by == block else cells % n_others
        total, multi = (np.bincount(owner, w, len(known[by])).astype(np.int64) for w in (k, k >= 2))
        yield from ((perm, v, t, m, None, None) for v, t, m in zip(known[by], total.tolist(), multi.tolist()))


def _range(rows, perm: int, seed: int, block: str, other: str, value: str, by: str, shift: int, nth: int, low: int, n: int, before: dict):
    """perm, by, and the other and the value that fall together in one permutation, among the values whose keys
    have ``nth`` above ``shift`` bits: those of the places ``low`` to ``low + n`` of a block, read a piece at a time."""
    known, name, held = {other: {}, value: {}}, None, []
    cell = np.empty(n, dtype=np.uint32)
    for r in rows:
        name = r[f"{block}_values"][0]
        far = _read(r["offsets"], r["n"])
        keys, place = mixed(r["first"], far, seed, perm), _ties(far, None)
        at = np.flatnonzero(keys >> np.uint64(shift) == nth)
        held.append((keys[at], None, _coded(r[f"{value}_values"], known[value])[_read(r[f"{value}_codes"], r["n"])[at]], None if place is None else place[at]))
        first, last = max(before[r["part"]], low), min(before[r["part"]] + r["n"], low + n)
        if first < last:
            own = _read(r[f"{other}_codes"], r["n"])[first - before[r["part"]] : last - before[r["part"]]]
            cell[first - low : last - low] = _coded(r[f"{other}_values"], known[other])[own]
    deepest = max((int(h[3].max(initial=0)) for h in held if h[3] is not None), default=0)
    values = _by_key(lambda: iter(held), n, 1, len(known[value]), deepest)
    others, names = list(known[other]), list(known[value])
    for c, v in zip(*(x.tolist() for x in _met(cell, len(others), values, len(names)))):
        yield (perm, name, None, None, others[c], names[v]) if by == block else (perm, others[c], None, None, name, names[v])


def _ranked(table: DataFrame, bits: dict[int, int], permutations: int, seed: int) -> tuple[dict, dict]:
    """group -> how many keys each permutation has in each range; group -> part -> the block's rows in the parts before."""

    def run(rows):
        counts, parts = {}, []
        for r in rows:
            g, far = r["group"], _read(r["offsets"], r["n"])
            counts.setdefault(g, np.zeros((permutations, 1 << bits[g]), dtype=np.int64))
            for perm in range(permutations):
                counts[g][perm] += np.bincount((mixed(r["first"], far, seed, perm + 1) >> np.uint64(64 - bits[g])).astype(np.int64), minlength=1 << bits[g])
            parts.append((g, r["part"], r["n"]))
        yield counts, parts

    sums, before = {}, {}
    found = table.where(F.col("group").isin(list(bits))).select("group", "part", "n", "first", "offsets").rdd.mapPartitions(run).collect()
    for counts, _ in found:
        for g, c in counts.items():
            sums[g] = sums.get(g, 0) + c
    for g, part, n in sorted(x for _, parts in found for x in parts):
        own = before.setdefault(g, {"rows": 0})
        own[part], own["rows"] = own["rows"], own["rows"] + n
    return sums, before


def spread_of_deals(runs: DataFrame, block: str, other: str, value: str, by: str, permutations: int, seed: int) -> DataFrame:
    """perm, by, total, multi: the values dealt anew among the bins of each block, perm 1 up; over the pairs of block and other
    of a ``by`` (one of the two), the sum of their distinct values and how many have several.

    A task has one group of blocks and some permutations; of a block beyond ``HELD_ROWS`` one permutation's keys of a range.
    """
    spark = runs.sparkSession
    table, sizes = _pieces(runs, block, other, value)
    bits = {g: (-(-n // HELD_ROWS) - 1).bit_length() for g, n in sizes.items() if n > HELD_ROWS}
    # what many small blocks make up is held whole: only a single block is cut
    single = {r["group"] for r in table.where(F.col("group").isin(list(bits))).select("group", F.explode(f"{block}_values").alias("b")).groupBy("group").agg(F.countDistinct("b").alias("n")).where("n = 1").collect()} if bits else set()
    bits = {g: b for g, b in bits.items() if g in single}
    counts, before = _ranked(table, bits, permutations, seed) if bits else ({}, {})
    sources, tasks = [], []
    rows = min(UNIT_ROWS, max(LEAST_ROWS, sum(sizes.values()) * permutations // spark.sparkContext.defaultParallelism))
    for g, n in sorted(sizes.items()):
        pieces = table.where(F.col("group") == g).coalesce(1).rdd
        if g in bits:
            jobs = [(g, perm + 1, nth, int(counts[g][perm, :nth].sum()), int(counts[g][perm, nth])) for perm in range(permutations) for nth in range(1 << bits[g]) if counts[g][perm, nth]]
        else:
            each = max(1, rows // n)
            jobs = [(g, list(range(p, min(p + each, permutations + 1)))) for p in range(1, permutations + 1, each)]
        sources += [pieces] * len(jobs)
        tasks += jobs
    kinds = {c: runs.schema[f"{c}_values"].dataType.elementType for c in (block, other, value)}
    rest = other if by == block else block
    made = T.StructType([T.StructField("perm", T.LongType()), T.StructField(by, kinds[by]), T.StructField("total", T.LongType()), T.StructField("multi", T.LongType()), T.StructField(rest, kinds[rest]), T.StructField(value, kinds[value])])
    known = spark.sparkContext.broadcast((tasks, before))

    def run(index, rows):
        tasks, before = known.value
        job = tasks[index]
        if len(job) == 2:
            return _whole(rows, job[1], seed, block, other, value, by)
        g, perm, nth, low, n = job
        return _range(rows, perm, seed, block, other, value, by, 64 - bits[g], nth, low, n, before[g])

    found = spark.sparkContext.union(sources).mapPartitionsWithIndex(run) if sources else spark.sparkContext.emptyRDD()
    found = materialised(spark.createDataFrame(found, made, verifySchema=False))
    per = found.where("total IS NULL").groupBy("perm", by, rest).agg(F.countDistinct(value).alias("k"))
    cut = per.select("perm", by, F.col("k").alias("total"), (F.col("k") >= 2).cast("long").alias("multi"))
    return found.where("total IS NOT NULL").select("perm", by, "total", "multi").unionByName(cut).groupBy("perm", by).agg(F.sum("total").alias("total"), F.sum("multi").alias("multi"))
