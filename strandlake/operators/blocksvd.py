"""Subspace iteration over tables: for matrices whose columns x components are too many for one place.

The basis is a table (col, v), one short vector a column.  Rows are dealt into parts
of a bounded number of entries; a part is sent just the basis vectors of the columns
that it has, and returns its share of Aᵀ(A basis), summed by column in a shuffle.  The
basis is made orthonormal by its Gram matrix: tasks sum k x k products, the driver takes
their eigenvectors, and tasks apply the small factor (two or three times, as the Gram
matrix squares the condition).  The driver never holds more than k x k numbers a task.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, shared_dir

#: Entries of a part, and columns that one row of the start makes.
ENTRIES, START = 200_000, 4096
VECTOR = "col int, v array<double>"


def _stack(batch, name: str = "v") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _vectors(values: np.ndarray):
    import pyarrow as pa

    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, dtype=float).ravel()))


class Parts:
    """The rows of a sparse table dealt into parts, and which columns each part has; tables of a folder of their own."""

    def __init__(self, rows: DataFrame, entries: int, row: str):
        self.spark, self.row = rows.sparkSession, row
        self.folder = f"{shared_dir(self.spark)}/strandlake-svd-{uuid.uuid4().hex}"
        self.count = max(1, -(-entries // ENTRIES))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(row), F.lit(self.count)).cast("int"))
        self.rows = self.write(dealt.select("part", row, "cols", "vals"), "rows")
        self.needs = self.write(self.rows.select("part", F.explode("cols").alias("col")).distinct(), "needs")
        self.turn = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def next(self, df: DataFrame) -> DataFrame:
        """``df`` written as the present basis; the one before the last goes."""
        self.turn += 1
        out = self.write(df, f"basis-{self.turn}")
        if self.turn > 2:
            drop(self.spark, f"{self.folder}/basis-{self.turn - 2}")
        return out

    def close(self) -> None:
        drop(self.spark, self.folder)

    def meet(self, basis: DataFrame, transposed: bool) -> DataFrame:
        """Aᵀ(A basis) as (col, v), or A basis as (row, pcs)."""
        row, kind = self.row, self.rows.schema[self.row].dataType.simpleString()
        ask = self.needs.join(basis, "col").select("part", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias(row), "col", "v", F.lit(None).cast("array<int>").alias("cols"), F.lit(None).cast("array<double>").alias("vals"))
        own = self.rows.select("part", F.lit(1).alias("kind"), row, F.lit(None).cast("int").alias("col"), F.lit(None).cast("array<double>").alias("v"), "cols", "vals")
        dealt = ask.unionByName(own).repartition(min(self.count, 4000), "part").sortWithinPartitions("part", "kind")

        def run(batches):
            import pyarrow as pa

            now, cols, vectors, place, total = None, [], [], None, None

            def done():
                if transposed and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(place[0].astype(np.int32)), _vectors(total)], names=["col", "v"])

            for batch in batches:
                part, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
                cuts = np.flatnonzero(np.diff(part) | np.diff(kinds)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                    some = batch.slice(a, b - a)
                    if part[a] != now:
                        yield from done()
                        now, cols, vectors, place, total = part[a], [], [], None, None
                    if kinds[a] == 0:
                        cols.append(some.column("col").to_numpy())
                        vectors.append(_stack(some))
                        continue
                    if place is None:
                        names = np.concatenate(cols)
                        order = np.argsort(names)
                        place = names[order], np.concatenate(vectors)[order]
                        total = np.zeros(place[1].shape) if transposed else None
                    lists = some.column("cols")
                    sizes = lists.value_lengths().to_numpy()
                    at = np.searchsorted(place[0], lists.flatten().to_numpy())
                    x = some.column("vals").flatten().to_numpy()
                    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    projected = np.add.reduceat(place[1][at] * x[:, None], first, axis=0)
                    if transposed:
                        spread, order = np.repeat(projected, sizes, axis=0) * x[:, None], np.argsort(at, kind="stable")
                        start = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                        total[at[order][start]] += np.add.reduceat(spread[order], start, axis=0)
                    else:
                        yield pa.RecordBatch.from_arrays([some.column(row), _vectors(projected)], names=[row, "pcs"])
            yield from done()

        if not transposed:
            return dealt.mapInArrow(run, f"{row} {kind}, pcs array<double>")
        width = len(basis.first()["v"])
        names = [f"v{i}" for i in range(width)]
        sums = dealt.mapInArrow(run, VECTOR).select("col", *[F.col("v")[i].alias(n) for i, n in enumerate(names)]).groupBy("col").agg(*[F.sum(n).alias(n) for n in names])
        return sums.select("col", F.array(*names).alias("v"))


def start(spark, n_columns: int, width: int, seed: int) -> DataFrame:
    """Normal draws of every column, by blocks of columns, the same however they are dealt."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block in batch.column("id").to_pylist():
                own = np.arange(block * START, min(n_columns, (block + 1) * START), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), _vectors(np.random.default_rng([seed, block]).normal(size=(len(own), width)))], names=["col", "v"])

    return spark.range(-(-n_columns // START)).mapInArrow(run, VECTOR)


def gram(left: DataFrame, right: DataFrame | None = None) -> np.ndarray:
    """leftᵀ right (by default left itself), summed in tasks."""
    both = left.withColumn("w", F.col("v")) if right is None else left.join(right.withColumnRenamed("v", "w"), "col")

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = _stack(batch).T @ _stack(batch, "w")
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([_vectors(total.reshape(1, -1))], names=["g"])

    found = both.select("v", "w").mapInArrow(run, "g array<double>").toArrow()
    flat = np.sum([np.array(g) for g in found["g"].to_pylist()], axis=0)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def applied(basis: DataFrame, factor: np.ndarray) -> DataFrame:
    """basis @ factor."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("col"), _vectors(_stack(batch) @ factor)], names=["col", "v"])

    return basis.mapInArrow(run, VECTOR)


def orthonormal(parts: Parts, basis: DataFrame) -> DataFrame:
    """The same span with QᵀQ = 1; directions that are lost in rounding keep a length of nearly nothing."""
    basis = parts.next(basis)
    for _ in range(4):
        g = gram(basis)
        if np.abs(g - np.eye(len(g))).max() < 1e-13 * len(g):
            break
        scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        values, vectors = np.linalg.eigh(g * scale[:, None] * scale[None])
        basis = parts.next(applied(basis, scale[:, None] * vectors / np.sqrt(np.maximum(values, values.max() * 1e-15))))
    return basis


def largest_signs(basis: DataFrame) -> np.ndarray:
    """Sign of the entry of the largest size of each component (of equal ones that of the first column)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v, cols = _stack(batch), batch.column("col").to_numpy()
                order = np.argsort(cols)
                at = order[np.abs(v[order]).argmax(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1], dtype=np.int32)), pa.array(v[at, np.arange(v.shape[1])]), pa.array(cols[at])], names=["i", "x", "col"])

    best = F.max_by(F.signum("x"), F.struct(F.abs("x"), -F.col("col")))
    found = basis.mapInArrow(run, "i int, x double, col int").groupBy("i").agg(best.alias("sign")).orderBy("i").collect()
    return np.array([r["sign"] for r in found])


def block_svd(rows: DataFrame, entries: int, n_columns: int, k: int, width: int, rounds: int, drop_first: int, seed: int, row: str = "row") -> tuple[DataFrame, DataFrame, np.ndarray, Parts]:
    """(row, pcs), (col, v: its entries in the components), singular values, and the tables' handle, to be closed after use.

    ``rows``: row, cols, vals.  Columns without entries are nowhere sent and drop out of the basis, as they must.
    """
    parts = Parts(rows, entries, row)
    basis = orthonormal(parts, start(rows.sparkSession, n_columns, width, seed))
    for _ in range(rounds):
        basis = orthonormal(parts, parts.meet(basis, True))
    product = parts.write(parts.meet(basis, True), "product")
    small = gram(basis, product)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    found = parts.write(applied(basis, vectors[:, order]), "found")
    signs = largest_signs(found)
    components = parts.write(applied(found, np.diag(signs)[:, drop_first:]), "components")
    return parts.meet(components, False), components, np.sqrt(np.maximum(values[order], 0))[drop_first:], parts
