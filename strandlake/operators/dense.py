"""Truncated SVD of sparse tables, nearest neighbours and a two-dimensional layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialised

#: The largest basis (columns x components, in doubles) that is sent to every task.
BASIS_BYTES = 128 << 20


def gathered_rows(coo: DataFrame, row: str = "row") -> DataFrame:
    """row, cols, vals: one sparse row each (a bin's features, bounded by its width)."""
    return coo.groupBy(row).agg(F.collect_list(F.struct("col_idx", "value")).alias("e")).select(row, F.col("e.col_idx").cast("array<int>").alias("cols"), F.col("e.value").cast("array<double>").alias("vals"))


#: Rows of a batch that are multiplied at once: each entry makes a row of the basis.
ROWS_AT_ONCE = 256


def _slices(batches):
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS_AT_ONCE):
            yield whole.slice(first, ROWS_AT_ONCE)


def _product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Aᵀ(A basis): tasks sum their rows' part by column, columns are summed in a shuffle; columns x basis returns."""
    shape, shared = basis.shape, rows.sparkSession.sparkContext.broadcast(basis)
    names = [f"v{i}" for i in range(shape[1])]

    def run(batches):
        import pyarrow as pa

        part = np.zeros(shape)
        for batch in _slices(batches):
            cols, vals = batch.column("cols"), batch.column("vals")
            at = cols.values.to_numpy()[cols.offsets[0].as_py() : cols.offsets[-1].as_py()]
            x = vals.values.to_numpy()[vals.offsets[0].as_py() : vals.offsets[-1].as_py()]
            starts = cols.offsets.to_numpy()[:-1] - cols.offsets[0].as_py()
            if len(at):
                terms = shared.value[at] * x[:, None]
                projected = np.add.reduceat(terms, starts, axis=0)
                spread = np.repeat(projected, np.diff(np.append(starts, len(at))), axis=0) * x[:, None]
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                part[at[order][first]] += np.add.reduceat(spread[order], first, axis=0)
        met = np.flatnonzero(part.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(part[met, i]) for i in range(shape[1]))], names=["col", *names])

    sums = rows.select("cols", "vals").mapInArrow(run, "col int, " + ", ".join(f"{n} double" for n in names)).groupBy("col").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros(shape)
    out[sums["col"].to_numpy(dtype=int)] = sums[names].to_numpy()
    shared.unpersist()
    return out


def truncated_svd(coo: DataFrame, n_columns: int, n_rows: int, components: int = 64, oversamples: int = 20, rounds: int = 7, drop_first: int = 0, seed: int = 7, row: str = "row") -> tuple[DataFrame, dict]:
    """row, pcs (array: U times the singular values); and {"singular_values", "energy_ratio", "components"}.

    Uncentred, by subspace iteration on AᵀA.  While the columns x k basis is of at most
    ``BASIS_BYTES`` it is broadcast, and made orthonormal on the driver; beyond that it
    is a table (see ``blocksvd``), and "components" is one, too (col, v).  Signs: the
    largest entry of each component is positive.  A decomposition of nothing is empty.
    """
    k = min(components, min(n_rows, n_columns) - 1)
    if k < 1:
        return coo.sparkSession.createDataFrame([], f"{row} long, pcs array<double>"), {"singular_values": [], "energy_ratio": [], "components": np.zeros((0, n_columns))}
    energy = coo.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    if energy is None or not np.isfinite(energy):
        raise ValueError("the matrix has entries that are not finite")
    width, drop = min(k + oversamples, n_columns), min(drop_first, k - 1)
    if n_columns * width * 8 > BASIS_BYTES:
        from .blocksvd import block_svd

        pcs, parts, sigma, tables = block_svd(gathered_rows(coo, row), coo.count(), n_columns, k, width, rounds, drop, seed, row)
        pcs, parts = materialised(pcs), materialised(parts)
        tables.close()
        return pcs, {"singular_values": sigma.tolist(), "energy_ratio": (sigma**2 / energy).tolist(), "components": parts}
    rows = materialised(gathered_rows(coo, row))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_columns, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_product(rows, basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ _product(rows, basis))
    order = np.argsort(-values)[:k]
    sigma, parts = np.sqrt(np.maximum(values[order], 0)), basis @ vectors[:, order]
    parts *= np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(k)])
    known = rows.sparkSession.sparkContext.broadcast(parts[:, drop:])

    def project(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            sizes = batch.column("cols").value_lengths().to_numpy()
            terms = known.value[batch.column("cols").flatten().to_numpy()] * batch.column("vals").flatten().to_numpy()[:, None]
            made = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) if len(terms) else terms
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * terms.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=[row, "pcs"])

    kind = dict(coo.dtypes)[row]
    return rows.mapInArrow(project, f"{row} {kind}, pcs array<double>"), {"singular_values": sigma[drop:].tolist(), "energy_ratio": (sigma[drop:] ** 2 / energy).tolist(), "components": parts.T}


#: Vectors of a block on average; pairs of blocks are compared so many rows at a time, and a task has one block and so many others.
BLOCK, STRIP, OTHERS = 2048, 128, 64


def _blocks(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """block, ids, data (all its vectors, one after another), in the shared folder."""
    n = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("x")).withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n)))
    grouped = rows.repartitionByRange(n, "block").groupBy("block").agg(F.collect_list(F.struct("i", "x")).alias("e"))
    return grouped.select("block", F.col("e.i").alias("ids"), F.flatten("e.x").alias("data")).checkpoint()


def nearest_neighbours(vectors: DataFrame, k: int, metric: str = "cosine", id: str = "id", vector: str = "vector", among: DataFrame | None = None) -> DataFrame:
    """id, neighbour, distance, rank (0-based; ties by id): the ``k`` nearest of ``among`` (``vectors`` itself by default), exact.

    Blocks of the one table meet blocks of the other, read from the checkpoint in the shared folder; a
    task holds two blocks and the best so far of one, and the best of each run of ``OTHERS`` blocks
    are merged by id.  Nothing is gathered in one place.  Products (of cosines in single precision)
    only choose, with their error allowed for, what is then compared exactly with a vector's worst so far.
    """
    left = _blocks(vectors, id, vector)
    right = left if among is None else _blocks(among, id, vector)
    blocks = max(1, right.rdd.getNumPartitions())
    spread = -(-vectors.sparkSession.sparkContext.defaultParallelism // max(1, left.rdd.getNumPartitions()))
    right = right.coalesce(max(-(-blocks // OTHERS), min(blocks, spread)))
    pairs = left.crossJoin(right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns]))

    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x

    def length(x):
        found = np.linalg.norm(x, axis=1)
        return np.where(np.isfinite(found), found, 0)

    kind = np.float32 if metric == "cosine" else np.float64

    def near(ids, x, other_ids, y, limit):
        """Row of x, id of y and distance of all that may be among the k nearest, where ``limit`` is the k-th distance so far."""
        short, turned, sizes, furthest = x.astype(kind), y.astype(kind).T, length(x), length(y).max(initial=0)
        slack = (x.shape[1] + 8) * np.finfo(kind).eps * (1 if metric == "cosine" else (sizes + furthest) ** 2) + 1e-12
        bound = (limit if metric == "cosine" else limit**2) + slack
        for s in range(0, len(x), STRIP):
            at = slice(s, s + STRIP)
            own, most = x[at], bound[at, None].astype(kind)
            d = 1 - short[at] @ turned if metric == "cosine" else np.maximum((own**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * own @ y.T, 0)
            if not np.isfinite(most).all():
                d[ids[at, None] == other_ids[None]] = np.inf
                if d.shape[1] > k:
                    here = np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * np.broadcast_to(slack, len(x))[at, None]
                    most = np.fmin(most, here).astype(kind)
            r, c = np.divmod(np.flatnonzero(d <= most), d.shape[1])  # faster than nonzero of a table
            met = (ids[r + s] != other_ids[c]) & np.isfinite(d[r, c])
            r, c = r[met], c[met]
            # again one by one: the product's last bits depend on a vector's place in its block
            exact = 1 - np.einsum("ij,ij->i", own[r], y[c]) if metric == "cosine" else np.sqrt(((own[r] - y[c]) ** 2).sum(axis=1))
            yield r + s, other_ids[c], np.maximum(exact, 0)

    def best(r, c, d):
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, dtype=int)
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        return r[place < k], c[place < k], d[place < k]

    def run(batches):
        import pyarrow as pa

        def table(ids, held):
            r, c, d = held
            return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(c), pa.array(d)], names=["own", "neighbour", "distance"])

        def merged(held, found):
            held = best(*(np.concatenate(z) for z in zip(held, *found)))
            full = np.bincount(held[0], minlength=len(ids)) == k
            limit = np.where(full, -np.inf, np.inf)
            np.maximum.at(limit, held[0], held[2])
            return held, limit

        block, ids, x, held = None, None, None, None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                if column["block"][i].as_py() != block:
                    if block is not None:
                        yield table(ids, merged(held, waiting)[0])
                    block = column["block"][i].as_py()
                    ids = column["ids"][i].values.to_numpy()
                    x = unit(column["data"][i].values.to_numpy().reshape(len(ids), -1))
                    held, limit, waiting, n = (np.zeros(0, dtype=int), np.zeros(0, dtype=np.int64), np.zeros(0)), np.full(len(ids), np.inf), [], 0
                others = column["other_ids"][i].values.to_numpy()
                y = unit(column["other_data"][i].values.to_numpy().reshape(len(others), -1))
                for found in near(ids, x, others, y, limit):
                    waiting.append(found if len(found[0]) <= 2 * k * STRIP else best(*found))
                    n += len(waiting[-1][0])
                if n > len(held[0]) // 2:  # a limit that lags is no smaller, so nothing is lost
                    (held, limit), waiting, n = merged(held, waiting), [], 0
        if block is not None:
            yield table(ids, merged(held, waiting)[0])

    found = pairs.mapInArrow(run, "own long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("own").orderBy("distance", "neighbour")) - 1
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") < k).select(F.col("own").alias(id), "neighbour", "distance", "rank")


def fuzzy_graph(neighbours: DataFrame, k: int, id: str = "id") -> DataFrame:
    """a, b, weight (a < b): memberships exp(-(d - nearest) / scale) joined as p + q - p q.

    Each point's scale makes its memberships sum to log2(k), found by bisection on its
    k distances.
    """

    target = np.log2(max(k, 2))

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            near, far = batch.column("near"), batch.column("far")
            sizes = near.value_lengths().to_numpy()
            held = np.arange(sizes.max(initial=0))[None] < sizes[:, None]
            d = np.full(held.shape, np.inf)
            d[held] = far.flatten().to_numpy()
            rho = np.where(d > 0, d, np.inf).min(axis=1, initial=np.inf)
            rho[~np.isfinite(rho)] = 0
            over = np.maximum(d - rho[:, None], 0)
            low, high, scale, on = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.arange(len(d))
            for _ in range(64):
                total = np.exp(-over[on] / scale[on, None]).sum(axis=1)
                some = np.abs(total - target) >= 1e-6
                on, total = on[some], total[some]
                if not len(on):
                    break
                much = total > target
                high[on[much]], low[on[~much]] = scale[on[much]], scale[on[~much]]
                scale[on] = np.where(np.isfinite(high[on]), (low[on] + high[on]) / 2, scale[on] * 2)
            mean = np.where(held, d, 0).sum(axis=1) / sizes
            weight = np.exp(-over / np.maximum(scale, 1e-3 * np.maximum(mean, 1e-12))[:, None])[held]
            yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(np.repeat(np.arange(len(d)), sizes))), near.flatten(), pa.array(weight)], names=[id, "neighbour", "weight"])

    listed = neighbours.groupBy(F.col(id).cast("long").alias(id)).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("e"))
    directed = listed.select(id, F.col("e.neighbour").cast("array<long>").alias("near"), F.col("e.distance").cast("array<double>").alias("far")).mapInArrow(weigh, f"{id} long, neighbour long, weight double")
    both = directed.select(F.least(id, "neighbour").alias("a"), F.greatest(id, "neighbour").alias("b"), "weight")
    sums = both.groupBy("a", "b").agg(F.sum("weight").alias("s"), (F.max("weight") * F.min("weight")).alias("product"), F.count(F.lit(1)).alias("n"))
    return sums.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("product")).otherwise(F.col("s")).alias("weight"))


def spectral_start(n: int, a, b, w, dimensions: int, random, rounds: int = 200):
    """Positions within 10 of the origin: the leading eigenvectors of the normalised graph besides the constant one,
    by orthogonal iteration over its edges, with a little noise.

    The constant one is known and projected out: in a graph of several parts its eigenvalue is not simple.
    """
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    root = np.sqrt(np.maximum(degree, 1e-12))
    scaled = w / root[a] / root[b]
    constant = root[:, None] / np.linalg.norm(root)

    def spread(v):
        moved = v + np.stack([np.bincount(a, scaled * v[b, c], n) + np.bincount(b, scaled * v[a, c], n) for c in range(v.shape[1])], axis=1)
        return moved - constant * (constant.T @ moved)

    v = random.normal(size=(n, min(dimensions + 2, n - 1)))
    for _ in range(rounds):
        v = np.linalg.qr(spread(v))[0]
    _, vectors = np.linalg.eigh(v.T @ spread(v))
    found = (v @ vectors[:, ::-1])[:, :dimensions]
    if found.shape[1] < dimensions:
        found = np.column_stack([found, np.zeros((n, dimensions - found.shape[1]))])
    return 10 * found / np.maximum(np.abs(found).max(), 1e-12) + random.normal(scale=1e-4, size=(n, dimensions))


def layout(vectors: DataFrame, k: int = 30, min_dist: float = 0.05, metric: str = "cosine", dimensions: int = 2, epochs: int = 200, seed: int = 7, id: str = "id", vector: str = "vector", max_fit_rows: int = 0) -> DataFrame:
    """id, position: attraction along the fuzzy graph, repulsion from random points, from a spread start.

    Neighbours and the graph are made in Spark; positions are moved on the driver, which
    holds the graph's edges.  Fewer than three points lie on a unit circle.  Every row is fitted,
    unless ``max_fit_rows`` is set: above it those with the smallest hash are fitted, and each
    other row lies at the mean of its ``k`` nearest fitted rows, weighted by closeness.
    """
    spark = vectors.sparkSession
    if max_fit_rows and vectors.count() > max_fit_rows:
        fit = vectors.select(id, vector).orderBy(F.xxhash64(F.lit(seed), F.col(id)), id).limit(max_fit_rows).checkpoint()
        placed = layout(fit, k, min_dist, metric, dimensions, epochs, seed, id, vector, 0)
        rest = vectors.select(id, vector).join(fit.select(id), id, "left_anti")
        near = nearest_neighbours(rest, k, metric, id, vector, fit).withColumn("w", 1 / (F.col("distance") + 1e-9))
        met = near.join(placed.select(F.col(id).alias("neighbour"), "position"), "neighbour")
        mean = F.array(*[F.sum(F.col("w") * F.col("position")[i]) / F.sum("w") for i in range(dimensions)])
        return placed.unionByName(met.groupBy(id).agg(mean.alias("position")))
    ids = vectors.select(id).orderBy(id).toPandas()[id].to_numpy()
    n = len(ids)
    if n < 3:
        return spark.createDataFrame([(int(i), [float(np.cos(2 * np.pi * j / max(n, 1))), float(np.sin(2 * np.pi * j / max(n, 1)))]) for j, i in enumerate(ids)], f"{id} long, position array<double>")
    k = max(2, min(k, n - 1))
    edges = fuzzy_graph(nearest_neighbours(vectors, k, metric, id, vector), k, id).toPandas()
    a, b = (np.searchsorted(ids, edges[c].to_numpy()).astype(np.int32) for c in ("a", "b"))
    order = np.lexsort((b, a))  # the draws below follow this order
    a, b, w = a[order], b[order], edges["weight"].to_numpy()[order]
    del edges, order
    # the curve 1 / (1 + alpha d**(2 beta)) that is flat up to min_dist
    grid = np.linspace(1e-3, 3, 300)
    want = np.where(grid <= min_dist, 1.0, np.exp(-(grid - min_dist)))
    candidates = [(float(((1 / (1 + x * grid ** (2 * y)) - want) ** 2).sum()), x, y) for x in np.linspace(0.5, 3, 26) for y in np.linspace(0.5, 1.5, 21)]
    _, alpha, beta = min(candidates)
    random = np.random.default_rng(seed)
    p = spectral_start(n, a, b, w, dimensions, random)
    # an edge is drawn in each direction by itself: its ends attract each other, its first is pushed
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        hit = random.permutation(np.flatnonzero(random.random(len(w)) < w / w.max()))
        # few edges a point at once: a step that sums many overshoots
        for some in np.array_split(hit, max(1, -(-2 * len(hit) // n))):
            i, j = a[some], b[some]
            delta = p[i] - p[j]
            d2 = np.maximum((delta**2).sum(axis=1), 1e-12)
            pull = np.clip((-2 * alpha * beta * d2 ** (beta - 1) / (1 + alpha * d2**beta))[:, None] * delta, -4, 4)
            ends, moves = [i, j], [pull, -pull]
            for _ in range(5):
                other = random.integers(0, n, len(i))
                away = p[i] - p[other]
                e2 = (away**2).sum(axis=1)
                push = np.clip((2 * beta / ((0.001 + e2) * (1 + alpha * np.maximum(e2, 1e-12) ** beta)))[:, None] * away, -4, 4)
                push[other == i] = 0
                ends.append(i)
                moves.append(push)
            ends, moves = np.concatenate(ends), np.concatenate(moves)
            step = np.stack([np.bincount(ends, moves[:, c], n) for c in range(dimensions)], axis=1)
            p += rate * np.clip(step, -4, 4)
    import pyarrow as pa

    ends = pa.array(np.arange(n + 1, dtype=np.int32) * dimensions)
    return spark.createDataFrame(pa.table({id: pa.array(ids, pa.int64()), "position": pa.ListArray.from_arrays(ends, pa.array(p.ravel()))}), f"{id} long, position array<double>")
