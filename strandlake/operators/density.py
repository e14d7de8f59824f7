"""Density clustering of low-dimensional points."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialised

NOISE = -1


def _cells(points: DataFrame, eps: float, dimensions: int) -> DataFrame:
    cell = [F.floor(F.col("p")[i] / eps).alias(f"c{i}") for i in range(dimensions)]
    return points.select("id", "p", *cell)


def epsilon_neighbours(points: DataFrame, eps: float, dimensions: int) -> DataFrame:
    """a, b: pairs at most ``eps`` apart, both ways; points (id, p: array) meet within grid cells of that width."""
    left = _cells(points, eps, dimensions)
    offsets = F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product((-1, 0, 1), repeat=dimensions)])
    right = _cells(points, eps, dimensions).withColumn("o", F.explode(offsets)).select(F.col("id").alias("b"), F.col("p").alias("q"), *[(F.col(f"c{i}") + F.col("o")[i]).alias(f"c{i}") for i in range(dimensions)])
    joined = left.withColumnRenamed("id", "a").join(right, [f"c{i}" for i in range(dimensions)])
    square = sum((F.col("p")[i] - F.col("q")[i]) * (F.col("p")[i] - F.col("q")[i]) for i in range(dimensions))
    return joined.where((F.col("a") != F.col("b")) & (square <= eps * eps)).select("a", "b")


def smallest_reachable(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component by the smallest label among neighbours and a jump along labels, checkpointed each round."""
    labels = nodes.select(F.col("id").alias("node"), F.col("id").alias("component"))
    for _ in range(rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = lower.select(F.col("node").alias("via"), F.col("low").alias("far"))
        after = lower.join(jump, F.col("low") == F.col("via")).select("node", "component", F.least("low", "far").alias("next")).checkpoint()
        if not after.where("next < component").limit(1).count():
            return after.select("node", F.col("next").alias("component"))
        labels = after.select("node", F.col("next").alias("component"))
    raise RuntimeError("components did not settle")


#: Core points of a cell that meet those of another at once.
PART = 1 << 16


def _meet(a: np.ndarray, b: np.ndarray, square: float) -> bool:
    """Whether a point of ``a`` lies at most sqrt(``square``) from one of ``b``: halves by halves, those whose boxes are farther apart aside."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        gap = np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0.0)
        if (gap**2).sum() > square * (1 + 1e-9):
            continue
        if len(a) * len(b) <= PART:
            if (sum((a[:, c][:, None] - b[:, c][None]) ** 2 for c in range(a.shape[1])) <= square).any():
                return True
            continue
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        order = np.argpartition(a[:, int(np.argmax(np.ptp(a, axis=0)))], len(a) // 2)
        todo += [(a[order[: len(a) // 2]], b), (a[order[len(a) // 2 :]], b)]
    return False


def _cell_links(cores: DataFrame, forward: list, eps: float, dimensions: int) -> DataFrame:
    """a, b: nodes of the cells of which two core points are at most ``eps`` apart; ``cores``: node, cell, p."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("cell")) / PART)
    rows = cores.groupBy("node", "cell", "p").agg(F.lit(1)).select("node", "cell", "p").withColumn("part", F.pmod(F.xxhash64("p"), parts))
    held = materialised(rows.groupBy("node", "cell", "part").agg(F.flatten(F.collect_list("p")).alias("x")))
    moved = held.select(F.col("node").alias("b"), F.col("x").alias("y"), F.explode(_offsets(forward)).alias("o"), "cell").select("b", "y", _shifted("o").alias("cell"))
    pairs = held.select(F.col("node").alias("a"), "x", "cell").join(moved, "cell").select("a", "b", "x", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            met = [_meet(x[i].values.to_numpy().reshape(-1, dimensions), y[i].values.to_numpy().reshape(-1, dimensions), eps * eps) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(met, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _offsets(offsets: list):
    return F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in offsets])


def _shifted(o: str):
    return F.zip_with("cell", o, lambda c, x: c + x)


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 10, dimensions: int = 2) -> DataFrame:
    """id, cluster, probability (1 core, 0.5 border, 0 noise), outlier_score: points (id, p: array<double>).

    A point counts itself; a border point joins its core neighbour with the lowest
    cluster; clusters are numbered by their smallest id.

    Points fall into cells whose diagonal is ``eps``: those of a cell are neighbours of each other, so
    all points of a cell of ``min_samples`` are core.  Only the fewer points of other cells are counted
    one by one, and clusters are components of cells: pairs of points are never listed.
    """
    width, reach = eps / np.sqrt(dimensions) * (1 - 1e-9), int(np.ceil(np.sqrt(dimensions)))
    # cells that may hold neighbours: boxes at most eps apart
    around = [o for o in itertools.product(range(-reach, reach + 1), repeat=dimensions) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= dimensions]
    forward = [o for o in around if o > (0,) * dimensions]
    placed = points.where(F.size(F.filter("p", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) == dimensions)
    cut = placed.select("id", "p", F.array(*[F.floor(F.col("p")[i] / width).cast("long") for i in range(dimensions)]).alias("cell"))
    sizes = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    cut = materialised(cut.join(sizes, "cell"))
    full = F.col("size") >= min_samples
    square = sum((F.col("p")[i] - F.col("q")[i]) * (F.col("p")[i] - F.col("q")[i]) for i in range(dimensions))

    def near(some: DataFrame, others: DataFrame) -> DataFrame:
        asked = some.select("id", "p", F.explode(_offsets(around)).alias("o"), "cell").select("id", "p", _shifted("o").alias("cell"))
        return asked.join(others, "cell").where(square <= eps * eps)

    counted = near(cut.where(~full), cut.select("cell", F.col("p").alias("q"))).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
    core = cut.where(full).select("id", "p", "cell").unionByName(cut.where(~full).join(counted.select("id"), "id", "left_semi").select("id", "p", "cell"))
    nodes = core.groupBy("cell").agg(F.min("id").cast("long").alias("node"))
    core = materialised(core.join(nodes, "cell"))
    links = _cell_links(core, forward, eps, dimensions)
    links = materialised(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    parts = materialised(smallest_reachable(links, core.select(F.col("node").alias("id")).distinct()))
    numbers = parts.select("component").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("component")) - 1)
    cores = core.join(parts.join(numbers, "component").select("node", "cluster"), "node")
    outer = cut.where(~full).join(core.select("id"), "id", "left_anti")
    border = near(outer, cores.select("cell", F.col("p").alias("q"), "cluster")).groupBy("id").agg(F.min("cluster").alias("touch"))
    whole = points.select("id").join(cores.select("id", "cluster"), "id", "left").join(border, "id", "left")
    probability = F.when(F.col("cluster").isNotNull(), 1.0).when(F.col("touch").isNotNull(), 0.5).otherwise(0.0)
    return whole.select("id", F.coalesce("cluster", "touch", F.lit(NOISE)).alias("cluster"), probability.alias("probability"), F.lit(0.0).alias("outlier_score"))


# --- hierarchical ------------------------------------------------------------

def _spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Prim's minimum spanning tree of mutual reachability: rows (a, b, distance), by distance, then by the smaller and
    the larger end.  That order is total, so the tree is the one that any other way finds."""
    n = len(x)
    best, low, high, left = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    edges, at, places = [], 0, np.arange(n)
    left[0] = False
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(np.sqrt(sum((x[:, c] - x[at, c]) ** 2 for c in range(x.shape[1]))), core), core[at])
        a, b = np.minimum(places, at), np.maximum(places, at)
        closer = left & ((reach < best) | ((reach == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = reach[closer], a[closer], b[closer]
        tied = np.flatnonzero(left & (best == best[left].min()))
        at = int(tied[np.lexsort((high[tied], low[tied]))[0]])
        left[at] = False
        edges.append((low[at], high[at], best[at]))
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1]))) if edges else np.zeros((0, 3))


#: Points from which the tree is made in tasks, points of a leaf of the kd-tree, and leaves met between two looks at the bound.
SPREAD_FROM, LEAF, MEET = 4096, 64, (8, 64)


class Leaves:
    """Points dealt into the leaves of a kd-tree: ``order`` has the points leaf by leaf, ``starts`` where each leaf begins."""

    def __init__(self, x: np.ndarray, size: int = LEAF):
        self.order, cuts, todo = np.arange(len(x)), [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            if b - a <= size:
                cuts.append(a)
                continue
            own = self.order[a:b]
            at = int(np.argmax(x[own].max(axis=0) - x[own].min(axis=0)))
            self.order[a:b] = own[np.argpartition(x[own, at], (b - a) // 2)]
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        cuts.sort()
        self.starts = np.array([*cuts, len(x)])
        self.x = x[self.order]
        self.low, self.high = np.minimum.reduceat(self.x, cuts, axis=0), np.maximum.reduceat(self.x, cuts, axis=0)

    def __len__(self) -> int:
        return len(self.low)

    def gaps(self, leaf: int) -> np.ndarray:
        """Distances from the box of a leaf to all boxes: no two points of them are closer, to the last bit."""
        total = np.zeros(len(self))
        for c in range(self.x.shape[1]):
            total = total + np.maximum(np.maximum(self.low[:, c] - self.high[leaf, c], self.low[leaf, c] - self.high[:, c]), 0.0) ** 2
        return np.sqrt(total)

    def members(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in leaves])

    def distances(self, leaf: int, at: np.ndarray) -> np.ndarray:
        own = self.x[self.starts[leaf] : self.starts[leaf + 1]]
        return np.sqrt(sum((own[:, c][:, None] - self.x[at, c][None]) ** 2 for c in range(self.x.shape[1])))

    def cores(self, leaf: int, k: int) -> np.ndarray:
        """Distance of each point of the leaf to its k-th nearest, itself included."""
        gaps = self.gaps(leaf)
        near = np.argsort(gaps, kind="stable")
        sizes = np.cumsum(np.diff(self.starts)[near])
        done, upto, held = 0, int(np.searchsorted(sizes, k)) + 1, np.zeros((self.starts[leaf + 1] - self.starts[leaf], 0))
        while upto > done:
            d = np.concatenate([held, self.distances(leaf, self.members(near[done:upto]))], axis=1)
            held = np.partition(d, k - 1, axis=1)[:, :k]
            done, upto = upto, int(np.searchsorted(gaps[near], held.max()))
        return held.max(axis=1)

    def least_edges(self, leaf: int, core: np.ndarray, component: np.ndarray, least_core: np.ndarray, single: np.ndarray, best: dict) -> None:
        """Bring ``best`` (component -> (distance, smaller end, larger end)) up to date with the edges that leave the
        leaf's points; leaves farther than the worst best of the leaf's components are not met."""
        a, b = self.starts[leaf], self.starts[leaf + 1]
        own, own_core = component[a:b], core[a:b]
        gaps = np.maximum(np.maximum(self.gaps(leaf), least_core), least_core[leaf])
        if single[leaf] >= 0:
            gaps[single == single[leaf]] = np.inf
        near = np.argsort(gaps, kind="stable")
        gaps = gaps[near]
        there, names, done, step = int(np.searchsorted(gaps, np.inf)), np.unique(own).tolist(), 0, MEET[0]
        while True:
            bound = max(best[c][0] if c in best else np.inf for c in names)
            stop = min(there, int(np.searchsorted(gaps, bound, side="right")), done + step)
            if stop <= done:
                return
            at = self.members(near[done:stop])
            d = np.maximum(np.maximum(self.distances(leaf, at), own_core[:, None]), core[at][None])
            d[own[:, None] == component[at][None]] = np.inf
            low = d.min(axis=1)
            known = np.array([best[c][0] if c in best else np.inf for c in own.tolist()])
            for r in np.flatnonzero((low <= known) & np.isfinite(low)).tolist():
                c, end, others = int(own[r]), int(self.order[a + r]), self.order[at[d[r] == low[r]]]
                first, second = np.minimum(others, end), np.maximum(others, end)
                smallest = first.min()
                edge = (float(low[r]), int(smallest), int(second[first == smallest].min()))
                best[c] = min(best.get(c, edge), edge)
            done, step = stop, MEET[1]


def spread_spanning_tree(spark, x: np.ndarray, k: int) -> np.ndarray:
    """Boruvka's minimum spanning tree of mutual reachability over all points, exact, over a kd-tree searched in tasks.

    The driver holds what is linear in the points: coordinates, core distances and
    edges.  In each round every task returns the least edge that leaves each component,
    meeting only leaves that can hold one.  Equal distances go by the smaller, then the
    larger end, so no round closes a circle.
    """
    n, context = len(x), spark.sparkContext
    leaves = Leaves(x)
    parts = min(len(leaves), context.defaultParallelism * 4)
    blocks = context.parallelize([range(i * len(leaves) // parts, (i + 1) * len(leaves) // parts) for i in range(parts)], parts)
    tree = context.broadcast(leaves)
    core = np.concatenate(blocks.map(lambda b: np.concatenate([tree.value.cores(i, k) for i in b])).collect())
    least_core = np.minimum.reduceat(core, leaves.starts[:-1])
    component, edges, left = np.arange(n), [], n  # by place in the order of leaves
    while left > 1:
        low, high = np.minimum.reduceat(component, leaves.starts[:-1]), np.maximum.reduceat(component, leaves.starts[:-1])
        state = context.broadcast((core, component, least_core, np.where(low == high, low, -1)))

        def least(block, state=state):
            best: dict[int, tuple] = {}
            for i in block:
                tree.value.least_edges(i, *state.value, best)
            return list(best.items())

        chosen = dict(blocks.flatMap(least).reduceByKey(min).collect())
        new = set(chosen.values())
        edges += new
        place = np.empty(n, dtype=int)
        place[leaves.order] = np.arange(n)
        names, inverse = np.unique(component, return_inverse=True)
        up = {int(c): int(c) for c in names}

        def root(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        for _, a, b in new:
            p, q = root(int(component[place[a]])), root(int(component[place[b]]))
            up[max(p, q)] = min(p, q)
        roots = np.array([root(int(c)) for c in names])
        component, left = roots[inverse], len(np.unique(roots))
        state.unpersist()
    tree.unpersist()
    return np.array([(a, b, d) for d, a, b in sorted(edges)]) if edges else np.zeros((0, 3))


def hdbscan_fit(x: np.ndarray, min_cluster_size: int = 50, min_samples: int = 10, method: str = "eom", epsilon: float = 0.0, spark=None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and probabilities of the points; with ``spark``, the distances of many points are taken in tasks.

    Core distances, spanning tree, single-linkage merges, condensed tree, and
    clusters by excess of mass (or leaves).
    """
    n = len(x)
    if n < 2:
        return np.full(n, NOISE), np.zeros(n)
    size, k = max(2, min(min_cluster_size, n)), max(1, min(min_samples, n))
    if spark is not None and n >= SPREAD_FROM:
        tree = spread_spanning_tree(spark, x, k)
    else:
        core = np.concatenate([np.sort(np.sqrt(sum((x[i : i + 256, c][:, None] - x[None, :, c]) ** 2 for c in range(x.shape[1]))), axis=1)[:, min(k, n) - 1] for i in range(0, n, 256)])
        tree = _spanning_tree(x, core)
    # merges: node n + i joins two nodes at a distance
    up = list(range(2 * n - 1))

    def find(v):
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    children, weight = {}, [1] * n
    for i, (a, b, d) in enumerate(tree):
        p, q = find(int(a)), find(int(b))
        children[n + i] = (p, q, d)
        up[p] = up[q] = n + i
        weight.append(weight[p] + weight[q])
    # condensed tree: a split makes two clusters only if both sides are large enough
    birth, parent, fell, leaving = {0: 0.0}, {0: -1}, [], {}
    stack, count = [(2 * n - 2, 0)], 1

    def leaves(v):
        todo = [v]
        while todo:
            u = todo.pop()
            if u < n:
                yield u
            else:
                todo += children[u][:2]

    while stack:
        node, cluster = stack.pop()
        while node >= n:
            p, q, d = children[node]
            level = 1 / d if d > 0 else np.inf
            big = [c for c in (p, q) if weight[c] >= size]
            if len(big) == 2:
                for c in big:
                    birth[count], parent[count] = level, cluster
                    fell.append((cluster, count, level, weight[c]))
                    stack.append((c, count))
                    count += 1
                break
            for c in (p, q):
                if c not in big:
                    for leaf in leaves(c):
                        leaving[leaf] = (cluster, level)
            if not big:
                break
            node = big[0]
        else:
            leaving[node] = (cluster, np.inf)
    finite = [lv for _, lv in leaving.values() if np.isfinite(lv)] + [f[2] for f in fell if np.isfinite(f[2])]
    ceiling = max(finite, default=1.0)
    cap = lambda v: min(v, ceiling)
    stability = {c: 0.0 for c in birth}
    for c, level in leaving.values():
        stability[c] += cap(level) - cap(birth[c])
    for c, _, level, w in fell:
        stability[c] += (cap(level) - cap(birth[c])) * w
    kids: dict[int, list[int]] = {c: [] for c in birth}
    for c, p in parent.items():
        if p >= 0:
            kids[p].append(c)
    chosen = {c: not kids[c] for c in birth}
    if method == "eom":
        for c in sorted(birth, reverse=True):
            if kids[c]:
                below = sum(stability[k_] for k_ in kids[c])
                if c and stability[c] >= below:
                    chosen[c] = True
                    todo = list(kids[c])
                    while todo:
                        d = todo.pop()
                        chosen[d] = False
                        todo += kids[d]
                else:
                    stability[c] = below
    chosen[0] = False  # the whole is no cluster
    if epsilon > 0:
        for c in [c for c in chosen if chosen[c] and 1 / birth[c] < epsilon]:
            chosen[c], p = False, c
            while parent[p] > 0 and 1 / birth[p] < epsilon:
                p = parent[p]
            chosen[p] = True
    labels, strength, names = np.full(n, NOISE), np.zeros(n), {}
    owner = {}
    for c in sorted(birth):
        owner[c] = c if chosen[c] else owner.get(parent[c], NOISE) if c else NOISE
    for point in sorted(leaving):
        c, level = leaving[point]
        if owner[c] != NOISE and owner[c] >= 0:
            labels[point] = names.setdefault(owner[c], len(names))
            strength[point] = cap(level)
    for c in range(len(names)):
        inside = labels == c
        strength[inside] /= max(strength[inside].max(), 1e-300)
    return labels, np.clip(strength, 0, 1)


def hdbscan(points: DataFrame, min_cluster_size: int = 50, min_samples: int = 10, method: str = "eom", epsilon: float = 0.0, max_fit_rows: int = 0, seed: int = 7) -> DataFrame:
    """id, cluster, probability, outlier_score: fitted on all points, or, if ``max_fit_rows`` is set, on at most so many
    (those with the smallest hash), from which the labels of all others follow: another result, not a close one."""
    fitted = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_fit_rows) if max_fit_rows else points
    sampled = fitted.toPandas().sort_values("id")
    x = np.array(sampled["p"].tolist(), dtype=float).reshape(len(sampled), -1)
    if not np.isfinite(x).all():
        raise ValueError("coordinates must be finite")
    labels, strength = hdbscan_fit(x, min_cluster_size, min_samples, method, epsilon, points.sparkSession)
    if len(sampled) and not max_fit_rows:
        return _labelled(points, sampled["id"].to_numpy(), labels, strength)
    return propagate(points, sampled["id"].to_numpy(), x, labels, strength)


def _labelled(points: DataFrame, ids: np.ndarray, labels: np.ndarray, strength: np.ndarray) -> DataFrame:
    """The fit's own labels of all points, as a table."""
    import pandas as pd

    found = pd.DataFrame({"id": ids.astype("int64"), "cluster": labels.astype("int32"), "probability": strength, "outlier_score": 1 - strength})
    return points.sparkSession.createDataFrame(found, "id long, cluster int, probability double, outlier_score double")


def propagate(points: DataFrame, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, strength: np.ndarray) -> DataFrame:
    """Labels of the nearest labelled anchor, within twice the 99th percentile of the anchors' second-neighbour
    distances; beyond that, noise.  Anchors keep their own."""
    real = labels >= 0
    anchors, names, power = x[real], labels[real], strength[real]
    if len(anchors) > 1:
        second = np.concatenate([np.sort(np.sqrt(((anchors[i : i + 256, None] - anchors[None]) ** 2).sum(axis=2)), axis=1)[:, min(2, len(anchors) - 1)] for i in range(0, len(anchors), 256)])
        cutoff = 2 * float(np.quantile(second, 0.99))
    else:
        cutoff = 0.0
    shared = points.sparkSession.sparkContext.broadcast((dict(zip(ids.tolist(), zip(labels.tolist(), strength.tolist()))), anchors, names, power, cutoff))

    def run(batches):
        import pyarrow as pa

        own, anchors, names, power, cutoff = shared.value
        for batch in batches:
            keys, p = batch.column("id").to_pylist(), np.array(batch.column("p").to_pylist(), dtype=float)
            cluster, prob, far = [], [], []
            for i, key in enumerate(keys):
                if key in own:
                    cluster.append(own[key][0])
                    prob.append(own[key][1])
                    far.append(1 - own[key][1])
                    continue
                d = np.sqrt(((anchors - p[i]) ** 2).sum(axis=1)) if len(anchors) else np.array([np.inf])
                j = int(d.argmin())
                near = d[j] <= cutoff
                cluster.append(int(names[j]) if near else NOISE)
                prob.append(float(power[j]) if near else 0.0)
                far.append(float(np.clip(d[j] / cutoff, 0, 1)) if cutoff > 0 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(prob, pa.float64()), pa.array(far, pa.float64())], names=["id", "cluster", "probability", "outlier_score"])

    return points.select(F.col("id").cast("long").alias("id"), "p").mapInArrow(run, "id long, cluster int, probability double, outlier_score double")


def size_histogram(clusters: DataFrame) -> DataFrame:
    """cluster, n, noise_frac (of all rows)."""
    counted = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.agg(F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("n"))), F.lit(0)).alias("noise"))
    return counted.join(F.broadcast(totals)).select("cluster", "n", (F.col("noise") / F.col("t")).alias("noise_frac"))
