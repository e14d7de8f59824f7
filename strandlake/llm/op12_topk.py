"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers (floor of 1024 x).  Candidates are dealt into groups; a task
holds one group column by column, dimensions in order of falling mass.  A query is
scored a block of dimensions at a time.  After each block, what the rest can still add
is bounded by the product of the two remaining norms (Cauchy-Schwarz): the k-th best
lower bound is a floor, candidates whose upper bound lies under it are gone, and the
others are moved together before the next block.

Each query first meets one group, which gives it a floor, then all others with that floor,
so most groups give up their candidates after a block or two.  A group returns at most
k + 1 rows a query (one may be the query itself); the best of those of all groups
are ranked.  Queries pass through the shuffle once for each group; groups grow with
the table up to ``MOST_ROWS``.

Scores are exact: doubles are used while every possible sum stays under 2^53,
beyond that Python integers (and scores outside 64 bits count as its bound).

Defined cases: vectors null, or with components null or not finite (1024 x, too) take
no part; vectors meet only vectors of their own length, empty ones with score 0;
repeated vec_ids are rows of their own, and only the query's own row is left out; a
null vec_id is no query, and comes last among ties; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, read

EVERY, TOP = 100, 10
LEAST_ROWS, MOST_ROWS, GROUPS = 4_096, 262_144, 64
#: Dimensions scored between two looks at the bounds.
DIMENSIONS = 8
_EXACT = float(1 << 53)
ROW = "group int, query long, id long, floor double, vector array<double>"
FOUND = "query long, query_id long, own long, vec_id long, score long"


def _clipped(score: int) -> int:
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


class Columns:
    """One group's vectors of one length, stored by dimension."""

    def __init__(self, ids, vectors):
        import numpy as np

        self.ids, self.n = ids, len(vectors)
        self.order = np.argsort(-np.abs(vectors).sum(axis=0), kind="stable")
        self.rows = vectors
        self.most = float(np.abs(vectors).max(initial=0.0))
        ordered = vectors[:, self.order]
        self.cuts = list(range(0, ordered.shape[1], DIMENSIONS)) or [0]
        self.blocks = [np.ascontiguousarray(ordered[:, c : c + DIMENSIONS].T) for c in self.cuts]
        with np.errstate(over="ignore"):  # not used where sums may pass 2^53
            self.rest = [np.sqrt(np.square(ordered[:, c + DIMENSIONS :]).sum(axis=1)) for c in self.cuts]

    def best(self, query, k: int, floor: float):
        """Positions and scores of the best ``k`` of those that reach ``floor``; ties by id, null ids last."""
        import numpy as np

        if len(query) * self.most * float(np.abs(query).max(initial=0.0)) >= _EXACT:
            scores = np.array([_clipped(sum(int(a) * int(b) for a, b in zip(r, query))) for r in self.rows], dtype=object)
            return self._first(np.arange(self.n), scores, k)
        ordered = query[self.order]
        alive, partial = np.arange(self.n), np.zeros(self.n)
        for cut, block, rest in zip(self.cuts, self.blocks, self.rest):
            whole = len(alive) == self.n
            partial = partial + ordered[cut : cut + DIMENSIONS] @ (block if whole else block[:, alive])
            reach = float(np.sqrt(np.square(ordered[cut + DIMENSIONS :]).sum())) * (rest if whole else rest[alive])
            reach = reach * (1 + 1e-9) + 0.25  # scores are whole numbers: a quarter covers the roots' rounding
            if len(alive) > k:
                lower = partial - reach
                floor = max(floor, float(np.partition(lower, len(lower) - k)[len(lower) - k]))
            keep = partial + reach >= floor
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        return self._first(alive, partial, k)

    def _first(self, alive, scores, k: int):
        import numpy as np

        if scores.dtype != object and len(alive) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[keep], scores[keep]
        order = sorted(range(len(alive)), key=lambda i: (-scores[i], self.ids[alive[i]] is None, self.ids[alive[i]] or 0))[:k]
        return [(self.ids[alive[i]], int(scores[i])) for i in order]


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        group, held, columns = None, {}, {}
        for batch in batches:
            vectors, out = batch.column("vector"), []
            flat, ends = np.floor(1024.0 * vectors.flatten().to_numpy(zero_copy_only=False)), np.cumsum(vectors.value_lengths().to_numpy())
            for i, (g, query, id_, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "query", "id", "floor")))):
                vector = flat[ends[i - 1] if i else 0 : ends[i]]
                if g != group:
                    group, held, columns = g, {}, {}
                if query is None:
                    ids, rows = held.setdefault(len(vector), ([], []))
                    ids.append(id_)
                    rows.append(vector.copy())
                    continue
                if held:  # all candidates of a group come before its queries
                    columns = {size: Columns(ids, np.array(rows).reshape(len(ids), size)) for size, (ids, rows) in held.items()}
                    held = {}
                if len(vector) in columns:
                    own = _clipped(sum(int(x) * int(x) for x in vector))
                    out += [(query, id_, own, *r) for r in columns[len(vector)].best(vector, k, -np.inf if floor is None else floor)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names=["query", "query_id", "own", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP, least: int = LEAST_ROWS, most: int = MOST_ROWS, groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, embedding) for each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    shared = Shared(spark, "topk")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 1024.0) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    # rows of one id or one vector may be many: the row's place, written down, deals it
    rows = shared.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    dealt = max(1, -(-n // most), min(groups, -(-n // least)))
    group = F.pmod(F.xxhash64("row"), F.lit(dealt)).cast("int")
    candidates = rows.select(group.alias("group"), F.lit(None).cast("long").alias("query"), "id", F.lit(None).cast("double").alias("floor"), "vector")
    queries = rows.where(F.col("id") % every == 0).select(F.col("row").alias("query"), "id", "vector", group.alias("home"))

    def searched(asked: DataFrame, name: str) -> DataFrame:
        both = candidates.unionByName(asked.select(*candidates.columns))
        cells = both.repartitionByRange(dealt, "group").sortWithinPartitions(F.col("group"), F.col("query").asc_nulls_first())
        return shared.write(cells.mapInArrow(_search(k + 1), FOUND), name)

    first = searched(queries.select("query", "id", "vector", F.col("home").alias("group"), F.lit(None).cast("double").alias("floor")), "first")
    floors = first.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score").cast("double")).alias("floor"))
    rest = queries.join(floors, "query", "left").select("query", "id", "vector", "floor", F.explode(F.expr(f"filter(sequence(0, {dealt - 1}), g -> g != home)")).alias("group"))
    found = first.unionByName(searched(rest, "rest")) if dealt > 1 else first

    asked = Window.partitionBy("query")
    ranked = found.withColumn("rank", F.row_number().over(asked.orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= k + 1)
    # rows with the query's id and its own score look alike: the first of them stands for the query itself
    own = F.min(F.when(F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(asked)
    ranked = ranked.withColumn("at", own).where(~F.coalesce(F.col("rank") == F.col("at"), F.lit(False)))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") > F.col("at"), F.col("rank") - 1).otherwise(F.col("rank"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
