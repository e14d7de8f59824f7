"""Queries: decomposition, neighbours, layout and density clusters, on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, density
from .mappings import table
from .registry import query, rounded


def _points(spark, sf_dir):
    """The first two components of each embedding, scaled."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.col("embedding")[0].cast("double") * 10, F.col("embedding")[1].cast("double") * 10).alias("p"))


_POINTS = "WITH pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)"


@query(f"{_POINTS} SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.15::DOUBLE * 0.15::DOUBLE")
def epsilon_pairs(spark, sf_dir):
    return density.epsilon_neighbours(_points(spark, sf_dir), 0.15, 2)


@query(f"{_POINTS}, n AS (SELECT a.id, count(*) AS n FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.15::DOUBLE * 0.15::DOUBLE GROUP BY a.id) SELECT id, CASE WHEN n >= 5 THEN 1.0 WHEN EXISTS (SELECT 1 FROM pts p JOIN pts q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.15::DOUBLE * 0.15::DOUBLE JOIN n m ON m.id = q.id WHERE p.id = n.id AND m.n >= 5) THEN 0.5 ELSE 0.0 END::DOUBLE AS probability FROM n")
def dbscan_core(spark, sf_dir):
    return density.dbscan(_points(spark, sf_dir), 0.15, 5).select("id", "probability")


@query()
def dbscan_labels(spark, sf_dir):
    return density.dbscan(_points(spark, sf_dir), 0.15, 5)


@query()
def hdbscan_labels(spark, sf_dir):
    return density.hdbscan(_points(spark, sf_dir), 15, 5)


@query("SELECT vec_id AS id, o AS neighbour, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) - 1 AS rank, round(d, 5) AS distance FROM (SELECT a.vec_id, b.vec_id AS o, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, o) <= 5")
def nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(dense.nearest_neighbours(vectors, 5), 5)


@query()
def svd_components(spark, sf_dir):
    """Rows-only: the first components of the embeddings as a sparse table."""
    coo = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col_idx", "value")).withColumn("value", F.col("value").cast("double"))
    pcs, _ = dense.truncated_svd(coo, 64, table(spark, sf_dir, "embeddings").count(), components=8)
    return pcs


@query()
def umap_layout(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return dense.layout(vectors, k=15, epochs=60)
