"""Incremental ingest: new assemblies are sketched as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sketch


def sketch_new(spark: SparkSession, sequences_dir: str, out: str, checkpoint: str, k: int = 31, bin_size: int = 10_000, scaled: int = 200):
    """Sketch every Parquet file of (assembly, sample, contig, seq) that has not been seen; returns the query.

    Each assembly's folder is written whole, so a batch that is repeated after a
    failure leaves the same result.
    """
    stream = spark.readStream.schema("assembly string, sample string, contig string, seq string").parquet(sequences_dir)

    def write(batch: DataFrame, _: int) -> None:
        done = sketch.sketch(batch, k, bin_size, scaled, ["assembly", "sample", "contig"])
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assembly").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
