"""Token-id files: Parquet lists of ids with delta or dictionary encoding.

``write_token_files`` range-partitions documents by id, sorts each partition,
encodes it and writes one Parquet file per partition: columns ``part``,
``doc_id``, ``local_start`` (ids before the document in its file),
``n_tokens`` and ``ids`` (array<int>).  Row groups have a set size, the id
column a set encoding, and the writer adds column and offset indexes (page
indexes), so that readers can take the three small columns alone or the ids of
a doc_id range without touching the rest.  ``token_index`` turns the small
columns into positions in the whole stream: the only thing gathered is one sum
per file.

Defined cases: null text counts as empty (its end id alone); a null doc_id sorts
first; repeated doc_ids are kept as rows of their own, in order of their text;
an empty table gives empty files and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, arrow_schema, read, spark_schema
from .tokens import ChunkTokenizer, slices, vocabulary_path

FILE_FIELDS = "part int, doc_id long, local_start long, n_tokens long, ids ints"
#: Parquet writer settings for the two encodings of the id column.
ENCODINGS = {
    "delta": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
    "dictionary": {"parquet.writer.version": "PARQUET_1_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": "1048576"},
}


def _encoder(path: str, end_id: int, memo_size: int):
    schema = arrow_schema(FILE_FIELDS)

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        tokenizer = ChunkTokenizer.of(path, memo_size)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts):
                coded = [x + end for x in tokenizer.encode(texts[i:j])]
                counts = np.array([len(x) // 4 for x in coded], dtype=np.int64)
                ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, dtype=np.int32)), batch.column("doc_id").slice(i, j - i), pa.array(at + ends - counts), pa.array(counts), lists], schema=schema)
                at += int(ends[-1])

    return encode


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 1, encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, partitions: int | None = None, memo_size: int = 700_000) -> None:
    """Write ``docs`` (doc_id, text) to ``path`` as token files, in ascending doc_id order."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(_encoder(vocabulary or vocabulary_path(), end_id, memo_size), spark_schema(FILE_FIELDS))
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes)}
    coded.write.mode("overwrite").options(**options).option("compression", "snappy").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark_schema(FILE_FIELDS)).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids in all files before each file (one small row per file)."""
    from pyspark.sql import Window

    sums = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the whole stream, read back from the files.

    The index is written beside the files first: its size is known then, and Spark
    broadcasts it unless it has grown past the session's threshold.
    """
    token_index(spark, path).write.mode("overwrite").parquet(f"{path}-index")
    index = spark.read.schema("part int, base long").parquet(f"{path}-index")
    return read_token_files(spark, path).join(index, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def tokens_between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The rows with low <= doc_id < high; page indexes keep other pages from being read."""
    return token_table(spark, path).where((F.col("doc_id") >= low) & (F.col("doc_id") < high))


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), shared.path("files"))
    return token_table(spark, shared.path("files")).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
