"""Shared helpers: table access, word splitting and tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch to and from Python workers; Spark's default is eight times as much.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of_text(value, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def ascii_lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased; null gives none.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is what the
    word pattern asks for: they touch A-Z and split at space, \\t..\\r.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without it; there a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder there")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    made = tempfile.mkdtemp(prefix="strandlake-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Shared:
    """Parquet tables in the shared folder: lineage ends there, lost executors can read them again."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/strandlake-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as error:  # the session may have ended; the folder then goes with it
            if name:
                raise error


def arrow_schema(fields: str):
    """A pyarrow schema from "name type, ..." with the few types used here."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(), "ints": pa.list_(pa.int32()), "longs": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(","))])


def spark_schema(fields: str) -> str:
    kinds = {"ints": "array<int>", "longs": "array<bigint>"}
    return ", ".join(f"`{n}` {kinds.get(k, k)}" for n, k in (f.split() for f in fields.split(",")))


def all_of(df: DataFrame, *, but: str | None = None) -> list[Column]:
    """The columns of ``df``, whatever they are called, without one of the name ``but`` (in any case)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if but is None or c.lower() != but.lower()]


def mapped(df: DataFrame, change, *added: tuple[str, str]) -> DataFrame:
    """``df.mapInArrow`` over whole rows, whatever the columns are called: ``change`` meets them as c0, c1, ... in order,
    and may append columns (name, type), which it names as it likes."""
    names = [*df.columns, *(name for name, _ in added)]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate([*(f.dataType.simpleString() for f in df.schema), *(kind for _, kind in added)]))
    return plain.mapInArrow(change, schema).toDF(*names)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores appended until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
