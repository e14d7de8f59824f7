"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents:

1. toxicity: rows that the toxicity model rejects (score 0.5 or higher) go;
2. simhash: one document of each group of near-duplicates stays;
3. secrets: every secret in a text is replaced by ``[SECRET]``; all rows stay;
4. mixing: each document is repeated as its source's rate says;
5. packing: the pieces of packed sequences, with their ids.

Null texts, repeated rows, empty tables and further columns are treated as the
operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import op1_toxicity, op2_simhash, op3_packing, op6_mixing, op7_secrets
from strandlake.llm.common import Shared, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_toxicity.reject(docs, op1_toxicity.train(docs, read(spark, sf_dir, "labels")))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_simhash.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Models and fingerprints are beyond SQL; the tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = shared.write(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            shared.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
