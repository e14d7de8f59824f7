"""The registered queries: their columns, their rows, and the SQL of those that have it."""

import duckdb
import pytest

from strandlake.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id fingerprint component_id",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "vec_id n_links component_id kept",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id size source_size target taken",
    "op7": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8": "doc_id start n_tokens ids_crc32",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11": "lang source part item value rank",
    "op12": "query_id rank vec_id score",
    "op13": "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    if name.startswith(("op11", "op12", "op13")):  # their rows are held against SQL or a plain version
        assert df.count() > 0
        return
    table = "embeddings" if name.startswith("op4") else "documents"
    rows, there = df.count(), spark.read.parquet(f"{data_dir}/{table}.parquet").count()
    assert rows >= there if name.startswith("op3") else rows == there


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, data_dir).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes))
