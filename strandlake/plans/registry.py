"""The registered queries: name -> callable (spark, sf_dir) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Double columns rounded, as the SQL side rounds them; -0.0 becomes 0.0."""
    chosen = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in chosen})
