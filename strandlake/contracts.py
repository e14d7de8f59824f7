"""Fixed schemas of the tables that stages exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields.items()])


#: Fixed: columns of each table.
MANIFEST = _schema(assembly="string", sample="string", haplotype="string", source="string", fasta="string", fai="string", gzi="string", chrom_alias="string", censat_bed="string", repeatmasker_bed="string", segdup_bed="string", population="string", superpopulation="string", sex="string")
BINS = _schema(bin_idx="int", bin_uid="string", assembly="string", sample="string", haplotype="string", source="string", contig="string", chrom="string", placed="boolean", start="long", end="long", n_acgt="long", n_kmers="long", n_sketch="int", gc="float", nfrac="float")
SKETCH = _schema(bin_idx="int", hash="long")
FEATURES = _schema(hash="long", col_idx="int", n_samples="int", n_assemblies="int", n_bins="long")
PREVALENCE = _schema(n_samples="int", n_kmers="long", selected="boolean")
CLUSTERS = _schema(row_idx="long", bin_uid="string", cluster="int", probability="float", outlier_score="float")
ENRICHMENT = _schema(cluster="int", feature="string", n_bins_cluster="long", n_bins_total="long", cluster_size="long", background_size="long", frac_cluster="double", frac_background="double", log2_enrichment="double", neg_log10_p="double")
CLUSTER_NAMES = _schema(cluster="int", name="string", top_features="string", size="long", n_assemblies="int", n_chroms="int", purity="double")
TRANSFER = _schema(cluster="int", name="string", n_ref_bins="long", n_asm_bins="long", ref_top_feature="string", asm_top_feature="string", asm_agreement="double", asm_annotated_frac="double")
INFERRED = _schema(bin_uid="string", cluster="int", inferred_feature="string", support="int", cluster_ref_bins="int", purity="float", novel="boolean")


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Columns in the schema's order and types, missing text as ''; ValueError if a column is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cast = [(F.coalesce(F.col(f.name).cast("string"), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in schema]
    extra = [F.col(c) for c in df.columns if c not in schema.names] if keep_extra else []
    return df.select(*cast, *extra)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
