"""Queries: k-mers, sketches and bins over the documents as bases; names of contigs and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, names
from ..operators import ranking, sketch
from .mappings import SEQUENCES_SQL, sequences, table
from .q_features import mix_sql
from .registry import query, rounded

K, BIN, SCALED = 11, 200, 64
KEYS = ["assembly", "chrom"]
CEILING = hashing.hash_ceiling(SCALED)
_CODE = "list_reduce(list_transform(string_split(kmer, ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END::BIGINT), lambda a, b: a * 4 + b)"
_KMERS = f"""{SEQUENCES_SQL}, few AS (SELECT * FROM sequences WHERE {{where}}),
raw AS (SELECT assembly, chrom, p.i AS pos, substr(seq, (p.i + 1)::BIGINT, {K}) AS kmer FROM few, range(0, length(seq) - {K} + 1) p(i)),
kmers AS (SELECT assembly, chrom, pos, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM raw WHERE kmer NOT LIKE '%N%'),
coded AS (SELECT assembly, chrom, pos, kmer, {_CODE} AS forward, {_CODE.replace('kmer', 'rc')} AS backward FROM kmers)"""


def _few(spark, sf_dir):
    return sequences(spark, sf_dir)


def _sql(where: str, rest: str) -> str:
    return f"WITH {_KMERS.replace("{where}", where)} {rest}"


@query(_sql("true", f"SELECT assembly, chrom, count(*) AS n, sum({mix_sql('least(forward, backward)::UHUGEINT')} % 2147483648::UHUGEINT)::BIGINT AS checksum FROM coded GROUP BY ALL"))
def canonical_kmers(spark, sf_dir):
    """Every k-mer of every document: its hash, summed over the low 31 bits."""
    every = sketch.positioned_sketch(sketch.blocks(_few(spark, sf_dir), K, 4096, KEYS), K, 1, KEYS)
    return every.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hash").bitwiseAND(F.lit((1 << 31) - 1))).alias("checksum"))


@query("SELECT n_name AS kmer_source, translate(upper(substr(n_name, 1, 3)), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'CGAATCGTACGTACGTACGTACG') AS kmer, list_reduce(list_transform(string_split(translate(upper(substr(n_name, 1, 3)), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'CGAATCGTACGTACGTACGTACG'), ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END::BIGINT), lambda a, b: a * 4 + b) AS code FROM nation")
def kmer_codes(spark, sf_dir):
    """Packing and unpacking of short k-mers made from nation names."""
    made = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kmer_source"), F.translate(F.upper(F.substring("n_name", 1, 3)), "BDEFHIJKLMNOPQRSUVWXYZ ", "CGAATCGTACGTACGTACGTACG").alias("kmer"))
    coded = made.withColumn("code", hashing.kmer_code(F.col("kmer")))
    return coded.select("kmer_source", hashing.code_kmer(F.col("code"), 3).alias("kmer"), "code")


@query(f"SELECT c_custkey AS x, CAST(h % 9223372036854775808::UHUGEINT AS BIGINT) AS low63, h >= 9223372036854775808::UHUGEINT AS top FROM (SELECT c_custkey, {mix_sql('c_custkey::UHUGEINT')} AS h FROM customer)")
def mix64_hash(spark, sf_dir):
    with hashing.wrapping(spark):
        hashed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x"), hashing.mix64(F.col("c_custkey").cast("long")).alias("h"))
    return hashed.select("x", F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).alias("low63"), (F.col("h") < 0).alias("top"))


_SKETCH = f"SELECT DISTINCT assembly, chrom, pos // {BIN} * {BIN} AS start, hash FROM (SELECT assembly, chrom, pos, {mix_sql('least(forward, backward)::UHUGEINT')} AS hash FROM coded) WHERE hash <= {CEILING}::UHUGEINT"


@query(_sql("true", f"SELECT assembly, chrom, start, hash::BIGINT AS hash FROM ({_SKETCH})"))
def frac_sketch(spark, sf_dir):
    made = sketch.bin_sketch(sketch.blocks(_few(spark, sf_dir), K, 20 * BIN, KEYS), K, BIN, SCALED, 20 * BIN, KEYS)
    return made.select(*KEYS, "start", F.explode("hashes").alias("hash"))


_STATS = f"""stats AS (SELECT assembly, chrom, length(seq) AS total, b.i AS start, least(b.i + {BIN}, length(seq)) AS "end", substr(seq, (b.i + 1)::BIGINT, {BIN}) AS piece FROM sequences, range(0, length(seq), {BIN}) b(i))"""


@query(f"WITH {SEQUENCES_SQL}, {_STATS}, counted AS (SELECT assembly, chrom, start, \"end\", length(replace(piece, 'N', '')) AS n_acgt, length(regexp_replace(piece, '[^GC]', '', 'g')) AS n_gc FROM stats) SELECT assembly, chrom, start, \"end\", n_acgt, CASE WHEN n_acgt > 0 THEN round(n_gc::DOUBLE / n_acgt, 6) END AS gc, round(1 - n_acgt::DOUBLE / (\"end\" - start), 6) AS nfrac FROM counted")
def bin_base_stats(spark, sf_dir):
    return rounded(sketch.bin_stats(sequences(spark, sf_dir), BIN, KEYS).drop("total", "n_kmers"))


@query(_sql("true", f"SELECT assembly, chrom, pos // {BIN} * {BIN} AS start, count(*) AS n_kmers FROM coded GROUP BY ALL"))
def bin_kmer_counts(spark, sf_dir):
    return sketch.kmer_counts(sequences(spark, sf_dir), K, BIN, KEYS)


@query(_sql("true", f""", hashed AS ({_SKETCH}), sizes AS (SELECT assembly, chrom, start, count(*) AS n_sketch FROM hashed GROUP BY ALL), {_STATS.replace('FROM sequences', 'FROM few')},
kept AS (SELECT assembly, chrom, stats.start, coalesce(n_sketch, 0) AS n_sketch FROM stats LEFT JOIN sizes USING (assembly, chrom, start) WHERE start + {BIN} <= total AND length(replace(piece, 'N', ''))::DOUBLE / ("end" - start) >= 0.5 AND coalesce(n_sketch, 0) >= 3)
SELECT assembly, chrom, start, n_sketch, row_number() OVER (ORDER BY assembly, chrom, start) - 1 AS row_idx FROM kept"""))
def bin_keep(spark, sf_dir):
    few = _few(spark, sf_dir)
    kept = sketch.keep_bins(sketch.bin_stats(few, BIN, KEYS), sketch.sketch(few, K, BIN, SCALED, KEYS), BIN, KEYS, 0.5, 3)
    return kept.select("assembly", "chrom", "start", "n_sketch", "row_idx")


# --- names: made from tables by expressions that both sides read, judged by the rule in SQL ----

#: Names of contigs in all forms, with chromosomes 0 to 29.
_CONTIGS = """CASE c_custkey % 13 WHEN 0 THEN 'chr' || (c_custkey % 30) WHEN 1 THEN concat(c_custkey % 30, '') WHEN 2 THEN concat('HG', c_custkey, '#1#chr', c_custkey % 30) WHEN 3 THEN 'CHRX' WHEN 4 THEN ' y ' WHEN 5 THEN 'chrMT'
 WHEN 6 THEN concat('chr', c_custkey % 30, '_', c_name, '_random') WHEN 7 THEN concat('chr', c_custkey % 30, '_alt') WHEN 8 THEN concat('chrUn_', c_custkey) WHEN 9 THEN concat('chrX_', c_nationkey, '_fix') WHEN 10 THEN c_name WHEN 11 THEN concat('chrM_', c_custkey, '_ALT') ELSE concat('chr', c_custkey % 30, '_', c_custkey) END"""


def _chrom_sql(x: str) -> str:
    """The chromosome of a name without white space around it."""
    core = f"regexp_replace(lower(trim(regexp_replace({x}, '^.*#', ''))), '^chr', '')"
    return f"CASE WHEN {core} IN ('m', 'mt', 'mito', 'mtdna', 'chrmt') THEN 'chrM' WHEN {core} IN ('x', 'y') THEN 'chr' || upper({core}) WHEN regexp_full_match({core}, '0*([1-9]|1[0-9]|2[0-2])') THEN 'chr' || {core}::INT ELSE '' END"


_NAMED_SQL = f"named AS (SELECT c_custkey, {_CONTIGS} AS contig FROM customer), chroms AS (SELECT *, {_chrom_sql('trim(contig)')} AS chrom FROM named)"


def _named(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CONTIGS).alias("contig"))


@query(f"WITH {_NAMED_SQL} SELECT c_custkey, contig, chrom FROM chroms")
def chrom_normalize(spark, sf_dir):
    return _named(spark, sf_dir).withColumn("chrom", names.normalize_chrom(F.col("contig")))


_PIECE = "regexp_full_match(contig, '(?i)chr([0-9]{1,2}|[XYM]|MT)_[^ ]*_(random|alt|fix)')"


@query(f"WITH {_NAMED_SQL} SELECT c_custkey, contig AS ucsc, CASE WHEN contig ILIKE 'chrUn\\_%' ESCAPE '\\' THEN '' WHEN {_PIECE} THEN {_chrom_sql("regexp_extract(contig, '^[^_]*')")} ELSE chrom END AS chrom, NOT contig ILIKE 'chrUn\\_%' ESCAPE '\\' AND NOT {_PIECE} AND chrom <> '' AS placed FROM chroms")
def ucsc_placement(spark, sf_dir):
    c = F.col("ucsc")
    return _named(spark, sf_dir).withColumnRenamed("contig", "ucsc").withColumns({"chrom": names.ucsc_chrom(c), "placed": names.ucsc_placed(c)})


@query(f"WITH {_NAMED_SQL} SELECT c_custkey, contig, chrom FROM chroms WHERE chrom IN ('chr1', 'chr7') OR contig IN ('chr1', 'chr7', 'Customer#000000010') OR chrom = ''")
def contig_filter(spark, sf_dir):
    named = chrom_normalize(spark, sf_dir)
    return named.where(sketch.contig_filter(F.col("chrom"), F.col("contig"), ["chr1", "chr7", "Customer#000000010"], include_unplaced=True))


#: Labels, indexes and details of satellites, crossed over the parts' keys.
_LABELS = ["hor", "dhor", "active_hor", "HSat2_3", "hsat1A", "mon", "gSat", "censat", "GAP", "weird", "rDNA", "ct", "cen", "hsat2", "beta"]
_INDEXES = ["", "_1_1", "_X_6", "_21", ",HSat2", "_1_p"]
_DETAILS = ["", "(S3C1H2-A,B)", "(S1C1H1L)", "(TAR1)", "(x,SST1_3)", "(hsat3)", " (rnd-6) ", "()"]
_pick = lambda xs, n: "CASE " + " ".join(f"WHEN {n} % {len(xs)} = {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
_SATELLITES = f"concat({_pick(_LABELS, 'p_partkey')}, {_pick(_INDEXES, 'CAST(floor(p_partkey / 15) AS INT)')}, {_pick(_DETAILS, 'CAST(floor(p_partkey / 7) AS INT)')})"
_map_sql = lambda table: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
_SHORT = "regexp_replace(trim(lower(t)), '(_([0-9]+|[xym]))+$', '')"


@query(f"""WITH m AS (SELECT {_map_sql(names.CENSAT_SPELLINGS)} AS m), made AS (SELECT p_partkey, {_SATELLITES} AS name FROM part),
cut AS (SELECT *, lower(trim(regexp_replace(name, '[(].*$', ''))) AS head, CASE WHEN name LIKE '%(%' THEN lower(trim(regexp_extract(name, '[(](.*)[)]', 1))) ELSE '' END AS detail FROM made),
heads AS (SELECT p_partkey, i, CASE WHEN map_extract_value(m, trim(t)) IS NOT NULL THEN trim(t) ELSE {_SHORT} END AS key FROM (SELECT p_partkey, unnest(string_split(head, ',')) AS t, generate_subscripts(string_split(head, ','), 1) AS i FROM cut), m WHERE trim(t) NOT IN ('gap', 'n', 'unknown', 'na', '.')),
details AS (SELECT p_partkey, 100 + i AS i, {_SHORT} AS key FROM (SELECT p_partkey, unnest(string_split(detail, ',')) AS t, generate_subscripts(string_split(detail, ','), 1) AS i FROM cut)),
found AS (SELECT p_partkey, arg_min(key, i) AS key, arg_min(map_extract_value(m, key), i) AS kind FROM (SELECT * FROM heads UNION ALL SELECT * FROM details), m WHERE map_extract_value(m, key) IS NOT NULL GROUP BY p_partkey)
SELECT c.p_partkey, name, CASE WHEN key = 'hor' AND detail NOT LIKE '%,%' AND detail LIKE '%l' THEN 'asat_hor_active' WHEN kind = 'censat_other' AND regexp_matches(detail, '(^|, *)(sst1|subtelo|subterminal)') THEN 'subterminal' WHEN kind = 'censat_other' AND regexp_matches(detail, '(^|, *)(tar|gsat)') THEN 'gsat' ELSE coalesce(kind, '') END AS kind FROM cut c LEFT JOIN found USING (p_partkey)""")
def satellite_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_SATELLITES).alias("name")).withColumn("kind", names.censat_class(F.col("name")))


_REPEATS = ["LINE", "SINE?", "Simple repeat", "Low-complexity", "Unknown", "other", "", "DNA/hAT", ".", "undefined", "Sat"]
_KIND, _FAMILY = _pick(_REPEATS, "p_partkey"), _pick([*_REPEATS[1:], "L1", "LTR/ERV"], "CAST(floor(p_partkey / 11) AS INT)")
_repeat_sql = lambda x: f"map_extract_value(m, translate(lower(trim(regexp_replace(split_part(trim({x}), '/', 1), '[?]+$', ''))), '- ', '__'))"


@query(f"WITH m AS (SELECT {_map_sql(names.REPEAT_SPELLINGS)} AS m), made AS (SELECT p_partkey, {_KIND} AS kind, {_FAMILY} AS family FROM part) SELECT p_partkey, kind, family, coalesce({_repeat_sql('kind')}, nullif({_repeat_sql('family')}, 'repeat_unknown'), '') AS class FROM made, m")
def repeat_names(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KIND).alias("kind"), F.expr(_FAMILY).alias("family"))
    return made.withColumn("class", names.repeat_class(F.col("kind"), F.col("family")))


@query("SELECT n_name AS alias, min(n_nationkey) AS first_key FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT upper(r_name), r_regionkey FROM region) GROUP BY 1")
def alias_first(spark, sf_dir):
    """Aliases from several columns, of which the first row wins."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    all_ = nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("first_key")).unionByName(region.select(F.upper("r_name").alias("alias"), F.col("r_regionkey").alias("first_key")))
    return ranking.first_by(all_, ["alias"], [F.col("first_key")])


_URIS = "CASE doc_id % 6 WHEN 0 THEN concat('s3://', source, '/', doc_id, '.fa') WHEN 1 THEN concat('https://', source, '/', lang) WHEN 2 THEN concat('s3://', source) WHEN 3 THEN 'NA' WHEN 4 THEN concat(' s3://', lang, '/a/', doc_id, ' ') ELSE concat('ftp://', source) END"


@query(f"SELECT doc_id, uri, CASE WHEN regexp_full_match(trim(uri), 's3://[^/]+/.+') THEN 'https://' || split_part(trim(uri), '/', 3) || '.s3.amazonaws.com/' || substr(trim(uri), length(split_part(trim(uri), '/', 3)) + 7) WHEN trim(uri) LIKE 'http%://%' THEN trim(uri) ELSE '' END AS url FROM (SELECT doc_id, {_URIS} AS uri FROM documents)")
def s3_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_URIS).alias("uri")).withColumn("url", names.s3_to_https(F.col("uri")))


@query("SELECT p_type AS raw, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, count(*) AS n FROM part GROUP BY 1")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", names.safe_name(F.col("raw")).alias("safe"), "n")
