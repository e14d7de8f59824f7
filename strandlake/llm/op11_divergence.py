"""Source divergence audit over wide term vectors.

Per language and term the counts of all sources are pivoted into an array indexed
by source.  Higher-order functions turn such an array into contributions of pairs
of sources, which are summed up before the shuffle.  A term that a source lacks has
the same smoothed share as every other term it lacks, so for each pair the sum over
all kept terms is (number of terms) x (value of two absent shares) plus, for each term
that one of the two has, the difference to that value: terms cost by the sources that
have them, and no zero is ever written.

Only the cut of texts into terms runs in Python, which sums up counts by batches.
Shares are exact: products are decimals of 38 digits, divided as integers.

Defined cases: null text, lang and source are read as ''; texts without terms still
make their (lang, source) group occur; a language without kept terms has pair rows of
value 0 and no term rows; a language of one source has no pair rows; repeated rows
count each; ties go to the smaller item in UTF-8 order; very long texts are cut in
pieces between terms; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, read

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

#: Fixed: over UTF-8 bytes with A-Z lower-cased, what the pattern of terms matches.
TERM = re.compile(rb"[a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^a-z\x80-\xff]")
PIECE = 1 << 20
#: Distinct (lang, source, term) that a task holds before it hands them on.
HELD = 400_000


def terms_of(text: bytes):
    """Lists of terms of one text, a piece at a time."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield TERM.findall(text, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed up within tasks: a key may occur again."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        held: dict = {}

        def table():
            rows = [(*g, t, n, d[t]) for g, (c, d) in held.items() for t, n in c.items()]
            held.clear()
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "d"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set = set()
                for part in terms_of(text):
                    n.update(part)
                    seen.update(part)
                d.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield table()
        yield table()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counted = kept.mapInArrow(run, "lang string, source string, term binary, n long, d long")
    return counted.withColumn("term", F.col("term").cast("string"))


def _share(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly: in longs while the product fits, else in decimals."""
    wide = f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))"
    return f"(1 + CASE WHEN {count} < {(1 << 62) // SCALE} THEN ({SCALE}L * ({count} + 2L)) div ({total} + 2L * {terms}) ELSE {wide} END)"


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank for every (lang, source) group of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    shared = Shared(spark, "divergence")
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    terms = shared.write(terms.where(F.col("d") >= min_docs).drop("d"), "terms")

    # one row a language: its sources in order, their totals and the shares of terms they lack
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    held = terms.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = groups.unionByName(held).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    layout = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    layout = layout.join(sizes, "lang", "left").select("lang", F.col("sources.source").alias("sources"), F.col("sources.n").alias("totals"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    absent = F.expr(f"CASE WHEN terms > 0 THEN transform(totals, n -> {_share('0L', 'n', 'terms')}) END")
    layout = shared.write(layout.withColumn("absent", absent), "layout")

    wide = terms.join(layout, "lang").withColumn("vector", F.expr("transform(sources, s -> coalesce(try_element_at(by_source, s), 0))"))
    shares = F.expr(f"transform(vector, (c, i) -> CASE WHEN c = 0 THEN absent[i] ELSE {_share('c', 'totals[i]', 'terms')} END)")
    wide = wide.select("lang", "term", "sources", "absent", "vector", shares.alias("shares"), F.expr(_share("total", "lang_n", "terms")).alias("lang_share"))
    here = "filter(sequence(0, size(vector) - 1), i -> vector[i] > 0)"
    others = "filter(sequence(0, size(vector) - 1), j -> j != i AND (vector[j] = 0 OR j > i))"
    change = f"{_distance('shares[i]', 'shares[j]')} - {_distance('absent[i]', 'absent[j]')}"
    pairs = wide.select("lang", F.explode(F.expr(f"flatten(transform({here}, i -> transform({others}, j -> struct(least(i, j) AS i, greatest(i, j) AS j, {change} AS change))))")).alias("x"))
    summed = pairs.groupBy("lang", F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg(F.sum("x.change").alias("change"))
    plain = layout.select("lang", "sources", "absent", "terms", F.explode(F.expr("sequence(0, size(sources) - 1)")).alias("i")).where("i + 1 < size(sources)")
    plain = plain.select("*", F.explode(F.expr("sequence(i + 1, size(sources) - 1)")).alias("j"))
    base = F.expr(f"CASE WHEN terms > 0 THEN terms * {_distance('absent[i]', 'absent[j]')} ELSE 0 END")
    plain = plain.select("lang", "i", "j", F.expr("sources[i]").alias("left"), F.expr("sources[j]").alias("right"), base.alias("base"))
    plain = shared.write(plain.join(summed, ["lang", "i", "j"], "left").select("lang", "left", "right", (F.col("base") + F.coalesce("change", F.lit(0))).alias("value")), "pairs")
    pair = plain.select("lang", F.col("left").alias("source"), F.lit("pair").alias("part"), F.col("right").alias("item"), "value")
    pair = pair.unionByName(plain.select("lang", F.col("right").alias("source"), F.lit("pair").alias("part"), F.col("left").alias("item"), "value"))

    said = F.expr(f"transform(filter({here}, i -> shares[i] > lang_share), i -> struct(sources[i] AS source, {_distance('shares[i]', 'lang_share')} AS value))")
    term = wide.select("lang", "term", F.explode(said).alias("x")).select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top)).withColumn("value", F.col("value").cast("long"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
      1 + (1000000000::HUGEINT * (kept.total + 2)) // (l.total + 2 * l.v) AS q
      FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
           UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
