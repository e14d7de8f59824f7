"""64-bit mixing, base codes and unsigned order, as Column expressions that stay in generated code."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SplitMix64's increment and multipliers, and the second multiplier of paired tokens.
GAMMA, MIX_1, MIX_2, PAIR_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F
MAX_U64 = (1 << 64) - 1
MIN_LONG = -(1 << 63)


def signed(x: int) -> int:
    """The long that holds an unsigned 64-bit value."""
    x &= MAX_U64
    return x - (1 << 64) if x >> 63 else x


def unsigned_key(c: Column) -> Column:
    """Orders longs as unsigned 64-bit values."""
    return c.bitwiseXOR(F.lit(MIN_LONG))


@contextmanager
def wrapping(spark: SparkSession):
    """Arithmetic analysed within wraps around at 64 bits; the session's setting returns afterwards."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _word(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def finish64(z: Column) -> Column:
    """SplitMix64's output function (without the increment)."""
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * _word(MIX_1)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * _word(MIX_2)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def mix64(x: Column) -> Column:
    """SplitMix64 of a long; analyse it within ``wrapping``."""
    return finish64(x + _word(GAMMA))


def mix64_int(x: int) -> int:
    z = (x + GAMMA) & MAX_U64
    z = ((z ^ z >> 30) * MIX_1) & MAX_U64
    z = ((z ^ z >> 27) * MIX_2) & MAX_U64
    return z ^ z >> 31


def hash_ceiling(scaled: int) -> int:
    """The largest hash that a 1-in-``scaled`` sample keeps (inclusive)."""
    if scaled < 1:
        raise ValueError("scaled must be 1 or more")
    return MAX_U64 // scaled


def subsample_ceiling(wanted: int, found: int) -> int:
    """The largest mixed hash kept so that about ``wanted`` of ``found`` stay; -1 keeps none."""
    if wanted <= 0 or found <= wanted:
        return MAX_U64
    return max(-1, min(MAX_U64, (wanted << 64) // found - 1))


def at_most_unsigned(c: Column, ceiling: int) -> Column:
    if ceiling < 0:
        return F.lit(False)
    return unsigned_key(c) <= F.lit(signed(ceiling) ^ MIN_LONG).cast("long")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, first base highest; null unless all of A, C, G, T (U as T)."""
    clean = F.upper(kmer)
    code = F.conv(F.translate(clean, "ACGTU", "01233"), 4, 10).cast("long")
    return F.when(clean.rlike("^[ACGTU]+$"), code)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(F.upper(kmer), "ACGTU", "TGCAA"))


def canonical_code(kmer: Column) -> Column:
    """The smaller of the codes of a k-mer and of its reverse complement."""
    return F.least(kmer_code(kmer), kmer_code(reverse_complement(kmer)))


def code_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
