"""Streams of positioned hashes: repeat lags, paired tokens, matches and offsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import GAMMA, PAIR_2, finish64, signed


def pair_correlation(stream: DataFrame, keys: list[str], least: int, most: int, window: int | None = None) -> DataFrame:
    """lag, n: pairs of the same hash at a distance of ``least`` to ``most``.

    Positions meet within tiles as wide as the longest lag and the next tile, so a
    frequent hash joins only what lies near.
    """
    tile = F.floor(F.col("pos") / most)
    left = stream.select(*keys, "hash", F.col("pos").alias("p"), tile.alias("tile"))
    right = stream.select(*keys, "hash", F.col("pos").alias("q"), F.explode(F.array(tile, tile - 1)).alias("tile"))
    lag = F.col("q") - F.col("p")
    return left.join(right, [*keys, "hash", "tile"]).where(lag.between(least, most)).groupBy(lag.alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def smooth(histogram: DataFrame, least: int, most: int, width: int = 5) -> DataFrame:
    """lag, n, smoothed: a boxcar over all lags of the range, absent ones as 0 (bounded by the range)."""
    axis = histogram.sparkSession.range(least, most + 1).select(F.col("id").alias("lag"))
    full = axis.join(histogram, "lag", "left").select("lag", F.coalesce("n", F.lit(0)).alias("n"))
    half = width // 2
    return full.withColumn("smoothed", F.sum("n").over(Window.orderBy("lag").rowsBetween(-half, half)) / float(width))


def top_peaks(smoothed: list[tuple[int, float]], count: int = 8, apart: int = 150) -> list[int]:
    """Lags of the highest values, each more than ``apart`` from those before (on the bounded histogram)."""
    chosen: list[int] = []
    for lag, _ in sorted(smoothed, key=lambda r: (-r[1], r[0])):
        if len(chosen) == count:
            break
        if all(abs(lag - c) > apart for c in chosen):
            chosen.append(lag)
    return chosen


def fundamental(peaks: list[int], least: int = 60, slack: float = 0.06) -> int | None:
    """The smallest lag of which enough peaks are near-integer multiples."""
    for lag in sorted(p for p in peaks if p >= least):
        hits = sum(round(p / lag) >= 1 and abs(p / lag - round(p / lag)) <= slack for p in peaks)
        if hits >= max(2, len(peaks) / 2):
            return lag
    return None


def pair_tokens(stream: DataFrame, keys: list[str], fanout: int = 3, gap: str = "rank", max_gap: int | None = None) -> DataFrame:
    """keys, pos, token: each hash with the ``fanout`` after it; ``gap`` enters as rank, log-bucketed bases, or not.

    Analyse within ``hashing.wrapping``: the products wrap around.
    """
    order = Window.partitionBy(*keys).orderBy("pos", "hash")
    word = lambda x: F.lit(signed(x)).cast("long")
    parts = []
    for d in range(1, fanout + 1):
        nxt, at = F.lead("hash", d).over(order), F.lead("pos", d).over(order)
        distance = at - F.col("pos")
        q = F.lit(d).cast("long") if gap == "rank" else F.floor(F.log(F.greatest(distance, F.lit(1)).cast("double")) / math.log(1.25)).cast("long") if gap == "base" else F.lit(0).cast("long")
        token = finish64(F.col("hash") * word(GAMMA)).bitwiseXOR(finish64(nxt * word(PAIR_2))).bitwiseXOR(finish64(q + F.lit(0x9E37).cast("long")))
        near = nxt.isNotNull() if max_gap is None else nxt.isNotNull() & (distance <= max_gap)
        parts.append(F.when(near, F.struct(F.lit(d).alias("step"), token.alias("token"))))
    made = stream.select(*keys, "pos", "hash", F.array(*parts).alias("made"))
    return made.select(*keys, "pos", F.explode(F.filter("made", lambda x: x.isNotNull())).alias("t")).select(*keys, "pos", "t.step", "t.token")


def specificity(tokens: DataFrame, token: str = "token") -> DataFrame:
    """distinct, frac_unique, median, p99, most: multiplicities of tokens."""
    m = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("distinct_tokens"), F.avg((F.col("m") == 1).cast("double")).alias("frac_unique"), F.median("m").alias("median"), F.percentile("m", 0.99).alias("p99"), F.max("m").alias("most"))


def match(left: DataFrame, right: DataFrame, most: int = 4, token: str = "token") -> DataFrame:
    """a_pos, b_pos: equal tokens of two streams, tokens more frequent than ``most`` in either left out."""
    rare = lambda s: s.groupBy(token).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= most).select(token)
    kept = rare(left).join(rare(right), token)
    a, b = left.join(kept, token).select(token, F.col("pos").alias("a_pos")), right.join(kept, token).select(token, F.col("pos").alias("b_pos"))
    return a.join(b, token).select("a_pos", "b_pos")


def collinear(matches: DataFrame, window: int = 100_000, bucket: int = 10_000, votes: int = 10) -> DataFrame:
    """a_pos, b_pos, collinear: within each window the fullest offset bucket is the peak (the lowest of equally full
    ones); buckets begin at the window's smallest offset.  Offsets within one bucket of the peak's left edge are
    collinear, if the window has enough matches."""
    marked = matches.withColumn("w", F.floor(F.col("a_pos") / window)).withColumn("offset", F.col("b_pos") - F.col("a_pos"))
    anchors = marked.groupBy("w").agg(F.min("offset").alias("least"), F.count(F.lit(1)).alias("total"))
    anchored = marked.join(anchors, "w").withColumn("o", F.floor((F.col("offset") - F.col("least")) / bucket))
    counts = anchored.groupBy("w", "o").agg(F.count(F.lit(1)).alias("n"))
    peaks = counts.groupBy("w").agg((-F.max(F.struct("n", (-F.col("o")).alias("order")))["order"]).alias("peak"))
    distance = F.abs(F.col("offset") - F.col("least") - F.col("peak") * bucket)
    return anchored.join(peaks, "w").select("a_pos", "b_pos", ((F.col("total") >= votes) & (distance <= bucket)).alias("collinear"))
