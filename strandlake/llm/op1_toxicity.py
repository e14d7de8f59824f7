"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary training texts, count as Kneser-Ney
models do below their highest order: a word by the distinct words before it, a
pair of words by the distinct words before the pair - so copies of a text count
once.  Both orders back off to counts shared by the classes: a class's
discounted pairs rest on the pairs of both classes, then on its own words, then
on the words of both, with one common weight, so that what neither class knows
well cancels out.  A word's evidence is the difference of its two
log-probabilities; a text is judged by its length-normalised evidence over the
whole text and over its most toxic passage of ``WINDOW`` words, and by its clearly
toxic words, through a logistic calibration on training rows that the counts leave out.

The classifier is fitted on a bounded sample of whole texts: of each class all
labelled training rows up to about ``ROWS_PER_CLASS``, beyond that the smallest by a
hash of the id.  The discount takes all of
what a pair after one distinct word counts, and of what a word after one counts; so
the fitted model, all that reaches the driver, holds the other pairs, their words and
words after two, and any other word, known or not, has the mass that the word before
it leaves to the backoff in each class.

Words are whole.  Runs of scripts without spaces are taken as overlapping pairs of
characters.

Defined cases: null or empty texts get the score of no evidence; labels of null
doc_id or null class are not used, of repeated labels the largest counts;
repeated rows are scored alike, and so are equal texts; very long texts are scored
whole, by prefix sums; without training rows of both classes each score is the
share of toxic rows (0 if none); a score of exactly the threshold is rejected; an
empty table gives no rows; ``with_score`` replaces a column that has the name of
its own in any case, ``reject`` keeps all columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, all_of, crc_bucket, free_name, mapped, read, words_of

ROWS_PER_CLASS = 6000
WINDOW = 16
CLEAR = 1.0
DISCOUNT = 1.5
FEATURES = ("whole", "passage", "clear", "top")
#: Of every four sampled rows, one calibrates and three are counted.
HELD_FOR_CALIBRATION = 4


#: Fixed: ASCII punctuation, stripped from words.
_PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_PARTS = re.compile(f"[{_UNSPACED}]+|[^{_UNSPACED}]+")


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, without punctuation around them; pairs of characters where a script has no spaces."""
    words = [x for w in words_of(text) if (x := w.strip(_PUNCTUATION))]
    if not words or text.isascii() or not _HAS_UNSPACED.search(text):
        return words
    out = []
    for word in words:
        for part in _PARTS.findall(word.decode("utf-8", "surrogatepass")):
            if _HAS_UNSPACED.match(part):
                out += [part[i : i + 2].encode() for i in range(max(1, len(part) - 1))]
            elif x := part.encode("utf-8", "surrogatepass").strip(_PUNCTUATION):
                out.append(x)
    return out


def _count(batches):
    """The distinct runs of three words of each class; nothing stands before the first."""
    import pyarrow as pa

    def table(seen):
        rows = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int32()), *(pa.array([k[i] for k in rows], pa.binary()) for i in (1, 2, 3))], names=["toxic", "u", "h", "w"])

    seen: set = set()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = tokens_of(text)
            seen.update((toxic, u, h, w) for u, h, w in zip([b"", b"", *words], [b"", *words], words))
            if len(seen) > 200_000:
                yield table(seen)
                seen = set()
    yield table(seen)


class Model:
    """Kneser-Ney evidence as arrays over a vocabulary; pickled to the workers."""

    def __init__(self, words, lower, weight, keys, gain):
        #: words; per class the lower level and the weight of backing off to it; sorted pair keys and per class the pairs' own part
        self.words, self.lower, self.weight, self.keys, self.gain = words, lower, weight, keys, gain
        self.coefficients = [0.0] * (len(FEATURES) + 1)
        self._places = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def evidence(self, words: list[bytes]):
        """log p(word | before, toxic) - log p(word | before, ordinary) for each word.

        Of other words than the vocabulary's the lowest level is the same for both classes and cancels out.
        """
        import numpy as np

        if self._places is None:
            self._places = {w: i for i, w in enumerate(self.words)}
        get = self._places.get
        at = np.array([get(w, -1) for w in words], dtype=np.int64)
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        if not len(self.words):
            return np.zeros(len(at))
        known, after = at >= 0, before >= 0
        p = np.where(after, self.weight[:, before], 1.0) * np.where(known, self.lower[:, at], 1.0)
        if len(self.keys):
            key = before * len(self.words) + at
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = known & after & (self.keys[place] == key)
            p += np.where(hit, self.gain[:, place], 0.0)
        p = np.log(p)
        return p[1] - p[0]

    def features(self, words: list[bytes]) -> tuple[float, float, float, float]:
        """Evidence a word: of the whole text, of its most toxic passage, above ``CLEAR`` over the root of its length, and of its most toxic word."""
        import numpy as np

        e = self.evidence(words)
        if not len(e):
            return 0.0, 0.0, 0.0, 0.0
        sums = np.concatenate([[0.0], np.cumsum(e)])
        width = min(WINDOW, len(e))
        return float(e.mean()), float((sums[width:] - sums[:-width]).max() / WINDOW), float(np.maximum(e - CLEAR, 0).sum() / len(e) ** 0.5), float(e.max())

    def score(self, words: list[bytes]) -> float:
        import math

        z = self.coefficients[0] + sum(a * x for a, x in zip(self.coefficients[1:], self.features(words)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _fit_logistic(x, y, rounds: int = 60, ridge: float = 0.05):
    """Newton steps on a ridge-penalised logistic loss."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        penalty = ridge * np.array([0.0] + [1.0] * (x.shape[1] - 1))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def _sample(documents: DataFrame, labels: DataFrame, shared: Shared, rows_per_class: int) -> tuple[DataFrame, dict]:
    """text, toxic, calibrates: the sampled rows; and the number of all training labels of each class."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(crc_bucket("doc_id", 5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, rows_per_class / n))) for k, n in sizes.items()], F.lit(0.0)) if sizes else F.lit(0.0)
    draw = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
    chosen = shared.write(usable.where(draw < share).select(F.col("doc_id").alias("labelled"), "toxic"), "labels")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(chosen, F.col("doc_id") == F.col("labelled"))
    held = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(HELD_FOR_CALIBRATION)) == 0
    return shared.write(joined.select("text", "toxic", held.alias("calibrates")), "sample"), sizes


def train(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on ``labels`` (doc_id, toxic) whose id is not held out, joined to ``documents`` (doc_id, text)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = Shared(documents.sparkSession, "toxicity")
    sample, sizes = _sample(documents, labels, shared, rows_per_class)
    counted = sample.where("not calibrates").select("text", "toxic").mapInArrow(_count, "toxic int, u binary, h binary, w binary")
    pairs = shared.write(counted.distinct().groupBy("toxic", "h", "w").agg(F.count(F.lit(1)).alias("n")), "pairs")
    side = lambda t, e: F.sum(F.when(F.col("toxic") == t, e).otherwise(F.lit(0)))
    ends = pairs.groupBy("w").agg(*[side(t, F.lit(1)).alias(f"ends{t}") for t in (0, 1)], F.countDistinct("h").alias("shared"))
    both = pairs.groupBy("h", "w").agg(side(0, F.col("n")).alias("n0"), side(1, F.col("n")).alias("n1"))
    starts = both.groupBy("h").agg(F.sum("n0").alias("after0"), F.sum("n1").alias("after1"))
    totals = ends.agg(F.sum("ends0"), F.sum("ends1"), F.sum("shared"), F.sum(F.when(F.col("ends0") > 0, 1).otherwise(0) + F.when(F.col("ends1") > 0, 1).otherwise(0)), *[F.sum(F.least(F.col(f"ends{t}").cast("double"), F.lit(DISCOUNT))) for t in (0, 1)]).first()
    # what the discount leaves: a pair after one word of both classes together has no part of its own
    frequent = shared.write(both.where(F.col("n0") + F.col("n1") > DISCOUNT), "frequent")
    paired = frequent.select("h").union(frequent.select("w")).distinct().select(F.col("h").alias("paired"))
    kept = ends.join(paired, F.col("w") == F.col("paired"), "left").where("shared > 1 or paired is not null")
    table = kept.join(starts, F.col("w") == F.col("h"), "left").select("w", "ends0", "ends1", "shared", *[F.coalesce(f"after{t}", F.lit(0)).cast("double").alias(f"after{t}") for t in (0, 1)]).orderBy("w").toArrow()
    words = table["w"].to_pylist()
    if not words or not totals[0] or not totals[1]:
        model = Model([], np.zeros((2, 0)), np.zeros((2, 0)), np.zeros(0, dtype=np.int64), np.zeros((2, 0)))
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        model.coefficients = [float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), *[0.0] * len(FEATURES)]
        return model
    size = len(words)
    found = np.stack([table[f"ends{t}"].to_numpy().astype(float) for t in (0, 1)])
    # the lowest level counts the classes that have a word; its weight is the mass discounted above, the same for both
    base = (found > 0).sum(axis=0) / totals[3]
    common = sum(totals[4 + t] / totals[t] for t in (0, 1)) / 2
    lower = np.stack([np.maximum(found[t] - DISCOUNT, 0) / totals[t] for t in (0, 1)]) + common * base
    pairs_of = frequent.toArrow()
    known = table["w"].combine_chunks()
    h, w = (pc.fill_null(pc.index_in(pairs_of[c], value_set=known), -1).to_numpy().astype(np.int64) for c in ("h", "w"))
    ok = (h >= 0) & (w >= 0)
    h, w = h[ok], w[ok]
    counts = np.stack([pairs_of[f"n{t}"].to_numpy().astype(float)[ok] for t in (0, 1)])
    after = np.stack([table[f"after{t}"].to_numpy() for t in (0, 1)])
    # shares of a pair after its first word: of each class, and of both together
    own = np.maximum(counts - DISCOUNT, 0) / np.maximum(after[:, h], 1)
    pooled = (counts.sum(axis=0) - DISCOUNT) / after.sum(axis=0)[h]
    rest = np.stack([1 - np.bincount(h, own[t], size) for t in (0, 1)])
    shared_rest = 1 - np.bincount(h, pooled, size)
    key = h * size + w
    order = np.argsort(key)
    model = Model(words, lower, rest * shared_rest, key[order], (own + rest[:, h] * pooled)[:, order])
    del table, pairs_of, known, own, pooled
    pa.default_memory_pool().release_unused()
    broadcast = documents.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            found = [broadcast.value.features(tokens_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))] + [batch.column("toxic")], names=[*FEATURES, "toxic"])

    measured = sample.where("calibrates").select("text", "toxic").mapInArrow(measure, ", ".join([*(f"{f} double" for f in FEATURES), "toxic int"])).toPandas()
    if measured["toxic"].nunique() == 2:
        y = measured["toxic"].to_numpy(dtype=float)
        model.coefficients = _fit_logistic(measured[list(FEATURES)].to_numpy(), y)
        # the sample may have another share of toxic rows than the labels
        model.coefficients[0] += float(np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum())))
    else:
        model.coefficients = [-2.0, 2.0, 4.0, 1.0, 0.0]
    return model


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and a column of scores, in place of any that has its name."""
    docs = docs.select(*all_of(docs, but=column))
    at = docs.columns.index("text")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [broadcast.value.score(tokens_of(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return mapped(docs, run, (column, "double"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or higher."""
    column = free_name(docs, "toxicity")
    return with_score(docs, model, column).where(F.col(column) < threshold).select(*all_of(docs))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = train(documents, read(spark, sf_dir, "labels"))
    scored = with_score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
