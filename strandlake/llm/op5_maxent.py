"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

log p(word | before) = log p(class | before) + log p(slot | class, before) + log p(word | slot).
Both softmax factors are maximum-entropy models over hashed features of the three words
before (n-grams of one and two words, and skips over one and two words); those of the
slot, of one word and the skip over one, are features of the class too.  Classes are ``CLASSES`` clusters of word endings
that stand among similar neighbours.  Within a class the most frequent words have a
slot each, all others share ``SHARED_SLOTS`` slots by their ending: in the same factor,
words of a slot have weights in common and differ by their counts alone.  Every shared
slot holds one unknown word, so the probabilities of all known and unknown words sum to one.

1. Counting, over all training texts: words, and endings by their neighbours.
   Counts are summed per task before the shuffle.
2. Fitting, over all training texts once: in each of ``ROUNDS`` rounds a part of
   the texts; each task takes gradient steps (with per-row step sizes) on every
   position and returns the change of each feature's weights; the
   changes are averaged by a grouped sum over features, never in one place.
   The table of weights has at least a row for every fourth distinct training word,
   as a power of two from ``LEAST_FEATURES`` to ``MOST_FEATURES`` (a bound on
   workers' memory: beyond it features share rows).
3. Scoring, in sparse numpy batches.  The ``HEAD`` most frequent words come from a
   broadcast table of that bound; counts of all other tokens come by a join of
   their hashes with the whole count table, so no vocabulary has to fit a task.

Texts are cut into words in Arrow; Python sees each distinct word of a slice once.

Defined cases: null text counts as empty (its end alone); a null doc_id is in
training as crc32 of the empty text says; repeated rows count each time and are
scored alike; words of equal count are ordered by their bytes; very long texts are
scored whole; without any training text every token has base probability 1; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, crc_bucket, crc_of_text, read

HEAD = 200_000
CLASSES = SLOTS = 16
#: Slots of a class that hold many words, by ending; the others hold one word each.
SHARED_SLOTS = 4
ENDINGS, NEIGHBOURS = 4096, 64
LEAST_FEATURES, MOST_FEATURES = 1 << 14, 1 << 17
ROUNDS, BATCH = 2, 8192
#: Splits of the input that one fitting task takes.
SPLITS = 4
#: Step size, and what keeps the steps of features that were seen a few times small.
RATE, DAMPING = 0.35, 1e-2
SEED = 42
#: Stands for a text's end; no word is empty.
END = b""
#: Log mass of a slot without words.
NO_WORDS = -1e4


def text_slices(column, limit: int = 4_000_000):
    """Slices of an Arrow column of texts with about ``limit`` bytes each, as (start, length)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        stop = min(len(sizes), int(np.searchsorted(sizes, before + limit)) + 1)
        yield start, stop - start
        start = stop


def tokenized(column):
    """Distinct words (with END; an Arrow column), each token's place among them, and the number of tokens of each text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    offsets = lists.offsets.to_numpy()
    numbered = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words = numbered.dictionary.cast(pa.binary())
    which = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(lists)), np.diff(offsets))
    end = pc.index(words, pa.scalar(END, pa.binary())).as_py()
    if end >= 0:  # cuts at the ends of a text leave empty words
        real = which != end
        which, text = which[real], text[real]
    else:
        end = len(words)
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
    sizes = np.bincount(text, minlength=len(lists)) + 1
    tokens = np.full(len(which) + len(lists), end, dtype=np.int64)
    tokens[np.arange(len(which)) + text] = which
    return words, tokens, sizes


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _summed(df: DataFrame, width: int) -> DataFrame:
    """row, v0.. -> sums by row."""
    return df.groupBy("row").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])


# --- counting ---------------------------------------------------------------

def _count(batches):
    """(word, n) of this task; and (row, v: NEIGHBOURS floats) for endings by hashed neighbours."""
    import numpy as np
    import pyarrow as pa

    def words(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.list_(pa.float32()))], names=["word", "n", "row", "v"])

    counts: Counter = Counter()
    beside = np.zeros((ENDINGS, NEIGHBOURS))
    for batch in batches:
        column = batch.column("text")
        for start, n in text_slices(column):
            found, which, _ = tokenized(column.slice(start, n))
            found = found.to_pylist()
            counts.update(dict(zip(found, np.bincount(which, minlength=len(found)).tolist())))
            own = np.array([_ending(w) for w in found], dtype=np.int64)[which]
            if len(own) > 1:
                pairs = np.concatenate([own[1:] * NEIGHBOURS + own[:-1] % NEIGHBOURS, own[:-1] * NEIGHBOURS + own[1:] % NEIGHBOURS])
                beside += np.bincount(pairs, minlength=ENDINGS * NEIGHBOURS).reshape(ENDINGS, NEIGHBOURS)
            if len(counts) > 400_000:
                yield words(counts)
                counts = Counter()
    yield words(counts)
    rows = np.flatnonzero(beside.sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64()), pa.array(rows.astype(np.int32)), pa.array(list(beside[rows].astype(np.float32)), pa.list_(pa.float32()))], names=["word", "n", "row", "v"])


def cluster_endings(beside, clusters: int = CLASSES, rounds: int = 15, seed: int = 5):
    """Cluster of each ending: spherical k-means over its neighbours' shares, weighted by the root of its count."""
    import numpy as np

    totals = beside.sum(axis=1)
    share = beside.sum(axis=0) / max(1.0, beside.sum())
    unit = np.sqrt(beside / np.maximum(totals, 1)[:, None]) - np.sqrt(share)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    weight = np.sqrt(totals)
    chooser = np.random.default_rng(seed)
    centres = unit[np.argsort(-totals)[:1]]
    while len(centres) < clusters:  # far from those chosen
        gap = np.maximum(1 - (unit @ centres.T).max(axis=1), 0) * weight
        centres = np.vstack([centres, unit[chooser.choice(len(unit), p=gap / gap.sum()) if gap.sum() > 0 else len(centres) % len(unit)]])
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        for k in range(clusters):
            if (own == k).any():
                centres[k] = (unit[own == k] * weight[own == k, None]).sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return (unit @ centres.T).argmax(axis=1)


class Vocabulary:
    """What tasks need of the counts: the head words and the endings' clusters; bounded by HEAD and ENDINGS.

    ``sizes`` are the masses of the slots (class * SLOTS + slot): the sum of count + 1 over its words.
    """

    def __init__(self, words: list[bytes], counts, clusters, total: int, distinct: int, masses):
        """``words`` by falling count; ``masses``: the sum of count + 1 over the words of each ending."""
        import numpy as np

        self.words, self.counts, self.clusters, self.total, self.distinct = words, counts, np.asarray(clusters), total, distinct
        ending = np.arange(ENDINGS)
        self.shared = self.clusters * SLOTS + SLOTS - SHARED_SLOTS + ending % SHARED_SLOTS
        self.sizes = np.zeros(CLASSES * SLOTS)
        self.sizes.reshape(CLASSES, SLOTS)[:, SLOTS - SHARED_SLOTS :] = 1.0
        np.add.at(self.sizes, self.shared, masses)
        self.own, taken = {}, [0] * CLASSES
        for w, n in zip(words[: 64 * CLASSES], np.asarray(counts[: 64 * CLASSES]).tolist()):
            kind = int(self.clusters[_ending(w)])
            if taken[kind] < SLOTS - SHARED_SLOTS:
                self.own[w] = kind * SLOTS + taken[kind]
                taken[kind] += 1
                self.sizes[self.own[w]] = n + 1
                self.sizes[self.shared[_ending(w)]] -= n + 1
        self._places = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def log_masses(self):
        import numpy as np

        return np.where(self.sizes > 0, np.log(np.maximum(self.sizes, 0.5)), NO_WORDS)

    def places(self, words):
        """Of each word (an Arrow column): its place among the head words or -1, its slot, its feature identity."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self._places is None:
            self._places = pa.array(self.words, pa.binary())
            self._slot = np.array([self.own.get(w, self.shared[_ending(w)]) for w in self.words], dtype=np.int64)
        at = pc.fill_null(pc.index_in(words, value_set=self._places), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        slots, identity = np.zeros(len(at), dtype=np.int64), at.copy()
        head = at >= 0
        slots[head] = self._slot[at[head]]
        rest = np.flatnonzero(~head)
        if len(rest):
            ending = np.array([_ending(w) for w in words.take(pa.array(rest)).to_pylist()], dtype=np.int64)
            slots[rest], identity[rest] = self.shared[ending], len(self.words) + ending
        return at, slots, identity


def features(identity, starts, kinds, size: int):
    """Rows of the weight table (features x tokens): for the class factor a bias, one word, two words and skips over one and
    two words; for the slot factor within the classes ``kinds`` a bias, one word and the skip over one.

    ``starts`` marks the first token of each text; words before a text are one special word.
    Row 0 is the class factor's bias, the next ``CLASSES`` those of the slot factors.
    """
    import numpy as np

    place = np.arange(len(identity)) - np.maximum.accumulate(np.where(starts, np.arange(len(identity)), 0))
    words = (identity + 1).astype(np.uint64)

    def before(k):
        shifted = np.zeros(len(words), dtype=np.uint64)
        shifted[k:] = words[: max(0, len(words) - k)]
        shifted[place < k] = 0
        return shifted

    def fold(h):
        return ((h >> np.uint64(40)) * np.uint64(size - 1 - CLASSES) >> np.uint64(24)).astype(np.int64) + (1 + CLASSES)

    one, two, three = before(1), before(2), before(3)
    values = (one, (one << np.uint64(20)) + two, two, three)
    hashed = [(x * np.uint64(5) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) for k, x in enumerate(values, 1)]
    class_hash = (kinds + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    within = [((h ^ h >> np.uint64(29)) + class_hash) * np.uint64(0x94D049BB133111EB) for h in (hashed[0], hashed[2])]
    return np.stack([np.zeros(len(kinds), dtype=np.int64), *map(fold, hashed)]), np.stack([1 + kinds, *map(fold, within)])


class Room:
    """Arrays of a batch's size that are used again for each batch; fresh memory for each costs more than the arithmetic."""

    def __init__(self):
        self.arrays: dict = {}

    def __call__(self, name: str, shape: tuple, kind):
        import numpy as np

        if name not in self.arrays or self.arrays[name].shape != shape:
            self.arrays[name] = np.empty(shape, dtype=kind)
        return self.arrays[name]


def _odds(weights, rows, room: Room):
    """exp of the sums of the rows' weights; the sums are far below the bound, which only keeps them finite."""
    import numpy as np

    shape = (rows.shape[1], weights.shape[1])
    z = weights.take(rows[0], axis=0, out=room("odds", shape, weights.dtype), mode="clip")
    for row in rows[1:]:
        z += weights.take(row, axis=0, out=room("more", shape, weights.dtype), mode="clip")
    np.minimum(z, 80, out=z)
    return np.exp(z, out=z)


def probabilities(weights, rows, room: Room):
    """Softmax of the sums of the rows' weights (tokens x classes or slots)."""
    import numpy as np

    p = _odds(weights, rows, room)
    p /= np.einsum("ij->i", p)[:, None]
    return p


def _sums_by_feature(push, rows, room: Room):
    """The features of a batch (features x tokens), and for each the sum of its tokens' rows of ``push``."""
    import numpy as np

    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16) if flat.max() < 1 << 16 else flat, kind="stable")  # 16 bits are sorted by radix
    ordered = flat[order]
    order %= len(push)
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(begin, append=len(ordered))
    total = push.take(order[begin], axis=0, out=room("total", (len(flat), push.shape[1]), push.dtype)[: len(begin)], mode="clip")
    many = np.flatnonzero(size > 1)
    if len(many):  # sums along memory, of the features that occur twice or more
        turned = room("turned", push.shape[::-1], push.dtype)
        turned[...] = push.T
        kept = order[np.repeat(size > 1, size)]
        spread = room("spread", (rows.size * push.shape[1],), push.dtype)[: len(kept) * push.shape[1]].reshape(-1, len(kept))
        turned.take(kept, axis=1, out=spread, mode="clip")
        total[many] = np.add.reduceat(spread, np.cumsum(size[many]) - size[many], axis=1).T
    return ordered[begin], total


def gradient_step(weights, squares, rows, kinds, room: Room) -> None:
    """One step on a batch, in place; each feature's step size falls with its gradients so far."""
    import numpy as np

    push = probabilities(weights, rows, room)
    push[np.arange(len(kinds)), kinds] -= 1.0
    which, total = _sums_by_feature(push, rows, room)
    total /= len(kinds) ** 0.5
    so_far = squares[which] + np.einsum("ij,ij->i", total, total) / total.shape[1]
    squares[which] = so_far
    total *= (RATE / np.sqrt(so_far + DAMPING)).astype(weights.dtype)[:, None]
    stepped = weights.take(which, axis=0, out=room("stepped", (rows.size, weights.shape[1]), weights.dtype)[: len(which)], mode="clip")
    stepped -= total
    weights[which] = stepped


def examples(words, which, sizes, vocabulary, size: int):
    """Of each token: its place among the head words, slot (class * SLOTS + slot), and the two factors' rows; and marks of the texts' first tokens."""
    import numpy as np

    at, slots, identity = (x[which] for x in vocabulary.places(words))
    starts = np.zeros(len(which), dtype=bool)
    starts[np.cumsum(sizes) - sizes] = True
    return at, slots, *features(identity, starts, slots // SLOTS, size)


def _fit(vocabulary, weights):
    """One task's change of the weights, for the features it met, and its number of positions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        start = weights.value
        own, squares, seen, room = start.copy(), np.zeros(len(start)), 0, Room()
        for batch in batches:
            column = batch.column("text")
            for first, n in text_slices(column):
                _, slots, by_class, by_slot = examples(*tokenized(column.slice(first, n)), vocabulary.value, len(start))
                batches_of = -(-len(slots) // BATCH)
                for k in range(batches_of):  # positions at equal distances, so that each batch is of all texts
                    some = slice(k, None, batches_of)
                    gradient_step(own, squares, by_class[:, some].copy(), slots[some] // SLOTS, room)
                    gradient_step(own, squares, by_slot[:, some].copy(), slots[some] % SLOTS, room)
                seen += len(slots)
        met = np.flatnonzero(squares)
        change = ((own[met] - start[met]) * seen).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(np.full(len(met), seen, dtype=np.float32)), *(pa.array(change[:, c]) for c in range(CLASSES))], names=["row", f"v{CLASSES}", *(f"v{c}" for c in range(CLASSES))])

    return run


class Fitted:
    """The whole model: vocabulary, weights, and the count table."""

    def __init__(self, vocabulary, weights, counts: DataFrame | None):
        self.vocabulary, self.weights, self.counts = vocabulary, weights, counts


def _head(counts: DataFrame):
    """The most frequent words, as many whole classes of similar counts as ``HEAD`` holds (word, n; falling n).

    A histogram over sixteenths of powers of two, a few hundred rows, gives the least
    count; so no task sends more than belongs to the head.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        if held + n > HEAD:
            break
        least, held = at, held + n
    chosen = counts.where(level >= least if least is not None else F.lit(False)).select("word", "n").toPandas()
    return chosen.assign(word=[bytes(w) for w in chosen["word"]]).sort_values(["n", "word"], ascending=[False, True])


def train(docs: DataFrame, shared: Shared) -> Fitted:
    """Count and fit on all ``docs`` (doc_id, text) that are not held out."""
    import numpy as np

    spark = docs.sparkSession
    usable = docs.where(crc_bucket("doc_id", 7) != 2).select("doc_id", F.col("text").cast("string").alias("text"))
    counted = shared.write(usable.select("text").mapInArrow(_count, "word binary, n long, row int, v array<float>"), "counted")
    counts = shared.write(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).withColumn("key", F.xxhash64("word")), "counts")
    beside = np.zeros((ENDINGS, NEIGHBOURS))
    for r in _summed(counted.where("row is not null").select("row", *[F.col("v")[i].cast("double").alias(f"v{i}") for i in range(NEIGHBOURS)]), NEIGHBOURS).toPandas().itertuples(index=False):
        beside[r[0]] = r[1:]
    shared.drop("counted")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = _head(counts)
    ending = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int")
    by_ending = counts.groupBy(ending.alias("ending")).agg(F.sum(F.col("n") + 1).alias("mass")).toPandas()
    masses = np.zeros(ENDINGS)
    masses[by_ending["ending"].to_numpy(dtype=np.int64)] = by_ending["mass"].to_numpy(dtype=float)
    vocabulary = Vocabulary([bytes(w) for w in head["word"]], head["n"].to_numpy(dtype=np.int64), cluster_endings(beside), int(total), int(distinct), masses)
    rows = min(MOST_FEATURES, max(LEAST_FEATURES, 1 << (int(distinct) // 4).bit_length()))
    weights = np.zeros((rows, CLASSES), dtype=np.float32)
    slots = vocabulary.log_masses().reshape(CLASSES, SLOTS)
    kinds = np.log(np.exp(slots).sum(axis=1))
    weights[0], weights[1 : CLASSES + 1] = kinds - kinds.max(), np.maximum(slots - slots.max(axis=1, keepdims=True), NO_WORDS)
    known = spark.sparkContext.broadcast(vocabulary)
    for k in range(ROUNDS):
        part = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text")
        # a task returns as many rows as the table has: fewer, longer tasks return less
        part = part.coalesce(max(spark.sparkContext.defaultParallelism, part.rdd.getNumPartitions() // SPLITS))
        start = spark.sparkContext.broadcast(weights)
        fields = ", ".join(["row int", f"v{CLASSES} float", *(f"v{c} float" for c in range(CLASSES))])
        changes = _summed(part.mapInArrow(_fit(known, start), fields), CLASSES + 1)
        changes = changes.select("row", *[F.col(c).cast("float").alias(c) for c in changes.columns if c != "row"]).toArrow()
        if len(changes):  # a column at a time: the driver holds one copy of them
            rows, seen = changes["row"].to_numpy(), np.maximum(changes[f"v{CLASSES}"].to_numpy(), 1)
            for c in range(CLASSES):
                weights[rows, c] += changes[f"v{c}"].to_numpy() / seen
        start.unpersist()
    return Fitted(vocabulary, weights, counts)


# --- scoring ----------------------------------------------------------------

SCORED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>"


def _score(vocabulary, weights):
    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        v, table = vocabulary.value, weights.value
        per_token = math.log10((v.total + v.distinct + 1) or 1)
        head = np.append(np.log10(v.counts + 1.0), 0.0)  # the last is of the others
        mass = v.log_masses() / math.log(10)
        key = TaskContext.get().partitionId() << 33

        room = Room()

        def chosen(rows, kinds):
            p = probabilities(table, rows, room)
            return np.log(np.maximum(p[np.arange(len(p)), kinds], 1e-30))

        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            for first, n in text_slices(column):
                words, which, sizes = tokenized(column.slice(first, n))
                at, slots, by_class, by_slot = examples(words, which, sizes, v, len(table))
                logs = np.empty(len(which))
                for k in range(0, len(which), BATCH):
                    part = slice(k, k + BATCH)
                    logs[part] = chosen(by_class[:, part], slots[part] // SLOTS) + chosen(by_slot[:, part], slots[part] % SLOTS)
                begin = np.cumsum(sizes) - sizes
                total = np.add.reduceat(head[at], begin)
                model = total + np.add.reduceat(logs / math.log(10) - mass[slots], begin)
                # the hash of each word outside the head, once; the tokens' hashes by text
                rest = np.flatnonzero(at < 0)
                outside = np.unique(which[rest])
                hashes = np.zeros(len(words), dtype=np.int64)
                hashes[outside] = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words.take(pa.array(outside)).to_pylist()], dtype=np.uint64).view(np.int64)
                stops = np.searchsorted(rest, np.append(begin, len(which)))
                lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(hashes[which[rest]]))
                own = ids.slice(first, n)
                held = [crc_of_text(d, 7) == 2 for d in own.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + n)), own, pa.array(held, pa.bool_()), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((at >= 0).astype(np.int64), begin)), pa.array(total - sizes * per_token), pa.array(model), lists], names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"])
                key += n

    return run


def score(docs: DataFrame, model: Fitted, shared: Shared) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(x) for x in (model.vocabulary, model.weights)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = shared.write(texts.mapInArrow(_score(*parts), SCORED), "scored")
    tail = rows.select(F.col("key").alias("row"), F.explode("tail").alias("hash"))
    found = tail.join(model.counts.select(F.col("key").alias("hash"), "n"), "hash")
    sums = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count(F.lit(1)).alias("hits"))
    joined = rows.drop("tail").join(sums, F.col("key") == F.col("row"), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, shared = read(spark, sf_dir, "documents"), Shared(spark, "maxent")
    return score(documents, train(documents, shared), shared)
