"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

One edit leaves a half of the shorter word intact: the words of a near pair share
either a prefix up to the middle or a suffix from it.  Each word enters a forward
dictionary (sorted by prefix) and a reversed one (sorted by suffix), once as the
shorter and once as the longer word of a pair (block lengths s = its length, and
that less one).  Words that agree in s and in the intact half stand together; a scan
over the sorted ranges meets them block by block and verifies each pair.

A block is described by the window [a, b) of the shorter word that may hold the edit:
its words agree before a and from b on.  A block of more than ``BLOCK`` words is
subdivided by the same argument: the edit lies in one half of the window, so the other
half is intact as well.  Halving ends at windows of one letter, whose blocks hold no more
words than the alphabet allows.  A pair is judged in the one block whose window holds its
edit (an inserted letter's last possible place), so counts add up and nothing is
compared twice; a block hands on one row a word, never pairs.

Defined cases: null and empty texts have no words; a null doc_id is read as '' in
``<doc_id>:<run>``; repeated rows count each; ties for the form go to the smaller word in
code-point order; runs of any length are taken whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, ascii_lower, read

LEAST_LETTERS, LEAST_COUNT, RATIO, DROP_EVERY = 7, 2, 10, 31
BLOCK = 64
_KEY = ["s", "a", "b", "head", "tail"]
#: Cells of a comparison by arrays; larger blocks (of long words) are compared pair by pair.
_CELLS = 1 << 21


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, n over all texts, each run of letters lower-cased (A-Z) and short of one letter where its checksum says so."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit("[a-zÀ-ÿ]{%d,}" % least_letters), F.lit(0))
    listed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    listed = listed.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    short = F.expr(f"CASE WHEN h % {drop_every} = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2)) ELSE run END")
    return listed.select(short.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _blocks(words: DataFrame, rows: str) -> DataFrame:
    """word, n, the block's s, a, b and what its words agree in; ``rows``: SQL of an array of (s, a, b)."""
    spread = words.select("word", "n", F.inline(F.expr(rows)))
    return spread.withColumns({"head": F.expr("left(word, a)"), "tail": F.expr("right(word, s - b)")})


def _common(x: str, y: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def near_pairs(words: list[str], s: int, a: int, b: int) -> list[tuple[int, int]]:
    """Positions of pairs of a block whose one edit lies in its window."""
    short = [i for i, w in enumerate(words) if len(w) == s]
    long = [i for i, w in enumerate(words) if len(w) == s + 1]
    width = b - a
    if len(words) > 8 and len(short) * len(words) * (width + 1) <= _CELLS:
        import numpy as np

        letters = lambda at, extra: np.array([words[i][a : b + extra] for i in at], dtype=f"<U{width + extra}").view(np.uint32).reshape(len(at), width + extra)
        x = letters(short, 0)
        i, j = np.nonzero(np.triu((x[:, None, :] != x[None, :, :]).sum(axis=2) == 1, 1))
        found = [(short[p], short[q]) for p, q in zip(i.tolist(), j.tolist())]
        if long:
            y = letters(long, 1)
            before = np.logical_and.accumulate(x[:, None, :] == y[None, :, :-1], axis=2).sum(axis=2)
            after = np.logical_and.accumulate((x[:, None, :] == y[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero((before + after >= width) & ((before < width) | (b == s)))
            found += [(short[p], long[q]) for p, q in zip(i.tolist(), j.tolist())]
        return found
    found = []
    for k, i in enumerate(short):
        x = words[i][a:b]
        for j in short[k + 1 :]:
            y = words[j][a:b]
            p = _common(x, y)
            if p < width and x[p + 1 :] == y[p + 1 :]:
                found.append((i, j))
        for j in long:
            y = words[j][a : b + 1]
            p = _common(x, y)
            if x[p:] == y[p + 1 :] and (p < width or b == s):
                found.append((i, j))
    return found


def _verify(batches):
    """Scans sorted blocks; a block may pass from one batch to the next."""
    import pyarrow as pa

    def judged(key, group, out):
        best: dict = {}
        for i, j in near_pairs([w for w, _ in group], *key[:3]):
            for x, y in ((i, j), (j, i)):
                word, n = group[y]
                near, most, form = best.get(x, (0, -1, ""))
                best[x] = (near + 1, n, word) if n > most or (n == most and word < form) else (near + 1, most, form)
        out += [(group[i][0], *v) for i, v in best.items()]

    def table(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "near", "form_n", "form"])

    key, group = None, []
    for batch in batches:
        out: list = []
        for s, a, b, word, n in zip(*(batch.column(c).to_pylist() for c in ("s", "a", "b", "word", "n"))):
            now = (s, a, b, word[:a], word[len(word) - (s - b) :])
            if now != key:
                if len(group) > 1:
                    judged(key, group, out)
                key, group = now, []
            group.append((word, n))
        yield table(out)
    out = []
    if len(group) > 1:
        judged(key, group, out)
    yield table(out)


def near_words(shared: Shared, words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = BLOCK) -> DataFrame:
    """word, near (number of words one edit away), form_n and form (the most frequent of them), for words that have any."""
    half = "CAST(s div 2 AS INT)"
    halves = f"flatten(transform(filter(array(length(word), length(word) - 1), s -> s >= {least_letters}), s -> array(struct(s AS s, {half} AS a, s AS b), struct(s AS s, 0 AS a, {half} AS b))))"
    pending, ready, turn = _blocks(words, halves), [], 0
    while True:
        pending = shared.write(pending, f"blocks-{turn}")
        sizes = pending.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words"), F.max(F.length("word") == F.col("s")).alias("some")).where("words > 1 AND some")
        sizes = shared.write(sizes.withColumn("large", (F.col("words") > block) & (F.col("b") - F.col("a") > 1)), f"sizes-{turn}")
        ready.append(pending.join(sizes.where("NOT large"), _KEY, "left_semi"))
        large = sizes.where("large")
        if large.isEmpty():
            break
        middle = "CAST((a + b) div 2 AS INT)"
        split = pending.join(large, _KEY, "left_semi").select("word", "n", F.expr(f"array(struct(s, {middle} AS a, b), struct(s, a, {middle} AS b))").alias("parts"))
        pending, turn = _blocks(split, "parts"), turn + 1
    scanned = ready[0]
    for df in ready[1:]:
        scanned = scanned.unionByName(df)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("head"), F.reverse("tail"), F.col("s"), F.col("a"), F.col("b")]
    scanned = scanned.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "word").select("s", "a", "b", "word", "n")
    found = scanned.mapInArrow(_verify, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("best")).select("word", "near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    shared = Shared(docs.sparkSession, "variants")
    words = shared.write(word_counts(docs, least_letters).where(F.col("n") >= least_count), "words")
    near = near_words(shared, words, least_letters, block)
    has = F.col("form_n") >= F.col("n") * ratio
    joined = words.join(near, "word", "left").select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n"))
    joined = shared.write(joined, "near")
    # forms grow tenfold at each step, so the doubling below ends after a few rounds
    roots, turn = shared.write(joined.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(onward, "root", "left_semi").isEmpty():
            break
        turn += 1
        roots = shared.write(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{turn}")
        shared.drop(f"roots-{turn - 1}")
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
