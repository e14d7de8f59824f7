"""Language identification by prediction with partial matching (PPM).

Each language has a tree of byte contexts up to ``ORDER`` bytes long, counted on
its training texts with A-Z in lower case.  A byte's code length is that of PPM's
method C: a seen byte of the longest known context costs -log2(count / (total +
kinds)), an escape costs -log2(kinds / (total + kinds)) and passes to the next
shorter context, at the end to a uniform byte.  Contexts run over white space and
all other bytes of the text, which is read as if ``ORDER`` spaces stood before it.

Statistics are frozen after training, so a byte's code length depends on nothing but
itself and the ``ORDER`` bytes before it: each worker keeps the code lengths of the
windows it met in a table of bounded size (a window overwrites another one in its
place), and computes those of new windows together, one array step an order.

The trees are fitted on a bounded sample: about ``ROWS_PER_LANGUAGE`` whole
training texts of each language, the smallest by a hash of the id.

Defined cases: null texts, texts without a letter (Unicode category L) and texts
scored before anything was learned are ``und`` with score 0; a null lang or text is
not learned from, an empty lang is a language; ties go to the language that sorts
first; repeated rows are predicted alike; very long texts are coded whole, in parts;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, crc_bucket, read
from .tokens import slices

ORDER = 4
ROWS_PER_LANGUAGE = 400
#: Code lengths that a worker keeps, over all languages.
KEPT = 1 << 22
#: Bytes of text coded at once.
PART = 1 << 20
UNDETERMINED = "und"


def windows_of(text: bytes):
    """Each byte with the ``ORDER`` bytes before it, as one number; the last byte is the lowest."""
    import numpy as np

    raw = np.frombuffer(b" " * ORDER + text.lower(), dtype=np.uint8)
    run = np.zeros(len(text), dtype=np.int64)
    for back in range(ORDER + 1):
        run |= raw[ORDER - back : len(raw) - back].astype(np.int64) << 8 * back
    return run


def _parts(text: bytes, size: int):
    """The windows of a text, in parts of bounded size."""
    for at in range(0, max(1, len(text)), size):
        before = min(at, ORDER)
        yield windows_of(text[at - before : at + size])[before:]


def _count(batches):
    """Counts of (language, window)."""
    import numpy as np
    import pyarrow as pa

    def table(lang, parts):
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for part in _parts(text.encode("utf-8", "surrogatepass"), PART):
                by.setdefault(lang, []).append(part)
                if sum(map(len, by[lang][-8:])) >= 4 * PART:
                    yield table(lang, by.pop(lang))
        for lang, parts in by.items():
            yield table(lang, parts)


class Trees:
    """Frozen context trees: for each language and order a sorted array of grams and one of contexts."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.seen: list = []  # by language, by order: (grams, code lengths)
        self.escape: list = []  # by language, by order: (contexts, escape lengths)
        self._kept = None

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    @classmethod
    def build(cls, langs, grams, counts) -> "Trees":
        """From arrays of languages, windows and their counts."""
        import numpy as np

        langs = np.asarray(langs, dtype=object)
        trees = cls(sorted(set(langs)))
        for lang in trees.languages:
            own = langs == lang
            gram, n = np.asarray(grams, dtype=np.int64)[own], np.asarray(counts, dtype=np.int64)[own]
            seen, escape = [], []
            for order in range(ORDER + 1):
                # the counts of a shorter context are sums of those of the longer ones that end with it
                short, place = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                total = np.bincount(place, n, len(short))
                context, at = np.unique(short >> 8, return_inverse=True)
                kinds = np.bincount(at, minlength=len(context))
                mass = np.bincount(at, total, len(context)) + kinds
                seen.append((short, -np.log2(total / mass[at])))
                escape.append((context, -np.log2(kinds / mass)))
            trees.seen.append(seen)
            trees.escape.append(escape)
        return trees

    @staticmethod
    def _find(table, keys):
        import numpy as np

        known, values = table
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[place] == keys, values[place]

    def code(self, windows):
        """Code lengths in bits (windows x languages) of each window's last byte."""
        import numpy as np

        out = np.zeros((len(windows), len(self.languages)))
        for k in range(len(self.languages)):
            open_ = np.arange(len(windows))
            for order in range(ORDER, -1, -1):
                gram = windows[open_] & ((1 << 8 * (order + 1)) - 1)
                hit, length = self._find(self.seen[k][order], gram)
                out[open_[hit], k] += length[hit]
                open_, gram = open_[~hit], gram[~hit]
                known, length = self._find(self.escape[k][order], gram >> 8)
                out[open_[known], k] += length[known]
            out[open_, k] += 8.0
        return out

    def code_kept(self, windows):
        """As ``code``, by the table of windows met before."""
        import numpy as np

        if self._kept is None:
            slots = 1 << max(10, (KEPT // max(1, len(self.languages))).bit_length() - 1)
            self._kept = np.full(slots, -1, dtype=np.int64), np.zeros((slots, len(self.languages)))
        keys, rows = self._kept
        shift = np.uint64(64 - (len(keys).bit_length() - 1))
        slot = lambda w: ((w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64)
        at = slot(windows)
        out = rows[at]
        missed = np.flatnonzero(keys[at] != windows)
        if len(missed):
            fresh, place = np.unique(windows[missed], return_inverse=True)
            lengths = self.code(fresh)
            out[missed] = lengths[place]
            at = slot(fresh)
            # of windows that share a place the last one stays, in both arrays
            keys[at] = fresh
            mine = keys[at] == fresh
            rows[at[mine]] = lengths[mine]
        return out

    def code_texts(self, texts: list[bytes]):
        """Code lengths in bits (texts x languages)."""
        import numpy as np

        out = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        most = min(PART, max(1 << 14, 8 * PART // max(1, len(self.languages))))

        def flush():
            nonlocal held, size
            if held:
                begin = np.cumsum([0] + [len(w) for _, w in held[:-1]])
                sums = np.add.reduceat(self.code_kept(np.concatenate([w for _, w in held])), begin, axis=0)
                np.add.at(out, [i for i, _ in held], sums)
            held, size = [], 0

        for i, text in enumerate(texts):
            for part in _parts(text, most) if text else ():
                held.append((i, part))
                size += len(part)
                if size >= most:
                    flush()
        flush()
        return out


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Trees:
    """Trees from ``docs`` (doc_id, text, lang), but for those with crc32(doc_id) mod 4 = 2."""
    shared = Shared(docs.sparkSession, "language")
    usable = docs.where((crc_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    draw = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()
    if not sizes:
        return Trees([])
    # rows of one id and text are drawn together; the least draw is always in, so every language is learned
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(max(min(1.0, rows_per_language / r["n"]), r["least"]))) for r in sizes])
    counted = usable.where(draw <= share).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    rows = shared.write(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams").toArrow()
    return Trees.build(rows["lang"].to_pylist(), rows["gram"].to_numpy(), rows["n"].to_numpy())


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score (the share of the best language in 2**-(bits per root of the text's bytes))."""
    broadcast = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trees = broadcast.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for i, j in slices(texts):
                judged = [bool(t) and bool(trees.languages) and any(map(str.isalpha, t)) for t in texts[i:j]]
                part = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts[i:j], judged)]
                names, scores = [], []
                for ok, text, own in zip(judged, part, trees.code_texts(part)):
                    best = int(own.argmin()) if ok else None
                    names.append(trees.languages[best] if ok else UNDETERMINED)
                    scores.append(float(1 / np.exp2(-(own - own[best]) / len(text) ** 0.5).sum()) if ok else 0.0)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return predict(documents, train(documents)).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
