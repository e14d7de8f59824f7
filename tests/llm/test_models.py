import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import op1_toxicity as toxicity
from strandlake.llm import op5_maxent as maxent
from strandlake.llm import op9_language as language
from strandlake.llm.common import Shared, crc_of_text, words_of

from .conftest import TEXTS


@pytest.fixture(scope="module")
def labelled(spark):
    random = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = random.choice(plain, 60).tolist()
        bad = i % 5 == 0
        for at in random.integers(0, 60, 4 if bad else 0):
            words[at] = random.choice(["vile", "nasty!", "HATEFUL"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int")


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(scored[i] >= 0.5) == (i % 5 == 0) for i in held])
    assert right >= 0.97 and all(0 <= s <= 1 for s in scored.values())
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, s in scored.items() if s < 0.5}


def test_toxicity_of_odd_rows(labelled, odd_docs, no_docs, spark):
    model = toxicity.train(*labelled)
    scored = toxicity.with_score(odd_docs, model).collect()
    assert scored[0].__fields__.count("score") == 1 and len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.reject(odd_docs, model).columns == odd_docs.columns
    assert toxicity.with_score(no_docs, model).count() == 0
    nothing = toxicity.train(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.score([b"a"]) < 1e-6


def test_toxicity_words_are_whole():
    assert toxicity.tokens_of("Internet, international привет приветствие") == [b"internet", b"international", "привет".encode(), "приветствие".encode()]
    assert toxicity.tokens_of("見た日本語abc! 字 (ok)") == [*(x.encode() for x in ("見た", "た日", "日本", "本語", "abc", "字", "ok"))]
    assert toxicity.tokens_of(None) == [] and toxicity.tokens_of("!!! é") == ["é".encode()]


def test_toxicity_of_set_phrases(spark):
    """An expression that always follows the same word, which ordinary texts have too."""
    random = np.random.default_rng(6)
    rows = []
    for i in range(600):
        words = random.choice([f"w{j}" for j in range(300)], 60).tolist()
        for at in random.integers(0, 50, 4):
            words[at : at + 2] = ["you", "oaf" if i % 2 else "all"]
        rows.append((i, " ".join(words)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert model.evidence([b"w1", b"you", b"oaf"])[2] > 1 and model.evidence([b"w1", b"you", b"all"])[2] < -1
    held = [(i, model.score(toxicity.tokens_of(t))) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (i % 2) for i, s in held]) > 0.95


class PlainKneserNey:
    """The evidence by definition, in dictionaries."""

    def __init__(self, rows, d):
        runs = set()
        for words, toxic in rows:
            runs.update((toxic, u, h, w) for u, h, w in zip([b"", b"", *words], [b"", *words], words))
        self.d, self.n = d, Counter((t, h, w) for t, _, h, w in runs)
        self.ends = [Counter(w for t, _, w in self.n if t == k) for k in (0, 1)]
        self.sums = [sum(c.values()) for c in self.ends]
        self.types = sum(map(len, self.ends))
        self.common = sum(sum(min(x, d) for x in c.values()) / s for c, s in zip(self.ends, self.sums)) / 2
        self.follow: dict = {}
        for _, h, w in self.n:
            self.follow.setdefault(h, set()).add(w)

    def lower(self, t, w):
        return max(self.ends[t][w] - self.d, 0) / self.sums[t] + self.common * sum(c[w] > 0 for c in self.ends) / self.types

    def ratio(self, h, w):
        p = []
        after = [sum(self.n[t, h, x] for x in self.follow.get(h, ())) for t in (0, 1)]
        for t in (0, 1):
            own = lambda x: max(self.n[t, h, x] - self.d, 0) / max(after[t], 1)  # noqa: B023,E731
            pooled = lambda x: max(self.n[0, h, x] + self.n[1, h, x] - self.d, 0) / max(sum(after), 1)  # noqa: B023,E731
            if h == b"":  # nothing stands before the first word
                p.append(self.lower(t, w))
                continue
            rest = 1 - sum(map(own, self.follow.get(h, ())))
            p.append(own(w) + rest * (pooled(w) + (1 - sum(map(pooled, self.follow.get(h, ())))) * self.lower(t, w)))
        return math.log(p[1] / p[0])


def test_toxicity_evidence_by_definition(labelled, spark, monkeypatch):
    """Against plain Kneser-Ney models of the rows that the sample counts."""
    docs, labels = labelled
    kept = []
    original = toxicity._sample
    monkeypatch.setattr(toxicity, "_sample", lambda *a: kept.append(original(*a)) or kept[0])
    model = toxicity.train(docs, labels)
    rows = [(toxicity.tokens_of(r.text), r.toxic) for r in kept[0][0].where("not calibrates").collect()]
    plain = PlainKneserNey(rows, toxicity.DISCOUNT)
    words = [w for w, _ in Counter(w for t, _ in rows for w in t).most_common()]
    random = np.random.default_rng(8)
    for text in [rows[0][0], rows[1][0], [words[i] for i in random.integers(0, len(words), 80)]]:
        want = [plain.ratio(h, w) for h, w in zip([b"", *text], text)]
        assert np.allclose(model.evidence(text), want)


def test_toxicity_of_the_held_out_labels(spark):
    """A floor on the driver's own labels, of which a few carry no sign of toxicity."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op1_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 7


def _padded(text):
    return b" " * language.ORDER + text.lower()


def test_language_code_lengths_by_definition(monkeypatch):
    """Against dictionaries of contexts, over white space and beyond the kept windows and parts."""
    samples = (("xx", b"Abra cadabra, abra"), ("yy", b"xyz zyx\nabra"), ("", b""))
    counts, windows = Counter(), Counter()
    for lang, text in samples:
        s = _padded(text)
        windows.update((lang, int(w)) for w in language.windows_of(text))
        for e in range(language.ORDER, len(s)):
            counts.update((lang, s[e - o : e + 1]) for o in range(language.ORDER + 1))
    trees = language.Trees.build([k[0] for k in windows], [k[1] for k in windows], list(windows.values()))
    assert trees.languages == ["xx", "yy"]

    def bits(lang, text):
        s, total = _padded(text), 0.0
        for e in range(language.ORDER, len(s)):
            for o in range(language.ORDER, -1, -1):
                seen = {g[-1]: n for (x, g), n in counts.items() if x == lang and g[:-1] == s[e - o : e] and len(g) == o + 1}
                if seen:
                    all_ = sum(seen.values()) + len(seen)
                    total -= math.log2((seen[s[e]] if s[e] in seen else len(seen)) / all_)
                    if s[e] in seen:
                        break
            else:
                total += 8
        return total

    texts = [b"ABRA zebra", b"", b"q", b"caxyz\n\nbra abra " * 9, "é\x00".encode()]
    want = np.array([[bits(x, t) for x in trees.languages] for t in texts])
    monkeypatch.setattr(language, "KEPT", 1)
    for part in (language.PART, 7):
        monkeypatch.setattr(language, "PART", part)
        for _ in range(3):
            assert np.allclose(trees.code_texts(texts), want)


def test_language_accuracy_and_odd_rows(spark, data_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    trees = language.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.predict(docs, trees).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in language.predict(odd_docs.select("doc_id", "text"), trees).collect()}
    assert all(odd[i] == "und" for i in (3, 4, 5, 12)) and odd[6] == "fr" and odd[7] in trees.languages
    signs = spark.createDataFrame([(1, "½ ² ① Ⅷ 7"), (2, "½ ª"), (3, "日")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.predict(signs, trees).orderBy("doc_id").collect()] == [True, False, False]
    assert language.predict(no_docs, trees).count() == 0
    assert {r.lang_pred for r in language.predict(odd_docs, language.train(no_docs)).collect()} == {"und"}


def test_an_empty_language_is_learned(spark):
    rows = [(i, "aba abba baab" if i % 2 else "xyx yxxy zyx", "" if i % 2 else "xy") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.train(docs)
    assert trees.languages == ["", "xy"]
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, trees).collect()} == {i: x for i, _, x in rows}


def _base(texts, held):
    counts = Counter()
    for i, t in texts:
        if not held(i):
            counts.update([*words_of(t), b""])
    return counts, sum(counts.values())


def test_maxent_base_by_definition_and_gain(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    shared = Shared(spark, "t")
    rows = maxent.score(docs, maxent.train(docs, shared), shared).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts, total = _base(texts, held)
    by = dict(texts)
    for r in rows:
        tokens = [*words_of(by[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens), total)
        assert r.n_known == sum(w in counts for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_maxent_probabilities_sum_to_one(spark, odd_docs):
    """Over every known word and one unknown word of each shared slot, in any context."""
    shared = Shared(spark, "t")
    model = maxent.train(odd_docs, shared)
    v = model.vocabulary
    _, slots, identity = v.places(pa.array(v.words, pa.binary()))
    within = np.zeros(maxent.CLASSES * maxent.SLOTS)
    np.add.at(within, slots, (v.counts + 1) / v.sizes[slots])
    within.reshape(maxent.CLASSES, -1)[:, maxent.SLOTS - maxent.SHARED_SLOTS :] += 1 / v.sizes.reshape(maxent.CLASSES, -1)[:, maxent.SLOTS - maxent.SHARED_SLOTS :]
    assert np.allclose(within[v.sizes > 0], 1) and (within[v.sizes == 0] == 0).all()
    starts = np.array([True, False, False])
    by_class, _ = maxent.features(identity[:3], starts, slots[:3] // maxent.SLOTS, len(model.weights))
    classes = maxent.probabilities(model.weights, by_class, maxent.Room())
    total = np.zeros(3)
    for c in range(maxent.CLASSES):
        _, by_slot = maxent.features(identity[:3], starts, np.full(3, c), len(model.weights))
        total += classes[:, c] * (maxent.probabilities(model.weights, by_slot, maxent.Room()) @ within.reshape(maxent.CLASSES, -1)[c])
    assert np.allclose(total, 1, atol=1e-5)


def _plain_scores(texts, model, counts):
    """log10 probability of each text, token by token, from the model's weights and all counts."""
    v, size, mask = model.vocabulary, len(model.weights), (1 << 64) - 1
    place = {w: i for i, w in enumerate(v.words)}
    weights = model.weights.astype(float)

    def identity(w):
        return place[w] if w in place else len(v.words) + maxent._ending(w)

    def leaf(w):
        return v.own.get(w, int(v.shared[maxent._ending(w)]))

    out = []
    for text in texts:
        tokens, total = [*words_of(text), b""], 0.0
        before = [0, 0, 0]
        for w in tokens:
            one, two, three = before
            values = [one, (one << 20) + two, two, three]
            hashes = [(x * 5 + k) * 0x9E3779B97F4A7C15 & mask for k, x in enumerate(values, 1)]
            kind, slot = divmod(leaf(w), maxent.SLOTS)
            mixed = [((h ^ h >> 29) + (kind + 1) * 0xBF58476D1CE4E5B9) * 0x94D049BB133111EB & mask for h in (hashes[0], hashes[2])]
            for bias, hs, chosen in ((0, hashes, kind), (1 + kind, mixed, slot)):
                z = weights[bias] + sum(weights[1 + maxent.CLASSES + ((h >> 40) * (size - 1 - maxent.CLASSES) >> 24)] for h in hs)
                total += (z[chosen] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
            total += math.log10(counts[w] + 1) - math.log10(v.sizes[leaf(w)])
            before = [identity(w) + 1, *before[:2]]
        out.append(total)
    return out


def test_maxent_scores_by_definition(spark, data_dir, odd_docs, monkeypatch):
    """Of odd and of the driver's texts, with most words outside the head."""
    monkeypatch.setattr(maxent, "HEAD", 300)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    shared = Shared(spark, "t")
    model = maxent.train(docs, shared)
    assert len(model.vocabulary.words) <= 300 and len(model.vocabulary.own) > maxent.CLASSES
    rows = {(r.doc_id, r.n_tokens): r.score for r in maxent.score(docs, model, shared).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts, _ = _base(texts, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2)
    some = [t for t in texts if len(t[1] or "") < 4000][-60:]
    got = [rows[i, len(words_of(t)) + 1] for i, t in some]
    assert np.allclose(got, _plain_scores([t for _, t in some], model, counts), rtol=1e-4)


def test_tokens_by_definition():
    texts = [*(t for _, t, _, _ in TEXTS), "\x1ca\x85b \u2003c\x0b\x0cD  ", " \ufeff", "É İ"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    words, which, sizes = maxent.tokenized(column)
    want = [[*words_of(t), b""] for t in texts]
    words = words.to_pylist()
    assert [words[i] for i in which.tolist()] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    cut = list(maxent.text_slices(column, 100))
    assert [i for a, n in cut for i in range(a, a + n)] == list(range(len(texts))) and len(cut) > 2


def test_maxent_learns_at_every_position(spark):
    """Texts whose length is a multiple of four, of which a fixed share of positions shows one word only."""
    docs = spark.createDataFrame([(i, "aa bb cc dd " * 20 + "aa bb cc") for i in range(60)], "doc_id long, text string")
    shared = Shared(spark, "t")
    rows = [r for r in maxent.score(docs, maxent.train(docs, shared), shared).collect() if r.held_out]
    assert rows and all((r.score - r.base_score) / r.n_tokens > 0.15 for r in rows)


def test_gradient_step_by_definition():
    random = np.random.default_rng(3)
    rows = np.stack([random.integers(0, 3, 500), *random.integers(1, 40, (2, 500)), *random.integers(1, 900, (2, 500))])
    kinds, weights, squares = random.integers(0, maxent.CLASSES, 500), random.normal(size=(1000, maxent.CLASSES)), np.full(1000, 0.5)
    push = maxent.probabilities(weights, rows, maxent.Room()).copy()
    push[np.arange(500), kinds] -= 1
    total = np.zeros_like(weights)
    for k in range(5):
        np.add.at(total, rows[k], push / 500**0.5)
    after = squares + (total**2).mean(axis=1)
    want = weights - maxent.RATE * total / np.sqrt(after + maxent.DAMPING)[:, None]
    maxent.gradient_step(weights, squares, rows, kinds, maxent.Room())
    assert np.allclose(weights, want) and np.allclose(squares, after)


def test_maxent_of_odd_rows(spark, odd_docs, no_docs):
    shared = Shared(spark, "t")
    model = maxent.train(odd_docs, shared)
    rows = maxent.score(odd_docs, model, shared).collect()
    assert len(rows) == len(TEXTS) and all(math.isfinite(r.score) and r.n_tokens >= r.n_known for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert maxent.score(no_docs, maxent.train(no_docs, Shared(spark, "t")), Shared(spark, "t")).count() == 0


def test_features_stay_within_texts():
    identity = np.array([5, 6, 7, 5, 6, 7])
    kinds = np.array([1, 2, 3, 1, 2, 3])
    for rows in maxent.features(identity, np.array([True, False, False, True, False, False]), kinds, 1024):
        assert (rows[:, :3] == rows[:, 3:]).all() and rows.max() < 1024 and rows[1:].min() > maxent.CLASSES


@pytest.mark.parametrize("ident", [12, 13, 14, None])
def test_each_language_with_a_usable_row_is_learned(spark, ident):
    rows = [(ident, f"le chat numero {i} dort sur la chaise", "fr") for i in range(1000)] + [(100_000 + i, f"the cat number {i} sleeps on a chair", "en") for i in range(1000)]
    rows += [(ident, "una sola fila repetida", "es")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.train(docs, 40).languages
    want = {"en"} | ({"fr", "es"} if crc_of_text(ident, 4) != 2 else set())
    assert set(learned) == want
