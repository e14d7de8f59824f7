"""Operators 11 to 13 against plain versions, over defined cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from strandlake.llm import op11_divergence, op12_topk, op13_variants


def plain_divergence(rows, min_docs=10, top=10):
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        sources = sorted(s for x, s in n if x == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], whole[t])) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_on_defined_cases(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["alpha", "Beta", "ÉTÉ", "été", "日本", "x1y", "don't"], 12)), ["en", None][i % 2], ["a", "b", None, "Z", "ä"][i % 5]) for i in range(60)]
    rows += [(None, "en", "only"), ("", "fr", "b"), ("rare words", "fr", None), ("Ω" * 30, "en", "a")] + [("one one ONE", "de", "lone")] * 11
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "text string, lang string, source string, value long, `term.x` string")
    got = [tuple(r) for r in op11_divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == plain_divergence(rows)
    assert not any(r[0] == "de" and r[2] == "pair" for r in got) and any(r[0] == "fr" and r[4] == 0 for r in got)
    assert op11_divergence.divergence(no_docs).count() == 0
    low = [tuple(r) for r in op11_divergence.divergence(odd_docs, min_docs=1, top=3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(low) == plain_divergence([(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()], 1, 3)


def test_terms_are_cut_between_terms(monkeypatch):
    text = ("Straße, naïve x" * 40 + "y" * 50 + " end").encode()
    want = op11_divergence.TERM.findall(text.lower())
    monkeypatch.setattr(op11_divergence, "PIECE", 7)
    assert [t for part in op11_divergence.terms_of(text) for t in part] == want


def plain_top(rows, every=100, k=10):
    usable = [(i, v, [math.floor(1024 * x) for x in w]) for i, (v, w) in enumerate(rows) if w is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in w)]
    out = []
    for i, q, x in usable:
        if q is None or q % every:
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(x, y)), 2**63 - 1), -(2**63)), v is None, v or 0, v) for j, v, y in usable if j != i and len(y) == len(x)]
        out += [(q, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "x") for r in rows], "vec_id long, embedding array<double>, score double, `a.b` string")


@pytest.mark.parametrize("least", [40, 4096])
def test_top_k_on_defined_cases(spark, least):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 19))
    rows = [(i * 5, list(map(float, base[i % 250]))) for i in range(300)]
    rows += [(100, rows[20][1]), (100, rows[20][1]), (100, rows[3][1]), (None, rows[7][1]), (-200, rows[40][1]), (0, rows[1][1])]
    rows += [(500, None), (501, [None] * 19), (600, [float("nan")] * 19), (700, [float("inf")] * 19), (800, [1e306] * 19), (900, [0.0] * 19), (1000, []), (1001, []), (1100, [1.0, 2.0]), (7, [3.0, 4.0])]
    rows += [(2000 + i, [0.5] * 19) for i in range(60)]
    got = sorted((tuple(r) for r in op12_topk.top_k(vectors_of(spark, rows), least=least).select("query_id", "rank", "vec_id", "score").collect()), key=repr)
    assert got == plain_top(rows)
    assert op12_topk.top_k(vectors_of(spark, [])).count() == 0


def test_top_k_beyond_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, [float(x) * 2.0**30 for x in rng.normal(size=6)]) for i in range(30)] + [(100, [1e300] * 6)]
    got = sorted((tuple(r) for r in op12_topk.top_k(vectors_of(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()), key=repr)
    assert got == plain_top(rows)


def plain_variants(rows, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    with_gap = defaultdict(set)  # words less one letter: near words share one, or one is the other less one
    for w in n:
        for j in range(len(w)):
            with_gap[w[:j], w[j + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for j in range(len(w)):
            near[w] |= with_gap[w[:j], w[j + 1 :]] - {w}
            less = w[:j] + w[j + 1 :]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def variants_of(df, **more):
    return sorted((tuple(r) for r in op13_variants.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("block", [2, 64])
def test_variants_on_defined_cases(spark, odd_docs, no_docs, block):
    rng = np.random.default_rng(8)
    stem = ["wanderung", "wanderungen", "Häuserfront", "bookkeeper", "aaaaaaaa", "×÷×÷×÷×÷", "x" * 400]
    texts = []
    for i in range(400):
        words = []
        for w in rng.choice(stem, 6, p=[0.3, 0.2, 0.1, 0.2, 0.1, 0.05, 0.05]):
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(w)))
                w = w[:at] + str(rng.choice(["", "a", "ä", "e"])) + w[at + int(rng.integers(0, 2)) :]
            words += [w] * int(rng.integers(1, 4))
        texts.append((None if i % 40 == 0 else i, " ".join(words)))
    texts += [(1, None), (2, ""), (3, "aaaaaaa1AAAAAAA_aaaaaaa")] + [(5, "wanderung " * 500)] * 2
    docs = spark.createDataFrame([(*t, "w", 1) for t in texts], "doc_id long, text string, word string, `n.near` int")
    assert variants_of(docs, block=block) == plain_variants(texts)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert variants_of(odd_docs) == plain_variants(odd)
    assert op13_variants.variants(no_docs).count() == 0


def test_near_pairs_in_arrays_and_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(9)
    words = sorted({"kern" + "".join(rng.choice(list("ab"), int(rng.integers(4, 6)))) + "ende" for _ in range(40)})
    for b in (8, 12):
        group = [w for w in words if len(w) in (12, 13)]
        arrays = op13_variants.near_pairs(group, 12, 4, b)
        monkeypatch.setattr(op13_variants, "_CELLS", 0)
        assert sorted(arrays) == sorted(op13_variants.near_pairs(group, 12, 4, b))
        monkeypatch.undo()


def test_variants_of_the_table(spark, data_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert Path(data_dir).exists() and sorted((tuple(r) for r in op13_variants.op13_variants(spark, data_dir).collect()), key=repr) == plain_variants(rows)
