import numpy as np
import pytest
from itertools import combinations
from pyspark.sql import functions as F

from strandlake.llm import op2_simhash as simhash
from strandlake.llm import op4_embeddings as embeddings
from strandlake.llm.common import Shared, words_of
from strandlake.llm.components import connected_components
from strandlake.llm.fingerprints import fingerprint, shingles

from .conftest import TEXTS


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def test_covering_triples():
    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(c) for t in triples) for c in combinations(range(8), 4))


def test_fingerprint_by_definition():
    import xxhash

    words = words_of("A b C d e f b C d e")
    assert shingles(words)[0] == b"a b c d" and len(shingles(words)) == 7
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(words)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(words) == want
    assert fingerprint([]) == 0 and fingerprint([b"x"]) == xxhash.xxh64_intdigest(b"x", 42)


def test_components_of_chains_stars_and_loops(spark):
    random = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(500, 500)] + [(int(a), int(b)) for a, b in random.integers(1000, 1200, (150, 2))]
    sets = Sets()
    for a, b in edges:
        sets.link(a, b)
    got = {r.node: r.component for r in connected_components(Shared(spark, "t"), spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {x: sets.root(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}


def test_near_fingerprints_against_all_pairs(spark, monkeypatch):
    """Fingerprints made to lie close, many in one list, in small blocks."""
    random = np.random.default_rng(5)
    centres = random.integers(-(1 << 62), 1 << 62, 12)
    values = set()
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in random.integers(0, 63, random.integers(0, 6)):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values) + [0, 1]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    monkeypatch.setattr(simhash.cells, "__defaults__", (16,))
    docs = spark.createDataFrame(list(enumerate(values, 1)), "doc_id long, fp long")
    sets = Sets()
    for (i, x), (j, y) in combinations(list(enumerate(values, 1)), 2):
        if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
            sets.link(i, j)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {i: sets.root(i) for i in range(1, len(values) + 1)}


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    by_id = {k[0]: v for k, v in rows.items()}
    assert by_id[2] == 1 and by_id[4] == by_id[5] == by_id[3] == 3 and by_id[None] is None
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    # 2 is a copy of 1; 4 and 5 have no words, as 3; both texts of 9 and the row without an id are alone
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 9, 12] and ids.count(None) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def _one_of_each_group(rows):
    """Plain: link rows by their fingerprints, all pairs; of each group the least by (null last, id)."""
    sets, prints = Sets(), [fingerprint(words_of(t)) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            sets.link(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(sets.root(i), []).append(i)
    return groups


def test_deduplication_is_by_row(spark):
    """Repeated ids with different texts, null ids, copies across both, near copies."""
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w7 ", "x7 ")
    a, b, c = "one text of a few words here", "quite another text stands in this row", "the third has words of its own too"
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, c), (1, long), (1, near), (None, near), (None, None), (8, ""), (9, "alone in the world it is"), (None, "nobody else says this"), (5, a), (5, a)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept_h1 int")
    kept = simhash.deduplicate(docs).collect()
    groups = _one_of_each_group(rows)
    assert len(kept) == len(groups) == 7
    where = {i: g for g, members in groups.items() for i in members}
    assert sorted(where[r.kept_h1] for r in kept) == sorted(groups)
    for r in kept:
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in groups[where[r.kept_h1]])
        assert (r.doc_id is None, r.doc_id or 0) == least
    assert {(r.doc_id, r.text) for r in kept} >= {(3, a), (5, b), (7, c)}


def test_embeddings_against_all_pairs(spark):
    random = np.random.default_rng(2)
    vectors, labels = [], []
    for c in range(8):
        centre = random.normal(size=32)
        for _ in range(30):
            vectors.append((centre + random.normal(size=32) * 0.16).astype(np.float32).tolist())
            labels.append(c % 3)
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], [0.0] * 32, None, [float("nan")] * 32, [1.0, 2.0], []]
    labels += [0, 0, 0, 0, 0, 0, 0, 0]
    vectors += [vectors[1]]
    labels += [None]
    rows = [(i, v, lab, "x") for i, (v, lab) in enumerate(zip(vectors, labels))]
    found = {r.vec_id: r for r in embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, weight string"), block=16).collect()}
    assert len(found) == len(rows)
    links, sets = {i: 0 for i in found}, Sets()
    ok = [i for i, v in enumerate(vectors) if v and len(v) == 32 and np.isfinite(v).all() and any(v) and labels[i] is not None]
    for i, j in combinations(ok, 2):
        a, b = np.array(vectors[i], np.float64), np.array(vectors[j], np.float64)
        if labels[i] == labels[j] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[j] += 1
            sets.link(i, j)
    total = sum(links.values())
    assert total > 1000 and sum(r.n_links for r in found.values()) >= 0.9 * total
    assert all(found[i].n_links <= links[i] for i in found)
    assert np.mean([found[i].component_id == sets.root(i) for i in found]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    alone = [i for i in found if i not in ok]
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in alone)


def test_embeddings_of_nothing(spark):
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("kind,labels,linked", [("double", [1.2, 1.7, 0.0, -0.0], [2, 3]), ("string", ["1", "01", "a", "a"], [2, 3]), ("boolean", [True, False, None, None], [])])
def test_labels_are_equal_in_their_own_type(spark, kind, labels, linked):
    rows = [(i, [1.0, 2.0 + i / 1000, 3.0, 4.0], x) for i, x in enumerate(labels)]
    found = embeddings.link_embeddings(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()
    assert {r.vec_id: r.n_links for r in found} == {i: int(i in linked) for i in range(4)}
