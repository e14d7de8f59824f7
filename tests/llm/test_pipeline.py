from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandlake.llm import op1_toxicity, op6_mixing, op7_secrets
from strandlake.llm.common import words_of
from strandlake.llm.fingerprints import fingerprint


def test_stages_keep_the_columns(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, count = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data_dir)
        assert docs.columns == columns
        if name != "mixing":
            now = docs.count()
            assert now <= count
            count = now


def test_run_packs_what_is_left(spark, data_dir):
    rows = corpus_pipeline.run(spark, data_dir)
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(rows.columns) and rows.count() > 0
    assert rows.where("length(ids) <> 4 * length").count() == 0


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def odd_columns(spark, odd_docs):
    """Null, empty, repeated and long texts, null and repeated ids, and columns that are hard to name."""
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 1"))
    return docs.withColumns({"a.b": F.lit(1), "Toxicity": F.lit("x"), "text.len": F.length("text"), "c0": F.lit(2.5), "back`tick": F.lit(0)})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_over_defined_cases(spark, data_dir, odd_columns, name, stage):
    got = stage(spark, odd_columns, data_dir)
    empty = stage(spark, odd_columns.limit(0), data_dir)
    assert empty.count() == 0
    if name == "packing":
        assert got.where("doc_id = 3").count() >= 1
        return
    assert got.columns == odd_columns.columns == empty.columns and got.dtypes == odd_columns.dtypes
    rows, kept = odd_columns.collect(), got.collect()
    if name == "simhash":
        assert sum(r["doc_id"] in (1, 2) for r in kept) == 1 and sum(r["doc_id"] == 9 for r in kept) == 2
        assert sum(r["text"] is None or not r["text"].strip() for r in kept) == 1
    if name == "secrets":
        assert len(kept) == len(rows)
        text = next(r["text"] for r in kept if r["doc_id"] == 9 and "plus" in r["text"])
        assert "hunter2secret" not in text and "AKIA" not in text and "[SECRET]" in text
    if name == "toxicity":
        assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows}
    if name == "mixing":
        assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}


def plain_stages(spark, data_dir):
    """What each stage leaves, from whole-table versions of its rule."""
    docs = [r.asDict() for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    scores = {r["doc_id"]: r["score"] for r in op1_toxicity.op1_toxicity(spark, data_dir).collect()}
    docs = [d for d in docs if scores[d["doc_id"]] < 0.5]
    yield docs
    prints = [fingerprint(words_of(d["text"])) for d in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for i, d in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    docs = [d for i, d in enumerate(docs) if d["doc_id"] == least[root(i)]]
    yield docs
    docs = [{**d, "text": op7_secrets.redacted(d["text"], op7_secrets.find_spans(d["text"]))} for d in docs]
    yield [{**d, "n_chars": len(d["text"])} for d in docs]


def test_stages_against_plain_versions(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(spark, data_dir)):
        docs = stage(spark, docs, data_dir)
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((d["doc_id"], d["text"], d["n_chars"]) for d in want), name


def test_mixing_and_packing_keep_every_word(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    plan = {r["doc_id"]: r["copies"] for r in op6_mixing.mixing_plan(docs).collect()}
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, data_dir).collect())
    assert {k: n for k, n in plan.items() if n} == dict(mixed)
    pieces = corpus_pipeline.packing(spark, docs, data_dir).select("doc_id", "length", "doc_tokens").collect()
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert all(total[p["doc_id"]] == p["doc_tokens"] for p in pieces)
