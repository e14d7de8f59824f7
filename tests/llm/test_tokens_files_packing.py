import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import op3_packing as packing
from strandlake.llm import op8_token_files as files
from strandlake.llm.common import Shared
from strandlake.llm.tokens import ChunkTokenizer, slices, vocabulary_path

from .conftest import TEXTS


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary_path())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(plain):
    texts = [t for _, t, _, _ in TEXTS] + ["".join(chr(i) + " a" for i in range(33, 0x250)), "İstanbul ΑΣ Σ ǅ a\x1cb\x85c q", "..'s 'tis ##x## é å <|endoftext|>"]
    small = ChunkTokenizer(vocabulary_path(), memo_size=5)
    for _ in range(2):
        for text, ids in zip(texts, small.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_slices_cover_everything_once():
    texts = ["a" * n for n in (5, 0, 3, 100, 1, 1)]
    assert [i for a, b in slices(texts, 6) for i in range(a, b)] == list(range(6))


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_round_trip(spark, odd_docs, plain, encoding):
    shared = Shared(spark, "test")
    files.write_token_files(odd_docs, shared.path("f"), encoding=encoding)
    rows = files.token_table(spark, shared.path("f")).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (doc_id, text, _, _) in zip(rows, order):
        ids = [*plain(text), 1]
        assert (row.doc_id, row.start, row.n_tokens, list(row.ids)) == (doc_id, at, len(ids), ids)
        at += len(ids)
    assert len(rows) == len(order)
    assert {r.doc_id for r in files.tokens_between(spark, shared.path("f"), 5, 8).collect()} == {5, 6, 7}


def test_token_files_of_nothing(spark, no_docs):
    shared = Shared(spark, "test")
    files.write_token_files(no_docs, shared.path("f"))
    assert files.token_table(spark, shared.path("f")).count() == 0


def test_token_file_metadata_has_page_indexes(spark, odd_docs):
    import pyarrow.parquet as pq

    shared = Shared(spark, "test")
    files.write_token_files(odd_docs, shared.path("f"))
    path = next(r.p for r in files.read_token_files(spark, shared.path("f")).select(F.col("_metadata.file_path").alias("p")).distinct().collect())
    column = pq.ParquetFile(path.removeprefix("file:").replace("///", "/")).metadata.row_group(0).column(4)
    assert column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings


def _brute(total, ends, sentences, options):
    cuts, penalty = packing.candidate_cuts(total, ends, sentences, options)
    places = [0, *cuts.tolist()]
    extra = dict(zip(cuts.tolist(), penalty.tolist()))
    cost = {0: 0.0}
    for j in places[1:]:
        cost[j] = min(cost[i] + packing.padding_of(j - i, options.length) + options.window_cost + extra[j] for i in places if j - options.length <= i < j)
    return cost[total]


def test_cuts_are_optimal():
    random = np.random.default_rng(3)
    for _ in range(40):
        options = packing.PackingOptions(length=64, grid=8, window_cost=20.0)
        ends = np.unique(random.integers(1, 700, 12))
        total = int(ends[-1])
        sentences = np.unique(random.integers(1, total + 1, 30))
        cuts, cost = packing.best_cuts(*packing.candidate_cuts(total, ends, sentences, options), options)
        assert cuts[-1] == total and max(np.diff([0, *cuts])) <= 64
        assert cost == pytest.approx(_brute(total, ends, sentences, options))


def test_packing_keeps_every_id_once(odd_docs, plain):
    options = packing.PackingOptions(block_ids=5000)
    rows = packing.pack(odd_docs.coalesce(2), options).collect()
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    # pieces of one row follow each other; rows that share an id have texts of their own
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        got.setdefault((r.doc_id, r.doc_tokens), b"")
        assert r.start == len(got[r.doc_id, r.doc_tokens]) // 4 and len(r.ids) == 4 * r.length
        got[r.doc_id, r.doc_tokens] += r.ids
    want = {}
    for doc_id, text, _, _ in TEXTS:
        ids = np.array([*plain(text), 1], "<u4").tobytes()
        want[doc_id, len(ids) // 4] = ids
    assert got == want and zlib.crc32(got[4, 1]) == zlib.crc32(b"\1\0\0\0")


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_short_windows_of_powers_of_two_and_the_grid():
    """A rest of 2,048 + 64 ids: a window of 64 saves the padding of a second long one."""
    options = packing.PackingOptions()
    end = [2112]
    cuts, _ = packing.best_cuts(*packing.candidate_cuts(2112, end, [64], options), options)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(packing.padding_of(s, options.length) for s in sizes) == 0
    assert 32 in packing.candidate_cuts(2112, end, end, options)[0]
