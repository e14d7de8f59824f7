"""Order-preserving packing of documents into sequences of bounded length.

Documents are taken in the order of their partition, as one stream of ids.  A
dynamic program chooses where the stream is cut: candidate cuts are document
ends (free), sentence ends (a small penalty) and, inside stretches that hold
neither, a grid of positions (a larger penalty).  A window of L ids costs
``length - L`` padding, or none if L is a power of two, plus ``window_cost``.
As padding is linear in the window's start, the best start of all windows that
end at one cut is the minimum of ``cost + position`` over a sliding range: a
monotone queue keeps it, so a cut costs constant time; windows of exactly a
power of two are further transitions.

Each input partition is packed by itself, in blocks of bounded size: a block
commits all windows but its last few, whose ids go on to the next block.  So no
row is shuffled and memory is bounded by a block and the longest document.
``sequence_id`` is partition * 2**33 + a count, which needs no second pass.

Defined cases: null or empty text is its end id alone; a null doc_id stays null;
repeated rows are packed as rows of their own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, read, spark_schema
from .tokens import ChunkTokenizer, slices, vocabulary_path

PIECE_FIELDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class PackingOptions:
    """Costs are in padding ids."""

    def __init__(self, length: int = 2048, sentence_cut: float = 2.0, other_cut: float = 16.0, window_cost: float = 16.0, grid: int = 32, block_ids: int = 400_000, end_id: int = 1):
        self.length, self.sentence_cut, self.other_cut, self.window_cost = length, sentence_cut, other_cut, window_cost
        self.grid, self.block_ids, self.end_id = grid, block_ids, end_id


def padding_of(size: int, length: int) -> int:
    """Padding of a sequence: up to ``length``, none at a power of two."""
    return 0 if size & (size - 1) == 0 else length - size


def candidate_cuts(total: int, doc_ends, sentence_ends, options: PackingOptions):
    """Sorted positions > 0 up to ``total`` with their penalties."""
    import numpy as np

    natural = np.unique(np.concatenate([doc_ends, sentence_ends, [total]]))
    natural = natural[natural > 0]
    begin = np.concatenate([[0], natural[:-1]])
    extra = np.maximum((natural - begin - 1) // options.grid, 0)
    extra[natural - begin <= 2 * options.grid] = 0
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    grid = np.repeat(begin, extra) + step * options.grid
    at = np.concatenate([natural, grid])
    penalty = np.concatenate([np.where(np.isin(natural, doc_ends) | (natural == total), 0.0, options.sentence_cut), np.full(len(grid), options.other_cut)])
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def best_cuts(positions, penalties, options: PackingOptions) -> tuple[list[int], float]:
    """Cuts (positions, ending with the last) of least total cost, and that cost.

    Ties go to the longest window.  ``positions`` must leave no gap longer than
    the sequence length.
    """
    import numpy as np

    length, fixed = options.length, options.window_cost
    at = np.concatenate([[0], np.asarray(positions, dtype=np.int64)])
    exact: dict[int, list[int]] = {}
    power = 1
    while power < length:
        where = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[where] == at - power)).tolist():
            exact.setdefault(j, []).append(int(where[j]))
        power *= 2
    place, extra = at.tolist(), [0.0, *np.asarray(penalties, dtype=float).tolist()]
    cost, back, value = [0.0] * len(place), [0] * len(place), [0.0] * len(place)
    queue, head = [0], 0
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[head]] < here - length:
            head += 1
        i = queue[head]
        best = value[i] + length - here
        for e in exact.get(j, ()):
            if cost[e] < best:
                best, i = cost[e], e
        cost[j] = best = best + fixed + extra[j]
        back[j] = i
        value[j] = own = best + here
        while len(queue) > head and value[queue[-1]] > own:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1], cost[-1]


class _Packer:
    """Packs one partition's stream of documents, block by block."""

    def __init__(self, options: PackingOptions, sentence_ids):
        self.options, self.sentence_ids = options, sentence_ids
        self.docs: list[tuple] = []  # doc_id, ids (bytes), first id still to pack, total
        self.held = 0
        self.sequence = 0

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        self.docs.append((doc_id, ids, 0, total))
        self.held += total

    def full(self) -> bool:
        return self.held >= self.options.block_ids

    def pieces(self, last: bool):
        import numpy as np

        if not self.docs:
            return
        rest = [ids[4 * a :] if a else ids for _, ids, a, _ in self.docs]
        stream = np.frombuffer(b"".join(rest), dtype="<u4")
        ends = np.cumsum([len(x) // 4 for x in rest])
        sentences = np.flatnonzero(self.sentence_ids[stream]) + 1
        cuts, _ = best_cuts(*candidate_cuts(len(stream), ends, sentences, self.options), self.options)
        kept = cuts if last else cuts[:-3]
        k, begin, doc_begin, ends = 0, 0, 0, ends.tolist()
        for cut in kept:
            at = begin
            while at < cut:
                doc_id, ids, first, total = self.docs[k]
                stop = min(cut, ends[k])
                start = first + at - doc_begin
                yield doc_id, start, stop - at, total, self.sequence, at - begin, ids[4 * start : 4 * (start + stop - at)]
                at = stop
                if stop == ends[k]:
                    doc_begin = stop
                    k += 1
            self.sequence += 1
            begin = cut
        if k < len(self.docs):
            doc_id, ids, first, total = self.docs[k]
            self.docs = [(doc_id, ids, first + begin - doc_begin, total), *self.docs[k + 1 :]]
        else:
            self.docs = []
        self.held -= begin


def _pack(path: str, options: PackingOptions, memo_size: int):
    schema = arrow_schema(PIECE_FIELDS)

    def table(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def pack(batches):
        import numpy as np
        from pyspark import TaskContext

        tokenizer = ChunkTokenizer.of(path, memo_size)
        vocabulary = tokenizer.model.get_vocab()
        sentence_ids = np.zeros(len(tokenizer.ends), dtype=bool)
        sentence_ids[[i for w, i in vocabulary.items() if w.endswith("</w>") and w[:-4] and not w[:-4].strip(".!?")]] = True
        end = np.array([options.end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        packer = _Packer(options, sentence_ids)

        def out(last):
            rows = [(d, s, n, t, first + q, o, x) for d, s, n, t, q, o, x in packer.pieces(last)]
            if rows:
                yield table(rows)

        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j in slices(texts):
                for doc_id, ids in zip(doc_ids[i:j], tokenizer.encode(texts[i:j])):
                    packer.add(doc_id, ids + end)
                    if packer.full():
                        yield from out(False)
        yield from out(True)

    return pack


def pack(docs: DataFrame, options: PackingOptions | None = None, vocabulary: str | None = None, memo_size: int = 700_000) -> DataFrame:
    """Pieces of sequences: PIECE_FIELDS; ids are little-endian uint32 bytes."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_pack(vocabulary or vocabulary_path(), options or PackingOptions(), memo_size), spark_schema(PIECE_FIELDS))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
