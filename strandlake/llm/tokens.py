"""Whole-text tokenisation with a public vocabulary, memoised by word.

White space never reaches the vocabulary's model and nothing in its normaliser
or pre-tokeniser crosses ASCII white space, so the ids of a text are the ids
of its white-space chunks in order.  Each Python worker keeps a bounded cache
of chunks and of the letter runs that chunks are made of; what it lacks is
encoded together, once per call.

Special tokens spelt out in a text become their ids, as a plain call makes them;
they are matched before anything is lower-cased, so texts that hold one in any
case keep the case of all their chunks.
"""

from __future__ import annotations

import os

import numpy as np

#: Fixed: ASCII punctuation; none of it is a letter, a digit or white space.
_PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_LOADED: dict[tuple, "ChunkTokenizer"] = {}


def _letters(chunk: bytes) -> bool:
    if chunk.isalpha():
        return True
    word = chunk.decode("utf-8", "surrogatepass")
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """encode(texts) -> for each text its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, memo_size: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: What all special tokens begin with, in any case; a text without it holds none.
        self.opening = os.path.commonprefix(self.special)[:2] if self.special else "\0"
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo_size = memo_size
        self.parts: dict[bytes, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, memo_size: int = 700_000) -> "ChunkTokenizer":
        """One for each worker process, so that the memo outlives a task."""
        key = (path, memo_size)
        if key not in _LOADED:
            _LOADED[key] = cls(path, memo_size)
        return _LOADED[key]

    def _encode_letters(self, words: list[bytes]) -> None:
        """Into the cache: words of letters below U+0250.  Each is one pre-token, which ends with one
        end-of-word id, so that all are encoded as one text."""
        text = b" ".join(words).decode()
        # of such words the normaliser changes nothing but case
        ids = np.array(self.letters.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words) or stops[-1] != 4 * len(ids):
            raise AssertionError("a word of letters must end with one end-of-word id")
        data, stops = ids.tobytes(), stops.tolist()
        self.parts.update(zip(words, [data[i:j] for i, j in zip([0, *stops], stops)]))

    def _encode_new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct chunks.  Letters with ASCII punctuation after them are two pre-tokens; both come
        from the cache of parts."""
        parts = self.parts
        if len(parts) > self.memo_size:
            parts.clear()
        found = dict(zip(chunks, map(parts.get, chunks)))
        if b"" in found:
            found[b""] = b""
        letters, other, cut = [], [], []
        for chunk in [c for c, ids in found.items() if ids is None]:
            if chunk.isalpha():
                letters.append(chunk)
                continue
            stem = chunk.rstrip(_PUNCTUATION)
            if not _letters(stem):
                other.append(chunk)
            elif len(stem) == len(chunk):
                letters.append(chunk)
            else:
                tail = chunk[len(stem) :]
                cut.append((chunk, stem, tail))
                if stem not in parts:
                    letters.append(stem)
                if tail not in parts:
                    other.append(tail)
        letters = list(set(letters))
        for i in range(0, len(letters), 50_000):
            self._encode_letters(letters[i : i + 50_000])
        other = list(set(other))
        for chunk, e in zip(other, self.model.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in other], add_special_tokens=False)):
            parts[chunk] = np.array(e.ids, dtype="<u4").tobytes()
        found.update([(chunk, parts[stem] + parts[tail]) for chunk, stem, tail in cut])
        found.update([(c, parts[c]) for c, ids in found.items() if ids is None])
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Chunks are cut and numbered in Arrow; Python sees each distinct chunk of a call once, and the ids of
        all texts are gathered from those of the distinct chunks as arrays."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        raw = pa.array([t or "" for t in texts], pa.string())
        lower = pc.ascii_lower(raw)
        if any(self.opening in t for t in texts if t):
            for token in self.special:
                lower = pc.if_else(pc.match_substring(lower, token.lower()), raw, lower)
        lists = pc.ascii_split_whitespace(lower)
        numbered = lists.values.dictionary_encode()
        chunks = numbered.dictionary.cast(pa.binary()).to_pylist()
        found = self._encode_new(chunks)
        coded = [found[c] for c in chunks]
        sizes = np.array([len(x) // 4 for x in coded], dtype=np.int32)
        table = np.frombuffer(b"".join(coded), dtype="<u4")
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        which = numbered.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        stops = np.cumsum(each, dtype=np.int32)
        place = np.repeat(first[which] - stops + each, each)
        place += np.arange(len(place), dtype=np.int32)
        data = table[place].tobytes()
        ends = (np.concatenate([[0], stops]).astype(np.int64)[lists.offsets.to_numpy()] * 4).tolist()
        return [data[i:j] for i, j in zip(ends, ends[1:])]


def slices(texts: list, limit: int = 6_000_000):
    """Start and end of runs of texts of about ``limit`` characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
