"""SimHash fingerprints of whole texts."""

from __future__ import annotations

from itertools import accumulate

#: Fixed: the seed of the shingle hash.
SEED = 42


def shingles(words: list[bytes], width: int = 4) -> list[bytes]:
    """Space-joined runs of ``width`` words, repeats included; fewer words give the whole sequence."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    data, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    return [data[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :])]


def fingerprint(words: list[bytes], width: int = 4) -> int:
    """64 bits: each set if set in over half of the shingles' XXH64; no words give 0."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_digest
    data = shingles(words, width)
    if not data:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(data), 65_536):
        part = data[i : i + 65_536]
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in part]), dtype=np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(data)).tobytes(), "big")
