"""Words of texts as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from loomgraph.llm._chunks import ColumnTable, texts_of

_G = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R30, _R27, _R31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _R30)) * _A
    x = (x ^ (x >> _R27)) * _B
    return x ^ (x >> _R31)


#: The hash of the empty piece before or after white space at the ends of a text.
_EMPTY = np.uint64(xxhash.xxh3_64_intdigest(b""))


class WordHashes(ColumnTable):
    """Hashes of words, each computed once."""

    def __init__(self, limit: int = 500_000):
        super().__init__(lambda new: [np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in new), np.uint64, len(new))], limit)


def split(texts: pa.Array) -> pa.ListArray:
    """Lower-case (A-Z) words between ASCII white space; empty pieces are left in and stand for nothing."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts_of(texts)))


def shingle_sets(texts: pa.Array, k: int, words: WordHashes) -> list[np.ndarray]:
    """Each document's distinct k-word shingles, sorted; fewer words are one shingle, no words none."""
    (flat,), counts = words.lookup(split(texts))
    real = flat != _EMPTY
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(counts)])])
    flat = flat[real]
    ends = np.cumsum(counts)
    z = flat.copy()
    for j in range(1, min(k, len(z))):  # a batch may hold fewer words than a shingle
        z[: len(z) - j] = mix(z[: len(z) - j]) * _G + flat[j:]
    z = mix(z)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= k:
            own = np.sort(z[a : b - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            for h in flat[a:b]:
                short = mix((np.array([short], np.uint64) * _G) + h)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(flat[:0])
    return out
