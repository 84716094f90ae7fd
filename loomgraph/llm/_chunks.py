"""Dictionary-coded text chunks: look a chunk up once, then work on whole batches of numbers.

Texts are cut and chunks numbered by Arrow kernels; Python sees only chunks that are new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def drop_latest(table: dict, limit: int) -> None:
    """Forget the latest keys: what came first holds the most frequent part of a text's words."""
    for _ in range(len(table) - limit):
        table.popitem()


def texts_of(column: pa.Array) -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


class Codes:
    """Numbers keys in the order in which they come; the first ``limit`` are kept between batches."""

    def __init__(self, limit: int):
        self.limit, self.known = limit, pa.array([], pa.string())

    def number(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes of all keys of all lists, one after the other; the number of keys of each list; new keys."""
        self.known = self.known[: self.limit]
        found = lists.flatten().dictionary_encode()
        at = pc.index_in(found.dictionary, value_set=self.known)
        new = found.dictionary.filter(pc.is_null(at))
        codes = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        codes[codes < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        return codes[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64), new.to_pylist()


class RaggedTable:
    """Chunk -> integer sequence, computed once per chunk; at most ``limit`` chunks stay between batches.

    ``compute`` gets the list of new chunks and returns one integer sequence for each.
    """

    def __init__(self, compute: Callable[[list], Sequence[Sequence[int]]], limit: int = 300_000):
        self.compute, self.codes = compute, Codes(limit)
        self.flat, self.size, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def expand(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences of all lists of chunks, one after the other, and the length for each list."""
        limit = self.codes.limit
        if len(self.size) > limit:
            self.start, self.size = self.start[:limit], self.size[:limit]
            self.flat = self.flat[: int(self.start[-1] + self.size[-1])]
        code, counts, pending = self.codes.number(lists)
        if pending:
            new = self.compute(pending)
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new), np.int64, int(sizes.sum()))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, sizes])
        size = self.size[code]
        ends = np.cumsum(size)
        where = np.repeat(self.start[code] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        upto = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        return self.flat[where], upto[last] - upto[last - counts]


class ColumnTable:
    """Chunk -> one number in each of several columns, computed once per chunk."""

    def __init__(self, compute: Callable[[list], Sequence[np.ndarray]], limit: int = 500_000):
        self.compute, self.codes = compute, Codes(limit)
        self.columns = [np.asarray(c) for c in compute([])]

    def lookup(self, lists: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns for all chunks of all lists, one after the other, and each list's number of chunks."""
        self.columns = [c[: self.codes.limit] for c in self.columns]
        code, counts, pending = self.codes.number(lists)
        if pending:
            self.columns = [np.concatenate([c, n]) for c, n in zip(self.columns, self.compute(pending), strict=True)]
        return [c[code] for c in self.columns], counts
