"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of template tokens: numbers, units after numbers, and names
(capitalised words) are replaced by typed placeholders, other words are lower-cased and stripped of marks.
There are four readings: capitalised words are names inside a sentence only, everywhere, or nowhere (case does
not matter then), and all tokens are literal.  Windows of ``window`` tokens of every reading are hashed and
joined by hash, so a name or number that one reading takes wrongly does not hide the others.  Windows that match
one item at one offset are lined up, and the slots under them are compared: within an occurrence, equal values
must stand for equal values.  Each offset, each run of near offsets and all together are judged, also without the
readings that take every capitalised word for a name; a text repeats an item if one of them passes, and that one is reported: "verbatim" if all slots agree, "filled anew" if
slots differ consistently.  ``running`` literal tokens in a row always count; matches whose slots contradict each other count only where ``window`` or more
literal tokens in a row agree.  A window of placeholders alone is compared as it literally stands: it would match any
row of numbers, and such matches grow with the product of two tables of numbers.

The item side of the join is bounded: items go to the executors in blocks of at most ``block_windows``
windows, one pass over the texts for each block; a pair of document and item lies in one block.

Defined results: null and empty texts match nothing; items shorter than ``window`` tokens match as a whole;
items without tokens match nothing; repeated rows are reported each; equal items are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _chunks, _store
from loomgraph.llm._words import _G, mix

_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,/:]*(?:st|nd|rd|th)?%?")
#: Units that may follow a number, in the corpus's four languages.
UNITS = frozenset(
    "km m cm mm mi miles mile feet ft inches inch kg g mg lb lbs pounds pound tons ton l ml liters litres gallons hours hour hrs minutes minute min seconds second sec "
    "days day weeks week months month years year dollars dollar cents cent euros euro percent degrees mph kph kmh "
    "meter kilometer gramm kilogramm liter stunden stunde minuten sekunden tage tag wochen woche monate monat jahre jahr prozent grad "
    "mètres mètre kilomètres grammes kilogrammes litre heures heure secondes jours jour semaines semaine mois ans an pourcent degrés "
    "metros metro kilómetros gramos kilos litros litro horas hora minutos segundos días día semanas semana meses mes años año grados".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUM, UNIT, NAME = (np.uint64(xxhash.xxh3_64_intdigest(p)) for p in ("<num>", "<unit>", "<name>"))
#: Sets of readings (bits) that are judged together: all, all but names at sentence starts, and names inside sentences.
_TOGETHER = (0b1111, 0b1101, 0b0001)
_TITLE, _ENDS, _IS_NUM, _IS_UNIT, _BLANK = 1, 2, 4, 8, 16


def _describe(chunk: str) -> tuple[int, int]:
    """Hash and flags of a chunk between spaces; a newline is a blank chunk that ends a sentence."""
    word = _EDGE.sub("", chunk)
    ends = _ENDS if chunk == "\n" or chunk.rstrip("\"')]»”").endswith((".", "!", "?", ":")) else 0
    if not word:
        return 0, _BLANK | (ends if chunk == "\n" else 0)
    low = word.lower()
    flags = ends | (_TITLE if word[0].isupper() and word[1:].islower() else 0) | (_IS_NUM if _NUMBER.fullmatch(low) else 0) | (_IS_UNIT if low in UNITS else 0)
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")), flags


def _described(chunks: list[str]) -> list[np.ndarray]:
    found = [_describe(c) for c in chunks]
    return [np.array([h for h, _ in found], np.uint64), np.array([f for _, f in found], np.uint8)]


class Templates:
    """Template tokens of whole batches of texts."""

    def __init__(self) -> None:
        self.table = _chunks.ColumnTable(_described, 300_000)

    def tokens(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(template hashes of every reading, literal hashes, tokens of each text).  They differ in slots."""
        cut = pc.split_pattern(pc.replace_substring(_chunks.texts_of(texts), "\n", " \n "), " ")
        (literal, flags), counts = self.table.lookup(cut)
        first = np.cumsum(counts) - counts
        starts = np.concatenate([[True], (flags[:-1] & _ENDS) > 0]) if len(flags) else np.zeros(0, bool)
        starts[first[counts > 0]] = True
        keep = (flags & _BLANK) == 0
        # a blank chunk between two words hands its sentence border on
        border = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1)) if len(starts) else np.zeros(0, np.int64)
        last_word = np.concatenate([[-1], np.maximum.accumulate(np.where(keep, np.arange(len(keep)), -1))[:-1]]) if len(keep) else np.zeros(0, np.int64)
        starts = border > last_word
        sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])])
        literal, flags, starts = literal[keep], flags[keep], starts[keep]
        number = (flags & _IS_NUM) > 0
        unit = (flags & _IS_UNIT) > 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        title = (flags & _TITLE) > 0
        plain = np.where(number, NUM, np.where(unit, UNIT, literal))
        free = ~(number | unit)
        return [np.where(title & ~starts & free, NAME, plain), np.where(title & free, NAME, plain), plain, literal], literal, sizes


def window_hashes(tokens: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` tokens from each place on; 0 where they would leave the text."""
    n = len(tokens)
    if n < window:
        return np.zeros(n, np.uint64)
    # hashes of 1, 2, 4, .. tokens; a window is put together of those that its length has as bits
    part, span, h, held = tokens, 1, None, 0
    while True:
        if window & span:
            h = part if h is None else mix(h[: n - held - span + 1]) * _G + part[held : n - span + 1]
            held += span
        if held == window:
            break
        part, span = mix(part[: len(part) - span]) * _G + part[span:], 2 * span
    h = np.concatenate([mix(h) | np.uint64(1), np.zeros(window - 1, np.uint64)])
    ends = np.repeat(np.cumsum(sizes), sizes)
    h[np.arange(n) + window > ends] = 0
    return h


class Index:
    """Windows of a block of items by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        templates = Templates()
        self.window = window
        readings, literal, size = templates.tokens(pa.array([t for _, t in items], pa.string()))
        ends = np.cumsum(size)
        self.items = [(i, [r[e - n : e] for r in readings], literal[e - n : e]) for (i, _), e, n in zip(items, ends.tolist(), size.tolist(), strict=True)]
        # (item, place, bits of the readings that have this hash there)
        self.by_size: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for k, (_, own, plain) in enumerate(self.items):
            w = min(window, len(plain))
            if w:
                table = self.by_size.setdefault(w, {})
                hashes = []
                for r in own:
                    h = window_hashes(r, np.array([len(plain)]), w)[: len(plain) - w + 1]
                    words = np.concatenate([[0], np.cumsum(r == plain)])
                    # placeholders alone say nothing of an item: such windows are looked up as they literally stand
                    hashes.append(np.where(words[w:] > words[:-w], h, np.uint64(0)).tolist())
                for at, there in enumerate(zip(*hashes, strict=True)):
                    for h in set(there) - {0}:
                        table.setdefault(h, []).append((k, at, sum(1 << r for r, other in enumerate(there) if other == h)))
        self.sorted = {w: np.array(sorted(t), np.uint64) for w, t in self.by_size.items()}
        self.bits = {}
        for w, keys in self.sorted.items():
            self.bits[w] = np.zeros(1 << 20, bool)
            self.bits[w][(keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, readings: list[np.ndarray], literal: np.ndarray, size: np.ndarray, coverage: float, running: int) -> list[tuple[int, int, int, int, int, int, str]]:
        """(text, item id, windows found, windows of the item, longest literal run, slots that differ, kind) of texts that repeat an item."""
        ends = np.cumsum(size)
        hits: dict[tuple[int, int], dict[int, set[tuple[int, int]]]] = {}
        for w, keys in self.sorted.items():
            before: list[np.ndarray] = []
            for token in readings:
                h = window_hashes(token, size, w)
                at = np.flatnonzero(self.bits[w][(h >> np.uint64(44)).astype(np.int64)] & (h > 0))
                for other in before:
                    at = at[other[at] != h[at]]
                before.append(h)
                at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
                doc = np.searchsorted(ends, at, side="right")
                for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                    for k, i, bits in self.by_size[w][int(h[p])]:
                        hits.setdefault((d, k), {}).setdefault(p - i, set()).add((i, bits))
        out = []
        for (d, k), lines in sorted(hits.items()):
            seen, leaks = set(), []
            for wanted in _TOGETHER:
                chosen = {o: frozenset(v for v in places if v[1] & wanted) for o, places in lines.items()}
                chosen = {o: places for o, places in chosen.items() if places}
                for offsets in _occurrences(chosen, self.window):
                    one = tuple((o, chosen[o]) for o in offsets)
                    if one and self._may_leak(k, one, coverage, running) and one not in seen:
                        seen.add(one)
                        m = self._judged(d, k, dict(one), literal, wanted)
                        if _leaks(m, self.window, coverage, running):
                            leaks.append(m)
            if leaks:
                out.append(max(leaks, key=lambda m: (m[6] != "inconsistent", m[2], -m[5], m[4])))
        return out

    def _may_leak(self, k: int, one: tuple, coverage: float, running: int) -> bool:
        """Whether the windows are enough, were all of them literal and consistent."""
        total = len(self.items[k][2])
        w = min(self.window, total)
        if max(len({i for i, _ in places}) for _, places in one) + w - 1 >= running:
            return True
        return len({i for _, places in one for i, _ in places}) >= coverage * (total - w + 1)

    def _judged(self, d: int, k: int, lines: dict[int, frozenset[tuple[int, int]]], literal: np.ndarray, wanted: int) -> tuple[int, int, int, int, int, int, str]:
        """What the windows of one occurrence amount to."""
        item, readings, own_literal = self.items[k]
        w = min(self.window, len(own_literal))
        found, run, map_to, clash, differ = set(), 0, {}, False, 0
        for offset, places in lines.items():
            covered, slot, own = np.zeros(len(own_literal), bool), np.zeros(len(own_literal), bool), own_literal.copy()
            for i, bits in places:
                token = readings[((bits & wanted) & -(bits & wanted)).bit_length() - 1][i : i + w]
                here = token != own_literal[i : i + w]
                covered[i : i + w] = True
                slot[i : i + w] |= here
                own[i : i + w][here] = token[here]
            inside = np.flatnonzero(covered)
            same = own_literal[inside] == literal[inside + offset]
            longest = here = 0
            for x, y in zip(inside.tolist(), same.tolist(), strict=True):
                here = here + 1 if y and (x == 0 or covered[x - 1]) else int(y)
                longest = max(longest, here)
            run = max(run, longest)
            slots = inside[slot[inside]]
            for a, b, t in zip(own_literal[slots].tolist(), literal[slots + offset].tolist(), own[slots].tolist(), strict=True):
                clash |= map_to.setdefault((t, a), b) != b
                differ += a != b
            found.update(i for i, _ in places)
        kind = "inconsistent" if clash else "filled anew" if differ else "verbatim"
        return d, item, len(found), len(own_literal) - w + 1, run, int(differ), kind


def _occurrences(lines: dict, near: int) -> list[tuple[int, ...]]:
    """Offsets that may be one occurrence: each alone, runs of near ones (words put in or left out), and all (long passages between)."""
    offsets = sorted(lines)
    cuts = [0, *(j for j in range(1, len(offsets)) if offsets[j] - offsets[j - 1] > near), len(offsets)]
    return list(dict.fromkeys([*((o,) for o in offsets), *(tuple(offsets[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), tuple(offsets)]))


SCHEMA = "doc_id long, item_id long, windows long, item_windows long, literal_run long, slots_changed long, kind string"


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded number of windows (a text has no more windows than half its characters, plus one)."""
    items: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        size = len(row["text"]) // 2 + 1
        if items and held + size > block_windows:
            yield items
            items, held = [], 0
        items.append((row["item_id"], row["text"]))
        held += size
    if items:
        yield items


def _leaks(found: tuple, window: int, coverage: float, running: int) -> bool:
    """``running`` literal tokens in a row, or enough of the item's windows, with consistent slots or a literal run of a window's length."""
    _, _, n, total, run, _, kind = found
    return run >= running or n >= coverage * total and (kind != "inconsistent" or run >= min(window, total))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.4, block_windows: int = 2_000_000, running: int = 13) -> DataFrame:
    """One row for each document and item that it repeats: ``SCHEMA``.

    ``coverage``: share of an item's windows that must stand in the text, unless ``running`` (at least ``window``)
    literal tokens of it stand there in a row, however long the item is.
    """
    spark = _store.prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for items in _blocks(benchmark, window, block_windows):
        index = spark.sparkContext.broadcast(Index(items, window))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            templates = _store.cached("templates", Templates)
            for part in _store.slices(batches, "text"):
                ids = part.column("doc_id")
                found = index.value.search(*templates.tokens(part.column("text")), coverage, running)
                columns = [ids.take(pa.array([m[0] for m in found], pa.int64())), *(pa.array([m[k] for m in found], pa.int64()) for k in range(1, 6)), pa.array([m[6] for m in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "windows", "item_windows", "literal_run", "slots_changed", "kind"])

        parts.append(own.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.4, block_windows: int = 2_000_000, running: int = 13) -> DataFrame:
    """The rows of ``docs`` that repeat no item, with all their columns; nothing is shuffled."""
    spark = _store.prepare(docs.sparkSession)
    for items in _blocks(benchmark, window, block_windows):
        index = spark.sparkContext.broadcast(Index(items, window))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            templates = _store.cached("templates", Templates)
            for part in _store.slices(batches, "text"):
                bad = {m[0] for m in index.value.search(*templates.tokens(part.column("text")), coverage, running)}
                yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
