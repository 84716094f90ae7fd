"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes the tokens of every word.  A sequence of tokens is what merging would
give exactly if every adjacent pair is (the first merge across a border would also happen in the pair
alone), so the adjacent pairs of a whole batch of words are tested at once against a table of known
pairs; only words with a failing pair are merged exactly, in rank order.

Texts are cut at white space before words are looked up, where no token of the pre-tokenizer can span
the cut; words come from the tokenizer file's own pre-tokenizer, so any Unicode text is split alike.

Defined results: null text is the empty text; empty text gives no tokens; the strings of special tokens
inside a text become their ids (the library's default); repeated rows are encoded each; other columns
are not looked at.  A single very long word is merged in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomgraph.llm import _chunks, _store

#: Texts with white space that meets white space, but for one empty line, or that is neither space nor newline.
_APART = r"  | \n|\n |\n\n\n|\n\n\z|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word in Western letters, perhaps after a space, and marks after it: two words of the pre-tokenizer.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*]*)")
_LONG = 200  # longer words are not kept in tables


class SpeculativeBPE:
    """Encoder and decoder of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.none = len(merges)
        self.longest: dict[str, int] = {}
        for token in self.vocab:
            self.longest[token[0]] = max(self.longest.get(token[0], 0), len(token))
        self.n = max([*self.vocab.values(), *self.special.values()]) + 1
        self.rank = {a * self.n + b: rank for (a, b), (rank, _) in self.merge.items()}
        unit = {c: b for b, c in _byte_alphabet().items()}
        self.alphabet = dict(_byte_alphabet())
        self.bytes = [b""] * self.n
        self.text = [""] * self.n
        for token, i in self.vocab.items():
            self.bytes[i], self.text[i] = bytes(unit[c] for c in token), token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(self.n)]
        self.pair_ok: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = _chunks.RaggedTable(self._encode_chunks)

    # -- words ---------------------------------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        """Greedy longest match."""
        vocab, longest, at, end, out = self.vocab, self.longest, 0, len(word), []
        while at < end:
            for stop in range(min(end, at + longest[word[at]]), at, -1):
                if (i := vocab.get(word[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging of single-character tokens: lowest rank first, then leftmost."""
        n, ids = len(ids), list(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or (j := after[k]) >= n or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[k] < n:
                before[after[k]] = k
                if m := self.merge.get((new, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, new, ids[after[k]], m[1]))
            if (p := before[k]) >= 0 and (m := self.merge.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [i for i, x in zip(ids, alive, strict=True) if x]

    def exact(self, word: str) -> list[int]:
        ids = [self.vocab[c] for c in word]
        return self.merged(ids) if len(ids) > 40 else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        """As ``merged``, without a heap: for a short word the ranks of all pairs are looked over each time."""
        n, rank, none = self.n, self.rank.get, self.none
        ranks = [rank(a * n + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            ids[k] = self.made[low]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank(ids[k] * n + ids[k + 1], none)
            if k:
                ranks[k - 1] = rank(ids[k - 1] * n + ids[k], none)
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Propose all, test all adjacent pairs at once, merge the failing words exactly."""
        proposed = [self.propose(w) for w in words]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(words)), size)
        inside = owner[1:] == owner[:-1]
        pairs, inverse = np.unique((flat[:-1] * self.n + flat[1:])[inside], return_inverse=True)
        _chunks.drop_latest(self.pair_ok, 2_000_000)
        ok = np.fromiter(map(self._compatible, pairs.tolist()), bool, len(pairs))
        for k in np.unique(owner[1:][inside][~ok[inverse]]).tolist():
            proposed[k] = self.exact(words[k])
        return proposed

    def _compatible(self, pair: int) -> bool:
        known = self.pair_ok.get(pair)
        if known is None:
            a, b = divmod(pair, self.n)
            known = self.pair_ok[pair] = self.exact(self.text[a] + self.text[b]) == [a, b]
        return known

    # -- texts ---------------------------------------------------------------------------------
    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts between safe cuts."""
        split = [self._split(c) for c in chunks]
        _chunks.drop_latest(self.words, 300_000)
        new = list({w for ws in split for w in ws if w not in self.words})
        fresh = dict(zip(new, self.encode_words(new), strict=True))
        self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= _LONG)
        get = self.words.get
        return [[i for w in ws for i in (get(w) or fresh[w])] for ws in split]

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk in the alphabet of the vocabulary."""
        if plain := _PLAIN.fullmatch(chunk):
            return [w.encode().decode("latin-1").translate(self.alphabet) for w in plain.groups() if w]
        return [w for w, _ in self.pre.pre_tokenize_str(chunk)]

    def _encode_any(self, text: str) -> list[int]:
        """Special tokens and any white space, a text at a time."""
        parts = self.splitter.split(text) if self.splitter else [text]
        return [i for p in parts for i in ([self.special[p]] if p in self.special else chain.from_iterable(self._encode_chunks([p])))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids.

        Texts are cut where the pre-tokenizer always cuts: before a space between visible characters, and
        around a newline.  Texts in which white space meets white space in other ways are encoded apart.
        """
        texts = _chunks.texts_of(texts)
        apart = pc.match_substring_regex(texts, _APART)
        for token in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, token))
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(apart, "", texts), " ", "\0 "), "\n", "\0\n\0")
        ids, size = self.table.expand(pc.split_pattern(cut, "\0"))
        if slow := np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            at = np.cumsum(size) - size
            own = [self._encode_any(texts[k].as_py()) for k in slow]
            pieces, last = [], 0
            for k, new in zip(slow, own, strict=True):
                pieces += [ids[last : at[k]], np.array(new, np.int64)]
                last, size[k] = at[k], len(new)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, size

    def decode(self, ids: list[int]) -> str:
        """As the library with ``skip_special_tokens=False``; invalid UTF-8 becomes U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def _byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(path: str) -> SpeculativeBPE:
    """One encoder for each file and worker process."""
    return _store.cached(f"bpe {path}", lambda: SpeculativeBPE(path))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    bpe = load(path)
    for part in _store.slices(batches, "text"):
        ids, size = bpe.encode(part.column("text"))
        yield part.column("doc_id"), ids, size


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``."""
    _store.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids, size in _encoded(batches, tokenizer_path):
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    _store.prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for part in _store.slices(batches, "ids"):
            texts = [bpe.decode(ids or []) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode every text in one Python pass.

    (doc_id, n_tokens long, ids_sha256, decoded_sha256): digests of the decimal ids joined by commas and of
    the text decoded from those ids.
    """
    _store.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for doc, ids, size in _encoded(batches, tokenizer_path):
            flat, at, listed, decoded = ids.tolist(), 0, [], []
            for n in size.tolist():
                own = flat[at : at + n]
                at += n
                listed.append(hashlib.sha256(",".join([bpe.decimal[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc, pa.array(size), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
