"""Token ids in Parquet: list columns, dictionary or delta encoded, with row groups and pages of set sizes.

A token data set is a folder of Parquet files in ascending document order.  Columns: ``doc_id``, ``shard``
(the range partition), ``place`` (ascending in file order), ``n_tokens``, ``ids`` (list of int).  Small row
groups with page indexes let a reader take a few documents, or only the metadata columns, without decoding the
rest.  The number of shards comes from the size of the table; rows that share a doc_id may lie in several.

Defined results: null text is the empty text (the end id alone); rows that share a doc_id are ordered by a
hash of their text; a null doc_id comes first; no rows give a data set without rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import _chunks, _store

SCHEMA = "doc_id long, ids array<int>, n_tokens long"


#: A word in Western letters and marks after it: two words of a pre-tokenizer that parts letters and marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*]*)")
#: A letter, marks and white space: there the marks become a chunk of their own, so a word has one form, not many.
_MARKS = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:#$%&*]+)([ \\n])"


class ChunkEncoder:
    """The library's ids, computed once for each text between spaces or newlines.

    Right for tokenizers that drop white space before merging, never join what stands on its two sides,
    part letters from marks and end every word with a token of its own kind (``</w>``).  New words go to the
    library in lines of many; the tokens that end words part its answer.  Other chunks (special tokens, other
    white space, other scripts) go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}
        self.words: dict[str, tuple[int, ...]] = {"": ()}
        self.table = _chunks.RaggedTable(self._new, limit=400_000)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], line: int = 500) -> None:
        for k in range(0, len(words), line):
            own = words[k : k + line]
            ids = self._library([" ".join(own)])[0]
            parts, at = [], 0
            for stop, i in enumerate(ids, 1):
                if i in self.ends:
                    parts.append(tuple(ids[at:stop]))
                    at = stop
            self.words.update(zip(own, parts if len(parts) == len(own) else map(tuple, self._library(own)), strict=True))

    def _new(self, chunks: list[str]) -> list[list[int]]:
        _chunks.drop_latest(self.words, 250_000)
        match = _PLAIN.fullmatch
        split = [m.groups() if (m := match(c)) and len(c) < 200 else None for c in chunks]
        words = self.words
        self._learn(list({w for s in split if s for w in s if w not in words}))
        other = iter(self._library([c for c, s in zip(chunks, split, strict=True) if not s]))
        return [words[s[0]] + words[s[1]] if s else next(other) for s in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids."""
        apart = pc.replace_substring_regex(_chunks.texts_of(texts), _MARKS, r"\1 \2\3")
        return self.table.expand(pc.split_pattern(pc.replace_substring(apart, "\n", " "), " "))


def _encoder(path: str) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _store.cached(f"chunks {path}", lambda: ChunkEncoder(path))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n_tokens) in the order of the rows; ``end_id`` ends every document."""
    _store.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for part in _store.slices(batches, "text", 4 << 20):
            ids, size = encoder.encode(part.column("text"))
            ends = np.cumsum(size)
            flat = np.insert(ids, ends, end_id).astype(np.int32)
            offsets = np.concatenate([[0], ends + np.arange(1, len(size) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(size + 1)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def shards(docs: DataFrame, shard_bytes: int, least_bytes: int = 4 << 20) -> int:
    """How many shards a table makes: of ``shard_bytes``, or smaller ones for a small table to use the session's partitions.

    The size is the stored one or, where a plan has no statistics, the bytes of the texts.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # what a plan without statistics states
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    session = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // shard_bytes), min(session, -(-size // least_bytes)))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, shard_bytes: int = 128 << 20) -> None:
    """Write the token data set of (doc_id, text).

    ``encoding``: "dictionary" (ids as bit-packed codes) or "delta" (delta binary packing, for vocabularies
    far beyond a page's dictionary).  Texts, not ids, are sorted: they are the smaller side of the exchange.
    ``partitions`` sets the number of shards; else it follows from the table's size (``shards``).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or shards(docs, shard_bytes)
    # equal rows may go to any shard, so the row's place in the input parts even a third of all rows of one id
    keys = ["doc_id", "_hash", "_row"]
    ordered = own.select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tokens = tokenize(ordered, tokenizer_path, end_id).select("doc_id", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place"), "n_tokens", "ids")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.page.row.count.limit": 1000,
    }
    tokens.write.mode("overwrite").options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a data set; only the pages of ``columns`` that ``where`` can match are decoded."""
    df = spark.read.schema("doc_id long, shard int, place long, n_tokens long, ids array<int>").parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, place, n_tokens, ids_crc32) of the ids as they stand in the files."""
    _store.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _store.slices(batches, "ids", 16 << 20):
            lists = part.column("ids")
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            offsets = lists.offsets.to_numpy()
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), part.column("place"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    return read(spark, path, ["doc_id", "shard", "place", "ids"]).mapInArrow(run, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where every document stands in the whole id sequence, and its checksum.

    A shard is one range partition of bounded size; of all shards only one row each meets in one task.
    """
    rows = checksums(spark, path)
    each = read(spark, path, ["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = each.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("base"))
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, "shard").select("doc_id", (F.col("base") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
