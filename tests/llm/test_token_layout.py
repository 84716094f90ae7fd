"""Token files: what their footers say, repeated ids, and a table without rows."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "word_bpe_49k.json"
DOCS = "doc_id long, text string, ids string, shard string, place string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def in_files(spark, path):
    """(doc_id, start, n_tokens, crc) by reading the files row by row, in their order."""
    files = sorted(glob.glob(f"{path}/*.parquet"), key=lambda f: f.split("part-")[1])
    at, out = 0, []
    for f in files:
        for r in pq.read_table(f).to_pylist():
            out.append((r["doc_id"], at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
            at += len(r["ids"])
    return out


@pytest.mark.parametrize("partitions", [1, 4])
def test_repeated_ids_start_where_they_lie(spark, tmp_path, partitions):
    rows = [(1, "a"), (1, "b b b b"), (1, "c c"), (None, "n"), (None, None), (0, "x " * 50), *[(7, "same")] * 9, (2, ""), (1, "a")]
    path = str(tmp_path / "t")
    token_files.write(docs_of(spark, rows), path, public_tokenizers.path(WORDS), 2, partitions)
    want = in_files(spark, path)
    got = [tuple(r) for r in token_files.index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == len(rows)
    ids = [-1 if i is None else i for i, *_ in want]
    assert ids == sorted(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_footers(spark, tmp_path, encoding):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(k, " ".join(rng.choice(words, 120))) for k in range(4000)]
    path = str(tmp_path / "t")
    token_files.write(docs_of(spark, rows), path, public_tokenizers.path(WORDS), 2, 2, encoding, row_group_bytes=256 << 10, page_bytes=16 << 10)
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups >= 3
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * (256 << 10)
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    if encoding == "dictionary":
                        assert column.has_dictionary_page and {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} & set(column.encodings)
                    else:
                        assert not column.has_dictionary_page and "DELTA_BINARY_PACKED" in column.encodings
    some = token_files.read(spark, path, ["doc_id", "ids"], F.col("doc_id").between(2500, 2503))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,2500)" in plan and "shard" not in plan
    assert sorted(r["doc_id"] for r in some.collect()) == [2500, 2501, 2502, 2503]


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(docs_of(spark, []), path, public_tokenizers.path(WORDS), 2)
    assert token_files.index(spark, path).count() == 0
    assert token_files.index(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_shards_grow_with_the_table(spark, tmp_path):
    small, large = str(tmp_path / "s"), str(tmp_path / "l")
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 122, 2000).astype(np.uint8)).decode() for _ in range(400)]
    docs_of(spark, list(enumerate(texts[:100]))).write.parquet(small)
    docs_of(spark, list(enumerate(texts))).write.parquet(large)
    n = [token_files.shards(spark.read.parquet(p), 50_000, 10**9) for p in (small, large)]
    assert 2 <= n[0] and 3 * n[0] <= n[1] <= 5 * n[0]
    assert token_files.shards(docs_of(spark, list(enumerate(texts))), 100_000, 10**9) == 8
