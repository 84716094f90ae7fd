"""Archives: payloads that hold what stands between records, cut at every place, come back byte for byte."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _store, warc

PAGES = "page_id long, url string, html string, digest string, chunk string"


def written(spark, path, pages, **options):
    df = spark.createDataFrame([(i, u, h, "d", "c") for i, u, h in pages], PAGES)
    with _store.Workspace(spark, "test") as space:
        warc.write_archives(df, path, space, **options)
    return warc.read_archives(spark, path)


def same(table, pages):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.payloads(table).collect()), key=str)
    bodies = [(i, (h or "").encode()) for i, _, h in pages]
    assert got == sorted(((i, len(b), hashlib.sha256(b).hexdigest()) for i, b in bodies), key=str)


MARK = warc.VERSION
SHAPES = ["x\r\n\r\n" + MARK, MARK + "\r\nhello", MARK, "\r\n" + MARK + "\r\n", "\r\n\r\n", "\r\n", MARK + MARK, "WARC", "/1.1\r\n", warc.BETWEEN * 3, "a" + warc.BETWEEN, "\r\n\r\n\r\n" + MARK + "\r\n\r\n"]


def test_marks_come_back(spark, tmp_path):
    pages = [(k, f"u{k}", h) for k, h in enumerate(SHAPES)]
    for chunk in (5, 7, 64, 65536):
        table = written(spark, str(tmp_path / f"w{chunk}"), pages, chunk_bytes=chunk)
        assert table.where("NOT whole OR contains(cast(chunk AS string), 'WARC/1.1')").count() == 0
        same(table, pages)


def test_marks_around_every_cut(spark, tmp_path):
    size = 48
    pages = [(k, "u", "é" * (k % 3) + "y" * (size - 24 + k) + warc.BETWEEN + "tail" + MARK + "\r\n" + "z" * k) for k in range(40)]
    table = written(spark, str(tmp_path / "w"), pages, chunk_bytes=size, revisit_bytes=10**6)
    assert table.agg(F.max(F.octet_length("chunk"))).first()[0] <= size
    same(table, pages)


def test_revisits_name_a_record(spark, tmp_path):
    body = "same " * 60
    pages = [(5, "a", body), (3, "b", body), (3, "b", body), (9, None, body), (None, "n", body), (None, "n", "short"), (7, "c", "other")]
    table = written(spark, str(tmp_path / "w"), pages, chunk_bytes=64)
    same(table, pages)
    firsts = {r["record_id"].split("#")[0] for r in table.where("record_type = 'response'").collect()}
    revisits = table.where("record_type = 'revisit'").collect()
    assert sorted(r["page_id"] for r in revisits) == [5, 9]
    assert all(r["refers_to"] == 3 and r["refers_to_record"] in firsts for r in revisits)


def test_no_pages(spark, tmp_path):
    table = written(spark, str(tmp_path / "w"), [])
    assert table.count() == 0 and warc.payloads(table).count() == 0


def test_damage_raises(spark, tmp_path):
    pages = [(1, "u", "abc" * 100), (2, "v", "short")]
    table = written(spark, str(tmp_path / "w"), pages, chunk_bytes=64)
    same(table, pages)
    for broken in (
        table.where("NOT (page_id = 1 AND chunk_no = 2)"),
        table.where("NOT (page_id = 1 AND chunk_no = 4)"),
        table.withColumn("chunk", F.when(F.col("chunk_no") == 1, F.encode(F.lit("zz"), "UTF-8")).otherwise(F.col("chunk"))),
        table.withColumn("chunk", F.when(F.col("page_id") == 2, F.encode(F.lit("zz"), "UTF-8")).otherwise(F.col("chunk"))),
        table.withColumn("whole", F.lit(False)),
    ):
        with pytest.raises(Exception, match="missing|not what was written|another digest|not as long"):
            warc.payloads(broken).collect()
