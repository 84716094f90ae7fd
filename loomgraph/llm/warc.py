"""WARC archives through a chunked record table.

A payload is cut into chunks; every chunk is one row (record id, chunk number, bytes, digest so far) and one
WARC segment (a response, then continuations).  A payload is one value of its row and is held once more as
chunks while that row is written; archives, exchanges and readers hold chunks alone.  Archives are written and
read by Spark's own text source, on any file system Spark knows: a record ends with CR LF CR LF, and the next
begins with ``WARC/1.1``.  Every payload is cut inside that version mark wherever it holds it, so no chunk
holds it, the mark stands at the head of records alone, and archives can be read as a stream.

Digests: a record of one chunk is hashed where it stands.  Segments of longer records carry a chain, each
digest made of the one before it and the chunk; on reading, chunks are sorted by number, and the chain and the
payload's digest are checked as a stream, each row carrying the digest of all bytes up to it.  A block of
another length than its header says, a missing segment or another digest raises an error.

Record ids are made of page id, payload digest and URL, so a revisit names the record it refers to; rows that
agree in all three are one record stored again and told apart by ``X-Row``.

Defined results: a null payload is empty, a null URL an empty field; equal payloads of at least
``revisit_bytes`` are stored once, under the smallest id, the others are revisits; rows that share the
smallest id of such a group are all responses; shorter payloads are all responses; a null page id comes back
as null and is never a smallest id; no pages, no archives' rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import _store

VERSION, CRLF = "WARC/1.1", "\r\n"
BETWEEN = CRLF + CRLF + VERSION + CRLF
#: Identical-payload profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks(payload: Column, chunk_bytes: int) -> Column:
    """array<binary>: the payload in order, cut every ``chunk_bytes`` and inside every version mark."""
    safe = F.when(F.instr(payload, VERSION) == 0, F.array(payload)).otherwise(F.split(payload, r"(?<=WARC)(?=/1\.1)"))

    def cut(piece: Column) -> Column:
        raw = piece.cast("binary")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1)), F.lit(chunk_bytes)), lambda at: F.substring(raw, at, F.lit(chunk_bytes)))

    return F.flatten(F.transform(safe, cut))


def chain(parts: Column) -> Column:
    """array<string>: for every chunk the digest of (digest of the chunk before, chunk); one chunk has its own digest."""
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))
    link = lambda s, x: F.sha2(F.concat(s["last"].cast("binary"), x), 256)
    step = lambda s, x: F.struct(link(s, x).alias("last"), F.concat(s["all"], F.array(link(s, x))).alias("all"))
    return F.aggregate(parts, zero, step)["all"]


def _field(name: str, value: Column | str) -> list[Column]:
    return [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF)]


def write_archives(pages: DataFrame, path: str, space: _store.Workspace, chunk_bytes: int = 64 << 10, revisit_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as gzipped archives below ``path``."""
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    own = own.withColumn("uid", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.substring("digest", 1, 32), F.hex(F.xxhash64("url"))))
    known = own.where((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull())
    groups = known.groupBy("digest").agg(F.min(F.struct("page_id", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.uid").alias("first_uid"))
    # a written table: the join is a broadcast if that is small, else its hot digests can be split
    repeated = space.table(groups, "repeated")
    joined = own.join(repeated, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & (F.col("page_id") > F.col("first")))
    joined = joined.withColumn("revisit", F.coalesce("revisit", F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    parts = F.when(F.col("revisit"), F.array(F.lit(b""))).otherwise(chunks(F.col("payload"), chunk_bytes))
    rows = joined.select("page_id", "url", "digest", "size", "first_uid", "revisit", "uid", "row", parts.alias("parts"))
    links = F.when(F.size("parts") > 1, chain(F.col("parts"))).otherwise(F.array("digest"))
    rows = rows.withColumn("count", F.size("parts")).withColumn("links", links)
    rows = rows.select("page_id", "url", "digest", "size", "first_uid", "revisit", "uid", "row", "count", "links", F.posexplode("parts").alias("k", "chunk"))
    kind = F.when(F.col("revisit"), "revisit").when(F.col("k") == 0, "response").otherwise("continuation")
    head = [
        F.lit(VERSION + CRLF),
        *_field("WARC-Type", kind),
        *_field("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), "uid", F.lit(":"), F.col("k").cast("string"), F.lit(">"))),
        *_field("WARC-Segment-Number", (F.col("k") + 1).cast("string")),
        *_field("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:x-page:"), "uid", F.lit(":0>"))),
        *_field("WARC-Segment-Total-Length", F.col("size").cast("string")),
        *_field("WARC-Date", date),
        *_field("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", "%0A")),
        *_field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(*_field("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), "first_uid", F.lit(":0>"))), *_field("WARC-Profile", PROFILE))).otherwise(""),
        *_field("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        *_field("X-Segment-Count", F.col("count").cast("string")),
        *_field("X-Chain-Digest", F.concat(F.lit("sha256:"), F.get("links", F.col("k")))),
        *_field("X-Row", F.col("row").cast("string")),
        *_field("Content-Type", "text/html"),
        *_field("Content-Length", F.octet_length("chunk").cast("string")),
        F.lit(CRLF),
    ]
    rows.select(F.concat(*head, F.col("chunk").cast("string")).alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: record_id (of the record's first segment, and ``#`` with its row), page_id,
    record_type, url, refers_to (page id), refers_to_record, declared_bytes, declared_digest, chunk_no,
    chunk_count, chain_digest, whole (the block is as long as its header says), chunk."""
    text = spark.read.option("lineSep", BETWEEN).text(path)
    head = F.substring_index("value", CRLF + CRLF, 1)
    # the first record of a file still has its version line
    fields = text.select("value", head.alias("head")).withColumn("f", F.str_to_map(F.regexp_replace("head", "^WARC/1\\.1\r\n", ""), F.lit("\r\n"), F.lit(": ")))
    raw = F.col("value").cast("binary")
    length = F.col("f")["Content-Length"].cast("int")
    from_ = F.octet_length("head") + 5
    number = lambda name: F.nullif(F.col("f")[name], F.lit(""))
    return fields.select(
        F.concat_ws("#", F.col("f")["WARC-Segment-Origin-ID"], F.col("f")["X-Row"]).alias("record_id"),
        number("X-Page-ID").cast("long").alias("page_id"),
        F.col("f")["WARC-Type"].alias("record_type"),
        F.col("f")["WARC-Target-URI"].alias("url"),
        F.regexp_extract(F.col("f")["WARC-Refers-To"], "<urn:x-page:(-?[0-9]+)", 1).cast("long").alias("refers_to"),
        F.col("f")["WARC-Refers-To"].alias("refers_to_record"),
        F.col("f")["WARC-Segment-Total-Length"].cast("long").alias("declared_bytes"),
        F.substring_index(F.col("f")["WARC-Payload-Digest"], ":", -1).alias("declared_digest"),
        (F.col("f")["WARC-Segment-Number"].cast("int") - 1).alias("chunk_no"),
        F.col("f")["X-Segment-Count"].cast("int").alias("chunk_count"),
        F.substring_index(F.col("f")["X-Chain-Digest"], ":", -1).alias("chain_digest"),
        F.coalesce((F.octet_length(raw) - from_ + 1 - length).isin(0, 4), F.lit(False)).alias("whole"),
        F.substring(raw, from_, length).alias("chunk"),
    )


def running_digests(table: DataFrame) -> DataFrame:
    """(record_id, page_id, chunk_no, chunk_count, bytes_so_far, digest_so_far) of the chunks of a record table.

    Chunks of a record are sorted, not gathered: one hash state is alive at a time, and a batch in memory.
    A broken chain, a missing chunk or another digest at a record's end raises an error.
    """
    _store.prepare(table.sparkSession)
    columns = ["record_id", "page_id", "chunk_no", "chunk_count", "chain_digest", "declared_digest", "chunk"]
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk_count", pa.int32()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, total, link, due, left = None, hashlib.sha256(), 0, b"", 0, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for record, page, k, count, told, whole, chunk in zip(*(batch.column(c) for c in columns), strict=True):
                if (own := record.as_py()) != last:
                    if left:
                        raise ValueError(f"segments of {last} are missing")
                    last, state, total, link, due, left = own, hashlib.sha256(), 0, b"", 0, count.as_py()
                block = chunk.as_buffer()
                step = hashlib.sha256(link)
                step.update(block)
                state.update(block)
                total += block.size
                link = step.hexdigest().encode()
                if k.as_py() != due or link.decode() != told.as_py():
                    raise ValueError(f"segment {k.as_py()} of {own} is not what was written")
                due, left = due + 1, left - 1
                if not left and state.hexdigest() != whole.as_py():
                    raise ValueError(f"the payload of {own} has another digest")
                for c, v in zip(out, (own, page.as_py(), due - 1, count.as_py(), total, state.copy().hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        if left:
            raise ValueError(f"segments of {last} are missing")

    ordered = table.select(*columns).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(run, "record_id string, page_id long, chunk_no int, chunk_count int, bytes_so_far long, digest_so_far string")


def payloads(table: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of a record table.

    Lengths and digests of responses are computed from the blocks and must be those stated; a revisit states
    those of the payload it refers to.
    """
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    broken = F.raise_error(F.concat(F.lit("a block of "), F.coalesce("record_id", F.lit("a record without headers")), F.lit(" is not as long as its header says")))
    table = table.withColumn("chunk", F.when(F.col("whole"), F.col("chunk")).otherwise(broken.cast("binary")))
    single = table.where((F.col("chunk_count") == 1) & (F.col("record_type") == "response")).withColumn("own", F.sha2("chunk", 256))
    wrong = F.raise_error(F.concat(F.lit("the payload of "), "record_id", F.lit(" has another digest")))
    digest = F.when(F.col("own") == F.col("declared_digest"), F.col("own")).otherwise(wrong.cast("string"))
    single = single.select("page_id", F.octet_length("chunk").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = table.where(F.col("record_type") == "revisit").select("page_id", F.col("declared_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to")
    long = table.where((F.col("chunk_count") > 1) & F.col("record_type").isin("response", "continuation"))
    ends = running_digests(long).where("chunk_no = chunk_count - 1")
    streamed = ends.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return single.select(out).unionByName(revisits.select(out)).unionByName(streamed.select(out))
