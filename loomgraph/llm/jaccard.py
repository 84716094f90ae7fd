"""N-gram Jaccard self-join by vertical partitioning.

Every text becomes the set of its distinct k-word shingles (64-bit hashes).  A global order of all shingles
puts rare ones first: shingles fall into 2^18 hash classes, all documents are counted into them, and classes
are ranked by count.  (Any order gives exact results; this one keeps frequent shingles out of prefixes.)
The order is cut into fragments of equal mass.

* Equal sets are one class, found by a 128-bit digest; the rest works on one document of each class.
* Candidates: if two sets reach the threshold, all but p-1 of the shingles of either are shared, p = n -
  ceil(t n) + 1.  So of the first q = p + l - 1 shingles of a set that has any partner, at least l are also
  among the first q of another document.  Few texts pass this test; only they go on.
* Pairs: a pair's first common shingle stands in both sets at a place of at most n - a, where a is the
  overlap that the pair's sizes ask for; only such places bring two documents together.  (For the shorter set
  these are early places, n - ceil(2 t n / (1 + t)) at most.)
* Links: where a prefix shingle brings many documents together, they first meet in a star around one of
  them: the one in which it stands first, which has the fewest shingles of its own, then others.  Pairs whose
  counts of shingles by piece of the order rule the overlap out are left.  For the others, partial overlaps
  are counted for each fragment alone and summed for each pair.  Components are merged between rounds, so members of a group of near copies are not paired with
  each other again.  When the pairs left between components are few for the number of rows, or stars merge
  no more, each pair left is counted.  No link between components is lost, no bucket is cut short.

Defined results: null or empty text has no shingles and is linked with nothing; fewer than k words are one
shingle; repeated rows are equal sets; a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store, _words, graph

CLASS_BITS = 18
#: l is a SHARED-th part of the prefix length p: a larger l lengthens prefixes and leaves fewer candidates.
SHARED = 2
FRAGMENTS = 4
#: Finer pieces of the order, 16 to a fragment: their counts alone bound an overlap from above.
SLOTS = 64
#: A written table of at most so many narrow rows (tens of bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def _hashes() -> _words.WordHashes:
    return _store.cached("words", lambda: _words.WordHashes(300_000))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for part in _store.slices(batches, "text"):
        yield part.column("doc_id").to_pylist(), _words.shingle_sets(part.column("text"), k, _hashes())


def _class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def summarise(docs: DataFrame, k: int) -> DataFrame:
    """One pass: a row (doc_id, n, sig) for every document and, for each task, counts of hash classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.int64)
        names = ["doc_id", "n", "sig", "class", "count"]
        for ids, sets in _sets(batches, k):
            sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            if n.sum():
                counts += np.bincount(_class_of(np.concatenate(sets)), minlength=len(counts))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(sig, pa.binary()), pa.nulls(len(ids), pa.int32()), none], names)
        held = np.flatnonzero(counts)
        for at in range(0, len(held), 1 << 16):
            own = held[at : at + (1 << 16)]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(own), pa.binary()), pa.array(own.astype(np.int32)), pa.array(counts[own])], names)

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, class int, count long")


def class_ranks(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every hash class in the global order and its slot; 2^18 numbers, whatever the corpus."""
    found = summary.where("class IS NOT NULL").groupBy("class").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    counts[found["class"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    mass = np.cumsum(counts[order])
    slot = np.empty(len(order), np.int8)
    slot[order] = np.clip((mass - 1) * SLOTS // max(1, mass[-1]), 0, SLOTS - 1)
    return rank, slot


def _prefix_sizes(n: np.ndarray | int, num: int, den: int):
    """(p, l): prefix length, and how many of the first p + l - 1 must be shared."""
    p = n - -(-num * n // den) + 1
    return p, -(-p // SHARED)


def prefixes(docs: DataFrame, k: int, num: int, den: int, rank) -> DataFrame:
    """(token, doc_id, pos): the first p + l - 1 shingles of every set; equal sets of one task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = rank.value, set()
        for ids, sets in _sets(batches, k):
            tokens, owners, places = [], [], []
            for doc, own in zip(ids, sets, strict=True):
                if not len(own) or doc is None:
                    continue
                if (sig := xxhash.xxh3_64_digest(own.tobytes())) in seen:
                    continue
                seen.add(sig)
                p, more = _prefix_sizes(len(own), num, den)
                q = min(len(own), p + more - 1)
                order = np.lexsort((own, ranks[_class_of(own)]))[:q]
                tokens.append(own[order])
                owners.append(np.full(q, doc, np.int64))
                places.append(np.arange(q, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places))], ["token", "doc_id", "pos"])

    return docs.mapInArrow(run, "token long, doc_id long, pos int")


def segments(docs: DataFrame, k: int, slot) -> DataFrame:
    """(sig, fragment, shingles): every set cut at the borders of the global order's fragments.

    Fragment -1 holds, instead of shingles, how many the set has in each slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = slot.value
        for _, sets in _sets(batches, k):
            doc, frag, parts = [], [], []
            for own in sets:
                sig, slots = xxhash.xxh3_128_digest(own.tobytes()), cut[_class_of(own)]
                of = slots // (SLOTS // FRAGMENTS)
                for f in (-1, *np.unique(of).tolist()):
                    doc.append(sig)
                    frag.append(f)
                    parts.append(own[of == f] if f >= 0 else np.bincount(slots, minlength=SLOTS).astype(np.uint64))
            if doc:
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.binary()), pa.array(frag, pa.int32()), lists], ["sig", "fragment", "shingles"])

    return docs.mapInArrow(run, "sig binary, fragment int, shingles array<long>")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps of the fragments of both, counted alone and summed for each pair."""
    left = pairs.join(cut.select(F.col("sig").alias("sig_a"), "fragment", F.col("shingles").alias("sa")), "sig_a").drop("sig_a")
    both = left.join(cut.select(F.col("sig").alias("sig_b"), "fragment", F.col("shingles").alias("sb")), ["sig_b", "fragment"])
    parts = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))


def _links(pairs: DataFrame, cut: DataFrame, num: int, den: int, space: _store.Workspace) -> DataFrame:
    """Pairs at or over the threshold: den * overlap >= num * union."""
    counts = cut.where("fragment = -1")
    both = pairs.join(counts.select(F.col("sig").alias("sig_a"), F.col("shingles").alias("ca")), "sig_a").join(counts.select(F.col("sig").alias("sig_b"), F.col("shingles").alias("cb")), "sig_b")
    bound = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    open_pairs = space.table(both.where(den * bound >= num * (F.col("na") + F.col("nb") - bound)).drop("ca", "cb"), "open_pairs")
    return overlaps(open_pairs, cut.where("fragment >= 0")).where(den * F.col("overlap") >= num * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _may_meet(x: str, y: str, num: int, den: int):
    """The places of a common shingle leave room for the overlap that the two sizes ask for."""
    need = f"((({num} * (n{x} + n{y}) + {num + den - 1}) div {num + den}))"
    return F.expr(f"pos{x} <= n{x} - {need} AND pos{y} <= n{y} - {need}")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, star_rounds: int = 6, few: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text); linked at Jaccard >= num / den.

    Stars are made, at most ``star_rounds`` times, while more than ``few`` times as many pairs as rows lie
    between components; neither number changes the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with _store.Workspace(spark, "jaccard") as space:
        summary = space.table(summarise(docs, k), "summary")
        rank, slot = class_ranks(summary)
        rank, slot = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(slot)
        rows = summary.where("class IS NULL").select("doc_id", "n", "sig")
        classes = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
        classes = space.table(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")

        prefix = space.table(prefixes(docs, k, num, den, rank), "prefix")
        shared = space.table(prefix.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "shared")
        hits = space.table(prefix.join(shared, "token", "left_semi"), "hits")
        per_doc = space.table(hits.groupBy("doc_id").agg(F.count("*").alias("found")), "per_doc")
        # of q = min(n, p + l - 1) prefix shingles, q - (p - 1) or more are shared
        p = F.expr(f"n - (({num} * n + {den} - 1) div {den}) + 1")
        q = F.least(F.col("n"), p + F.ceil(p / SHARED) - 1)
        possible = per_doc.join(rows, "doc_id").where(F.col("found") >= q - p + 1).select("doc_id", "sig").distinct()
        # copies fall together in their class
        keyed = space.table(possible.join(classes, "sig").select("doc_id", "doc", "n", "sig", "rep"), "keyed")
        bucket = hits.join(_small(keyed.select("doc_id", "doc", "n")), "doc_id").where(F.col("pos") < p).select("token", "doc", "n", "pos").distinct()
        bucket = bucket.withColumn("early", F.expr(f"pos <= n - ((2 * {num} * n + {num + den - 1}) div {num + den})"))
        # the largest set that this place leaves room for
        bucket = space.table(bucket.withColumn("cap", F.expr(f"({num + den} * (n - pos) - {num} * n) div {num}")), "bucket")
        sizes = space.table(keyed.select("doc", "n", "sig", "rep").distinct(), "sizes")
        ids = space.table(sizes.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        # few candidates are sent to the texts, not the texts to them; beyond the bound both are shuffled
        wanted = docs.join(_small(ids), "doc_id", "left_semi")
        cut = space.table(segments(wanted, k, slot), "cut")
        if not cut.groupBy("sig", "fragment").count().where("count > 1").isEmpty():  # repeated rows
            cut = space.table(cut.dropDuplicates(["sig", "fragment"]), "cut")

        assigned = space.table(sizes.select("doc", F.col("doc").alias("comp")), "assigned")
        side = lambda x: sizes.select(F.col("doc").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("sig_" + x))
        before, idle = float("inf"), 0
        for turn in range(star_rounds + 1):
            member = space.table(bucket.join(_small(assigned), "doc"), "member")
            held = space.table(member.groupBy("token", "comp").agg(F.count("*").alias("m"), F.sum(F.col("early").cast("long")).alias("e"), F.max("cap").alias("cap"), F.min("n").alias("low")), "held")
            tokens = held.groupBy("token").agg(F.sum("m").alias("m"), F.sum("e").alias("e"), F.sum(F.col("m") * F.col("e")).alias("me")).where("m * e > me")
            tokens = space.table(tokens, "tokens")
            rows_left, pairs_left = tokens.agg(F.sum("m"), F.sum(F.col("m") * F.col("e") - F.col("me"))).first()
            if not rows_left:
                break
            idle, before = idle + 1 if pairs_left > 0.95 * before else 0, pairs_left
            final = turn == star_rounds or (turn and pairs_left <= few * rows_left) or idle == 2
            if final:
                # the shorter of two sets meets the other in one of its early places
                held = space.table(held.join(_small(tokens.select("token")), "token", "left_semi"), "held")
                sides = held.where("e > 0").select("token", "comp", F.col("cap").alias("xcap"), F.col("low").alias("xlow")).join(held.select("token", F.col("comp").alias("other"), F.col("cap").alias("ycap"), F.col("low").alias("ylow")), "token")
                sides = space.table(sides.where("comp <> other AND xlow <= ycap AND ylow <= xcap").select("token", "comp", "other", "ycap", "ylow"), "sides")
                early = member.where("early").select("token", "comp", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("posx"), F.col("cap").alias("capx"))
                first = sides.join(early, ["token", "comp"]).where("nx <= ycap AND ylow <= capx").drop("ycap", "ylow", "capx")
                second = member.select("token", F.col("comp").alias("other"), F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("posy"))
                pairs = first.join(second, ["token", "other"]).where(_may_meet("x", "y", num, den)).where("nx < ny OR (nx = ny AND x < y)")
                pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            else:
                # one document of each (shingle, size band) is the centre; others in each round
                band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))) if num < den else F.col("n")
                banded = member.join(_small(tokens.select("token")), "token", "left_semi").withColumn("band", band.cast("long")).withColumn("order", F.struct(F.col("pos") if turn == 0 else F.lit(0), F.xxhash64("doc", F.lit(turn), F.pmod("token", F.lit(4)))))
                centre = banded.groupBy("token", "band").agg(F.min(F.struct("order", "doc", "n", "comp", "pos")).alias("c"), F.count("*").alias("m")).where("m > 1")
                centre = space.table(centre.select("token", "band", F.col("c.doc").alias("cd"), F.col("c.n").alias("nc"), F.col("c.comp").alias("cc"), F.col("c.pos").alias("posc")), "centre")
                banded = space.table(banded.withColumnsRenamed({"n": "nm", "pos": "posm"}), "banded")
                pairs = banded.join(_small(centre), ["token", "band"]).where("comp <> cc").where(_may_meet("m", "c", num, den)).select(F.least("doc", "cd").alias("a"), F.greatest("doc", "cd").alias("b")).distinct()
            pairs = space.table(space.table(pairs, "pairs").join(side("a"), "a").join(side("b"), "b"), "pairs")
            links = space.table(_links(pairs, cut, num, den, space), "links")
            ends = links.join(assigned.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(assigned.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b")
            merged = graph.components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), space)
            assigned = space.table(assigned.join(merged.select(F.col("node").alias("comp"), "label"), "comp", "left").select("doc", F.coalesce("label", "comp").alias("comp")), "assigned")
            if final:
                break

        placed = space.table(classes.join(assigned, "doc", "left").select("sig", "rep", F.coalesce("comp", "doc").alias("comp")), "placed")
        least = space.table(placed.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
        named = space.table(placed.join(least, "comp").select("sig", "component_id"), "named")
        out = rows.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return space.table(out, "components", keep=True)
