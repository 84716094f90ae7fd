"""Quality by co-training of two views.

The text view sees the whole text: kinds of words, repetition, marks and lines, and its distinct words hashed
into ``CONTENT`` signed counts.  The metadata view sees language, source and stated length.  Each is a logistic
regression, fitted at first on labelled documents.  In every round each view labels the unlabelled documents it is
sure of, for the other view to learn from: all unlabelled documents take part.  A round is one pass over a table
of features, written once: every partition hands in the gradient and the curvature of both views' likelihoods on
the pseudo-labels (sums, whose size the number of features decides), the driver adds those of the labelled rows
and takes a Newton step.  Pseudo-labels together weigh at most as much as the labelled rows.  Before every round
both views are calibrated on a fold of labelled documents that neither learned from, so being sure means being
right there; at last a third regression joins the two calibrated views.  All documents are scored.

Only the labelled rows are bounded (``max_labelled``, those with the smallest hash of doc_id).

Defined results: null text is empty, null metadata a value of its own; repeated rows are scored each, and a row
counts as labelled if its doc_id is; without labels of both kinds every score is the share of good labels (1/2
without any); no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _chunks, _store

_LANGS, _SOURCES = 16, 64
#: Signed hashed counts of distinct words in the text view.
CONTENT = 64
TEXT, META = 11 + CONTENT, _LANGS + _SOURCES + 2


def _word(chunk: str) -> tuple[int, float, float, float, float, float, float]:
    """Hash, length, and whether a chunk is upper case, without letters, with a digit, ends in doubled marks, ends a sentence."""
    letters = sum(map(str.isalpha, chunk))
    return (
        xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "replace")) & 0x7FFFFFFFFFFFFFFF,
        float(len(chunk)),
        float(letters > 1 and chunk.isupper()),
        float(not letters),
        float(any(map(str.isdigit, chunk))),
        float(len(chunk) > 2 and not chunk[-1].isalnum() and chunk[-1] == chunk[-2]),
        float(chunk.endswith((".", "?", "!"))),
    )


def _words(chunks: list[str]) -> list[np.ndarray]:
    rows = [_word(c) for c in chunks]
    return [np.array([r[0] for r in rows], np.int64), *(np.array([r[k] for r in rows], np.float64) for k in range(1, 7))]


class Views:
    """Feature matrices of batches of documents."""

    def __init__(self) -> None:
        self.table = _chunks.ColumnTable(_words, 300_000)

    def text(self, texts: pa.Array) -> np.ndarray:
        texts = _chunks.texts_of(texts)
        (key, *flags), counts = self.table.lookup(pc.utf8_split_whitespace(texts))
        owner = np.repeat(np.arange(len(counts)), counts)
        n = np.maximum(counts, 1)
        mean = [np.bincount(owner, f, minlength=len(counts)) / n for f in flags]
        order = np.lexsort((key, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order], fresh, minlength=len(counts)) / n
        word, text = key[order][fresh], owner[order][fresh]
        sign = np.where((word >> 6) & 1, 1.0, -1.0)
        content = np.bincount(text * CONTENT + (word & (CONTENT - 1)), sign, minlength=len(counts) * CONTENT).reshape(len(counts), CONTENT)
        content /= np.sqrt(np.maximum(np.bincount(text, minlength=len(counts)), 1))[:, None]
        lines = [t.split("\n") for t in texts.to_pylist()]
        repeated = [1 - len(set(x)) / len(x) for x in lines]
        long = np.log1p(counts)
        return np.column_stack([*mean, distinct, repeated, [np.log1p(len(x)) for x in lines], long, distinct * long, content])

    def meta(self, lang: list, source: list, n_chars: list) -> np.ndarray:
        out = np.zeros((len(lang), _LANGS + _SOURCES + 2))
        for k, (a, b, n) in enumerate(zip(lang, source, n_chars, strict=True)):
            out[k, xxhash.xxh3_64_intdigest(str(a).encode("utf-8", "replace")) % _LANGS] = 1
            out[k, _LANGS + xxhash.xxh3_64_intdigest(str(b).encode("utf-8", "replace")) % _SOURCES] = 1
            out[k, -2:] = (0, 1) if n is None else (np.log1p(max(0, n)), 0)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 4.0, start: np.ndarray | None = None) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1]) if start is None else start
    for _ in range(30):
        step = _newton(w, *_sums(x, y, w), ridge)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the likelihood of ``y`` at ``w``; ``x`` has a column of ones."""
    p = _sigmoid(x @ w)
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def _newton(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.diag([1e-6, *[ridge] * (len(w) - 1)])
    return np.linalg.solve(curvature + penalty, gradient - penalty @ w)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    centre: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray]
    joint: np.ndarray
    #: Shares of the calibration fold that each view gets wrong, before the first round and after each.
    errors: list[tuple[float, float]]

    def margins(self, view: int, x: np.ndarray) -> np.ndarray:
        w = self.weights[view]
        return w[0] + ((x - self.centre[view]) / self.scale[view]) @ w[1:]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [c[0] + c[1] * np.clip(self.margins(v, x), -30, 30) for v, (x, c) in enumerate(zip((text, meta), self.calibration, strict=True))]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.joint[0] + np.column_stack(z) @ self.joint[1:])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m, more columns): both views' features, as bytes of floats, of every row of a table with texts."""
    more = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    kept = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = _store.cached("views", Views)
        for part in _store.slices(batches, "text"):
            t = views.text(part.column("text")).astype(np.float32)
            m = views.meta(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (t, m))], [*kept, "t", "m"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "t binary", "m binary"]))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), width).astype(float)


def exchanged(model: CoTrained, views: tuple[np.ndarray, np.ndarray], confident: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each view: rows that the other view is sure of, with their gradient and curvature under its labels."""
    x = [np.column_stack([np.ones(len(v)), (v - c) / s]) for v, c, s in zip(views, model.centre, model.scale, strict=True)]
    p = [_sigmoid(c[0] + c[1] * np.clip(a @ w, -30, 30)) for a, w, c in zip(x, model.weights, model.calibration, strict=True)]
    out = []
    for v in (0, 1):
        other = p[1 - v]
        sure = np.maximum(other, 1 - other) >= confident
        out.append((int(sure.sum()), *_sums(x[v][sure], (other[sure] >= 0.5).astype(float), model.weights[v])))
    return out


def _added_up(free: DataFrame, model: CoTrained, confident: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``exchanged`` over all unlabelled rows; a bounded number of sums reaches the driver."""
    broadcast = free.sparkSession.sparkContext.broadcast(model)
    widths = [TEXT + 1, META + 1]

    def add(total: list, more: list) -> list:
        return more if total is None else [(a + d, b + e, c + f) for (a, b, c), (d, e, f) in zip(total, more, strict=True)]

    def packed(total: list | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            rows = [(v, n, g.tobytes(), h.tobytes()) for v, (n, g, h) in enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["view", "n", "g", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = add(total, exchanged(broadcast.value, (_rows(b.column("t"), TEXT), _rows(b.column("m"), META)), confident))
        yield from packed(total)

    def unpacked(rows: list[dict]) -> list:
        zero = [(0, np.zeros(w), np.zeros((w, w))) for w in widths]
        for r in rows:
            w = widths[r["view"]]
            n, g, h = zero[r["view"]]
            zero[r["view"]] = (n + r["n"], g + np.frombuffer(r["g"]), h + np.frombuffer(r["h"]).reshape(w, w))
        return zero

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [unpacked(b.to_pylist()) for b in batches if b.num_rows]
        total = None
        for r in rows:
            total = add(total, r)
        yield from packed(total)

    schema = "view int, n long, g binary, h binary"
    sums = free.select("t", "m").mapInArrow(run, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(16)))
    merged = sums.repartition(16, "_part").drop("_part").mapInArrow(merge, schema)
    found = unpacked([r.asDict() for r in merged.collect()])
    broadcast.unpersist()
    return found


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, **options) -> CoTrained:
    """``options``: ``max_labelled``, ``rounds`` and ``confident``, the probability from which a view is sure."""
    with _store.Workspace(docs.sparkSession, "quality") as space:
        return _fitted(docs, labels, space, usable, **options)[0]


def _fitted(docs: DataFrame, labels: DataFrame, space: _store.Workspace, usable: Column | None = None, max_labelled: int = 20_000, rounds: int = 4, confident: float = 0.95) -> tuple[CoTrained, DataFrame]:
    """The model, and the written features (doc_id, t, m, ..) of all documents."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = (known if usable is None else known.where(usable)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = space.table(chosen.select("doc_id", F.col("quality").cast("int").alias("_quality")), "chosen")
    # the labelled side is bounded, so it is sent to the texts
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id", "left").withColumn("_fold", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)).cast("int"))
    table = space.table(features(own), "features")
    # one row of each labelled id, however often it is repeated
    least = table.where("_quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("t", "m", "_quality", "_fold")).alias("r"))
    rows = least.orderBy("doc_id").select("r.*").toPandas()
    views = tuple(np.stack([np.frombuffer(b, np.float32) for b in rows[c]]).astype(float) if len(rows) else np.zeros((0, w)) for c, w in (("t", TEXT), ("m", META)))
    return train(views, rows["_quality"].to_numpy(float), rows["_fold"].to_numpy(int), lambda model: _added_up(table.where("_quality IS NULL"), model, confident), rounds), table


def train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, exchange: Callable[[CoTrained], list], rounds: int) -> CoTrained:
    """From labelled rows on the driver, and a function that sums the pseudo-labels of all others."""
    y = np.where(y > 0, 1.0, 0.0)
    if len(set(y)) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        flat = [np.array([np.log(rate / (1 - rate)), 0.0])] * 2
        return CoTrained([np.zeros(w) for w in (TEXT, META)], [np.ones(w) for w in (TEXT, META)], [np.zeros(w + 1) for w in (TEXT, META)], flat, np.array([0.0, 0.5, 0.5]), [])
    learn = fold != 0
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn = np.ones(len(y), bool)
    check = ~learn if not learn.all() else learn
    centre = [v[learn].mean(axis=0) for v in views]
    scale = [np.where(v[learn].std(axis=0) > 1e-6, v[learn].std(axis=0), 1.0) for v in views]
    model = CoTrained(centre, scale, [_logistic(((v - c) / s)[learn], y[learn]) for v, c, s in zip(views, centre, scale, strict=True)], [np.array([0.0, 1.0])] * 2, np.array([0.0, 0.5, 0.5]), [])
    x = [np.column_stack([np.ones(len(v)), (v - c) / s]) for v, c, s in zip(views, centre, scale, strict=True)]

    def errors() -> tuple[float, float]:
        return tuple(float(((a @ w >= 0) != (y > 0))[check].mean()) for a, w in zip(x, model.weights, strict=True))

    def calibrate() -> None:
        for v, a in enumerate(views):
            model.calibration[v] = _logistic(np.clip(model.margins(v, a[check]), -30, 30)[:, None], y[check], 0.01)

    model.errors.append(errors())
    calibrate()
    for _ in range(rounds):
        for v, (n, gradient, curvature) in enumerate(exchange(model)):
            weight = min(1.0, learn.sum() / n) if n else 0.0
            g, h = _sums(x[v][learn], y[learn], model.weights[v])
            step = _newton(model.weights[v], g + weight * gradient, h + weight * curvature, 4.0)
            # far from the optimum a Newton step may be too long: it moves at most by half of the weights, and one
            most = 1 + np.linalg.norm(model.weights[v]) / 2
            model.weights[v] = model.weights[v] + step * min(1.0, most / max(np.linalg.norm(step), 1e-12))
        model.errors.append(errors())
        calibrate()
    z = np.column_stack([c[0] + c[1] * np.clip(model.margins(v, a[check]), -30, 30) for v, (a, c) in enumerate(zip(views, model.calibration, strict=True))])
    model.joint = _logistic(z, y[check], 0.01)
    return model


def rated(table: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row of a table of features."""
    broadcast = _store.prepare(table.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                a, b, s = broadcast.value.scores(_rows(part.column("t"), TEXT), _rows(part.column("m"), META))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a), pa.array(b), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "t", "m").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep int")


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row of (doc_id, text, lang, source, n_chars)."""
    _store.prepare(docs.sparkSession)
    return rated(features(docs.select("doc_id", "text", "lang", "source", "n_chars")), model, threshold)


def assess(docs: DataFrame, labels: DataFrame, usable: Column | None = None, **options) -> DataFrame:
    """Fit on labelled rows and score all documents; texts are read once, for the table of features."""
    with _store.Workspace(docs.sparkSession, "quality") as space:
        model, table = _fitted(docs, labels, space, usable, **options)
        return space.table(rated(table, model), "scores", keep=True)
