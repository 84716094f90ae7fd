"""Toxic passages by maximum-scoring segment search.

Token scores are log-odds of a token's document counts in toxic against other labelled documents, with an
informative Dirichlet prior (the background counts); so are those of the beginnings of tokens, for languages
that inflect: a token takes its own score or that of its longest scored beginning.  Scores count only where
the log-odds stand several standard errors over zero, and every token pays a small drift, so that scores fall in clean text.  A linear
scan finds all maximal-scoring segments of a text (Ruzzo and Tompa); long stretches between scoring tokens
are one number, so the scan takes as many steps as there are scoring tokens.  Segment scores are compared
with the extreme-value law of clean text (lambda from the score distribution, K from maxima of clean
documents), and the evidence of all significant segments of a document is turned into a probability by a
logistic curve fitted on documents whose tokens were not counted for it (two folds).

The model is fitted on at most ``max_labelled`` labelled rows, those with the smallest hash of doc_id; all
texts are scored whole.  Language, source and ids are never inputs.

Defined results: null text is the empty text and gets the score of a text without evidence; repeated rows
are scored each; equal texts count once in the fit; without toxic labels every score is the base rate.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _chunks, _store

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def token(chunk: str) -> str:
    """A chunk between spaces, lower-cased, without marks at its ends."""
    return _EDGE.sub("", chunk.lower())


def features(word: str, shortest: int = 3, longest: int = 7) -> list[str]:
    """The token and its beginnings (marked by ``~``), longest first."""
    return [word, *(word[:k] + "~" for k in range(min(longest, len(word) - 1), shortest - 1, -1))] if word else []


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.25
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def evidence(self, segments: list[tuple[int, int, float]], n_tokens: int) -> tuple[float, float]:
        """(best, total) normalised score: nats by which segments beat what clean text of this length gives."""
        ground = math.log(max(self.k * max(n_tokens, 1), 1e-9))
        over = [max(0.0, self.lam * s - max(ground, 0.0)) for _, _, s in segments]
        return (max(over), sum(over)) if over else (0.0, 0.0)

    def probability(self, best: float, total: float) -> float:
        b, w1, w2 = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + w1 * math.log1p(best) + w2 * math.log1p(total)))))


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) of a sequence, in order, in linear time."""
    found: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    for i, v in enumerate(values):
        if v <= 0:
            total += v
            continue
        own = [i, i + 1, total, total + v]
        total += v
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j -= 1
            if j < 0 or found[j][3] >= own[3]:
                found.append(own)
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r in found]


def _scan(score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments of one text, (first token, last token + 1, score); only scoring tokens are stepped over."""
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    paid = np.concatenate([[0.0], np.cumsum(score - drift)])
    values, places, end = [], [], None
    for k in at.tolist():
        if end is not None:
            values.append(float(paid[k] - paid[end]))
            places.append((end, k))
        values.append(float(paid[k + 1] - paid[k]))
        places.append((k, k + 1))
        end = k + 1
    return [(places[a][0], places[b - 1][1], s) for a, b, s in maximal_segments(values)]


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.table = _chunks.ColumnTable(lambda new: [np.array([self.value(token(c)) for c in new], np.float64)], 300_000)

    def value(self, word: str) -> float:
        return next((v for f in features(word) if (v := self.model.scores.get(f))), 0.0)

    def segments(self, texts: pa.Array) -> list[tuple[list[tuple[int, int, float]], int]]:
        """Each text's maximal segments, counted in its ``split()`` chunks, and its number of chunks."""
        texts = _chunks.texts_of(texts)
        cut = pc.utf8_split_whitespace(texts)
        (score,), counts = self.table.lookup(cut)
        size = pc.utf8_length(cut.flatten()).to_numpy(zero_copy_only=False)
        out: list = [([], int(n)) for n in counts]
        ends = np.cumsum(counts)
        hit = np.searchsorted(ends, np.flatnonzero(score > 0), side="right")
        for d in np.unique(hit).tolist():
            here = slice(int(ends[d] - counts[d]), int(ends[d]))
            full = size[here] > 0  # white space at the ends leaves empty pieces
            own, words = score[here][full], texts[d].as_py().split()
            if len(words) != len(own) or sum(map(len, words)) != int(size[here].sum()):
                # white space that the two ways of cutting see differently
                own = np.array([self.value(token(c)) for c in words], np.float64)
            out[d] = (_scan(own, self.model.drift), len(own))
        return out

    def score(self, texts: pa.Array) -> list[float]:
        return [self.model.probability(*self.model.evidence(s, n)) for s, n in self.segments(texts)]


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column | None, max_labelled: int) -> DataFrame:
    """(text, toxic, fold) of at most ``max_labelled`` labelled documents; the broadcast side has that bound."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = own if usable is None else own.where(usable)
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).cast("int").alias("fold"))


def _count(train: DataFrame, min_docs: int):
    """Document counts of tokens for each fold and label, and numbers of documents; equal texts count once."""

    def rows(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["token", "toxic", "fold", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in _store.slices(batches, "text"):
            for text, toxic, fold in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), part.column("fold").to_pylist(), strict=True):
                seen[("", toxic, fold)] += 1
                seen.update((f, toxic, fold) for f in {f for w in {token(c) for c in text.split()} for f in features(w)})
                if len(seen) > 100_000:  # partial counts go on; the aggregate after this adds them up
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    counted = train.mapInArrow(run, "token string, toxic int, fold int, docs long")
    cell = lambda t, f: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("docs")).otherwise(0)).alias(f"c{t}{f}")
    table = counted.groupBy("token").agg(*[cell(t, f) for t in (0, 1) for f in (0, 1)])
    return table.where((F.col("token") == "") | (F.col("c10") + F.col("c11") >= min_docs)).toPandas()


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float, z_min: float, least: float) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior of ``prior`` documents; 0 under ``least`` or ``z_min`` standard errors."""
    a = prior * (toxic + clean) / max(n_toxic + n_clean, 1.0)
    odds = lambda y, n: np.log(y + a + 1e-9) - np.log(np.maximum(n + prior - y - a, 1e-9))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    z = delta / np.sqrt(1 / (toxic + a + 1e-9) + 1 / (clean + a + 1e-9))
    return np.where((z >= z_min) & (delta >= least), delta, 0.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_labelled: int = 20_000, prior: float = 20.0, z_min: float = 3.0, least: float = 2.5, min_docs: int = 3, max_tokens: int = 100_000) -> ToxicityModel:
    """Fit on labelled rows where ``usable`` holds.  ``max_tokens`` bounds the table that goes to executors."""
    _store.prepare(docs.sparkSession)
    train = _labelled(docs, labels, usable, max_labelled)
    with _store.Workspace(docs.sparkSession, "toxicity") as space:
        train = space.table(train.groupBy(F.xxhash64("text").alias("h"), "fold").agg(F.max_by("text", "toxic").alias("text"), F.max("toxic").alias("toxic")).drop("h"), "train")
        counts = _count(train, min_docs)
        whole = counts[counts["token"] == ""]
        n = {(t, f): float(whole[f"c{t}{f}"].sum()) for t in (0, 1) for f in (0, 1)}
        words = counts[counts["token"] != ""]
        n_toxic, n_clean = n[1, 0] + n[1, 1], n[0, 0] + n[0, 1]
        if not n_toxic or not n_clean:
            rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
            return ToxicityModel(weights=(math.log(rate / (1 - rate)), 0.0, 0.0))

        def table(folds: tuple[int, ...]) -> dict[str, float]:
            toxic = sum(words[f"c1{f}"].to_numpy(float) for f in folds)
            clean = sum(words[f"c0{f}"].to_numpy(float) for f in folds)
            delta = log_odds(toxic, clean, sum(n[1, f] for f in folds), sum(n[0, f] for f in folds), prior, z_min, least)
            keep = np.argsort(-delta, kind="stable")[:max_tokens]
            return {words["token"].iat[k]: float(delta[k]) for k in keep if delta[k]}

        by_fold = [ToxicityModel(table((1,))), ToxicityModel(table((0,)))]  # scored by the tokens of the other fold
        broadcast = docs.sparkSession.sparkContext.broadcast(by_fold)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [_Scorer(m) for m in broadcast.value]
            for part in _store.slices(batches, "text"):
                both = [s.segments(part.column("text")) for s in scorers]
                found = [both[f][k] for k, f in enumerate(part.column("fold").to_pylist())]
                lists = [[s for _, _, s in segments] for segments, _ in found]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([m for _, m in found], pa.int64()), pa.array(lists, pa.list_(pa.float64()))], ["toxic", "tokens", "segments"])

        rows = train.mapInArrow(run, "toxic int, tokens long, segments array<double>").toPandas()
    model = ToxicityModel(table((0, 1)))
    _calibrate(model, rows["toxic"].to_numpy(float), rows["tokens"].to_numpy(float), [list(x) for x in rows["segments"]])
    return model


def _calibrate(model: ToxicityModel, toxic: np.ndarray, tokens: np.ndarray, segments: list[list[float]]) -> None:
    """lambda and K of the extreme-value law from clean documents, then the logistic curve."""
    clean = [(n, max(s)) for n, s, t in zip(tokens, segments, toxic, strict=True) if not t and s]
    # maxima of clean text: Gumbel by moments; too few or none that vary leave the scale of the scores
    top = np.array([m for _, m in clean])
    spread = float(top.std()) if len(top) >= 20 else 0.0
    model.lam = min(math.pi / (spread * math.sqrt(6)), 2.0) if spread > 1e-6 else 1.0
    n_clean, mean_n = max(1, int((toxic == 0).sum())), max(1.0, float(tokens[toxic == 0].mean()) if (toxic == 0).any() else 1.0)
    # the share of clean documents with any segment gives K: 1 - exp(-K n exp(-lambda s0))
    share = min(0.99, (len(clean) + 0.5) / (n_clean + 1))
    least = float(top.min()) if len(top) else 0.0
    model.k = -math.log1p(-share) / mean_n * math.exp(model.lam * least)
    x = np.array([model.evidence([(0, 0, v) for v in s], int(n)) for n, s in zip(tokens, segments, strict=True)]).reshape(-1, 2)
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(float(v) for v in w)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages): passages are array<struct<start, end, score, e_value>> in characters."""
    spark = _store.prepare(docs.sparkSession)
    broadcast, key = spark.sparkContext.broadcast(model), f"toxicity {uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _store.cached(key, lambda: _Scorer(broadcast.value))
        m = scorer.model
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for part in _store.slices(batches, "text"):
            texts, scores, passages = part.column("text"), [], []
            for k, (segments, n) in enumerate(scorer.segments(texts)):
                scores.append(m.probability(*m.evidence(segments, n)))
                spans = [x.span() for x in re.finditer(r"\S+", texts[k].as_py())] if segments else []
                passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "e_value": m.k * n * math.exp(-m.lam * s)} for a, b, s in segments])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {id_kind}, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, with all their columns; nothing is shuffled."""
    spark = _store.prepare(docs.sparkSession)
    broadcast, key = spark.sparkContext.broadcast(model), f"toxicity {uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _store.cached(key, lambda: _Scorer(broadcast.value))
        for part in _store.slices(batches, "text"):
            scores = scorer.score(part.column("text"))
            yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
