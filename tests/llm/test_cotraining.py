"""Co-training: sums over partitions against one matrix, what the exchange teaches, and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import _store, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, view int"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "t", 1) for i, t, la, s in rows], DOCS)


def corpus(n=400, labelled=60, seed=2):
    """Good texts are long words of source a, bad ones shouted repeats of source b; a few have the other's source."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 2
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))  # noqa: E731, B023
        text = " ".join(word() for _ in range(40)) + "." if good else " ".join(rng.choice(["BUY", "NOW", "!!!", word()]) for _ in range(40))
        rows.append((i, text, "en", "a" if bool(good) != (rng.random() < 0.1) else "b"))
        if i < labelled:
            labels.append((i, good, 0))
    return rows, labels


def test_partitions_add_up(spark):
    rows, labels = corpus()
    docs, known = docs_of(spark, rows).repartition(7), spark.createDataFrame(labels, LABELS)
    with _store.Workspace(spark, "test") as space:
        model, table = quality._fitted(docs, known, space)
        kept = table.toPandas().sort_values("doc_id")
    views = [np.stack([np.frombuffer(b, np.float32) for b in kept[c]]).astype(float) for c in ("t", "m")]
    have = kept["_quality"].notna().to_numpy()
    free = tuple(v[~have] for v in views)
    alone = quality.train(tuple(v[have] for v in views), kept["_quality"][have].to_numpy(float), kept["_fold"][have].to_numpy(), lambda m: quality.exchanged(m, free, 0.95), 4)
    for a, b in zip(model.weights + model.calibration + [model.joint], alone.weights + alone.calibration + [alone.joint], strict=True):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-8)
    assert model.errors == alone.errors and len(model.errors) == 5
    # the rounds are no idle ones: without them the weights are others
    idle = quality.train(tuple(v[have] for v in views), kept["_quality"][have].to_numpy(float), kept["_fold"][have].to_numpy(), None, 0)
    assert not np.allclose(idle.weights[1], model.weights[1], atol=1e-3)


def test_every_unlabelled_row_takes_part(spark):
    rows, labels = corpus()
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, known)
    with _store.Workspace(spark, "test") as space:
        _, table = quality._fitted(docs, known, space, rounds=0)
        n = [s[0] for s in quality._added_up(table.where("_quality IS NULL"), model, 0.5)]
    assert n == [len(rows) - len(labels)] * 2
    good = quality.score(docs, model).join(spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, want int"), "doc_id")
    assert good.where("keep = want").count() >= 0.97 * len(rows)


def test_words_are_seen():
    views = quality.Views()
    import pyarrow as pa

    a, b, c, d = views.text(pa.array(["one two three", "two three one", "one two four", None]))
    assert a.shape == (quality.TEXT,) and (a == b).all() and (a != c).any() and (d[-quality.CONTENT :] != 0).sum() <= 1


def test_odd_rows(spark):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, LABELS)
    odd = [(1000, None, None, None), (1001, "", "xx", ""), (None, "some text", "en", "a"), (1002, "word " * 200_000, "en", "a"), *[rows[0]] * 50]
    docs = docs_of(spark, rows + odd)
    out = quality.assess(docs, known)
    assert out.count() == len(rows) + len(odd) and out.where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
    same = out.where("doc_id = 0").select(F.round("score", 9)).distinct().count()
    assert same == 1 and out.columns == ["doc_id", "text_score", "meta_score", "score", "keep"]
    assert quality.assess(docs.limit(0), known).count() == 0
    assert quality.assess(docs, known.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.assess(docs, known, F.col("quality") == 1).where("score <= 0.5").count() == 0
