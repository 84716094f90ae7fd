"""The corpus pipeline's stages against brute force, their odd rows, and what is left on disk."""

import hashlib
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _store, queries

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, sig string, kind string, _least long"
ITEM = "then there were 12 apples and 30 pears in the basket of the old farmer near the wide river"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "sig", None, 4) for i, t, s in rows], COLUMNS)


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder of a few labels and items."""
    spark.createDataFrame([(k, 1, k % 2) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def training(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rude = "stupid ugly fool worthless idiot moron".split()
    return [(k, " ".join([*(word() for _ in range(30)), *((rng.choice(rude) for _ in range(5)) if k % 2 else ()), *(word() for _ in range(30))]), "s") for k in range(600)]


def test_toxic_documents_go(spark, folder):
    rows = [*training(spark), (1000, "abc the garden def", "s"), (1001, "abc def stupid worthless fool idiot ghi moron", "s"), (1002, None, "s"), (1003, "", "s"), (1001, "abc def stupid worthless fool idiot ghi moron", "s")]
    docs = docs_of(spark, rows)
    kept = pipeline.reject_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [*range(0, 600, 2), 1000, 1002, 1003]


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_of_each_group_stays(spark, folder):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = lambda t, k: " ".join(["x"] * k + t.split()[k:])
    rows = [(7, base[0], "s"), (3, base[0], "s"), (9, near(base[0], 2), "s"), (4, base[1], "s"), (5, near(base[1], 30), "s"), (6, None, "s"), (8, "", "s"), (11, "one two", "s"), (12, "One two", "s"), (None, base[0], "s"), (20, base[2], "z"), (20, base[2], "y"), (20, base[2], None), (2, near(base[3], 1), "s"), (1, near(base[3], 3), "s")]
    docs = docs_of(spark, rows)
    kept = pipeline.one_of_each(spark, docs, folder)
    assert kept.columns == docs.columns
    label = {i: i for i, _, _ in rows if i is not None}
    texts = {i: t for i, t, _ in rows if i is not None}
    for _ in label:
        for a in label:
            for b in label:
                x, y = shingles(texts[a]), shingles(texts[b])
                if x & y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    got = sorted(((r["doc_id"], r["source"]) for r in kept.collect()), key=str)
    want = [(i, None if i == 20 else "s") for i in label if label[i] == i] + [(None, "s")]
    assert got == sorted(want, key=str) and len(want) < len(rows) - 4


def test_leaks_go(spark, folder):
    anew = ITEM.replace("12", "5").replace("30", "8")
    rows = [(1, f"before {ITEM} after", "s"), (2, f"before {anew} after", "s"), (3, "nothing of it here", "s"), (4, None, "s"), (5, "", "s"), (6, " ".join(ITEM.split()[:6]), "s"), (2, f"before {anew} after", "s"), (None, ITEM, "s"), (None, "clean", "s")]
    docs = docs_of(spark, rows)
    kept = pipeline.drop_leaks(spark, docs, folder)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 6]


def test_personal_data_become_marks(spark, folder):
    rows = [(1, "mail a.b@c.de now", "s"), (2, None, "s"), (3, "", "s"), (4, "at 10.0.0.1 or +49 170 1234567.", "s"), (4, "at 10.0.0.1 or +49 170 1234567.", "s"), (5, "nothing 12 here", "s"), (None, "x@y.zz", "s")]
    docs = docs_of(spark, rows)
    out = pipeline.redact_personal_data(spark, docs, folder)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in out.collect() if r["text"] is not None)
    assert got == [("1", "mail <EMAIL> now"), ("3", ""), ("4", "at <IP> or <PHONE>."), ("4", "at <IP> or <PHONE>."), ("5", "nothing 12 here"), ("None", "<EMAIL>")]
    assert out.where("text IS NULL").count() == 1 and out.agg(F.sum("n_chars")).first()[0] == docs.agg(F.sum("n_chars")).first()[0]


def test_no_documents(spark, folder):
    docs = docs_of(spark, [])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert pipeline.tokenize(spark, docs, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run_is_its_stages_and_leaves_its_result(spark):
    from tokenizers import Tokenizer

    _store.release()
    base = _store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    result = {r["doc_id"]: r for r in pipeline.run(spark, DATA).collect()}
    left = [d for d in set(os.listdir(base)) - before if d.startswith(("pipeline", "pii"))]
    assert [d.split("-")[0] for d in left if os.listdir(f"{base}/{d}")] == ["pipeline"]
    assert len([t for d in left for t in os.listdir(f"{base}/{d}")]) == 1
    # every stage again, in memory, with the decisions taken apart
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in pipeline.reject_toxic(spark, docs, DATA).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    sets = {i: shingles(t) for i, t in rows.items()}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    label = {i: i for i in rows}
    links = {(a, b) for i, s in sets.items() for g in s for a, b in [(i, j) for j in where[g] if j != i]}
    links = [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    rows = {i: t for i, t in rows.items() if label[i] == i}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    windows = {tuple(w[k : k + 8]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [words(r["text"])] for k in range(len(w) - 7)}
    rows = {i: t for i, t in rows.items() if not any(tuple(w[k : k + 8]) in windows for w in [words(t)] for k in range(len(w) - 7))}
    assert sorted(result) == sorted(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same = 0
    for i, t in rows.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        same += result[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    changed = {r["doc_id"] for r in queries.op7_pii(spark, DATA).where("spans <> ''").collect()} & set(rows)
    assert same == len(rows) - len(changed) and changed


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Other:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="checkpoint"):
        _store.shared_dir(Other())
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        for given, want in (("1m", "1m"), ("64m", f"{_store.BATCH_BYTES}b"), ("1000b", "1000b")):
            spark.conf.set(key, given)
            _store.prepare(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, held)


def test_entry_point_with_a_requirement_missing(monkeypatch):
    import __spark_entry__ as entry

    assert {"op1_chat", "pipeline"} <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("loomgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import loomgraph

    monkeypatch.delattr(loomgraph, "llm")
    monkeypatch.setitem(sys.modules, "xxhash", None)
    left = entry.queries()
    assert "gcn_trade" in left and not any(q.startswith("op") or q == "pipeline" for q in left)
    assert set(entry.oracle_sql()) <= set(left)
