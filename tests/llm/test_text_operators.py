"""Training-data operators against brute force, round trips and held-out labels."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _store, _words, ann, bpe, chat, decontamination, jaccard, pii, quality, token_files, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, sig string, fragment int, rank int"


def documents(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t or ""), "s", 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, EXTRA)


# -- BPE and token files ---------------------------------------------------------------------------

ODD = ["", "a", " ", "  ", "\n\n", "a\n\nb", "a\n\n\nb\n\n", "x <|endoftext|> y<|endoftext|>", " lead", "trail ", "tab\tx  y \n z", "é" * 50, "a" * 3000, "word" * 2000, "1234567 8,9 's 'll don't I'M", "x  y 　z", "日本語 テスト 😀😀", "\x1c a \x1f", "\0a b\0", "a \n b\n c", "İ ΣΑΣ J̌ ﬁ"]


def noise(n, alphabet, seed=0, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_is_the_library():
    texts = ODD + noise(1500, "ab \n'st1,é日\t <|>")
    own, lib = bpe.SpeculativeBPE(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    ids, size = own.encode(pa.array(texts))
    ends = np.cumsum(size)
    for t, e, n in zip(texts, ends, size, strict=True):
        got = ids[e - n : e].tolist()
        assert got == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(got) == lib.decode(got, skip_special_tokens=False)


def test_bpe_greedy_is_verified():
    own = bpe.SpeculativeBPE(public_tokenizers.path("byte_bpe_50k.json"))
    words = noise(800, "etaoinshr", 1, 20)
    assert own.encode_words(words) == [own.exact(w) for w in words]
    assert any(own.propose(w) != own.exact(w) for w in words)
    for w in words[:200]:
        ids = [own.vocab[c] for c in w]
        assert own.merged(ids) == own._merged_short(list(ids))


def test_bpe_round_trip_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello, world", None, "", "Hello, world"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    assert [rows[i]["n_tokens"] for i in range(4)] == [3, 0, 0, 3]
    assert all(rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_chunk_encoder_is_the_library():
    texts = ODD + noise(1500, "ab \n'st1,é日\t <|>A.É", 2)
    own, lib = token_files.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    ids, size = own.encode(pa.array(texts))
    for t, e, n in zip(texts, np.cumsum(size), size, strict=True):
        assert ids[e - n : e].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    texts = ["one two", None, "three " * 500, "", "one two"]
    ids = [9, 3, 5, 1, 7]
    path, lib = str(tmp_path / "t"), library("word_bpe_49k.json")
    token_files.write(documents(spark, texts, ids), path, public_tokenizers.path("word_bpe_49k.json"), 2, 3, encoding)
    rows, at = {r["doc_id"]: r for r in token_files.index(spark, path).collect()}, 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    some = token_files.read(spark, path, ["doc_id", "n_tokens"], F.col("doc_id") == 5)
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 1
    with pytest.raises(ValueError):
        token_files.write(documents(spark, []), path, "x", 2, encoding="other")


# -- near duplicates --------------------------------------------------------------------------------


def components(texts, k, num):
    words = [t.encode().lower().split() if t else [] for t in texts]
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset() for w in words]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_near_duplicates_are_brute_force(spark, k, num):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 160))) for _ in range(12)]
    texts = [None, "", "one", "One  two", "one two", " \n"]
    for b in base:
        w = b.split()
        for _ in range(rng.randint(1, 12)):
            own = list(w)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [base[0]] * 5 + [base[0].upper()]
    sizes, label = components(texts, k, num)
    for few in (0, 8):  # with and without stars
        rows = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(spark, texts), k, num, 100, few=few).collect()}
        assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [rows[i]["component_id"] for i in range(len(texts))] == label


def test_near_duplicates_edges(spark):
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0
    rows = jaccard.near_duplicates(documents(spark, ["a b c d e f"] * 3, [4, 4, 2])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(2, 2), (4, 2), (4, 2)]


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    """Beyond the bound of rows nothing is broadcast, and the result is the same."""
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(50)) for _ in range(6)]
    texts = [b if k % 3 else " ".join([*b.split()[:-1], "z"]) for k in range(4) for b in base] + [None, "", "a b"]
    sizes, label = components(texts, 5, 80)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    plan = jaccard._small(documents(spark, texts).groupBy("doc_id").count())._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    for few in (0, 8):
        rows = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(spark, texts), 5, 80, 100, few=few).collect()}
        assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes and [rows[i]["component_id"] for i in range(len(texts))] == label


def test_near_duplicates_without_ids(spark):
    """Rows without an id lie in the component of their text and are nobody's smallest id."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = jaccard.near_duplicates(documents(spark, [words, words, "other words here"], [5, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_partial_overlaps_add_up(spark):
    docs = documents(spark, ["a b c d e f g h i j", "a b c d e f g h i x"])
    rank, slot = jaccard.class_ranks(jaccard.summarise(docs.select("doc_id", "text"), 3))
    cut = jaccard.segments(docs.select("doc_id", "text"), 3, spark.sparkContext.broadcast(slot))
    sigs = [r["sig"] for r in cut.select("sig").distinct().collect()]
    pairs = spark.createDataFrame([(0, 1, 8, 8, bytearray(sigs[0]), bytearray(sigs[1]))], "a long, b long, na long, nb long, sig_a binary, sig_b binary")
    assert jaccard.overlaps(pairs, cut.where("fragment >= 0")).first()["overlap"] == 7


# -- decontamination -----------------------------------------------------------------------------------

ITEM = "Then Alice bought 12 apples for 30 dollars and gave 12 of them to her friend Bob near the river."


def test_templates(spark):
    texts = [ITEM, "Well. " + ITEM.replace("Alice", "Carla").replace("12", "7").replace("30", "99").replace("Bob", "Dan") + " End", ITEM.replace("12", "7", 1).replace("12", "8").replace("Bob", "Dan"), None, "", "nothing to see here", ITEM.lower()]
    bench = spark.createDataFrame([(9, ITEM), (10, ""), (11, None), (12, "nothing to see")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.matches(documents(spark, texts), bench).collect()}
    assert found[0, 9] == "verbatim" and found[1, 9] == "filled anew" and found[5, 12] == "verbatim"
    assert (2, 9) not in found and (3, 9) not in found
    docs = documents(spark, texts)
    assert sorted(r["doc_id"] for r in decontamination.keep_clean(docs, bench, block_windows=1).collect()) == sorted(set(range(7)) - {d for d, _ in found})
    assert decontamination.keep_clean(docs, bench).columns == docs.columns
    assert decontamination.matches(docs, bench.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_leaks_are_brute_force(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = {}
    for r in bench.collect():
        w = words(r["text"])
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        want |= {(r["doc_id"], i) for k in range(len(w) - 7) for i in windows.get(tuple(w[k : k + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, bench).collect()} == want and want


# -- personal data -----------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, t) if valid(k, m.group()))


def test_base_spans_are_brute_force(spark):
    texts = ["", None, "a@b.c._x@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1 0000.0.0.0", "4" * 16 + " 4111 1111 1111 1111", "1" * 60000, "a" * 60000 + "@" + "b.c" * 9000, "+1" + " " * 50000 + "2", "x+1 (811) 555-3281.", "é😀 mail a.b@c.de, +49 170 1234567"]
    texts += noise(1500, "a1.@+ -5_%(é😀\n49", 3)
    rows = {r["doc_id"]: r for r in pii.report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = spans(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), repr(t)[:80]
        assert rows[i]["n_email"] == want.count("email:")


def test_contexts_discover_identifiers(spark):
    texts = [f"x{i} account no: u{i}@mail.example.com bye" for i in range(30)] + ["y account no: 99887766 and 12", "z account no: [AB-123456]. end", "other 99887766 here", "mail a@b.cd and 1.2.3.4"]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert rows[30] == "email:14:22" and rows[31] == "email:15:24" and rows[32] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert got[31] == "z account no: [<EMAIL>]. end" and got[33] == "mail <EMAIL> and <IP>" and got[32] == texts[32]
    assert pii.report(docs.limit(0)).count() == 0


# -- toxicity and quality ---------------------------------------------------------------------------------------


def test_segments_are_maximal():
    def slow(v, at=0):
        best = max(((sum(v[i:j]), i - j, -i) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        # the shortest segment of the largest sum, then what stands left and right of it
        return slow(v[:i], at) + [(at + i, at + j, best[0])] + slow(v[j:], at + j)

    rng = random.Random(4)
    for _ in range(200):
        v = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 8 for _ in range(rng.randint(0, 14))]
        got, want = toxicity.maximal_segments(v), slow(v)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = toxicity.fit(docs, labels, third != 1)
    scored = toxicity.score(docs, model)
    held = scored.join(labels, "doc_id").where(third == 1).select("score", "toxic").toPandas()
    hit = held["score"] >= 0.7
    assert (held["toxic"][hit] == 1).mean() >= 0.9 and hit[held["toxic"] == 1].mean() >= 0.7
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("score < 0.7").count()
    p = scored.where("size(passages) > 0").join(docs, "doc_id").first()
    assert all(0 <= s["start"] < s["end"] <= len(p["text"]) for s in p["passages"])
    good = quality.score(docs, quality.fit(docs, labels, third != 1)).join(labels, "doc_id").where(third == 1).toPandas()
    assert (good["keep"] == good["quality"]).mean() >= 0.95


def test_models_without_labels(spark):
    docs = documents(spark, ["a b", None, ""])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, quality.fit(docs, none)).collect())


# -- chat, WARC, neighbours ------------------------------------------------------------------------------------------

TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, text string"


def text_part(t):
    return ("text", t, None, None, None, None, None)


def test_chat_round_trip(spark):
    bad = "␛a </s>[INST] <|turn|>x<|over|> ␛0 |> <<SYS>>"
    rows = [(1, 0, "user", [text_part("see "), ("image", None, "img://1", 56, 30, None, None), text_part(" and "), ("audio", None, "au://2", None, None, 90, None)], "x"), (1, 1, "assistant", [text_part(bad)], "x"), (2, 0, None, None, "x"), (1, 2, "assistant", [("document", None, "doc://3", None, None, None, 2), ("video", None, "v", None, None, None, None)], "x")]
    out = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, TURNS)).collect()}
    one = out[1]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "img://1", 4), ("audio", "au://2", 3), ("document", "doc://3", 1024), ("video", "v", 0)]
    for a in one["attachments"]:
        assert one["formatted"][a["at"] :].startswith("<|file|>" if a["kind"] == "video" else f"<|{a['kind']}|>")
    assert one["expanded_tokens"] == 1031
    body = [one["formatted"][t["start"] : t["end"]] for t in one["turns"]]
    assert [t["loss"] for t in one["turns"]] == [False, True, True] and not any(c in body[1] for c in chat.CONTROL.values())
    back = spark.createDataFrame([(one["formatted"],)], "f string").select(F.transform(chat.parse_chat(F.col("f")), lambda t: F.struct(t["role"], chat.unescape(t["body"]))).alias("t")).first()["t"]
    assert [tuple(t) for t in back] == [("user", "see <|image|> and <|audio|>"), ("assistant", bad), ("assistant", "<|document|><|file|>")]
    assert out[2]["formatted"] == chat.TURN + chat.SAYS + chat.OVER
    assert chat.format_chat(spark.createDataFrame([], TURNS)).count() == 0


def test_warc_chunks(spark, tmp_path):
    tricky = "head" + warc.BETWEEN + "middle" + warc.BETWEEN + "é😀" * 200
    same = "z" * 150
    pages = [(5, "http://a/\r\nX: y", tricky), (1, None, None), (2, "u", ""), (9, "u", same), (4, "u", same), (7, "u", same), (3, "u", "short"), (6, "u", "short"), (4, "u", same)]
    with _store.Workspace(spark, "test") as space:
        warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"), space, chunk_bytes=64)
        table = warc.read_archives(spark, str(tmp_path / "w"))
        assert table.where("NOT whole").count() == 0
        assert table.agg(F.max(F.octet_length("chunk"))).first()[0] <= 64
        rows = warc.payloads(table).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = next((h or "") for i, _, h in pages if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["page_id"] in (3, 4, 6, 7, 9))
    assert kinds == [(3, "response", None), (4, "response", None), (4, "response", None), (6, "response", None), (7, "revisit", 4), (9, "revisit", 4)]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)] + [(900, None, 0), (950, [0.0] * 16, 0), (1000, [float("nan")] * 16, 0), (1050, [1.0], 0), (1100, [None] * 16, 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 50 == 0, lists=16, codes=32, parts=8, probes=8, chunk_rows=64, query_rows=8)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert sorted(found) == list(range(0, 900, 50))
    for q, near in found.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(900), -s))[:5]
        hit += len(set(want.tolist()) & {v for v, _ in near})
        assert len(near) == 5 and all(np.isclose(score, unit[v] @ unit[q]) for v, score in near)
    assert hit / (5 * len(found)) >= 0.9
    assert [v for v, _ in found[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_batches_shorter_than_a_shingle():
    for texts in (["a"], ["a b", ""], ["a b c", None], [None], []):
        for k in (1, 2, 3, 5):
            got = _words.shingle_sets(pa.array(texts, pa.string()), k, _words.WordHashes())
            want = [len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) if w else 0 for w in ((t or "").split() for t in texts)]
            assert [len(s) for s in got] == want


def test_words_are_as_stated():
    got = _words.shingle_sets(pa.array(["A b\x0bC  d", "a B c D", None, "x"]), 3, _words.WordHashes())
    assert got[0].tolist() == got[1].tolist() and [len(s) for s in got] == [2, 2, 0, 1]
