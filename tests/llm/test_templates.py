"""Decontamination against loops over all alignments, and its work on tables of numbers."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import decontamination

DOCS = "doc_id long, text string, item_id long, kind string"
WINDOW, COVERAGE, RUNNING = 8, 0.4, 13


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], DOCS)


def bench_of(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def slow(text, item):
    """The kind of leak by trying every alignment; lower-case words and whole numbers only, so there are two readings."""
    a, b = item.split(), text.split()
    w = min(WINDOW, len(a))
    if not w:
        return None
    lines = {}
    for offset in range(1 - len(a), len(b)):
        for i in range(len(a) - w + 1):
            if 0 <= i + offset and i + offset + w <= len(b):
                own, there = a[i : i + w], b[i + offset : i + offset + w]
                alike = all(x == y or x.isdigit() and y.isdigit() for x, y in zip(own, there, strict=True))
                if own == there or alike and not all(x.isdigit() for x in own):
                    lines.setdefault(offset, set()).add(i)
    offsets = sorted(lines)
    near = [[]]
    for o in offsets:
        if near[-1] and o - near[-1][-1] > WINDOW:
            near.append([])
        near[-1].append(o)
    best = None
    for chosen in [*([o] for o in offsets), *near, offsets]:
        found, map_to, clash, differ, longest = set(), {}, False, 0, 0
        for o in chosen:
            covered = {x for i in lines[o] for x in range(i, i + w)}
            run = 0
            for x in range(len(a)):
                run = run + 1 if x in covered and a[x] == b[x + o] else 0
                longest = max(longest, run)
            # only slots of windows that are no literal copies are slots
            slots = {x for i in lines[o] if a[i : i + w] != b[i + o : i + o + w] or not all(t.isdigit() for t in a[i : i + w]) for x in range(i, i + w) if a[x].isdigit()}
            for x in slots:
                clash |= map_to.setdefault(a[x], b[x + o]) != b[x + o]
                differ += a[x] != b[x + o]
            found |= lines[o]
        total = len(a) - w + 1
        if found and (longest >= RUNNING or len(found) >= COVERAGE * total and (not clash or longest >= w)):
            kind = "inconsistent" if clash else "filled anew" if differ else "verbatim"
            key = (not clash, len(found), -differ, longest)
            best = max(best or (key, kind), (key, kind), key=lambda m: m[0])
    return best and best[1]


def test_matches_are_all_alignments(spark):
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}x" for i in range(20)]

    def item():
        return " ".join(str(rng.randint(1, 60)) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(3, 40)))

    def refill(t, consistent=True):
        new = {}
        return " ".join((new.setdefault(x, str(rng.randint(100, 999))) if consistent else str(rng.randint(100, 999))) if x.isdigit() else x for x in t.split())

    items = [item() for _ in range(14)] + ["4 8 15 16 23 42 108 99 7", "", "wax"]
    texts = []
    for t in items:
        cut = t.split()
        part = " ".join(cut[len(cut) // 4 : len(cut) // 4 + 16])
        texts += [t, refill(t), refill(t, False), f"{item()} {refill(t)} {item()} {refill(t)}", f"{item()} {part} {item()}", f"{refill(part)} {item()}", item(), t[: len(t) // 2]]
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.matches(docs_of(spark, texts), bench_of(spark, items), WINDOW, COVERAGE, 200, RUNNING).collect()}
    want = {(d, k): kind for d, t in enumerate(texts) for k, i in enumerate(items) if (kind := slow(t, i))}
    assert found == want and len(set(want.values())) >= 2 and len(want) > 40


def test_odd_tables(spark):
    item = "so there were 12 apples and 30 pears in the basket of 12 apples"
    twice = docs_of(spark, [item, None, "", "filler " * 200_000 + item]).unionAll(docs_of(spark, [item]))
    bench = bench_of(spark, [item, item, None])
    rows = decontamination.matches(twice, bench).groupBy("doc_id", "item_id").count().collect()
    assert {(r["doc_id"], r["item_id"]): r["count"] for r in rows} == {(0, 0): 2, (0, 1): 2, (3, 0): 1, (3, 1): 1}
    kept = decontamination.keep_clean(twice, bench)
    assert kept.columns == twice.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert decontamination.matches(twice.limit(0), bench).count() == 0 and decontamination.keep_clean(twice.limit(0), bench).count() == 0
    assert decontamination.matches(twice, bench.limit(0)).columns == decontamination.matches(twice, bench).columns
    assert decontamination.keep_clean(twice.withColumn("doc_id", F.lit(None).cast("long")), bench).count() == 2


def test_tables_of_numbers_are_cheap():
    rng = random.Random(0)
    number = lambda n: " ".join(str(rng.randint(0, 99)) for _ in range(n))
    index = decontamination.Index([(k, number(400)) for k in range(20)], WINDOW)
    templates = decontamination.Templates()
    took = []
    for n in (1_000, 20_000):
        began = time.process_time()
        assert index.search(*templates.tokens(pa.array([number(n)])), COVERAGE, RUNNING) == []
        took.append(time.process_time() - began)
    assert took[0] < 1 and took[1] < 5
