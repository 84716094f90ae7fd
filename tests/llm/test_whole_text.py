"""Training-data operators where they once lost a part of their results."""

import numpy as np

from loomgraph.llm import decontamination

ITEM = "Then Alice bought 12 apples for 30 dollars and gave 12 of them to her friend Bob near the river."


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(docs, bench).collect()}
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in found}
    return found


def test_occurrences_are_judged_apart(spark):
    item = "so Alice has 12 apples and Bob has 30 more but then Alice eats 12 and Bob sells 30 of them"
    fill = lambda a, b, n, m: item.replace("Alice", a).replace("Bob", b).replace("12", n).replace("30", m)
    twice = fill("Carla", "Dan", "3", "4") + " . some words stand between the two of them here . " + fill("Eve", "Fred", "5", "6")
    apart = " and ".join(fill("Carla", "Dan", "3", "4").split(" and ", 1)[:1]) + " and also " + fill("Carla", "Dan", "3", "4").split(" and ", 1)[1]
    found = leaks(spark, [twice, apart, item, fill("Carla", "Dan", "3", "4").replace("3", "9", 1)], [item])
    assert found[0, 0]["kind"] == "filled anew" and (1, 0) in found and found[2, 0]["kind"] == "verbatim" and (3, 0) not in found


def test_names_at_sentence_starts_and_other_cases(spark):
    item = "Natalia sold 48 clips to friends in April.\nNatalia gave 12 more to Bob at noon.\nHow many clips did Natalia sell to Bob?"
    anew = item.replace("Natalia", "Carla").replace("48", "51").replace("Bob", "Dan").replace("12", "9")
    wrapped = item.replace("\n", " ").replace(" Bob", "\nBob").replace(" April", "\nApril")
    texts = [anew, item.lower(), item.title(), item.upper(), wrapped, item.lower().replace("48", "51").replace("12", "9"), "Natalia sold clips to nobody. Bob gave 12."]
    found = leaks(spark, texts, [item])
    assert {d for d, _ in found} == set(range(6))
    assert found[0, 0]["kind"] == "filled anew" and all(found[d, 0]["kind"] == "verbatim" for d in (1, 2, 3, 4)) and found[5, 0]["kind"] == "filled anew"
    assert all(found[d, 0]["windows"] == found[d, 0]["item_windows"] for d in (0, 1, 2, 3, 4))


def test_window_hashes_see_every_token():
    tokens = np.arange(40, dtype=np.uint64)
    for w in range(1, 20):
        whole = decontamination.window_hashes(tokens, np.array([25, 15]), w)
        assert (whole > 0).sum() == max(0, 26 - w) + max(0, 16 - w) and len(set(whole[whole > 0].tolist())) == (whole > 0).sum()
        for j in range(40):
            other = tokens.copy()
            other[j] += np.uint64(100)
            changed = np.flatnonzero(decontamination.window_hashes(other, np.array([25, 15]), w) != whole)
            assert changed.tolist() == [i for i in range(j - w + 1, j + 1) if i >= 0 and whole[i]]


def test_long_passages_of_long_items(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    texts = [" ".join(["before", *words[60 : 60 + n], "after"]) for n in (84, 27, 13, 12)]
    found = leaks(spark, texts, [" ".join(words)])
    assert {d: r["literal_run"] for (d, _), r in found.items()} == {0: 84, 1: 27, 2: 13}
