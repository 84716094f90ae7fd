"""Neighbours of a pack are found whole in one task, with vectors as narrow as they can be."""

import numpy as np
import pyarrow as pa
import pytest

from loomgraph import catalogue
from loomgraph.functions.shared import Rounds
from loomgraph.operators import models
from loomgraph.operators import transforms as T

DATA = "/root/testdata/sf0.001"
#: Queries over neighbours, by the number of their finding.
NEIGHBOURS = {
    15: "symmetrize_clip",
    1: "connected_components",
    20: "t_normalize_adj",
    18: "t_gcn_filter",
    16: "t_clustering_coeff",
    14: "segment_softmax",
    12: "gat_attention",
    11: "conv_sage",
    10: "conv_message_passing",
    9: "conv_gin_batch",
    8: "conv_gin",
    7: "conv_general",
    6: "conv_gat",
    5: "conv_edge",
    4: "conv_ecc",
    3: "conv_crystal",
    2: "conv_agnn",
}


@pytest.mark.parametrize("name", NEIGHBOURS.values())
def test_neighbours_leave_their_task_once(spark, name, monkeypatch):
    """No k nearest of each pair of packs are shuffled and ranked, and no pack travels with each of its candidates."""
    plans = []

    def table(self, df, name):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(self, df, name)

    written = Rounds.table
    monkeypatch.setattr(Rounds, "table", table)
    catalogue.QUERIES[name](spark, DATA)
    (plan,) = [p for columns, p in plans if "e" in columns]
    assert "MapInArrow" in plan and "Window" not in plan and "a_x" not in plan


def sets():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    yield "plain", x
    yield "64ths", np.floor(x / 3 * 64 + 0.5) / 64
    yield "singles", x.astype(np.float32).astype(float)
    yield "far from 0", x + 1e7
    yield "near copies", np.repeat(x[:20], 20, axis=0) + rng.normal(size=(400, 5)) * 1e-9
    yield "copies", np.repeat(x[:8], 50, axis=0)
    yield "one point", np.zeros((400, 5))
    yield "large and small", x * 10.0 ** rng.integers(-60, 60, (400, 1))


@pytest.mark.parametrize("kind, x", [pytest.param(*s, id=s[0]) for s in sets()])
def test_neighbours_of_vectors_of_all_scales(spark, kind, x):
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, i, v.tolist()) for i, v in enumerate(x[:4])]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, x array<double>")
    got = {(r["graph_id"], r["src"], r["dst"]): r["d2"] for r in T.knn_edges(nodes, 5, 5, pack=150).collect()}
    want = {}
    for g, part in ((0, x), (1, x[:4])):
        gap = part[:, None] - part[None]
        d2 = np.zeros(gap.shape[:2])
        for c in range(part.shape[1]):
            d2 += gap[:, :, c] ** 2
        for i in range(len(part)):
            near = sorted((d2[i, j], j) for j in range(len(part)) if j != i)[:5]
            want |= {(g, i, j): d for d, j in near}
    assert got == want


@pytest.mark.parametrize("kind, x, size", [("int8", [[0.5, -1 / 64]], 2), ("float32", [[0.1, 3.0]], 8), ("float64", [[1 / 3, 3.0]], 16)])
def test_packs_hold_vectors_as_narrow_as_they_can_be(kind, x, size):
    x = np.array(x, np.float32 if kind == "float32" else np.float64).astype(float)
    rows = pa.table({"graph_id": [0], "node_id": [7], "x": pa.array(x.tolist(), pa.list_(pa.float64())), "pack": [0]})
    (row,) = T._packed(5)(rows).to_pylist()
    assert (row["kind"], len(row["x"]), row["known"], row["kept"]) == (kind, size, b"", 1)


def test_components_go_on_with_fewer_edges(spark, monkeypatch):
    """Edges inside a component found so far are gone in the next round."""
    sizes = []

    def table(self, df, name):
        got = written(self, df, name)
        sizes.extend([got[0].count()] * (name == "edges"))
        return got

    written = Rounds.table
    monkeypatch.setattr(Rounds, "table", table)
    rng = np.random.default_rng(7)
    pairs = {(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 3000, (2600, 2))} | {(2, i, i + 1) for i in range(0, 500)} | {(3, i * 37 % 501, (i + 1) * 37 % 501) for i in range(500)}
    names = [(g, i) for g in (0, 1) for i in range(3000)] + [(g, i) for g in (2, 3) for i in range(501)] + [(4, 9), (None, 1), (4, None)]
    at = {v: v for v in names}

    def root(v):
        while at[v] != v:
            v = at[v]
        return v

    for g, a, b in pairs:
        p, q = sorted((root((g, a)), root((g, b))))
        at[q] = p
    nodes = spark.createDataFrame(names, "graph_id long, node_id long")
    edges = spark.createDataFrame(sorted(pairs), "graph_id long, src long, dst long")
    got = {(r["graph_id"], r["node_id"]): r["component"] for r in models.connected_components(edges, nodes).collect()}
    assert got == {v: root(v)[1] for v in names if None not in v}
    assert sizes[-1] == 0 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:], strict=False))


def test_products_of_packs_use_the_same_memory(monkeypatch):
    made = []

    def matmul(a, b, out=None):
        made.append(out)
        return product(a, b, out=out)

    product = np.matmul
    monkeypatch.setattr(T.np, "matmul", matmul)
    x = np.random.default_rng(1).normal(size=(600, 4))
    packs = [T._packed(3)(pa.table({"graph_id": [0] * 200, "node_id": list(range(i, i + 200)), "x": x[i : i + 200].tolist(), "pack": [i] * 200})) for i in (0, 200, 400)]
    rows = [(packs[0], False)] + [(p, True) for p in packs]
    batches = (pa.record_batch({"graph_id": [0], "pack": [0], "candidate": [c], **{n: p[n].combine_chunks() for n in ("ids", "kept", "kind", "x", "known")}}) for p, c in rows)
    got = [(r["src"], r["dst"]) for b in T._nearest_in_packs(3)(batches) for r in b.to_pylist()]
    d2 = ((x[:200, None] - x[None]) ** 2).sum(axis=2)
    assert got == [(i, j) for i in range(200) for j in [j for j in np.lexsort((np.arange(600), d2[i])).tolist() if j != i][:3]]
    assert len(made) > 3 and all(m is not None and np.shares_memory(m, made[0]) for m in made)
