"""Golden values and NumPy re-derivations on small graphs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators import conv, filters, layouts, linalg, models, pool
from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet


def graph(spark, a, x=None, e=None):
    return GraphSet.from_arrays(spark, [{"a": a, "x": x or [[float(i)] for i in range(len(a))], "e": e}])


def dense(edges, n):
    m = np.zeros((n, n))
    for r in edges.collect():
        m[r["src"], r["dst"]] += r["w"]
    return m


def matrix(nodes):
    return np.array([r["x"] for r in nodes.orderBy("graph_id", "node_id").collect()])


RNG = np.random.default_rng(5)
A = (RNG.random((6, 6)) < 0.4).astype(float) * RNG.integers(1, 4, (6, 6))
XS = RNG.integers(-4, 5, (6, 3)) / 4.0
ES = RNG.integers(-4, 5, (6, 6, 2)) / 4.0


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, A.tolist(), XS.tolist(), ES.tolist())


def test_scatters_are_numpy(spark):
    rng = np.random.default_rng(21)
    to, v = rng.integers(0, 9, 40), np.round(rng.normal(size=40), 3)
    to[to == 6] = 7  # nothing goes to 6
    m = spark.createDataFrame([(0, int(i), float(x)) for i, x in zip(to, v, strict=True)], "graph_id long, dst long, v double")
    u = spark.createDataFrame([(0, i) for i in range(9)], "graph_id long, node_id long")
    own = {"sum": (np.sum, 0), "mean": (np.mean, 0), "max": (np.max, linalg.LOWEST), "min": (np.min, linalg.HIGHEST), "prod": (np.prod, 1)}
    assert set(own) == set(linalg.SEGMENT)
    for how, (f, empty) in own.items():
        got = matrix(linalg.scatter(m, "dst", [F.col("v")], u, how)).ravel()
        assert np.allclose(got, [f(v[to == i]) if (to == i).any() else empty for i in range(9)]), how


def test_segment_top_k_is_a_sort(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([0.25, 0.75, 1.5, -2.0])) for g, n in ((0, 7), (3, 1), (5, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "graph_id long, node_id long, s double")
    for ratio in (0.3, 0.5, 1.0):
        got = [(r["graph_id"], r["node_id"], r["rank"]) for r in linalg.segment_top_k(df, F.col("s"), ratio).orderBy("graph_id", "rank").collect()]
        want = []
        for g in (0, 3, 5):
            own = sorted(((-s, i) for h, i, s in rows if h == g))
            want += [(g, i, k + 1) for k, (_, i) in enumerate(own[: math.ceil(ratio * len(own))])]
        assert got == want


def test_incidence_and_line_graph_are_numpy(spark):
    # a ring of five with two chords and a node on a string
    a = np.zeros((6, 6))
    for i, j in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 3), (0, 2), (4, 5)):
        a[i, j] = a[j, i] = 1
    ends = [(i, j) for i in range(6) for j in range(i, 6) if a[i, j]]
    b = np.zeros((6, len(ends)))
    for k, (i, j) in enumerate(ends):
        b[i, k] = b[j, k] = 1
    inc = filters.incidence(graph(spark, a.tolist()).edges)
    assert sorted((r["node_id"], r["edge_id"]) for r in inc.collect()) == [(i, k) for i, k in np.argwhere(b).tolist()]
    assert np.allclose(dense(filters.line_graph(inc), len(ends)), b.T @ b - 2 * np.eye(len(ends)))


def test_filters_match_numpy(g):
    d = A.sum(axis=1)
    half = np.array([0 if v == 0 else v**-0.5 for v in d])
    assert np.allclose(dense(filters.normalized_adjacency(g.edges, g.nodes), 6), half[:, None] * A * half)
    lap = np.eye(6) - half[:, None] * A * half
    assert np.allclose(dense(filters.normalized_laplacian(g.edges, g.nodes), 6), lap)
    b = A + np.eye(6)
    hb = b.sum(axis=1) ** -0.5
    assert np.allclose(dense(filters.gcn_filter(g.edges, g.nodes), 6), hb[:, None] * b * hb)
    values = np.linalg.eigvals(lap)
    assert np.isclose(filters.largest_eigenvalue(filters.normalized_laplacian(g.edges, g.nodes)).first()["lmax"], values[np.argmax(abs(values))].real)


def test_self_loops(spark):
    g = graph(spark, [[5, 1], [0, 0]])
    assert dense(filters.fill_self_loops(g.edges, g.nodes), 2).tolist() == [[5, 1], [0, 1]]
    assert dense(filters.set_self_loops(g.edges, g.nodes, 2.0), 2).tolist() == [[2, 1], [0, 2]]
    assert dense(filters.plus_identity(g.edges, g.nodes), 2).tolist() == [[6, 1], [0, 1]]


def test_gated_conv_matches_numpy(g):
    c = 4
    h = np.pad(XS, ((0, 0), (0, 1)))
    s = lambda z: 1 / (1 + np.exp(-z))
    w = lambda i: np.array(V.dyadic(c, c, i))
    for layer in range(2):
        m = (A != 0).T.astype(float) @ (h @ w(layer))
        z, r = s(m @ w(20) + h @ w(30)), s(m @ w(21) + h @ w(31))
        h = z * h + (1 - z) * np.tanh(m @ w(22) + r * (h @ w(32)))
    assert np.allclose(matrix(conv.gated_conv(g, c, 2)), h)


def test_xenet_matches_numpy(g):
    k, n, s = 3, 3, 2
    w = np.array(V.dyadic(2 * n + 2 * s, k))
    gate = lambda v, i: 1 / (1 + np.exp(-v @ np.array(V.dyadic(k, 1, i))))
    into, out, edges = np.zeros((6, k)), np.zeros((6, k)), {}
    for i, j in np.argwhere(A):
        back = ES[j, i] if A[j, i] else np.zeros(s)
        v = np.maximum(np.concatenate([XS[i], XS[j], ES[i, j], back]) @ w, 0)
        into[j] += gate(v, 1) * v
        out[i] += gate(v, 2) * v
        edges[i, j] = v @ np.array(V.dyadic(k, 2, 4))
    nodes, e = conv.xenet_conv(g, k, 2, 2)
    assert np.allclose(matrix(nodes), np.hstack([XS, into, out]) @ np.array(V.dyadic(n + 2 * k, 2, 3)))
    assert all(np.allclose(edges[r["src"], r["dst"]], r["e"]) for r in e.collect())


def test_ecc_and_compat_variants(g):
    kernel = np.array(V.dyadic(2, 6))
    want = XS @ np.array(V.dyadic(3, 2, 1))
    for i, j in np.argwhere(A):
        want[j] += XS[i] @ (ES[i, j] @ kernel).reshape(3, 2)
    assert np.allclose(matrix(conv.ecc_conv(g, 2)), want)
    hops = [XS, A.T @ XS, A.T @ A.T @ XS]
    assert np.allclose(matrix(conv.tag_conv(g, 2, 2, compat=False)), np.hstack(hops) @ np.array(V.dyadic(9, 2)))
    th = [[1.0, 0.5, 0.25]]
    total = sum(c * np.linalg.matrix_power(A, 2 - i) for i, c in enumerate(th[0])) @ XS.sum(axis=1)
    assert np.allclose(matrix(conv.diffusion_conv(g, 1, 2, th, None, compat=False)).ravel(), total)


def test_diff_pool_loss_is_the_plain_one(g):
    b = A + np.eye(6)
    s = np.sqrt(b.sum(axis=1)) + 1e-7
    a = b / s[:, None] / s
    z = a @ (XS @ np.array(V.dyadic(3, 2, 0)))
    soft = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    got = pool.diff_pool(g, 2, 2).losses.first()
    assert np.isclose(got["link_loss"], np.linalg.norm(A - soft @ soft.T))
    assert np.isclose(got["entropy_loss"], np.mean(-(soft * np.log(soft + 1e-7)).sum(axis=1)))


def test_la_pool_keeps_leaders_apart(spark):
    path = [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
    p = pool.la_pool(graph(spark, path, [[1.0, 0.0], [4.0, 1.0], [1.0, 0.5]]))
    assert {(r["node_id"], r["cluster"]): round(r["s"], 6) for r in p.selection.collect()} == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): 1.0}


def test_pe_and_delaunay(spark):
    ring = [[float(abs(i - j) in (1, 4)) for j in range(5)] for i in range(5)]
    v = matrix(T.laplacian_pe(graph(spark, ring), 2).nodes)[:, 1:]
    lap = np.eye(5) - np.array(ring) / 2
    assert np.allclose(lap @ v[:, 0], 0) and np.allclose(v.T @ v, np.eye(2))
    pts = [[0.0, 0.0], [1.0, 0.1], [0.1, 1.0], [1.1, 1.2], [0.5, 0.55]]
    e = {(r["src"], r["dst"]) for r in T.delaunay(graph(spark, np.zeros((5, 5)).tolist(), pts)).edges.collect()}
    assert {(4, i) for i in range(4)} <= e and (0, 3) not in e and all((b, a) in e for a, b in e)


def test_layouts(spark):
    x = [[1, 0], [0, 1], [1, 1]], [[0, 0], [1, 2]]
    g = GraphSet.from_arrays(spark, [{"x": x[0], "a": [[0, 1, 0], [1, 0, 0], [0, 1, 0]]}, {"x": x[1], "a": [[0, 1], [1, 0]]}])
    d = layouts.disjoint(g)
    assert sorted((r["src"], r["dst"]) for r in d.edges.collect()) == [(0, 1), (1, 0), (2, 1), (3, 4), (4, 3)]
    padded = layouts.padded_nodes(g, mask=True).orderBy("graph_id", "pos").collect()
    assert [r["x"] for r in padded] == [[1, 0, 1], [0, 1, 1], [1, 1, 1], [0, 0, 1], [1, 2, 1], [0, 0, 0]]
    b = layouts.batches(spark.range(10).withColumnRenamed("id", "graph_id"), 6, 2, shuffle=True).groupBy("epoch", "batch_id").count()
    assert sorted(r["count"] for r in b.collect()) == [4, 4, 6, 6] and layouts.steps_per_epoch(10, 6) == 2
    with pytest.raises(ValueError):
        layouts.mode_of(2, 3)


def test_graphset_checks(spark, g):
    assert g.validate() is g
    assert [r["n_edges"] for r in g.counts().collect()] == [int((A != 0).sum())]
    with pytest.raises(ValueError):
        GraphSet.from_arrays(spark, [{"a": [[0, 1]]}])


def test_config_round_trip(g):
    config = {"layer": "gat", "channels": 2, "heads": 2, "add_loops": False}
    run = conv.from_config(config)
    assert conv.to_config(run) == config and len(run(g).first()["x"]) == 4


def test_labels_raise(spark):
    row = spark.range(1)
    assert row.select(V.one_hot(F.lit(-1), 3).alias("y")).first()["y"] == [0, 0, 1]
    for bad in (V.one_hot(F.lit(3), 3), V.label_one_hot(F.lit(9), [1, 2])):
        with pytest.raises(Exception, match="out of range|unknown label"):
            row.select(bad).collect()


def test_explainer_finds_the_edge_that_matters(spark):
    # node 0 takes its class from node 5, two steps away behind node 4: the others' features are zero
    n = 6
    a = np.zeros((n, n))
    for i, j in ((0, 1), (0, 2), (0, 3), (0, 4), (4, 5)):
        a[i, j] = a[j, i] = 1
    x = [[0.0, 0.0]] * n
    x[5] = [3.0, 0.0]
    g = graph(spark, a.tolist(), x)
    weights = ([[1.0, 0.0], [0.0, 1.0]], [[1.0, -1.0], [-1.0, 1.0]])
    edges, feats = models.NodeExplainer(n_hops=2, epochs=400, rate=0.05, a_size=0.03).explain(g, 0, weights)
    assert {(i, j) for i, j, _ in edges} == {(int(i), int(j)) for i, j in np.argwhere(a)} and len(feats) == 2
    # removing an edge changes the class's probability the more, the larger its mask

    def probability(m):
        z = (m @ np.maximum(m @ np.array(x) @ np.array(weights[0]), 0) @ np.array(weights[1]))[0]
        return np.exp(z[0]) / np.exp(z).sum()

    drop = {}
    for i, j, _ in edges:
        m = a.copy()
        m[i, j] = 0
        drop[i, j] = probability(a) - probability(m)
    mask = {(i, j): w for i, j, w in edges}
    needed = {e for e, v in drop.items() if v > 1e-6}
    assert needed and min(mask[e] for e in needed) > max(mask[e] for e in mask if e not in needed)
    least = min(w for *_, w in edges)
    assert models.clean_explanation(spark, edges, 0, 2, least).count() == len(edges)


def test_layers_of_layers_are_numpy(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((5, 5)) < 0.6).astype(float)
    a = np.maximum(a, a.T) * (1 - np.eye(5))
    x = np.round(rng.normal(size=(5, 2)), 2)
    g = graph(spark, a.tolist(), x.tolist())
    relu = lambda v: np.maximum(v, 0)
    w = lambda i, o, k: np.array(V.dyadic(i, o, k))
    h = relu(relu(x @ w(2, 4, 40)) @ w(4, 3, 41))
    e = np.exp(h @ w(3, 2, 0) - (h @ w(3, 2, 0)).max(axis=1, keepdims=True))
    s = e / e.sum(axis=1, keepdims=True)
    got = pool.mincut_pool(g, 2, mlp_hidden=[4, 3]).losses.first()["cut_loss"]
    assert np.isclose(got, -np.trace(s.T @ a @ s) / np.trace(s.T @ np.diag(a.sum(axis=1)) @ s))
    z = h @ w(3, 2, 0)
    assert np.allclose(matrix(conv.appnp_conv(g, 2, 0.25, 1, mlp_hidden=[4, 3])), 0.75 * a @ z + 0.25 * z)


def test_concat_keeps_graphs_apart(spark, g):
    assert sorted(r["graph_id"] for r in g.concat(g).counts().collect()) == [0, 1]
    with pytest.raises(ValueError, match="merge"):
        g.concat(g, 0)
