"""Findings of round 2: ties of scores, neighbours, triangulations and eigenvectors of larger graphs."""

import math
import operator
from functools import reduce

import numpy as np
import pytest

from loomgraph import catalogue
from loomgraph.operators import pool
from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet

DATA = "/root/testdata/sf0.001"
#: Queries over neighbours, by the number of their finding.
NEIGHBOURS = {
    1: "connected_components",
    20: "t_normalize_adj",
    18: "t_gcn_filter",
    16: "t_clustering_coeff",
    12: "gat_attention",
    6: "conv_gat",
    2: "conv_agnn",
    4: "conv_ecc",
    3: "conv_crystal",
    7: "conv_general",
    5: "conv_edge",
    9: "conv_gin_batch",
    8: "conv_gin",
    11: "conv_sage",
    10: "conv_message_passing",
    15: "symmetrize_clip",
    14: "segment_softmax",
    13: "knn_graph",
}


def single(spark, xs, edges=()):
    nodes = spark.createDataFrame([(0, i, [float(v) for v in x]) for i, x in enumerate(xs)], "graph_id long, node_id long, x array<double>")
    return GraphSet(nodes, spark.createDataFrame([(0, a, b, 1.0) for a, b in edges], "graph_id long, src long, dst long, w double"), None, len(xs[0]))


def test_scores_that_differ_in_their_last_digits_tie(spark):
    pooled = pool.sag_pool(single(spark, [[1.0], [1.0 + 1e-13], [1.0 + 2e-13], [0.5]]), 0.5, [1.0])
    assert [r["from_id"] for r in pooled.nodes.orderBy("node_id").collect()] == [0, 1]
    assert {r["score"] for r in pooled.nodes.collect()} == {round(1 / (1 + 1e-7) ** 2, 9)}


def between(x, y):
    """The squared distance of the SQL: components that are null or missing do not count; nothing is the farthest."""
    terms = [(a - b) * (a - b) for a, b in zip(x or [], y or [], strict=False) if a is not None and b is not None]
    d = reduce(operator.add, terms, 0.0) if terms else None  # sum() would carry the lost digits on
    return (2, 0.0, None) if d is None else (1, 0.0, d) if math.isnan(d) else (0, d, d)


@pytest.mark.parametrize("pack", [7, 2048])
def test_neighbours_of_odd_vectors(spark, pack):
    rng = np.random.default_rng(3)
    rows = [(0, i, (rng.integers(-3, 4, 3) / 7).tolist()) for i in range(40)] + [(0, 40 + i, [0.1, 0.2, 0.3]) for i in range(20)]
    rows += [(0, 60, None), (0, 61, []), (0, 62, [None, None, None]), (0, 63, [None, 0.2, 0.3]), (0, 64, [0.1, 0.2]), (0, 65, [math.nan, 0.0, 0.0])]
    rows += [(0, 66, [math.inf, 0.0, 0.0]), (0, 67, [1e200, 0.0, 0.0]), (0, 68, [1e-200, 0.0, 0.0]), (0, 69, [0.0, 0.0, 0.0]), (0, 70, [0.1, 0.2, 0.3, 4.0])]
    rows += [(1, 0, [1.0, 1.0, 1.0]), (2, 0, [1e8, 0.0, 0.0]), (2, 1, [1e8 + 1e-8, 1e-9, 0.0]), (2, 2, [1e8, 2e-9, 0.0]), (None, 5, [0.0]), (0, None, [0.0])]
    want = {}
    for g, a, x in rows:
        others = sorted((*between(x, y)[:2], b, between(x, y)[2]) for h, b, y in rows if g is not None and g == h and None not in (a, b) and a != b)
        want |= {(g, a, b): d for *_, b, d in others[:5]} if a is not None else {}
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, x array<double>")
    got = {(r["graph_id"], r["src"], r["dst"]): r["d2"] for r in T.knn_edges(nodes, 3, 5, **({} if pack == 2048 else {"pack": pack})).collect()}
    assert got.keys() == want.keys()
    assert all(got[e] == d or d is not None and math.isnan(d) and math.isnan(got[e]) for e, d in want.items())


@pytest.mark.parametrize("name", [NEIGHBOURS[f] for f in sorted(NEIGHBOURS)])
def test_no_row_for_each_pair_of_nodes(spark, name):
    """Pairs of nodes are compared in packs and once: no distance is left in the query's own plan."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" not in plan


def test_triangulation_of_many_points():
    rng = np.random.default_rng(2)
    round_ones = T._triangulate(rng.normal(size=(4000, 2)))
    grid = np.array([[i, j] for i in range(30) for j in range(30)], float)
    again = T._triangulate(np.vstack([grid, grid]))
    assert 3 * 4000 - 3 - 60 < len(round_ones) < 3 * 4000 - 5
    assert len(again) == 3 * 900 - 3 - 116  # full, and no point twice
    assert all(abs(grid[a] - grid[b]).max() == 1 for a, b in again)


def test_triangulation_keeps_the_hull():
    flat = np.array([[0.0, 0.0], [1.0, 1e-9], [2.0, 0.0], [1.0, 1.0], [1.0, 1e-9]])
    assert T._triangulate(flat) == {(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)}
    assert T._triangulate(np.array([[2.0, 2.0], [0.0, 0.0], [1.0, 1.0], [3.0, 3.0]])) == {(1, 2), (0, 2), (0, 3)}
