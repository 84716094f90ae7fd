"""Neighbours bring the features of both ends along, and distances of whole 64ths are found once."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import catalogue
from loomgraph.operators import conv, linalg
from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet

DATA = "/root/testdata/sf0.001"
#: Layers over neighbours, by the number of their finding, and the joins that are left: those with all nodes.
LAYERS = {
    8: ("conv_gin", 2),
    12: ("gat_attention", 0),
    6: ("conv_gat", 1),
    11: ("conv_sage", 2),
    2: ("conv_agnn", 1),
    7: ("conv_general", 1),
    4: ("conv_ecc", 2),
    3: ("conv_crystal", 2),
    5: ("conv_edge", 1),
    9: ("conv_gin_batch", 2),
}


@pytest.mark.parametrize("name, joins", LAYERS.values())
def test_layers_do_not_join_edges_with_their_ends(spark, name, joins):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == joins


def odd_vectors():
    rng = np.random.default_rng(11)
    rows = [(0, i, (rng.normal(size=6) / 3).tolist()) for i in range(300)] + [(0, 300 + i, [0.5, -1 / 128, 1.0, 0.0, 0.25, 3 / 128]) for i in range(9)]
    rows += [(1, 1, None), (1, 2, [0.1, None, 0.3]), (1, 3, []), (1, 4, [float("nan"), 0.5]), (1, 5, [float("inf"), -float("inf"), 1e30, 0.2]), (1, 6, [1.9, -1.99]), (1, 7, [2.1, 0.1]), (2, 1, [0.5])]
    return rows


@pytest.mark.parametrize("pack", [40, 2048])
def test_vectors_are_rounded_in_workers_and_ends_come_along(spark, pack):
    rows = odd_vectors()
    nodes = spark.createDataFrame(rows, "graph_id long, node_id long, x array<float>")
    rounded = F.transform("x", lambda v: F.floor(v.cast("double") * 64 + 0.5) / 64)
    key = lambda r: (r["graph_id"], r["src"], r["dst"])
    want = {key(r): r["d2"] for r in T.knn_edges(nodes.withColumn("x", rounded), 0, 5, pack).collect()}
    got = T.knn_edges(nodes, 0, 5, pack, steps=64, ends=2).collect()
    assert {key(r): r["d2"] for r in got} == want and len(got) == len(want) > 1500
    x = {(r["graph_id"], r["node_id"]): ((r["x"] or []) + [None, None])[:2] for r in nodes.withColumn("x", rounded).collect()}
    assert all(r["s"] == x[r["graph_id"], r["src"]] and r["t"] == x[r["graph_id"], r["dst"]] for r in got)


def test_distances_of_whole_64ths_are_not_computed_again(spark):
    """Both the largest bytes and many ties: the product alone gives exact distances."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-127, 128, (200, 256)), np.where(rng.integers(0, 2, (60, 256)), 127, -127), np.repeat(rng.integers(-2, 3, (4, 256)), 10, axis=0)]) / 64
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    nodes = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "graph_id long, node_id long, x array<double>")
    got = {(r["src"], r["dst"]): r["d2"] for r in T.knn_edges(nodes, 0, 5, pack=90).collect()}
    want = {(i, j): d2[i, j] for i in range(len(x)) for j in [j for j in np.lexsort((np.arange(len(x)), d2[i])).tolist() if j != i][:5]}
    assert got == want


def looped_graph(spark):
    """A graph with loops, a hub and repeated edges, and the same with its ends beside the edges."""
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(g, i, rng.normal(size=2).tolist()) for g in (0, 1) for i in range(30)] + [(None, 1, [1.0, 1.0])], "graph_id long, node_id long, x array<double>")
    pairs = [(g, int(a), int(b), 1.0 + int(a) % 3) for g in (0, 1) for a, b in rng.integers(0, 30, (90, 2))] + [(0, i, i, 2.0) for i in range(5)] + [(1, i, 3, 1.0) for i in range(30)]
    edges = spark.createDataFrame(pairs, "graph_id long, src long, dst long, w double")
    plain = GraphSet(nodes, edges, None, 2)
    return plain, replace(plain, ends=linalg.gather(linalg.gather(edges, nodes, "src", "_s"), nodes, "dst", "_t"))


@pytest.mark.parametrize("layer", [lambda g: conv.sage_conv(g, 2), lambda g: conv.gat_conv(g, 2, 2), lambda g: conv.gat_conv(g, 2, add_loops=False), lambda g: conv.gin_conv_batch(g, 2), lambda g: conv.general_conv(g, 3), lambda g: conv.agnn_conv(g, 2.5), lambda g: conv.edge_conv(g, 2, aggregate="max")])
def test_layers_with_ends_give_what_they_give_without(spark, layer):
    plain, ends = looped_graph(spark)
    rows = [sorted((r["graph_id"] if r["graph_id"] is not None else -1, r["node_id"], [round(v, 9) for v in r["x"]]) for r in layer(g).collect()) for g in (plain, ends)]
    assert rows[0] == rows[1] and len(rows[0]) >= 60


@pytest.mark.parametrize("beta", [1.0, -299.0, 299.0])
def test_softmax_in_one_aggregate_is_that_of_rows(spark, beta):
    plain, _ = looped_graph(spark)
    rows = linalg.gather(linalg.gather(plain.edges, plain.nodes, "src", "_s"), plain.nodes, "dst", "_t")
    score = F.lit(beta) * F.col("_s")[0] / F.greatest(F.abs(F.col("_s")[0]), F.lit(0.5))
    parts = [F.col("_s")[i] for i in range(2)]
    one = linalg.scatter_softmax(rows, "dst", score, parts, plain.nodes).collect()
    two = linalg.scatter(linalg.segment_softmax(rows, "dst", score), "dst", [F.col("alpha") * p for p in parts], plain.nodes).collect()
    at = {(r["graph_id"], r["node_id"]): r["x"] for r in two}
    assert len(one) == len(two) == 61 and all(r["x"] == pytest.approx(at[r["graph_id"], r["node_id"]], rel=1e-9, abs=1e-12) for r in one)


def test_edges_changed_lose_their_ends(spark):
    _, g = looped_graph(spark)
    assert g.with_edges(g.edges.limit(3)).ends is None and g.with_x(g.nodes, 2).ends is None and g.take_ids([1]).ends is None


def test_degrees_of_a_filter_are_sums_of_its_terms(spark):
    """Cells are summed in the result alone, not for both degrees as well."""
    plan = catalogue.QUERIES["t_gcn_filter"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3
