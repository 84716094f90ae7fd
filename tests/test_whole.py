"""Queries and operators that once covered a part of their input only."""

import os

import numpy as np
import pytest

from loomgraph import catalogue
from loomgraph.operators import layouts, models
from loomgraph.operators.model import GraphSet

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def stored(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    return [(r["label"], r["vec_id"], np.floor(np.array(r["embedding"], float) * 64 + 0.5) / 64) for r in rows]


@needs_tables
@pytest.mark.parametrize("name, last, least", [("inner_product", 1, None), ("minkowski_product", -1, -1.0)])
def test_products_of_all_nodes(spark, name, last, least):
    rows = stored(spark)
    want = {(g, a, b): float(x[:3] * [1, 1, last] @ y[:3]) for g, a, x in rows for h, b, y in rows if g == h}
    got = {(r["graph_id"], r["src"], r["dst"]): r["w"] for r in catalogue.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - (w if least is None else min(least, w))) < 1e-5 for k, w in want.items())


@needs_tables
def test_neighbours_by_whole_embeddings(spark):
    rows = stored(spark)
    want = {(g, a, b) for g, a, x in rows for _, b in sorted((float(((x - y) ** 2).sum()), b) for h, b, y in rows if g == h and a != b)[:5]}
    assert {(r["graph_id"], r["src"], r["dst"]) for r in catalogue.QUERIES["knn_graph"](spark, DATA).collect()} == want
    ends = {(r["graph_id"], r["src"], r["dst"]) for r in catalogue.QUERIES["gat_attention"](spark, DATA).where("src <> dst").collect()}
    assert ends == want


def test_components_of_long_paths(spark):
    n = 200
    path = [0, *range(n, 0, -1)]
    edges = spark.createDataFrame([(g, a, b) for g in (0, 1) for a, b in zip(path, path[1:], strict=False) if g == 0 or a != 90], "graph_id long, src long, dst long")
    nodes = spark.createDataFrame([(g, i) for g in (0, 1) for i in range(n + 1)], "graph_id long, node_id long")
    got = {(r["graph_id"], r["node_id"]): r["component"] for r in models.connected_components(edges, nodes).collect()}
    assert got == {(g, i): int(g == 1 and 1 <= i < 90) for g in (0, 1) for i in range(n + 1)}


def test_padding_loses_no_node(spark, tmp_path):
    turns = [(c, t, "user", "x" * 64 * (t + 1)) for c, n in ((0, 12), (1, 2)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["graph_id"], r["pos"]): r["x0"] for r in catalogue.QUERIES["packed_pad"](spark, str(tmp_path)).collect()}
    assert got == {(c, t): float(t + 1 if t < n else 0) for c, n in ((0, 12), (1, 2)) for t in range(12)}
    nodes = spark.createDataFrame([(0, i, [1.0]) for i in range(4)], "graph_id long, node_id long, x array<double>")
    g = GraphSet(nodes, nodes.limit(0), None, 1)
    assert layouts.padded_nodes(g, n_max=5).count() == 5
    with pytest.raises(Exception, match="more nodes than n_max"):
        layouts.padded_nodes(g, n_max=3).collect()
