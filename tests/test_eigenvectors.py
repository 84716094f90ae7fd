"""Laplacian eigenvectors of graphs that are too large for a dense solver."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet


def whole(spark, n, edges):
    """Nodes 0 .. n - 1 and edges (src, dst) of weight 1, both ways."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.array(F.lit(0.0)).alias("x"))
    one = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return GraphSet.single(nodes, one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), 1)


def path(spark, n):
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def ring(spark, n, first=0):
    return spark.range(n).select((F.col("id") + first).alias("src"), ((F.col("id") + 1) % n + first).alias("dst"))


def encoding(g, k):
    rows = sorted(T.laplacian_pe(g, k).nodes.collect(), key=lambda r: r["node_id"])
    return np.array([r["x"][1:] for r in rows])


def test_no_square_of_a_graph_is_held(spark, monkeypatch):
    solvers = []
    group = type(spark.range(1).groupBy("id"))
    apply = group.applyInPandas

    def seen(self, solve, schema):
        solvers.append((solve, self._df))
        return apply(self, solve, schema)

    monkeypatch.setattr(group, "applyInPandas", seen)
    n = 3000
    T.laplacian_pe(whole(spark, n, ring(spark, n).unionByName(spark.range(n).select(F.col("id").alias("src"), (F.col("id") * F.col("id") * 7 % n).alias("dst")).where("src <> dst"))), 2)
    solve, rows = solvers[0]
    rows = rows.toPandas()
    tracemalloc.start()
    found = solve(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    v = np.stack(found["v"])
    m = np.zeros((n, n))
    np.add.at(m, (rows["src"], rows["dst"]), rows["w"])
    values = np.linalg.eigvalsh(m)[:2]
    assert np.allclose(m @ v, v * values, atol=1e-10) and np.allclose(v.T @ v, np.eye(2))
    assert (v[np.abs(v).argmax(axis=0), [0, 1]] > 0).all()
    assert peak < n * n * 8 / 2


def test_long_path(spark):
    """Eigenvalues that lie close to each other: the basis is begun again several times."""
    n = 1000
    v = encoding(whole(spark, n, path(spark, n)), 2)
    root = np.sqrt(np.r_[1.0, np.full(n - 2, 2.0), 1.0])
    for j in range(2):
        expected = root * np.cos(np.pi * j * np.arange(n) / (n - 1))
        expected /= np.linalg.norm(expected)
        assert np.allclose(v[:, j] * np.sign(v[:, j] @ expected), expected, atol=1e-8)


def test_equal_eigenvalues(spark):
    """The second of two equal eigenvalues is not passed over for a larger one."""
    n = 700
    v = encoding(whole(spark, n, ring(spark, n)), 4)
    times = v - (np.roll(v, 1, axis=0) + np.roll(v, -1, axis=0)) / 2
    values = 1 - np.cos(2 * np.pi * np.array([0, 1, 1, 2]) / n)
    assert np.allclose(times, v * values, atol=1e-12) and np.allclose(v.T @ v, np.eye(4))


def test_components(spark):
    """Each component has a vector of eigenvalue 0, the largest first; a node without edges has eigenvalue 1 and none."""
    both = ring(spark, 300).unionByName(ring(spark, 400, 300))
    v = encoding(whole(spark, 701, both), 2)
    assert np.allclose(v[:, 0], np.r_[np.zeros(300), np.full(400, 400**-0.5), 0]) and np.allclose(v[:, 1], np.r_[np.full(300, 300**-0.5), np.zeros(401)])
    v = encoding(whole(spark, 701, both), 3)[:700, 2]
    assert np.allclose(v[:300], 0) and np.allclose(v[300:] - (np.roll(v[300:], 1) + np.roll(v[300:], -1)) / 2, v[300:] * (1 - np.cos(2 * np.pi / 400)), atol=1e-12)


def test_weights_that_allow_negative_eigenvalues(spark):
    """Edges one way only: the least magnitude is looked for among values of both signs."""
    n = 600
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.array(F.lit(0.0)).alias("x"))
    steps = spark.range(n).select(F.col("id").alias("src"), (F.col("id") * F.col("id") % n).alias("dst"), F.lit(1.0).alias("w"))
    v = encoding(GraphSet.single(nodes, steps, 1), 2)
    i = np.arange(n)
    d = np.ones(n)
    m = np.eye(n)
    np.add.at(m, (i, i * i % n), -1 / np.sqrt(d[i] * d[i * i % n]))
    m = (m + m.T) / 2
    values = np.linalg.eigvalsh(m)
    least = np.sort(np.abs(values))[:2]
    assert np.allclose(np.abs(np.diag(v.T @ m @ v)), least, atol=1e-10)
