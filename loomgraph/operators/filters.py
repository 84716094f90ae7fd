"""Degrees, normalised adjacencies, Laplacians, incidence and line graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.vec import EPSILON
from loomgraph.operators import linalg

COO = ("graph_id", "src", "dst", "w")


def summed(edges: DataFrame) -> DataFrame:
    """One row for each cell, equal cells summed, zeros dropped."""
    return edges.groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")


def loops(nodes: DataFrame, value: float | Column = 1.0, *more: str) -> DataFrame:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), v.alias("w"), *more)


def fill_self_loops(edges: DataFrame, nodes: DataFrame, value: float = 1.0) -> DataFrame:
    """Only missing loops are added; those that exist keep their weight."""
    have = edges.where("src = dst").select("graph_id", "src", "dst")
    return edges.select(*COO).unionByName(loops(nodes, value).join(have, ["graph_id", "src", "dst"], "left_anti").select(*COO))


def set_self_loops(edges: DataFrame, nodes: DataFrame, value: float = 1.0) -> DataFrame:
    """The diagonal is overwritten."""
    return edges.where("src <> dst").select(*COO).unionByName(loops(nodes, value))


def plus_identity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """1 is added to the diagonal."""
    return summed(edges.select(*COO).unionByName(loops(nodes)))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, d): row sums; 0 for nodes without edges."""
    d = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum("w").alias("d"))
    return nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))


def degree_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w): the diagonal matrix of degrees; nodes without edges have no cell."""
    return degrees(edges, nodes).where("d <> 0").select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("d").alias("w"))


def degree_power(edges: DataFrame, nodes: DataFrame, k: float) -> DataFrame:
    """(graph_id, node_id, d): row sums to the power k; infinities become 0."""
    p = F.pow("d", F.lit(float(k)))
    return degrees(edges, nodes).withColumn("d", F.when((F.col("d") == 0) & F.lit(k < 0), F.lit(0.0)).otherwise(p))


def scaled(edges: DataFrame, left: DataFrame | None, right: DataFrame | None) -> DataFrame:
    """Diagonal matrices (graph_id, node_id, d) times the edges, from the left and the right."""
    w = F.col("w")
    if left is not None:
        edges, w = edges.join(left.select("graph_id", F.col("node_id").alias("src"), F.col("d").alias("_l")), ["graph_id", "src"]), w * F.col("_l")
    if right is not None:
        edges, w = edges.join(right.select("graph_id", F.col("node_id").alias("dst"), F.col("d").alias("_r")), ["graph_id", "dst"]), w * F.col("_r")
    return edges.select("graph_id", "src", "dst", w.alias("w"))


def normalized_adjacency(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """D^-1/2 A D^-1/2, or D^-1 A."""
    return _normalized(edges, edges, nodes, symmetric)


def _normalized(edges: DataFrame, terms: DataFrame, nodes: DataFrame, symmetric: bool) -> DataFrame:
    """Edges by degrees, which are summed over ``terms``: the edges, or what these are the sums of."""
    if symmetric:
        d = degree_power(terms, nodes, -0.5)
        return scaled(edges, d, d)
    return scaled(edges, degree_power(terms, nodes, -1.0), None)


def normalize_a(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends divided by sqrt(d) + 1e-7."""
    d = degrees(edges, nodes).withColumn("d", 1 / (F.sqrt("d") + F.lit(EPSILON)))
    return scaled(edges, d, d)


def laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D - A."""
    d = degrees(edges, nodes).select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("d").alias("w"))
    return summed(d.unionByName(edges.select("graph_id", "src", "dst", (-F.col("w")).alias("w"))))


def normalized_laplacian(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """I - normalised A."""
    a = normalized_adjacency(edges, nodes, symmetric)
    return summed(loops(nodes).unionByName(a.select("graph_id", "src", "dst", (-F.col("w")).alias("w"))))


def largest_eigenvalue(edges: DataFrame) -> DataFrame:
    """(graph_id, lmax): eigenvalue of largest magnitude, by a dense solver for each graph (small graphs)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {v: k for k, v in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        for s, d, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
            m[at[s], at[d]] += w
        values = np.linalg.eigvals(m)
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iat[0]], "lmax": [float(values[np.argmax(np.abs(values))].real)]})

    return edges.select(*COO).groupBy("graph_id").applyInPandas(solve, "graph_id long, lmax double")


def rescale_laplacian(lap: DataFrame, nodes: DataFrame, lmax: float | DataFrame | None = None) -> DataFrame:
    """2 / lmax L - I; without lmax it is found for each graph."""
    if isinstance(lmax, (int, float)):
        big = lap.withColumn("w", F.col("w") * F.lit(2.0 / lmax))
    else:
        values = largest_eigenvalue(lap) if lmax is None else lmax
        big = lap.join(values, "graph_id").withColumn("w", F.col("w") * 2.0 / F.col("lmax"))
    return summed(big.select(*COO).unionByName(loops(nodes, -1.0)))


def gcn_filter(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """(A + I) normalised; degrees come straight from A and I, so only the result sums equal cells."""
    terms = edges.select(*COO).unionByName(loops(nodes))
    return _normalized(summed(terms), terms, nodes, symmetric)


def chebyshev_polynomials(x: DataFrame, nodes: DataFrame, k: int) -> list[DataFrame]:
    """T_0 .. T_k of a sparse matrix (T_0 and T_1 even for k = 0)."""
    out = [loops(nodes), x.select(*COO)]
    for _ in range(2, k + 1):
        twice = linalg.spspmm(x, out[-1]).withColumn("w", 2 * F.col("w"))
        out.append(summed(twice.select(*COO).unionByName(out[-2].withColumn("w", -F.col("w")).select(*COO))))
    return out


def chebyshev_filter(edges: DataFrame, nodes: DataFrame, k: int, symmetric: bool = True, lmax: float | None = None) -> list[DataFrame]:
    """Polynomials of the rescaled normalised Laplacian."""
    return chebyshev_polynomials(rescale_laplacian(normalized_laplacian(edges, nodes, symmetric), nodes, lmax), nodes, k)


def incidence(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, edge_id): ends of the edges of the upper triangle, numbered row by row from 0."""
    upper = edges.where("src <= dst AND w <> 0").select("graph_id", "src", "dst").distinct()
    order = Window.partitionBy("graph_id").orderBy("src", "dst")
    numbered = upper.withColumn("edge_id", F.row_number().over(order).cast("long") - 1)
    return numbered.select("graph_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), "edge_id")


def line_graph(inc: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w) over edge ids: T'T - 2 I, without zeros."""
    a = inc.select("graph_id", "node_id", F.col("edge_id").alias("src"))
    b = inc.select("graph_id", "node_id", F.col("edge_id").alias("dst"))
    shared = a.join(b, ["graph_id", "node_id"]).groupBy("graph_id", "src", "dst").agg(F.count("*").cast("double").alias("n"))
    return shared.select("graph_id", "src", "dst", (F.col("n") - F.when(F.col("src") == F.col("dst"), 2.0).otherwise(0.0)).alias("w")).where("w <> 0")
