"""Pooling: select, reduce, connect; readouts of whole graphs.

Losses of soft assignments come from identities that need one join over edges and K x K sums only, never
an N x N matrix: tr(S'AS) = sum a_ij <s_i, s_j>, |A - SS'|^2 = sum a^2 - 2 sum a_ij <s_i, s_j> + |S'S|^2.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators import filters, linalg
from loomgraph.operators.conv import _done, _paired, project
from loomgraph.operators.model import GraphSet


@dataclass(frozen=True)
class Pooled:
    nodes: DataFrame
    edges: DataFrame
    selection: DataFrame
    losses: DataFrame | None = None


def select_reduce_connect(g: GraphSet, select: Callable, reduce: Callable, connect: Callable, reduce_index: Callable | None = None) -> Pooled:
    """The frame of all pools; each part is a function over tables, so own pools can be built."""
    s = select(g)
    nodes = reduce(g, s)
    return Pooled(reduce_index(nodes) if reduce_index else nodes, connect(g, s), s)


# -- pools that keep nodes ------------------------------------------------------------------------


def _keep_top(g: GraphSet, scored: DataFrame, ratio: float, gate) -> Pooled:
    """``scored``: nodes with x and score; kept nodes are numbered anew in the order of their ids."""
    top = linalg.segment_top_k(scored, F.col("score"), ratio)
    numbers = linalg.renumbered(top)
    kept = top.join(numbers, ["graph_id", "node_id"])
    x = V.vec([p * gate(F.col("score")) for p in V.items("x", g.n_features)])
    nodes = kept.select("graph_id", F.col("new_id").alias("node_id"), x.alias("x"), F.col("node_id").alias("from_id"), "score")
    return Pooled(nodes, linalg.induced(g.edges, numbers), linalg.indices_to_mask(g.nodes.select("graph_id", "node_id"), top))


def top_k_pool(g: GraphSet, ratio: float, p=None, sigmoid: bool = False) -> Pooled:
    """Score x . p / |p|; the best ceil(ratio n) nodes stay, scaled by tanh (or sigmoid) of their score."""
    p = p or [r[0] for r in V.dyadic(g.n_features, 1)]
    norm = max(sum(v * v for v in p), 1e-12) ** 0.5
    scored = g.nodes.withColumn("score", V.total([c * F.lit(v / norm) for c, v in zip(V.items("x", g.n_features), p, strict=True)]))
    return _keep_top(g, scored, ratio, V.ACTIVATIONS["sigmoid" if sigmoid else "tanh"])


def sag_pool(g: GraphSet, ratio: float, p=None, sigmoid: bool = False) -> Pooled:
    """As top_k_pool with scores normalised(A + I) X p, to nine places: sums differ in their last digits by the order
    of their terms, and nodes alike are to tie.
    """
    w = [[v] for v in p] if p else V.dyadic(g.n_features, 1)
    a = filters.normalize_a(filters.plus_identity(g.edges, g.nodes), g.nodes)
    y = linalg.spmm(a, project(g.nodes, g.n_features, w), 1)
    scored = _paired(g.nodes, y).select("graph_id", "node_id", "x", F.round(F.col("y")[0], 9).alias("score"))
    return _keep_top(g, scored, ratio, V.ACTIVATIONS["sigmoid" if sigmoid else "tanh"])


# -- soft assignments ------------------------------------------------------------------------------


def long_form(assign: DataFrame, k: int) -> DataFrame:
    """(graph_id, node_id, cluster, s) of nodes with an array s."""
    return assign.select("graph_id", "node_id", F.posexplode("s").alias("cluster", "s")).withColumn("cluster", F.col("cluster").cast("long"))


def reduce_soft(assign: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """S' X: (graph_id, node_id = cluster, x)."""
    rows = assign.join(x.select("graph_id", "node_id", "x"), ["graph_id", "node_id"])
    sums = rows.groupBy("graph_id", F.col("cluster").alias("node_id")).agg(*[F.sum(F.col("s") * F.col("x")[i]).alias(f"_x{i}") for i in range(n)])
    return sums.select("graph_id", "node_id", V.vec([F.col(f"_x{i}") for i in range(n)]).alias("x"))


def connect_soft(assign: DataFrame, edges: DataFrame) -> DataFrame:
    return linalg.at_b_a(assign, edges.select(*filters.COO))


def _assigned(g: GraphSet, parts: list[Column]) -> DataFrame:
    return g.nodes.select("graph_id", "node_id", "x", V.vec(V.softmax(parts)).alias("s"))


def _soft(g: GraphSet, k: int, w, mlp_hidden: Sequence[int], mlp_activation) -> DataFrame:
    """Assignments by an MLP of the features: hidden layers of ``mlp_hidden`` widths, then ``w``."""
    parts, n = V.dense(V.items("x", g.n_features), mlp_hidden, 40, mlp_activation)
    if mlp_hidden:  # hidden values are columns of their own, so the softmax does not repeat them
        hidden = g.nodes.select("graph_id", "node_id", "x", V.vec(parts).alias("_h"))
        return hidden.select("graph_id", "node_id", "x", V.vec(V.softmax(V.affine(V.items("_h", n), w or V.dyadic(n, k)))).alias("s"))
    return _assigned(g, V.affine(parts, w or V.dyadic(n, k)))


def _edge_dots(g: GraphSet, soft: DataFrame, k: int, **values: Callable[[list[Column], list[Column]], Column]) -> DataFrame:
    """(graph_id, ..): for each name the sum over edges of w value(s_i, s_j), all in one pass over the edges."""
    s = soft.select("graph_id", F.col("node_id").alias("src"), F.col("s").alias("_a"))
    d = soft.select("graph_id", F.col("node_id").alias("dst"), F.col("s").alias("_b"))
    rows = g.edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"])
    return rows.groupBy("graph_id").agg(*[F.sum(F.col("w") * f(V.items("_a", k), V.items("_b", k))).alias(name) for name, f in values.items()])


def _edge_dot(g: GraphSet, soft: DataFrame, k: int, value: Callable[[list[Column], list[Column]], Column]) -> DataFrame:
    """(graph_id, v): sum over edges of w value(s_i, s_j)."""
    s = soft.select("graph_id", F.col("node_id").alias("src"), F.col("s").alias("_a"))
    d = soft.select("graph_id", F.col("node_id").alias("dst"), F.col("s").alias("_b"))
    rows = g.edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"])
    return rows.groupBy("graph_id").agg(F.sum(F.col("w") * value(V.items("_a", k), V.items("_b", k))).alias("v"))


def _gram(soft: DataFrame, k: int) -> DataFrame:
    """(graph_id, n, g0 .. g(kk-1), c0 .. c(k-1)): S'S row by row and column sums."""
    s = V.items("s", k)
    return soft.groupBy("graph_id").agg(F.count("*").cast("double").alias("n"), *[F.sum(s[i] * s[j]).alias(f"g{i * k + j}") for i in range(k) for j in range(k)], *[F.sum(c).alias(f"c{i}") for i, c in enumerate(s)])


def _pooled(g: GraphSet, soft: DataFrame, k: int, losses: DataFrame, cleaned: bool, x: DataFrame | None = None, n: int | None = None) -> Pooled:
    assign = long_form(soft, k)
    nodes = reduce_soft(assign, g.nodes if x is None else x, g.n_features if n is None else n)
    edges = connect_soft(assign, g.edges)
    if cleaned:
        edges = filters.normalize_a(edges.where("src <> dst"), nodes)
    return Pooled(nodes, edges, soft.select("graph_id", "node_id", "s"), losses)


def mincut_pool(g: GraphSet, k: int, w=None, mlp_hidden: Sequence[int] = (), mlp_activation="relu") -> Pooled:
    """Losses: cut = -tr(S'AS) / tr(S'DS), ortho = |S'S/|S'S| - I/sqrt(k)|."""
    soft = _soft(g, k, w, mlp_hidden, mlp_activation)
    sums = _edge_dots(g, soft, k, num=V.dot, den=lambda a, b: V.dot(a, a))
    gram = _gram(soft, k)
    norm = F.sqrt(V.total([F.col(f"g{i}") * F.col(f"g{i}") for i in range(k * k)]))
    gaps = [F.col(f"g{i * k + j}") / norm - (1 / k**0.5 if i == j else 0.0) for i in range(k) for j in range(k)]
    losses = sums.join(gram, "graph_id").select("graph_id", (-F.col("num") / F.col("den")).alias("cut_loss"), F.sqrt(V.dot(gaps, gaps)).alias("ortho_loss"))
    return _pooled(g, soft, k, losses, True)


def dmon_pool(g: GraphSet, k: int, w=None, collapse: float = 0.1, mlp_hidden: Sequence[int] = (), mlp_activation="relu") -> Pooled:
    """Losses: -modularity with 2m = number of stored edges, and collapse (|column sums| / n sqrt(k) - 1)."""
    soft = _soft(g, k, w, mlp_hidden, mlp_activation)
    num = _edge_dot(g, soft, k, V.dot).withColumnRenamed("v", "num")
    m = g.edges.groupBy("graph_id").agg(F.count("*").cast("double").alias("m"))
    d = filters.degrees(g.edges, g.nodes).join(soft.select("graph_id", "node_id", "s"), ["graph_id", "node_id"])
    ds = d.groupBy("graph_id").agg(*[F.sum(F.col("d") * F.col("s")[i]).alias(f"d{i}") for i in range(k)])
    gram = _gram(soft, k)
    rows = num.join(m, "graph_id").join(ds, "graph_id").join(gram, "graph_id")
    norm = V.total([F.col(f"d{i}") * F.col(f"d{i}") for i in range(k)]) / (2 * F.col("m"))
    size = F.sqrt(V.total([F.col(f"c{i}") * F.col(f"c{i}") for i in range(k)]))
    losses = rows.select("graph_id", (-(F.col("num") - norm) / (2 * F.col("m"))).alias("spectral_loss"), (F.lit(collapse) * (size / F.col("n") * k**0.5 - 1)).alias("collapse_loss"))
    return _pooled(g, soft, k, losses, False)


def just_balance_pool(g: GraphSet, k: int, w=None, normalised: bool = False, mlp_hidden: Sequence[int] = (), mlp_activation="relu") -> Pooled:
    """Loss: minus the sum of column norms of S, over sqrt(n k) if normalised."""
    soft = _soft(g, k, w, mlp_hidden, mlp_activation)
    loss = -V.total([F.sqrt(F.col(f"g{i * k + i}")) for i in range(k)])
    losses = _gram(soft, k).select("graph_id", (loss / F.sqrt(F.col("n") * k) if normalised else loss).alias("balance_loss"))
    return _pooled(g, soft, k, losses, True)


def cheeger_pool(g: GraphSet, k: int, w=None, total_variation: float = 1.0, balance: float = 1.0, mlp_hidden: Sequence[int] = (), mlp_activation="relu") -> Pooled:
    """Losses: sum a_ij |s_i - s_j|_1 / (2 edges), and balance by the (floor(n / k) + 1)-th largest of each column."""
    soft = _soft(g, k, w, mlp_hidden, mlp_activation)
    tv = _edge_dot(g, soft, k, lambda a, b: V.total([F.abs(x - y) for x, y in zip(a, b, strict=True)])).withColumnRenamed("v", "tv")
    m = g.edges.groupBy("graph_id").agg(F.count("*").cast("double").alias("m"))
    each = long_form(soft, k)
    n = soft.groupBy("graph_id").agg(F.count("*").alias("n"))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "cluster").orderBy(F.desc("s"), "node_id"))).join(n, "graph_id")
    q = ranked.where(F.col("r") == F.floor(F.col("n") / k) + 1).select("graph_id", "cluster", F.col("s").alias("q"))
    gap = F.col("s") - F.col("q")
    away = each.join(q, ["graph_id", "cluster"]).groupBy("graph_id").agg(F.sum(F.when(gap >= 0, (k - 1) * gap).otherwise(-gap)).alias("away"))
    rows = tv.join(m, "graph_id").join(away, "graph_id").join(n, "graph_id")
    top = F.col("n") * (k - 1)
    losses = rows.select("graph_id", (total_variation * F.col("tv") / (2 * F.col("m"))).alias("variation_loss"), (balance * (top - F.col("away")) / top).alias("balance_loss"))
    return _pooled(g, soft, k, losses, True)


def diff_pool(g: GraphSet, k: int, channels: int, ws=None, we=None, activation=None) -> Pooled:
    """S and Z by graph convolutions over the normalised A + I; losses |A - SS'| and mean row entropy."""
    n = g.n_features
    ws, we = ws or V.dyadic(n, k, 0), we or V.dyadic(n, channels, 1)
    a = filters.normalize_a(filters.plus_identity(g.edges, g.nodes), g.nodes)
    scores = linalg.spmm(a, project(g.nodes, n, ws), k)
    soft = scores.select("graph_id", "node_id", V.vec(V.softmax(V.items("x", k))).alias("s"))
    z = linalg.spmm(a, project(g.nodes, n, we), channels)
    z = _done(z, V.activate(V.items("x", channels), activation))
    cross = _edge_dot(g, soft, k, V.dot).withColumnRenamed("v", "cross")
    squares = g.edges.groupBy("graph_id").agg(F.sum(F.col("w") * F.col("w")).alias("aa"))
    entropy = soft.groupBy("graph_id").agg(F.avg(V.total([-c * F.log(c + V.EPSILON) for c in V.items("s", k)])).alias("entropy_loss"))
    rows = cross.join(squares, "graph_id").join(_gram(soft, k), "graph_id").join(entropy, "graph_id")
    gg = V.total([F.col(f"g{i}") * F.col(f"g{i}") for i in range(k * k)])
    losses = rows.select("graph_id", F.sqrt(F.greatest(F.lit(0.0), F.col("aa") - 2 * F.col("cross") + gg)).alias("link_loss"), "entropy_loss")
    return _pooled(g, soft, k, losses, False, z, channels)


def la_pool(g: GraphSet) -> Pooled:
    """Leaders have the largest |L x| among their neighbours; others join leaders by cosine over distance.

    Distances follow edge weights inside each graph (Floyd and Warshall for each graph, so graphs are small).
    """
    n = g.n_features
    deg = filters.degrees(g.edges, g.nodes)
    ax = linalg.spmm(g.edges, g.nodes, n)
    lx = _paired(g.nodes, ax).join(deg, ["graph_id", "node_id"])
    v = lx.select("graph_id", "node_id", F.sqrt(V.total([(F.col("d") * x - y) * (F.col("d") * x - y) for x, y in zip(V.items("x", n), V.items("y", n), strict=True)])).alias("v"))
    beside = g.edges.select("graph_id", "src", "dst").join(v.select("graph_id", F.col("node_id").alias("dst"), F.col("v").alias("o")), ["graph_id", "dst"])
    most = beside.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.max("o").alias("o"))
    leads = v.join(most, ["graph_id", "node_id"], "left").where(F.col("o").isNull() | (F.col("v") >= F.col("o"))).select("graph_id", "node_id")
    numbers = linalg.renumbered(leads)
    pairs = g.edges.select(*filters.COO).unionByName(filters.loops(g.nodes, 0.0))

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {x: i for i, x in enumerate(ids)}
        d = np.full((len(ids), len(ids)), np.inf)
        for s, t, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True):
            if w:
                i, j = at[s], at[t]
                d[i, j] = d[j, i] = min(d[i, j], w)
        np.fill_diagonal(d, 0)
        for m in range(len(ids)):
            d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :])
        i, j = np.nonzero(np.isfinite(d) & (d > 0))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iat[0], "src": np.array(ids, np.int64)[i], "dst": np.array(ids, np.int64)[j], "b": 1 / d[i, j]})

    beta = pairs.groupBy("graph_id").applyInPandas(paths, "graph_id long, src long, dst long, b double")
    one = g.nodes.select("graph_id", F.col("node_id").alias("src"), F.col("x").alias("_a"))
    two = g.nodes.join(numbers, ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("dst"), F.col("new_id").alias("cluster"), F.col("x").alias("_b"))
    cos = V.dot(V.l2_normalised(V.items("_a", n)), V.l2_normalised(V.items("_b", n)))
    soft = linalg.segment_softmax(one.join(two, "graph_id"), "src", cos, "p").join(beta, ["graph_id", "src", "dst"], "left")
    lead = numbers.select("graph_id", F.col("node_id").alias("src"), F.lit(True).alias("lead"))
    soft = soft.join(lead, ["graph_id", "src"], "left")
    s = F.when(F.col("lead"), (F.col("src") == F.col("dst")).cast("double")).otherwise(F.coalesce("b", F.lit(0.0)) * F.col("p"))
    assign = soft.select("graph_id", F.col("src").alias("node_id"), "cluster", s.alias("s"))
    return Pooled(reduce_soft(assign, g.nodes, n), connect_soft(assign, g.edges), assign)


# -- readouts -----------------------------------------------------------------------------------------


def _by_graph(nodes: DataFrame, parts: list[Column], how: Callable[[Column], Column]) -> DataFrame:
    agg = nodes.groupBy("graph_id").agg(*[how(p).alias(f"_x{i}") for i, p in enumerate(parts)])
    return agg.select("graph_id", V.vec([F.col(f"_x{i}") for i in range(len(parts))]).alias("x"))


def global_sum(nodes: DataFrame, n: int) -> DataFrame:
    return _by_graph(nodes, V.items("x", n), F.sum)


def global_avg(nodes: DataFrame, n: int) -> DataFrame:
    return _by_graph(nodes, V.items("x", n), F.avg)


def global_max(nodes: DataFrame, n: int) -> DataFrame:
    return _by_graph(nodes, V.items("x", n), F.max)


def global_attention(nodes: DataFrame, n: int, channels: int, wa=None, wf=None) -> DataFrame:
    """Sum of sigmoid(x Wa) x Wf."""
    x = V.items("x", n)
    gate = V.activate(V.affine(x, wa or V.dyadic(n, channels, 0)), "sigmoid")
    return _by_graph(nodes, [a * b for a, b in zip(gate, V.affine(x, wf or V.dyadic(n, channels, 1)), strict=True)], F.sum)


def global_attention_sum(nodes: DataFrame, n: int, a=None) -> DataFrame:
    """Sum of x weighed by the softmax over the graph of x . a."""
    w = a or [r[0] for r in V.dyadic(n, 1)]
    score = V.total([p * F.lit(float(v)) for p, v in zip(V.items("x", n), w, strict=True)])
    scored = nodes.withColumn("_s", score)
    top = scored.groupBy("graph_id").agg(F.max("_s").alias("_m"))
    e = scored.join(top, "graph_id").withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    sums = e.groupBy("graph_id").agg(F.sum("_e").alias("_z"), *[F.sum(F.col("_e") * p).alias(f"_x{i}") for i, p in enumerate(V.items("x", n))])
    return sums.select("graph_id", V.vec([F.col(f"_x{i}") / (F.col("_z") + F.lit(1e-9)) for i in range(n)]).alias("x"))


def sort_pool(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """(graph_id, pos, x): the k nodes of largest last feature, with rows of zeros where a graph has fewer.

    Graphs are padded with zeros to the largest one first, so a padding row stands before negative nodes.
    """
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n").alias("m"))
    zero = F.array_repeat(F.lit(0.0), F.lit(n))
    fill = sizes.join(F.broadcast(top)).where("n < m").select("graph_id", F.explode(F.sequence("n", F.col("m") - 1)).alias("node_id")).select("graph_id", (F.col("node_id") + F.lit(1 << 60)).alias("node_id"), zero.alias("x"))
    rows = nodes.select("graph_id", "node_id", "x").unionByName(fill)
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("x")[n - 1].desc(), "node_id")).cast("long") - 1).where(F.col("pos") < k)
    frame = sizes.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("pos"))
    return frame.join(ranked.select("graph_id", "pos", "x"), ["graph_id", "pos"], "left").select("graph_id", "pos", F.coalesce("x", zero).alias("x"))


READOUTS = {"sum": global_sum, "avg": global_avg, "max": global_max, "attn": global_attention, "attn_sum": global_attention_sum, "sort": sort_pool}
