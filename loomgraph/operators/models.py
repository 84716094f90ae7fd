"""Models, subgraphs around a node, explanation and clustering measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.functions.shared import Rounds
from loomgraph.operators import conv, linalg, pool
from loomgraph.operators.model import GraphSet


def gcn_model(g: GraphSet, n_labels: int, channels: int = 16, activation="relu", output="softmax", weights: Sequence | None = None) -> DataFrame:
    """Two graph convolutions without bias over a filtered adjacency (inference: no dropout)."""
    w1, w2 = weights or (V.dyadic(g.n_features, channels, 0), V.dyadic(channels, n_labels, 1))
    hidden = conv.gcn_conv(g, channels, w1, activation=activation)
    return conv.gcn_conv(g.with_x(hidden, channels), n_labels, w2, activation=output)


def general_gnn(g: GraphSet, output: int, hidden: int = 8, layers: int = 2, connectivity: str | None = "cat", aggregate="sum", readout: str | None = "sum", activation="softmax") -> DataFrame:
    """MLP, general convolutions joined by "cat", "sum" or nothing, readout, MLP."""
    x = conv._done(g.nodes, V.mlp(V.items("x", g.n_features), [(V.dyadic(g.n_features, hidden), None, "prelu")]))
    cur, width = x, hidden
    for i in range(layers):
        z = conv.general_conv(g.with_x(cur, width), hidden, V.dyadic(width, hidden, i + 1), aggregate=aggregate)
        if connectivity is None:
            cur, width = z, hidden
            continue
        both = conv._paired(z, cur)
        if connectivity == "cat":
            cur, width = conv._done(both, V.items("x", hidden) + V.items("y", width)), hidden + width
        else:
            cur = conv._done(both, [a + b for a, b in zip(V.items("x", hidden), V.items("y", hidden), strict=True)])
    if readout:
        cur = pool.READOUTS[readout](cur, width).withColumn("node_id", F.lit(0).cast("long"))
    return conv._done(cur, V.mlp(V.items("x", width), [(V.dyadic(width, hidden, 7), None, "prelu"), (V.dyadic(hidden, output, 8), None, activation)]))


def mlp_model(nodes: DataFrame, n: int, sizes: Sequence[int], activation="prelu", output=None) -> DataFrame:
    widths = [n, *sizes]
    return conv._done(nodes, V.mlp(V.items("x", n), [(V.dyadic(a, b, i), None, output if i == len(sizes) - 1 else activation) for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False))]))


def binary_adjacency(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").withColumn("w", F.lit(1.0))


def k_hop_subgraph(edges: DataFrame, node: int, k: int, graph_id: int = 0) -> DataFrame:
    """Edges with an end among the nodes reached in k - 1 steps; weights become signs."""
    e = edges.where(F.col("graph_id") == graph_id)
    reached = e.sparkSession.range(1).select(F.lit(node).cast("long").alias("node_id"))
    for _ in range(k - 1):
        step = e.join(reached.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"))
        reached = reached.unionByName(step).distinct()
    a = e.join(reached.withColumnRenamed("node_id", "src"), "src", "left_semi")
    b = e.join(reached.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return a.select("graph_id", "src", "dst", "w").unionByName(b.select("graph_id", "src", "dst", "w")).distinct().withColumn("w", F.signum("w"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): the smallest node reachable over edges of either direction; edges end at nodes.

    Each round points every node at its smallest neighbour or itself, follows these pointers to their ends by doubling
    steps (so long paths take few of them), and goes on with the edges between different ends, until none is left.
    At least half of the nodes with edges are gone after a round.  Tables handed on are written and read again, and
    go when they are no longer needed.
    """
    rounds = Rounds(nodes.sparkSession, "components")
    ends = edges.select("graph_id", "src", "dst")
    found = nodes.where("graph_id IS NOT NULL AND node_id IS NOT NULL").select("graph_id", "node_id", F.col("node_id").alias("component")).distinct()
    e, e_path = rounds.table(ends.unionByName(linalg.transpose(ends)).where("src <> dst").distinct(), "edges")
    paths = []
    while True:
        to, path = rounds.table(e.groupBy("graph_id", "src").agg(F.min("dst").alias("dst")).select("graph_id", "src", F.least("src", "dst").alias("dst"), F.lit(True).alias("moved")), "pointers")
        moved = to.agg(F.max("moved")).first()[0]
        if moved is None:
            break
        while moved:
            step = to.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("_2"))
            two = to.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("_2").alias("dst"))
            four = two.join(two.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("_4")), ["graph_id", "dst"])
            to, now_path = rounds.table(four.select("graph_id", "src", F.col("_4").alias("dst"), (F.col("_4") != F.col("dst")).alias("moved")), "pointers")
            rounds.drop(path)
            path, moved = now_path, to.agg(F.max("moved")).first()[0]
        paths.append(path)
        to = to.drop("moved")
        found = found.join(to.select("graph_id", F.col("src").alias("component"), F.col("dst").alias("_to")), ["graph_id", "component"], "left").select("graph_id", "node_id", F.coalesce("_to", "component").alias("component"))
        for end in ("src", "dst"):
            e = e.join(to.select("graph_id", F.col("src").alias(end), F.col("dst").alias("_to")), ["graph_id", end]).withColumn(end, F.col("_to")).drop("_to")
        e, now_path = rounds.table(e.where("src <> dst").select("graph_id", "src", "dst").distinct(), "edges")
        rounds.drop(e_path)
        e_path = now_path
    found, _ = rounds.table(found, "found")
    for p in [*paths, path, e_path]:
        rounds.drop(p)
    return found


def cluster_metrics(rows: DataFrame, truth: str = "y", found: str = "c") -> DataFrame:
    """One row: homogeneity, completeness, v_measure and nmi of two labellings."""
    cells = rows.groupBy(truth, found).agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    a, b = cells.groupBy(truth).agg(F.sum("n").alias("na")), cells.groupBy(found).agg(F.sum("n").alias("nb"))
    p = cells.join(a, truth).join(b, found).join(F.broadcast(total))
    mutual = p.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda df, c, name: df.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    m = mutual.join(entropy(a, "na", "ha")).join(entropy(b, "nb", "hb"))
    ratio = lambda x, y: F.when(F.col(y) == 0, 1.0).otherwise(F.col(x) / F.col(y))
    m = m.select(ratio("mi", "ha").alias("homogeneity"), ratio("mi", "hb").alias("completeness"), "mi", "ha", "hb")
    h, c = F.col("homogeneity"), F.col("completeness")
    v = F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c))
    nmi = F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb")))
    return m.select("homogeneity", "completeness", v.alias("v_measure"), nmi.alias("nmi"))


def sgc_features(g: GraphSet, hops: int) -> DataFrame:
    """A^hops X, the hops applied to the signal."""
    x = g.nodes.select("graph_id", "node_id", "x")
    for _ in range(hops):
        x = linalg.spmm(g.edges, x, g.n_features)
    return x


def fit_sgc(features: DataFrame, n: int, labels: DataFrame, max_iter: int = 50):
    """A linear head on propagated features; ``labels`` has (graph_id, node_id, y double)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features.join(labels, ["graph_id", "node_id"]).select("y", array_to_vector(V.vec(V.items("x", n))).alias("features"))
    return LogisticRegression(labelCol="y", maxIter=max_iter).fit(rows)


def mask_weights(mask: DataFrame) -> DataFrame:
    """(.., sample_weight): mask / number of masked rows."""
    n = mask.agg(F.sum(F.col("mask").cast("int")).alias("_n"))
    return mask.join(F.broadcast(n)).withColumn("sample_weight", F.col("mask").cast("double") / F.col("_n")).drop("_n")


class NodeExplainer:
    """Which edges and features a node's prediction by ``gcn_model`` rests on.

    Spark finds the node's neighbourhood; two masks over it are then fitted on the driver by Adam, with sizes
    and entropies of the masks as penalties.  A neighbourhood is small; ``max_nodes`` bounds it.
    """

    def __init__(self, n_hops: int = 2, rate: float = 0.01, epochs: int = 100, a_size: float = 5e-4, x_size: float = 0.1, a_entropy: float = 0.1, x_entropy: float = 0.1, max_nodes: int = 2000):
        self.n_hops, self.rate, self.epochs, self.max_nodes = n_hops, rate, epochs, max_nodes
        self.penalty = (a_size, x_size, a_entropy, x_entropy)

    def explain(self, g: GraphSet, node: int, weights: Sequence, seed: int = 0) -> tuple[list[tuple[int, int, float]], list[float]]:
        """(edges with mask values, feature mask) for the class that the model gives the node."""
        sub = k_hop_subgraph(g.edges, node, self.n_hops).select("src", "dst").collect()
        ids = sorted({node} | {r["src"] for r in sub} | {r["dst"] for r in sub})
        if len(ids) > self.max_nodes:
            raise ValueError(f"{len(ids)} nodes around the node; the bound is {self.max_nodes}")
        spark = g.nodes.sparkSession
        wanted = spark.createDataFrame([(i,) for i in ids], "node_id long")
        x = {r["node_id"]: r["x"] for r in g.nodes.join(F.broadcast(wanted), "node_id", "left_semi").select("node_id", "x").collect()}
        at = {v: i for i, v in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        for r in sub:
            a[at[r["src"]], at[r["dst"]]] = 1
        feats, (w1, w2) = np.array([x[i] for i in ids], float), (np.array(w, float) for w in weights)
        return self._fit(a, feats, at[node], w1, w2, ids, seed)

    def _fit(self, a, x, target, w1, w2, ids, seed):
        rng = np.random.default_rng(seed)
        edges = np.argwhere(a > 0)
        state = [rng.normal(0, np.sqrt(2 / len(ids)), len(edges)), rng.normal(0, 0.1, x.shape[1])]
        moments = [(np.zeros_like(s), np.zeros_like(s)) for s in state]
        sig = lambda z: 1 / (1 + np.exp(-z))

        def run(ma, mx):
            m = np.zeros_like(a)
            m[edges[:, 0], edges[:, 1]] = ma
            xm = x * mx
            h = m @ (xm @ w1)
            r = np.maximum(h, 0)
            z = (m @ (r @ w2))[target]
            p = np.exp(z - z.max())
            return m, xm, h, r, p / p.sum()

        label = int(np.argmax(run(np.ones(len(edges)), np.ones(x.shape[1]))[-1]))
        a_size, x_size, a_ent, x_ent = self.penalty
        for t in range(1, self.epochs + 1):
            ma, mx = sig(state[0]), sig(state[1])
            m, xm, h, r, p = run(ma, mx)
            dz = p.copy()
            dz[label] -= 1
            dm = np.zeros_like(a)
            dm[target] = (r @ w2) @ dz
            dr = np.outer(m[target], w2 @ dz) * (h > 0)
            dm += dr @ (xm @ w1).T
            dx = ((m.T @ dr) @ w1.T * x).sum(axis=0)
            ga = dm[edges[:, 0], edges[:, 1]] + a_size + a_ent * np.log((1 - ma + 1e-15) / (ma + 1e-15)) / max(1, len(ma))
            gx = dx + x_size / len(mx) + x_ent * np.log((1 - mx + 1e-15) / (mx + 1e-15)) / len(mx)
            for s, (m1, m2), grad in zip(state, moments, (ga * ma * (1 - ma), gx * mx * (1 - mx)), strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                s -= self.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        return [(ids[i], ids[j], float(v)) for (i, j), v in zip(edges.tolist(), sig(state[0]), strict=True)], sig(state[1]).tolist()


def clean_explanation(spark, edges: Sequence[tuple[int, int, float]], node: int, n_hops: int, threshold: float = 0.1) -> DataFrame:
    """Edges of a mask at or over the threshold, made symmetric by the mean, cut to the node's neighbourhood again."""
    e = spark.createDataFrame([(0, s, d, w) for s, d, w in edges if w >= threshold], "graph_id long, src long, dst long, w double")
    both = e.unionByName(linalg.transpose(e).select(*e.columns)).groupBy("graph_id", "src", "dst").agg((F.sum("w") / 2).alias("w"))
    near = k_hop_subgraph(both, node, n_hops).select("graph_id", "src", "dst")
    return both.join(near, ["graph_id", "src", "dst"], "left_semi")


__all__ = ["NodeExplainer", "binary_adjacency", "clean_explanation", "cluster_metrics", "connected_components", "fit_sgc", "gcn_model", "general_gnn", "k_hop_subgraph", "mask_weights", "mlp_model", "sgc_features"]
