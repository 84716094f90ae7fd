"""Batches and data layouts.  Tables of many graphs are the disjoint layout already; the others are views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators import linalg
from loomgraph.operators.model import GraphSet


def batches(ids: DataFrame, batch_size: int, epochs: int = 1, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """(epoch, batch_id, graph_id): the last batch of an epoch may be short; shuffling is by hash."""
    order = [V.uniform(seed, "epoch", "graph_id"), "graph_id"] if shuffle else ["graph_id"]
    rows = ids.select("graph_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    n = F.row_number().over(Window.partitionBy("epoch").orderBy(*order))
    return rows.withColumn("batch_id", F.floor((n - 1) / batch_size).cast("long")).select("epoch", "batch_id", "graph_id")


def steps_per_epoch(n_graphs: int, batch_size: int) -> int:
    return -(-n_graphs // batch_size)


def offsets(g: GraphSet) -> DataFrame:
    """(graph_id, n_nodes, offset): where each graph's nodes begin in one disjoint union."""
    n = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    return n.withColumn("offset", F.sum("n_nodes").over(Window.orderBy("graph_id")) - F.col("n_nodes"))


def _local(g: GraphSet) -> DataFrame:
    return linalg.renumbered(g.nodes)


def disjoint(g: GraphSet) -> GraphSet:
    """Nodes numbered through over all graphs; graph_id stays as the batch index."""
    off, local = offsets(g), _local(g)
    numbers = local.join(off, "graph_id").select("graph_id", "node_id", (F.col("new_id") + F.col("offset")).alias("new_id"))
    nodes = g.nodes.join(numbers, ["graph_id", "node_id"]).drop("node_id").withColumnRenamed("new_id", "node_id")
    return GraphSet(nodes.select(*g.nodes.columns), linalg.induced(g.edges, numbers), g.graphs, g.n_features, g.n_edge_features)


def padded_nodes(g: GraphSet, mask: bool = False, n_max: int | None = None) -> DataFrame:
    """(graph_id, pos, x, valid): nodes in order, then rows of zeros up to the largest graph (or ``n_max``).

    With ``mask`` the validity is also the last feature.  A graph of more than ``n_max`` nodes raises.
    """
    local = g.nodes.join(_local(g), ["graph_id", "node_id"]).select("graph_id", F.col("new_id").alias("pos"), "x")
    sizes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    if n_max is None:
        top = sizes.agg(F.max("n").alias("m"))
        frame = sizes.select("graph_id").join(F.broadcast(top)).select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("pos"))
    else:
        last = F.when(F.col("n") > n_max, F.raise_error(F.concat(F.lit("a graph has more nodes than n_max: "), F.col("n").cast("string"))).cast("long")).otherwise(n_max - 1)
        frame = sizes.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos"))
    out = frame.join(local, ["graph_id", "pos"], "left").withColumn("valid", F.col("x").isNotNull())
    x = F.coalesce("x", F.array_repeat(F.lit(0.0), F.lit(g.n_features)))
    return out.withColumn("x", F.concat(x, F.array(F.col("valid").cast("double"))) if mask else x)


def padded_adjacency(g: GraphSet) -> DataFrame:
    """(graph_id, i, j, w): edges by place in their own graph; all other cells are 0."""
    return linalg.induced(g.edges.select("graph_id", "src", "dst", "w"), _local(g)).select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "w")


def padded_edges(g: GraphSet) -> DataFrame:
    """(graph_id, i, j, e): edge features by place in their own graph; those of all other cells are zeros."""
    return linalg.induced(g.edges.select("graph_id", "src", "dst", "e"), _local(g)).select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "e")


def disjoint_labels(labels: DataFrame, g: GraphSet | None = None) -> DataFrame:
    """(row, y): labels of graphs in the order of their ids or, where ``g`` is given, of its nodes as the disjoint union numbers them."""
    if g is not None:
        numbers = _local(g).join(offsets(g), "graph_id").select("graph_id", "node_id", (F.col("new_id") + F.col("offset")).alias("row"))
        return labels.join(numbers, ["graph_id", "node_id"]).select("row", "y")
    order = labels.select("graph_id").withColumn("row", F.row_number().over(Window.orderBy("graph_id")).cast("long") - 1)
    return labels.join(order, "graph_id").select("row", "y")


def mixed(signals: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """A X for signals (graph_id, node_id, x) of many graphs that share ``edges`` (src, dst, w)."""
    m = edges.select("src", F.col("dst").alias("node_id"), "w").join(signals, "node_id")
    agg = m.groupBy("graph_id", F.col("src").alias("node_id")).agg(*[F.sum(F.col("w") * F.col("x")[i]).alias(f"_x{i}") for i in range(n)])
    out = signals.select("graph_id", "node_id").join(agg, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", F.array(*[F.coalesce(F.col(f"_x{i}"), F.lit(0.0)) for i in range(n)]).alias("x"))


def mode_of(x_rank: int, a_rank: int) -> str:
    """Name of the layout that the ranks of features and adjacency belong to."""
    modes = {(2, 2): "single", (3, 3): "batch", (3, 2): "mixed"}
    if (x_rank, a_rank) not in modes:
        raise ValueError(f"no layout has ranks {x_rank} and {a_rank}")
    return modes[x_rank, a_rank]


def masked(nodes: DataFrame, n: int) -> DataFrame:
    """Splits the last of n features off as ``valid`` and drops rows that are padding."""
    return nodes.withColumn("valid", F.col("x")[n - 1] != 0).withColumn("x", F.slice("x", 1, n - 1)).where("valid")


def single(g: GraphSet, sample_weights: DataFrame | None = None) -> GraphSet:
    """The one graph of a set, with optional (graph_id, node_id, sample_weight); several graphs raise."""
    if g.ids().limit(2).count() != 1:
        raise ValueError("exactly one graph is needed")
    return g if sample_weights is None else g.with_x(g.nodes.join(sample_weights, ["graph_id", "node_id"], "left"), g.n_features)


def padded_labels(labels: DataFrame, width: int) -> DataFrame:
    """(graph_id, pos, y): node labels padded like ``padded_nodes``."""
    return padded_nodes(GraphSet(labels.withColumnRenamed("y", "x"), labels.limit(0), None, width)).select("graph_id", "pos", F.col("x").alias("y"))
