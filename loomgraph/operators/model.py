"""Graphs as tables.

``nodes(graph_id, node_id, x array<double>, ...)``, ``edges(graph_id, src, dst, w double, [e array<double>])``
and ``graphs(graph_id, [y], ...)``.  Many graphs lie in the same tables; a missing edge is a weight of 0.
Everything is lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V


@dataclass(frozen=True)
class GraphSet:
    nodes: DataFrame
    edges: DataFrame
    graphs: DataFrame | None = None
    n_features: int = 0
    n_edge_features: int = 0
    #: The edges with the features of their ends as _s and _t, where these have been found already.
    ends: DataFrame | None = None
    #: Whether it is known that no edge is a loop.
    loopless: bool = False

    # -- construction --------------------------------------------------------------------------
    @staticmethod
    def single(nodes: DataFrame, edges: DataFrame, n_features: int, n_edge_features: int = 0) -> GraphSet:
        """One graph: a constant graph_id is added."""
        return GraphSet(nodes.withColumn("graph_id", F.lit(0).cast("long")), edges.withColumn("graph_id", F.lit(0).cast("long")), None, n_features, n_edge_features)

    @staticmethod
    def from_arrays(spark: SparkSession, graphs: Sequence[dict]) -> GraphSet:
        """From dense Python values: x rows, a rows, optional e[i][j] vectors and y.  For small inputs."""
        node_rows, edge_rows, graph_rows, width, e_width = [], [], [], 0, 0
        for g, spec in enumerate(graphs):
            a = spec.get("a") or []
            x = spec.get("x") or [[] for _ in a]
            x = [v if isinstance(v, (list, tuple)) else [v] for v in x]
            if a and any(len(r) != len(a) for r in a):
                raise ValueError("an adjacency matrix is square")
            for i, v in enumerate(x):
                node_rows.append((g, i, [float(t) for t in v]))
                width = max(width, len(v))
            for i, row in enumerate(a):
                for j, w in enumerate(row):
                    if w:
                        e = [float(t) for t in spec["e"][i][j]] if spec.get("e") else []
                        e_width = max(e_width, len(e))
                        edge_rows.append((g, i, j, float(w), e))
            y = spec.get("y")
            graph_rows.append((g, None if y is None else [float(t) for t in (y if isinstance(y, (list, tuple)) else [y])]))
        return GraphSet(
            spark.createDataFrame(node_rows, "graph_id long, node_id long, x array<double>"),
            spark.createDataFrame(edge_rows, "graph_id long, src long, dst long, w double, e array<double>"),
            spark.createDataFrame(graph_rows, "graph_id long, y array<double>"),
            width,
            e_width,
        )

    def with_x(self, nodes: DataFrame, n_features: int) -> GraphSet:
        return replace(self, nodes=nodes, n_features=n_features, ends=None)

    def with_edges(self, edges: DataFrame) -> GraphSet:
        return replace(self, edges=edges, ends=None, loopless=False)

    # -- derived properties ---------------------------------------------------------------------
    def counts(self) -> DataFrame:
        """(graph_id, n_nodes, n_edges) of every graph that has nodes."""
        n = self.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
        m = self.edges.where("w <> 0").groupBy("graph_id").agg(F.count("*").alias("n_edges"))
        return n.join(m, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))

    def signature(self) -> dict[str, str]:
        return {k: df.schema.simpleString() for k, df in (("nodes", self.nodes), ("edges", self.edges), ("graphs", self.graphs)) if df is not None}

    def validate(self) -> GraphSet:
        """Raises unless all vectors have the stated width and all edges join nodes of their graph."""
        wide = self.nodes.where(F.size("x") != self.n_features).limit(1).count()
        keys = self.nodes.select("graph_id", F.col("node_id").alias("k"))
        loose = [self.edges.join(keys.withColumnRenamed("k", c), ["graph_id", c], "left_anti").limit(1).count() for c in ("src", "dst")]
        if wide or any(loose):
            raise ValueError("features of another width" if wide else "an edge without its node")
        return self

    # -- collections ----------------------------------------------------------------------------
    def _keep(self, ids: DataFrame) -> GraphSet:
        cut = lambda df: None if df is None else df.join(ids.select("graph_id"), "graph_id", "left_semi")
        return replace(self, ends=None, loopless=False, nodes=cut(self.nodes), edges=cut(self.edges), graphs=cut(self.graphs))

    def ids(self) -> DataFrame:
        return (self.graphs if self.graphs is not None else self.nodes).select("graph_id").distinct()

    def apply(self, transform: Callable[[GraphSet], GraphSet]) -> GraphSet:
        return transform(self)

    def map(self, value: Callable[[GraphSet], DataFrame], reduce: Column | None = None) -> DataFrame:
        """A row (graph_id, ..) for each graph, or one row of ``reduce`` over them."""
        rows = value(self)
        return rows if reduce is None else rows.agg(reduce)

    def filter(self, keep: Callable[[GraphSet], DataFrame]) -> GraphSet:
        """The graphs whose ids ``keep`` returns."""
        return self._keep(keep(self))

    def take_ids(self, ids: Sequence[int]) -> GraphSet:
        """Graphs by id, in this order and with repeats; they are numbered anew from 0."""
        spark = self.nodes.sparkSession
        wanted = spark.createDataFrame([(i, int(g)) for i, g in enumerate(ids)], "new_id long, graph_id long")
        pick = lambda df: None if df is None else df.join(F.broadcast(wanted), "graph_id").drop("graph_id").withColumnRenamed("new_id", "graph_id")
        return replace(self, ends=None, loopless=False, nodes=pick(self.nodes), edges=pick(self.edges), graphs=pick(self.graphs))

    def between(self, start: int, stop: int) -> GraphSet:
        cut = lambda df: None if df is None else df.where((F.col("graph_id") >= start) & (F.col("graph_id") < stop))
        return replace(self, ends=None, loopless=False, nodes=cut(self.nodes), edges=cut(self.edges), graphs=cut(self.graphs))

    def put(self, other: GraphSet) -> GraphSet:
        """Graphs of ``other`` in place of those of the same id."""
        gone = other.ids()
        swap = lambda a, b: None if a is None or b is None else a.join(gone, "graph_id", "left_anti").unionByName(b, allowMissingColumns=True)
        return replace(self, ends=None, loopless=False, nodes=swap(self.nodes, other.nodes), edges=swap(self.edges, other.edges), graphs=swap(self.graphs, other.graphs))

    def concat(self, other: GraphSet, offset: int | None = None) -> GraphSet:
        """All graphs of both; those of ``other`` are numbered from ``offset`` on, by default behind the last of these."""
        last = self.ids().agg(F.max("graph_id")).first()[0]
        least = 0 if last is None else last + 1
        offset = least if offset is None else offset
        if (other.ids().agg(F.min("graph_id")).first()[0] or 0) + offset < least:
            raise ValueError(f"an offset under {least} would merge graphs")
        move = lambda df: df.withColumn("graph_id", F.col("graph_id") + offset)
        both = lambda a, b: None if a is None or b is None else a.unionByName(move(b), allowMissingColumns=True)
        return replace(self, ends=None, loopless=False, nodes=both(self.nodes, other.nodes), edges=both(self.edges, other.edges), graphs=both(self.graphs, other.graphs))

    def split(self, share: float, seed: int = 0) -> tuple[GraphSet, GraphSet]:
        """By a hash of the id, alike on every run and cluster."""
        draw = V.uniform(seed, "graph_id")
        first = lambda df, yes: None if df is None else df.where((draw < share) == F.lit(yes))
        return tuple(replace(self, ends=None, loopless=False, nodes=first(self.nodes, y), edges=first(self.edges, y), graphs=first(self.graphs, y)) for y in (True, False))  # type: ignore[return-value]

    def shuffled(self, seed: int = 0) -> GraphSet:
        """Graphs numbered anew from 0 in an order that only the seed decides."""
        order = self.ids().withColumn("new_id", F.row_number().over(Window.orderBy(V.uniform(seed, "graph_id"), "graph_id")).cast("long") - 1)
        move = lambda df: None if df is None else df.join(order, "graph_id").drop("graph_id").withColumnRenamed("new_id", "graph_id")
        return replace(self, ends=None, loopless=False, nodes=move(self.nodes), edges=move(self.edges), graphs=move(self.graphs))
