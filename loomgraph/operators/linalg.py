"""Sparse matrices as edge tables: products, segments, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V

LOWEST, HIGHEST = -1.7976931348623157e308, 1.7976931348623157e308
#: Name -> (aggregate, value of a segment without rows).
SEGMENT = {
    "sum": (F.sum, 0.0),
    "mean": (F.avg, 0.0),
    "max": (F.max, LOWEST),
    "min": (F.min, HIGHEST),
    "prod": (F.product, 1.0),
}


def segment(how: str | Callable[[Column], Column]) -> tuple[Callable[[Column], Column], float]:
    """A named aggregate, or any function from a column to an aggregate (empty segments are 0)."""
    return SEGMENT[how] if isinstance(how, str) else (how, 0.0)


def scatter(messages: DataFrame, key: str, parts: list[Column], universe: DataFrame, how="sum") -> DataFrame:
    """(graph_id, node_id, x): ``parts`` aggregated by ``key``, one row for every row of ``universe``.

    Each dimension is an aggregate of its own, so partial sums are made before the exchange.
    """
    f, empty = segment(how)
    agg = messages.groupBy("graph_id", F.col(key).alias("node_id")).agg(*[f(p).alias(f"_x{i}") for i, p in enumerate(parts)])
    joined = universe.select("graph_id", "node_id").join(agg, ["graph_id", "node_id"], "left")
    return joined.select("graph_id", "node_id", V.vec([F.coalesce(F.col(f"_x{i}"), F.lit(empty)) for i in range(len(parts))]).alias("x"))


def scatter_softmax(messages: DataFrame, key: str, score: Column, parts: list[Column], universe: DataFrame) -> DataFrame:
    """``scatter`` of parts times the softmax of a score that lies between -300 and 300 (see ``segment_softmax``).

    exp(s - max) / (sum + 1e-9) is exp(s) / (sum of exp(s) + 1e-9 max of exp(s)), and such scores do not overflow: sums and
    maximum are made before the exchange, and no rows are sorted.
    """
    rows = messages.withColumn("_e", F.exp(score))
    agg = rows.groupBy("graph_id", F.col(key).alias("node_id")).agg(F.sum("_e").alias("_z"), F.max("_e").alias("_m"), *[F.sum(F.col("_e") * p).alias(f"_x{i}") for i, p in enumerate(parts)])
    joined = universe.select("graph_id", "node_id").join(agg, ["graph_id", "node_id"], "left")
    return joined.select("graph_id", "node_id", V.vec([F.coalesce(F.col(f"_x{i}") / (F.col("_z") + 1e-9 * F.col("_m")), F.lit(0.0)) for i in range(len(parts))]).alias("x"))


def gather(edges: DataFrame, nodes: DataFrame, end: str, name: str) -> DataFrame:
    """Edges with the vector of one end as column ``name``."""
    return edges.join(nodes.select("graph_id", F.col("node_id").alias(end), F.col("x").alias(name)), ["graph_id", end])


def spmm(edges: DataFrame, nodes: DataFrame, n: int, into: str = "src", universe: DataFrame | None = None) -> DataFrame:
    """A X (``into='src'``: rows receive) or A' X (``into='dst'``), for every node."""
    other = "dst" if into == "src" else "src"
    m = gather(edges, nodes, other, "_v")
    return scatter(m, into, [F.col("w") * F.col("_v")[i] for i in range(n)], nodes if universe is None else universe)


def spspmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w) of the product of two sparse matrices."""
    right = b.select("graph_id", F.col("src").alias("_k"), F.col("dst").alias("_d"), F.col("w").alias("_w"))
    left = a.select("graph_id", "src", F.col("dst").alias("_k"), "w")
    return left.join(right, ["graph_id", "_k"]).groupBy("graph_id", "src", F.col("_d").alias("dst")).agg(F.sum(F.col("w") * F.col("_w")).alias("w"))


def transpose(a: DataFrame) -> DataFrame:
    rest = [c for c in a.columns if c not in ("src", "dst")]
    return a.select(*rest, F.col("dst").alias("src"), F.col("src").alias("dst"))


def at_b_a(s: DataFrame, a: DataFrame) -> DataFrame:
    """S' A S for an assignment S with (graph_id, node_id, cluster, s)."""
    left = s.select("graph_id", F.col("node_id").alias("src"), F.col("cluster").alias("k"), F.col("s").alias("sk"))
    right = s.select("graph_id", F.col("node_id").alias("dst"), F.col("cluster").alias("l"), F.col("s").alias("sl"))
    joined = a.join(left, ["graph_id", "src"]).join(right, ["graph_id", "dst"])
    return joined.groupBy("graph_id", F.col("k").alias("src"), F.col("l").alias("dst")).agg(F.sum(F.col("sk") * F.col("w") * F.col("sl")).alias("w"))


def matrix_power(a: DataFrame, k: int) -> DataFrame:
    """k - 1 products from the left."""
    out = a.select("graph_id", "src", "dst", "w")
    for _ in range(k - 1):
        out = spspmm(a, out)
    return out


def segment_softmaxes(rows: DataFrame, key: str, scores: list[Column], alias: str = "alphas") -> DataFrame:
    """Softmax of several scores over the rows of each (graph, key) as one array; rows are made and sorted once, whatever their number."""
    n, segment_rows = range(len(scores)), Window.partitionBy("graph_id", key)
    scored = rows.where(F.col("graph_id").isNotNull() & F.col(key).isNotNull()).withColumns({f"_e{i}": s for i, s in enumerate(scores)})
    raised = scored.withColumns({f"_m{i}": F.max(f"_e{i}").over(segment_rows) for i in n}).withColumns({f"_e{i}": F.exp(F.col(f"_e{i}") - F.col(f"_m{i}")) for i in n})
    total = raised.withColumns({f"_z{i}": F.sum(f"_e{i}").over(segment_rows) for i in n})
    return total.withColumn(alias, V.vec([F.col(f"_e{i}") / (F.col(f"_z{i}") + 1e-9) for i in n])).drop(*[f"_{c}{i}" for c in "emz" for i in n])


def segment_softmax(edges: DataFrame, key: str, score: Column, name: str = "alpha") -> DataFrame:
    """exp(s - max) / (sum + 1e-9) over the rows of a key.

    Maximum and sum come from one pass over rows sorted by key: joining aggregates back makes the rows once for each
    of them.  A hub's rows, which such a join sends to one task as well, are buffered on disk where they are many.
    """
    found = segment_softmaxes(edges, key, [score], "_alphas")
    return found.withColumn(name, F.col("_alphas")[0]).drop("_alphas")


def segment_top_k(rows: DataFrame, score: Column, ratio: float) -> DataFrame:
    """The first ceil(ratio n) rows of each graph by score, ties to the smaller node_id, with ``rank`` from 1."""
    order = Window.partitionBy("graph_id").orderBy(score.desc(), "node_id")
    n = rows.groupBy("graph_id").agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(n, "graph_id")
    return ranked.where(F.col("rank") <= F.ceil(F.lit(float(ratio)).cast("float") * F.col("_n"))).drop("_n")


def renumbered(kept: DataFrame) -> DataFrame:
    """(graph_id, node_id, new_id): kept nodes numbered from 0 in the order of their ids."""
    return kept.select("graph_id", "node_id").withColumn("new_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")).cast("long") - 1)


def induced(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges between numbered nodes, under their new ids."""
    s = numbers.select("graph_id", F.col("node_id").alias("src"), F.col("new_id").alias("_s"))
    d = numbers.select("graph_id", F.col("node_id").alias("dst"), F.col("new_id").alias("_d"))
    rest = [c for c in edges.columns if c not in ("graph_id", "src", "dst")]
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)


def masked_axis(edges: DataFrame, numbers: DataFrame, axis: str) -> DataFrame:
    """Rows (``axis='src'``) or columns whose node is numbered, renumbered along that axis."""
    n = numbers.select("graph_id", F.col("node_id").alias(axis), F.col("new_id").alias("_i"))
    return edges.join(n, ["graph_id", axis]).drop(axis).withColumnRenamed("_i", axis).select(*edges.columns)


def indices_to_mask(universe: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """``universe`` with ``mask``: whether the row's ``keys`` (the node; more for masks of higher rank) are in ``kept``."""
    keys = keys or ("graph_id", "node_id")
    k = kept.select(*keys).distinct().withColumn("_k", F.lit(True))
    return universe.join(k, list(keys), "left").withColumn("mask", F.col("_k").isNotNull()).drop("_k")


def repeat(rows: DataFrame, times: Column, order: tuple[str, ...] = ("graph_id", "node_id")) -> DataFrame:
    """Every row ``times`` times (0: not at all), with ``copy`` from 0 and ``place``, its number in ``order``."""
    many = rows.withColumn("_t", times.cast("int")).where(F.col("_t") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    ends = rows.select(*order, times.cast("long").alias("_n")).withColumn("_end", F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return many.join(ends, list(order)).withColumn("place", F.col("_end") - F.col("_n") + F.col("copy")).drop("_t", "_n", "_end")


def reshape(edges: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """A matrix of ``columns`` columns with its cells, read row by row, laid out in ``new_columns`` columns."""
    cell = F.col("src") * columns + F.col("dst")
    out = edges.withColumn("_cell", cell).withColumn("src", F.floor(F.col("_cell") / new_columns)).withColumn("dst", F.pmod("_cell", F.lit(new_columns)))
    return out.drop("_cell")


def inner_product(nodes: DataFrame, n: int, kernel: V.Matrix | None = None, activation=None) -> DataFrame:
    """(graph_id, src, dst, w): X X' or X K X' within each graph."""
    left = V.items("x", n) if kernel is None else V.affine(V.items("x", n), kernel)
    a = nodes.select("graph_id", F.col("node_id").alias("src"), V.vec(left).alias("_a"))
    b = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("x").alias("_b"))
    w = V.dot(V.items("_a", len(left)), V.items("_b", len(left)))
    return a.join(b, "graph_id").select("graph_id", "src", "dst", V.activate([w], activation)[0].alias("w"))


def minkowski_product(nodes: DataFrame, n: int) -> DataFrame:
    """X diag(1, .., 1, -1) X' held in [-1e10, -1]."""
    a = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("x").alias("_a"))
    b = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("x").alias("_b"))
    terms = [x * y for x, y in zip(V.items("_a", n), V.items("_b", n), strict=True)]
    w = V.total([*terms[:-1], -terms[-1]])
    return a.join(b, "graph_id").select("graph_id", "src", "dst", F.greatest(F.lit(-1e10), F.least(F.lit(-1.0), w)).alias("w"))


def sparse_dropout(edges: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Drops edges by a hash of their ends; the others grow by 1 / (1 - rate)."""
    return edges.where(V.uniform(seed, "graph_id", "src", "dst") >= rate).withColumn("w", F.col("w") / (1 - rate))
