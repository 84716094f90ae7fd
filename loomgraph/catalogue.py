"""Query catalogue: every operator over the driver's tables, and its DuckDB twin.

Vectors come out as columns x0, x1, ..; doubles are rounded to six places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators import conv, filters, layouts, linalg, models, pool
from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet
from loomgraph.plans import file_queries
from loomgraph.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

W = V.dyadic


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _add_knn(name: str, make: Callable, sql: str | None = None) -> None:
    """A query over neighbours by whole embeddings."""
    _add(name, make(X.knn), sql)


def draw(seed: int, *keys: str) -> str:
    """The DuckDB form of ``vec.uniform``."""
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(keys)})), 1, 12))::BIGINT / {float(1 << 48)})"


def wide(rows: DataFrame, n: int, keys: tuple[str, ...] = ("graph_id", "node_id"), column: str = "x") -> DataFrame:
    return rows.select(*keys, *[F.round(F.col(column)[i], 6).alias(f"x{i}") for i in range(n)])


def coo(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "src", "dst", F.round("w", 6).alias("w"))


# -- SQL pieces -------------------------------------------------------------------------------------


def xs(n: int, p: str = "x", of: str = "") -> list[str]:
    return [f"{of}{p}{i}" for i in range(n)]


def lin(cols: list[str], w: list[list[float]]) -> list[str]:
    return ["(" + " + ".join(f"{c} * ({w[i][j]})" for i, c in enumerate(cols)) + ")" for j in range(len(w[0]))]


def named(exprs: list[str], p: str = "x") -> str:
    return ", ".join(f"{e} AS {p}{i}" for i, e in enumerate(exprs))


def rounded(n: int, of: str = "", p: str = "x") -> str:
    return ", ".join(f"round({of}{p}{i}, 6) AS x{i}" for i in range(n))


def act(e: str, name: str | None) -> str:
    return {
        None: e,
        "relu": f"greatest({e}, 0.0)",
        "sigmoid": f"(1 / (1 + exp(-({e}))))",
        "tanh": f"tanh({e})",
        "leaky": f"(CASE WHEN {e} > 0 THEN {e} ELSE 0.2 * ({e}) END)",
        "softplus": f"ln(1 + exp({e}))",
    }[name]


def softmax(cols: list[str]) -> list[str]:
    m = f"greatest({', '.join(cols)})"
    z = " + ".join(f"exp({c} - {m})" for c in cols)
    return [f"(exp({c} - {m}) / ({z}))" for c in cols]


def spmm(out: str, edges: str, src: str, n: int, into: str = "src", weight: str = "w", how: str = "sum", empty: str = "0.0", universe: str = "nodes") -> str:
    """A common table expression: rows of ``src`` gathered over edges, one row for every row of ``universe``."""
    other = "dst" if into == "src" else "src"
    inner = ", ".join(f"{how}({weight + ' * ' if weight else ''}v.x{i}) AS a{i}" for i in range(n))
    outer = ", ".join(f"coalesce(a{i}, {empty}) AS x{i}" for i in range(n))
    return f"""{out} AS (SELECT u.graph_id, u.node_id, {outer} FROM {universe} u LEFT JOIN
  (SELECT e.graph_id, e.{into} AS node_id, {inner} FROM {edges} e JOIN {src} v ON v.graph_id = e.graph_id AND v.node_id = e.{other} GROUP BY ALL) t
  ON t.graph_id = u.graph_id AND t.node_id = u.node_id)"""


def proj(out: str, src: str, exprs: list[str]) -> str:
    return f"{out} AS (SELECT graph_id, node_id, {named(exprs)} FROM {src})"


DEGREE = "deg AS (SELECT n.graph_id, n.node_id, coalesce(sum(e.w), 0.0) AS d FROM nodes n LEFT JOIN {edges} e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL)"


def deg(edges: str = "edges", name: str = "deg") -> str:
    return DEGREE.format(edges=edges).replace("deg AS", f"{name} AS", 1)


def norm(out: str, edges: str = "edges", d: str = "deg", sym: bool = True) -> str:
    f = lambda t: f"(CASE WHEN {t}.d = 0 THEN 0.0 ELSE power({t}.d, {-0.5 if sym else -1.0}) END)"
    right = f" * {f('b')}" if sym else ""
    return f"{out} AS (SELECT e.graph_id, e.src, e.dst, e.w * {f('a')}{right} AS w FROM {edges} e JOIN {d} a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN {d} b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"


def norm_eps(out: str, edges: str, d: str) -> str:
    return f"{out} AS (SELECT e.graph_id, e.src, e.dst, e.w / (sqrt(a.d) + 1e-7) / (sqrt(b.d) + 1e-7) AS w FROM {edges} e JOIN {d} a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN {d} b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"


EYE = "eye AS (SELECT graph_id, node_id AS src, node_id AS dst, 1.0::DOUBLE AS w FROM nodes)"
PLUS = "looped AS (SELECT graph_id, src, dst, sum(w) AS w FROM (SELECT graph_id, src, dst, w FROM edges UNION ALL SELECT * FROM eye) GROUP BY ALL)"
GCN = f"{EYE}, {PLUS}, {deg('looped', 'ldeg')}, {norm('ahat', 'looped', 'ldeg')}"
LAP = "lap AS (SELECT graph_id, src, dst, sum(w) AS w FROM (SELECT graph_id, node_id AS src, node_id AS dst, {diag} AS w FROM {of} UNION ALL SELECT graph_id, src, dst, -w FROM {a}) GROUP BY ALL HAVING sum(w) <> 0)"
NORMLAP = f"{deg()}, {norm('na')}, {LAP.format(diag='1.0::DOUBLE', of='nodes', a='na')}"
RESC = "resc AS (SELECT graph_id, src, dst, sum(w) AS w FROM (SELECT graph_id, src, dst, w * 1.0 AS w FROM lap UNION ALL SELECT graph_id, node_id, node_id, -1.0 FROM nodes) GROUP BY ALL HAVING sum(w) <> 0)"


def q(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def out_x(src: str, n: int) -> str:
    return f"SELECT graph_id, node_id, {rounded(n)} FROM {src}"


OUT_W = "SELECT graph_id, src, dst, round(w, 6) AS w FROM {}"

# -- flagship ------------------------------------------------------------------------------------------


def _gcn_trade(s: SparkSession, d: str) -> DataFrame:
    g = conv.preprocess("gcn", X.trade(s, d))
    h = conv.gcn_conv(g, 3, activation="relu").withColumn("graph_id", (F.col("node_id") >= X.PART).cast("long"))
    return wide(pool.global_avg(h, 3), 3, ("graph_id",))


_add("gcn_trade", _gcn_trade, q(X.TRADE, GCN, proj("p", "nodes", lin(xs(3), W(3, 3))), spmm("h", "ahat", "p", 3), select=f"SELECT (node_id >= {X.PART})::BIGINT AS graph_id, " + ", ".join(f"round(avg(greatest(x{i}, 0.0)), 6) AS x{i}" for i in range(3)) + " FROM h GROUP BY 1"))

# -- filters ---------------------------------------------------------------------------------------------


def _trade(f: Callable[[GraphSet], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(X.trade(s, d))


_D = lambda df: df.select("graph_id", "node_id", F.round("d", 6).alias("d"))
_add("degree", _trade(lambda g: _D(filters.degrees(g.edges, g.nodes))), q(X.TRADE, deg(), select="SELECT graph_id, node_id, round(d, 6) AS d FROM deg"))
_add("degree_power", _trade(lambda g: _D(filters.degree_power(g.edges, g.nodes, -0.5))), q(X.TRADE, deg(), select="SELECT graph_id, node_id, round(CASE WHEN d = 0 THEN 0.0 ELSE power(d, -0.5) END, 6) AS d FROM deg"))
def per_node(edges: DataFrame) -> DataFrame:
    """What a node's row of a matrix amounts to: cells, their sum, and a sum that tells columns apart."""
    sums = [F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w"), F.round(F.sum(F.col("w") * (F.col("dst") % 97)), 5).alias("mixed")]
    return edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(*sums)


PER_NODE = "SELECT graph_id, src AS node_id, count(*) AS n, round(sum(w), 6) AS w, round(sum(w * (dst % 97)), 5) AS mixed FROM {} GROUP BY ALL"
_add("norm_adj_sym", _trade(lambda g: per_node(filters.normalized_adjacency(g.edges, g.nodes))), q(X.TRADE, deg(), norm("na"), select=PER_NODE.format("na")))
_add("norm_adj_rw", _trade(lambda g: per_node(filters.normalized_adjacency(g.edges, g.nodes, False))), q(X.TRADE, deg(), norm("na", sym=False), select=PER_NODE.format("na")))
_add("normalize_a", _trade(lambda g: per_node(filters.normalize_a(g.edges, g.nodes))), q(X.TRADE, deg(), norm_eps("na", "edges", "deg"), select=PER_NODE.format("na")))
_add("laplacian", _trade(lambda g: coo(filters.laplacian(g.edges, g.nodes))), q(X.TRADE, deg(), LAP.format(diag="d", of="deg", a="edges"), select=OUT_W.format("lap")))
_add("norm_laplacian", _trade(lambda g: coo(filters.normalized_laplacian(g.edges, g.nodes))), q(X.TRADE, NORMLAP, select=OUT_W.format("lap")))
_add("rescale_laplacian_lmax2", _trade(lambda g: coo(filters.rescale_laplacian(filters.normalized_laplacian(g.edges, g.nodes), g.nodes, 2.0))), q(X.TRADE, NORMLAP, RESC, select=OUT_W.format("resc")))
_add("gcn_filter", _trade(lambda g: per_node(filters.gcn_filter(g.edges, g.nodes))), q(X.TRADE, GCN, select=PER_NODE.format("ahat")))
_add("self_loops_fill_missing", _trade(lambda g: coo(filters.fill_self_loops(g.edges, g.nodes))), q(X.TRADE, EYE, select="SELECT graph_id, src, dst, w FROM edges UNION ALL SELECT * FROM eye WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = eye.graph_id AND e.src = eye.src AND e.dst = eye.src)"))
_S = lambda f: lambda s, d: f(X.sessions(s, d)[0])
_add("self_loops_set", _S(lambda g: coo(filters.set_self_loops(g.edges, g.nodes, 2.0))), q(X.SESSIONS, select="SELECT graph_id, src, dst, w FROM edges WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id, 2.0 FROM nodes"))
_add("self_loops_add", _S(lambda g: coo(filters.plus_identity(g.edges, g.nodes))), q(X.SESSIONS, EYE, PLUS, select=OUT_W.format("looped")))
_add("self_loops_keep", _S(lambda g: coo(filters.fill_self_loops(g.edges, g.nodes))), q(X.SESSIONS, EYE, select="SELECT graph_id, src, dst, w FROM edges UNION ALL SELECT * FROM eye WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = eye.src AND e.dst = eye.src)"))
INC = "up AS (SELECT DISTINCT graph_id, src, dst FROM edges WHERE src <= dst), num AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS edge_id FROM up), inc AS (SELECT graph_id, src AS node_id, edge_id FROM num UNION SELECT graph_id, dst, edge_id FROM num)"
_add("incidence", lambda s, d: filters.incidence(X.orders(s, d).edges), q(X.ORDERS, INC, select="SELECT * FROM inc"))
_add("line_graph", lambda s, d: coo(filters.line_graph(filters.incidence(X.orders(s, d).edges))), q(X.ORDERS, INC, select="SELECT graph_id, src, dst, n - (CASE WHEN src = dst THEN 2 ELSE 0 END) AS w FROM (SELECT a.graph_id, a.edge_id AS src, b.edge_id AS dst, count(*)::DOUBLE AS n FROM inc a JOIN inc b USING (graph_id, node_id) GROUP BY ALL) WHERE n - (CASE WHEN src = dst THEN 2 ELSE 0 END) <> 0"))

# -- linear algebra --------------------------------------------------------------------------------------

MM = "mm AS (SELECT a.graph_id, a.src, b.dst, sum(a.w * b.w) AS w FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY ALL)"
_add("spmm", _S(lambda g: wide(linalg.spmm(g.edges, g.nodes, 2), 2)), q(X.SESSIONS, spmm("h", "edges", "nodes", 2), select=out_x("h", 2)))
_add("spspmm", _S(lambda g: coo(linalg.spspmm(g.edges, g.edges))), q(X.SESSIONS, MM, select=OUT_W.format("mm")))
_add("transpose", _S(lambda g: coo(linalg.transpose(g.edges))), q(X.SESSIONS, select="SELECT graph_id, dst AS src, src AS dst, w FROM edges"))
_add("matrix_power_3", _S(lambda g: coo(linalg.matrix_power(g.edges, 3))), q(X.SESSIONS, MM, select="SELECT a.graph_id, a.src, b.dst, round(sum(a.w * b.w), 6) AS w FROM edges a JOIN mm b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY ALL"))


def _atba(g: GraphSet) -> DataFrame:
    s = g.nodes.select("graph_id", "node_id", (F.col("node_id") % 2).alias("cluster"), (F.col("node_id") + 1.0).alias("s"))
    return coo(linalg.at_b_a(s, g.edges))


_add("at_b_a", _S(_atba), q(X.SESSIONS, select="SELECT graph_id, src % 2 AS src, dst % 2 AS dst, round(sum((src + 1.0) * w * (dst + 1.0)), 6) AS w FROM edges GROUP BY ALL"))
CH = "ta AS (SELECT a.graph_id, a.src, b.dst, 2 * sum(a.w * b.w) AS w FROM resc a JOIN resc b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY ALL), t2 AS (SELECT graph_id, src, dst, sum(w) AS w FROM (SELECT * FROM ta UNION ALL SELECT graph_id, node_id, node_id, -1.0 FROM nodes) GROUP BY ALL)"
_add("cheb_poly_k2", _S(lambda g: coo(filters.chebyshev_filter(g.edges, g.nodes, 2, lmax=2.0)[2])), q(X.SESSIONS, NORMLAP, RESC, CH, select="SELECT graph_id, src, dst, round(w, 6) AS w FROM t2 WHERE w <> 0"))


def _universe(s: SparkSession, d: str) -> DataFrame:
    """Orders as one node each, those without lines too."""
    return X.table(s, d, "orders").select(F.lit(0).cast("long").alias("graph_id"), F.col("o_orderkey").alias("node_id"))


def _scatter(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = X.table(s, d, "lineitem").select(F.lit(0).cast("long").alias("graph_id"), F.col("l_orderkey").alias("dst"), (F.col("l_quantity") / 64 if how == "prod" else F.col("l_quantity")).alias("v"))
        return wide(linalg.scatter(m, "dst", [F.col("v")], _universe(s, d), how), 1)

    return run


for _how, _f, _empty in (("sum", "sum", "0"), ("mean", "avg", "0"), ("max", "max", str(linalg.LOWEST)), ("min", "min", str(linalg.HIGHEST)), ("prod", "product", "1")):
    _v = "l_quantity / 64" if _how == "prod" else "l_quantity"
    _add(f"scatter_{_how}", _scatter(_how), f"SELECT 0 AS graph_id, o_orderkey AS node_id, round(coalesce(v, {_empty}), 6) AS x0 FROM orders LEFT JOIN (SELECT l_orderkey, {_f}({_v}) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")


def _seg_softmax(g: GraphSet) -> DataFrame:
    return linalg.segment_softmax(g.edges, "dst", F.col("e")[0]).select("graph_id", "src", "dst", F.round("alpha", 6).alias("alpha"))


_add_knn("segment_softmax", lambda x: lambda s, d: _seg_softmax(x(s, d)), q(X.KNN, select="SELECT graph_id, src, dst, round(exp(e0 - m) / (sum(exp(e0 - m)) OVER (PARTITION BY graph_id, dst) + 1e-9), 6) AS alpha FROM (SELECT *, max(e0) OVER (PARTITION BY graph_id, dst) AS m FROM edges)"))
_add("segment_topk", lambda s, d: linalg.segment_top_k(X.orders(s, d).nodes, F.col("x")[0], 0.5).select("graph_id", "node_id", F.col("rank").cast("long").alias("rank")), q(X.ORDERS, select="SELECT graph_id, node_id, rank FROM (SELECT n.graph_id, node_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY x0 DESC, node_id) AS rank, n FROM nodes n JOIN sizes USING (graph_id)) WHERE rank <= ceil(0.5 * n)"))


def _even(g: GraphSet) -> DataFrame:
    return linalg.renumbered(g.nodes.where("node_id % 2 = 0"))


NUM = "num AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS new_id FROM nodes WHERE node_id % 2 = 0)"
_add("mask_square", _trade(lambda g: coo(linalg.induced(g.edges, _even(g)))), q(X.TRADE, NUM, select="SELECT e.graph_id, a.new_id AS src, b.new_id AS dst, w FROM edges e JOIN num a ON a.node_id = e.src JOIN num b ON b.node_id = e.dst"))
_add("mask_axis", _trade(lambda g: coo(linalg.masked_axis(g.edges, _even(g), "src"))), q(X.TRADE, NUM, select="SELECT e.graph_id, a.new_id AS src, e.dst, w FROM edges e JOIN num a ON a.node_id = e.src"))
_add("gather_square", _S(lambda g: coo(linalg.induced(g.edges, g.nodes.select("graph_id", "node_id", (4 - F.col("node_id")).alias("new_id"))))), q(X.SESSIONS, select="SELECT graph_id, 4 - src AS src, 4 - dst AS dst, w FROM edges"))
_add("indices_to_mask", _S(lambda g: linalg.indices_to_mask(g.nodes.select("graph_id", "node_id"), g.nodes.where("node_id IN (1, 3)"))), q(X.SESSIONS, select="SELECT graph_id, node_id, node_id IN (1, 3) AS mask FROM nodes"))
_DOT = " + ".join(f"a.x{i} * b.x{i}" for i in range(3))
_add("inner_product", lambda s, d: coo(linalg.inner_product(X.vectors(s, d), 3)), q(X.KNN, select=f"SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, round({_DOT}, 6) AS w FROM nodes a JOIN nodes b USING (graph_id)"))
_add("minkowski_product", lambda s, d: coo(linalg.minkowski_product(X.vectors(s, d), 3)), q(X.KNN, select="SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, round(greatest(-1e10, least(-1.0, a.x0 * b.x0 + a.x1 * b.x1 - a.x2 * b.x2)), 6) AS w FROM nodes a JOIN nodes b USING (graph_id)"))

# -- building edges ------------------------------------------------------------------------------------------

_add_knn("knn_graph", lambda x: lambda s, d: x(s, d).edges.select("graph_id", "src", "dst", F.round(F.col("e")[0], 6).alias("d2")), q(X.KNN, select="SELECT graph_id, src, dst, round(e0, 6) AS d2 FROM edges"))
_add_knn("symmetrize_clip", lambda x: lambda s, d: coo(T.symmetrised(x(s, d).edges)), q(X.KNN, select="SELECT graph_id, src, dst, 1.0::DOUBLE AS w FROM edges UNION SELECT graph_id, dst, src, 1.0 FROM edges"))


def _reordered(g: GraphSet) -> DataFrame:
    """The rows numbered as they come out of the operator."""
    placed = coo(T.reordered(g.edges)).withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


_add("edge_reorder", _S(_reordered), q(X.SESSIONS, select="SELECT graph_id, src, dst, w, row_number() OVER (ORDER BY graph_id, src, dst) AS place FROM edges"))
_add("coo_dedup", lambda s, d: coo(filters.summed(X.table(s, d, "lineitem").select(F.lit(0).cast("long").alias("graph_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w")))), "SELECT 0 AS graph_id, l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0")

# -- transforms ------------------------------------------------------------------------------------------------

_K = lambda f: lambda x: lambda s, d: f(x(s, d))
_add("t_constant", _S(lambda g: wide(T.constant(g, 7.0).nodes, 3)), q(X.SESSIONS, select="SELECT graph_id, node_id, x0, x1, 7.0::DOUBLE AS x2 FROM nodes"))
_add("t_degree_onehot", lambda s, d: wide(T.degree_one_hot(X.orders(s, d), 2).nodes, 5), q(X.ORDERS, deg(), select="SELECT graph_id, node_id, x0, x1, (d = 0)::INT::DOUBLE AS x2, (d = 1)::INT::DOUBLE AS x3, (d = 2)::INT::DOUBLE AS x4 FROM nodes JOIN deg USING (graph_id, node_id)"))
_add("t_max_degree", lambda s, d: T.max_degree(X.orders(s, d)), q(X.ORDERS, deg(), select="SELECT graph_id, max(d) AS max_degree FROM deg GROUP BY 1"))
UND = "u AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), both_ AS (SELECT graph_id, a, b FROM u UNION ALL SELECT graph_id, b, a FROM u), k AS (SELECT graph_id, a AS node_id, count(*) AS k FROM both_ GROUP BY ALL), tri AS (SELECT x.graph_id, x.a AS node_id, count(*) / 2 AS t FROM both_ x JOIN both_ y ON y.graph_id = x.graph_id AND y.a = x.a AND x.b <> y.b JOIN both_ z ON z.graph_id = x.graph_id AND z.a = x.b AND z.b = y.b GROUP BY ALL)"
_add_knn("t_clustering_coeff", _K(lambda g: wide(T.clustering_coefficient(g).nodes, 4)), q(X.KNN, UND, select="SELECT n.graph_id, n.node_id, x0, x1, x2, round(CASE WHEN coalesce(k.k, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (k.k * (k.k - 1)) END, 6) AS x3 FROM nodes n LEFT JOIN k USING (graph_id, node_id) LEFT JOIN tri USING (graph_id, node_id)"))
_add("t_normalize_one", _trade(lambda g: wide(T.normalize_one(g).nodes, 3)), q(X.TRADE, select="SELECT graph_id, node_id, " + ", ".join(f"round(x{i} / (CASE WHEN x0 + x1 + x2 = 0 THEN 1.0 ELSE x0 + x1 + x2 END), 6) AS x{i}" for i in range(3)) + " FROM nodes"))
_add("t_normalize_sphere", lambda s, d: wide(T.normalize_sphere(X.orders(s, d)).nodes, 2), q(X.ORDERS, select="SELECT graph_id, node_id, " + ", ".join(f"round((x{i} - avg(x{i}) OVER g) / max(greatest(abs(x0), abs(x1))) OVER g, 6) AS x{i}" for i in range(2)) + " FROM nodes WINDOW g AS (PARTITION BY graph_id)"))
_add("t_one_hot_labels", lambda s, d: wide(T.one_hot_labels(X.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("graph_id"), F.col("r_name").alias("l")), F.col("l"), labels=["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]), 5, ("graph_id",), "y"), "SELECT r_regionkey::BIGINT AS graph_id, " + ", ".join(f"(r_name = '{v}')::INT::DOUBLE AS x{i}" for i, v in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])) + " FROM region")
_add_knn("t_gcn_filter", _K(lambda g: coo(T.gcn_filter(g).edges)), q(X.KNN, GCN, select=OUT_W.format("ahat")))
_add_knn("t_normalize_adj", _K(lambda g: coo(T.normalize_adj(g).edges)), q(X.KNN, deg(), norm("na"), select=OUT_W.format("na")))
_add("t_sgc_filter", _S(lambda g: coo(T.sgc_filter(g, 2).edges)), q(X.SESSIONS, MM, select=OUT_W.format("mm")))
_add_knn("t_laplacian_pe", lambda x: lambda s, d: (lambda g: wide(T.laplacian_pe(g.with_edges(T.symmetrised(g.edges)), 2).nodes, 4))(x(s, d, 2)))
_add("t_delaunay", lambda s, d: coo(T.delaunay(X.points(s, d)).edges))

# -- collections ---------------------------------------------------------------------------------------------------

_O = lambda f: lambda s, d: f(X.orders(s, d))
_add("ds_counts", _O(lambda g: g.counts()), q(X.ORDERS, select="SELECT graph_id, n AS n_nodes, 2 * (n - 1) AS n_edges FROM sizes"))
_add("ds_map_reduce", _O(lambda g: g.map(T.max_degree, F.max("max_degree").alias("top"))), q(X.ORDERS, deg(), select="SELECT max(d) AS top FROM deg"))
_add("ds_filter", _O(lambda g: g.filter(lambda h: h.counts().where("n_nodes >= 5")).nodes.groupBy("graph_id").agg(F.count("*").alias("n"))), q(X.ORDERS, select="SELECT graph_id, n FROM sizes WHERE n >= 5"))
_add("ds_concat", lambda s, d: (lambda g: g.concat(g).counts())(X.orders(s, d)), q(X.ORDERS, select="SELECT graph_id + o AS graph_id, n AS n_nodes, 2 * (n - 1) AS n_edges FROM sizes, (SELECT 0 AS o UNION ALL SELECT max(o_orderkey) + 1 FROM orders)"))
_add("ds_index", lambda s, d: X.turns(s, d).take_ids([3, 1, 3, 0]).counts(), q(X.TURNS, select="SELECT k AS graph_id, n AS n_nodes, 2 * (n - 1) AS n_edges FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) JOIN (VALUES (0::BIGINT, 3), (1, 1), (2, 3), (3, 0)) t(k, g) ON g = graph_id"))
_add("ds_slice", lambda s, d: X.turns(s, d).between(10, 20).counts(), q(X.TURNS, select="SELECT graph_id, count(*) AS n_nodes, 2 * (count(*) - 1) AS n_edges FROM nodes WHERE graph_id >= 10 AND graph_id < 20 GROUP BY 1"))


def _split(s: SparkSession, d: str) -> DataFrame:
    a, b = X.orders(s, d).split(0.8)
    return a.counts().withColumn("first", F.lit(True)).unionByName(b.counts().withColumn("first", F.lit(False)))


_add("ds_split", _split, q(X.ORDERS, select=f"SELECT graph_id, n AS n_nodes, 2 * (n - 1) AS n_edges, {draw(0, 'graph_id')} < 0.8 AS first FROM sizes"))

# -- layouts ---------------------------------------------------------------------------------------------------------

OFF = "off_ AS (SELECT graph_id, n, sum(n) OVER (ORDER BY graph_id) - n AS o FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1))"
_add("disjoint_layout", lambda s, d: coo(layouts.disjoint(X.turns(s, d)).edges), q(X.TURNS, OFF, select="SELECT e.graph_id, src + o AS src, dst + o AS dst, w FROM edges e JOIN off_ USING (graph_id)"))
FRAME = "frame AS (SELECT graph_id, unnest(range((SELECT max(n) FROM (SELECT count(*) AS n FROM nodes GROUP BY graph_id)))) AS pos FROM (SELECT DISTINCT graph_id FROM nodes))"
_PADSQL = q(X.TURNS, FRAME, select="SELECT f.graph_id, f.pos, coalesce(x0, 0.0) AS x0, coalesce(x1, 0.0) AS x1{} FROM frame f LEFT JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.pos")
_add("batch_pad", lambda s, d: wide(layouts.padded_nodes(X.turns(s, d)), 2, ("graph_id", "pos")), _PADSQL.format(""))
_add("batch_mask", lambda s, d: wide(layouts.padded_nodes(X.turns(s, d), True), 3, ("graph_id", "pos")), _PADSQL.format(", (n.node_id IS NOT NULL)::INT::DOUBLE AS x2"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    g = X.turns(s, d)
    largest = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return wide(layouts.padded_nodes(g, n_max=largest), 2, ("graph_id", "pos"))


_add("packed_pad", _packed, q(X.TURNS, FRAME, select="SELECT f.graph_id, f.pos, coalesce(x0, 0.0) AS x0, coalesce(x1, 0.0) AS x1 FROM frame f LEFT JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.pos"))
_add("batch_adjacency", lambda s, d: layouts.padded_adjacency(X.turns(s, d)), q(X.TURNS, select="SELECT graph_id, src AS i, dst AS j, w FROM edges"))
_add("mixed_layout", lambda s, d: (lambda g: wide(layouts.mixed(g[1], g[0].edges, 2), 2))(X.sessions(s, d)), q(X.SESSIONS, select="SELECT s.graph_id, e.src AS node_id, sum(e.w * s.x0) AS x0, sum(e.w * s.x1) AS x1 FROM edges e JOIN signals s ON s.node_id = e.dst GROUP BY ALL"))
_add("loader_batches", _O(lambda g: layouts.batches(g.nodes.select("graph_id").distinct(), 32, 2)), q(X.ORDERS, select="SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY graph_id) - 1) // 32 AS batch_id, graph_id FROM sizes, (VALUES (0), (1)) t(epoch)"))

# -- matrix convolutions ------------------------------------------------------------------------------------------------

NA = f"{deg()}, {norm('na')}"


def _conv(name: str, f: Callable[[GraphSet], DataFrame], n: int, fixture: Callable = X.trade) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: wide(f(conv.preprocess(name, fixture(s, d))), n)


def _add2(cols: list[str], others: list[str]) -> list[str]:
    return [f"({a} + {b})" for a, b in zip(cols, others, strict=True)]


JOIN2 = "(SELECT a.graph_id, a.node_id, {xa}, {xb} FROM {a} a JOIN {b} b USING (graph_id, node_id))"


def both(a: str, b: str, n: int, m: int) -> str:
    return JOIN2.format(a=a, b=b, xa=", ".join(f"a.x{i}" for i in range(n)), xb=", ".join(f"b.x{i} AS y{i}" for i in range(m)))


_add("conv_gcn", _conv("gcn", lambda g: conv.gcn_conv(g, 2, activation="relu"), 2), q(X.TRADE, GCN, proj("p", "nodes", lin(xs(3), W(3, 2))), spmm("h", "ahat", "p", 2), proj("r", "h", [act(c, "relu") for c in xs(2)]), select=out_x("r", 2)))
_add("conv_gcs", _conv("gcs", lambda g: conv.gcs_conv(g, 2, activation="relu"), 2), q(X.TRADE, NA, proj("p", "nodes", lin(xs(3), W(3, 2))), spmm("h", "na", "p", 2), proj("k", "nodes", lin(xs(3), W(3, 2, 1))), proj("r", both("h", "k", 2, 2), [act(c, "relu") for c in _add2(xs(2), xs(2, "y"))]), select=out_x("r", 2)))
_CHEB = lambda g: conv.cheb_conv(g.with_edges(filters.rescale_laplacian(filters.normalized_laplacian(g.edges, g.nodes), g.nodes, 2.0)), 2, 3)
_add("conv_cheb", lambda s, d: wide(_CHEB(X.trade(s, d)), 2), q(X.TRADE, NORMLAP, RESC, spmm("t1", "resc", "nodes", 3), spmm("lt", "resc", "t1", 3), proj("t2", both("lt", "nodes", 3, 3), [f"(2 * x{i} - y{i})" for i in range(3)]), proj("a", "nodes", lin(xs(3), W(3, 2, 0))), proj("b", "t1", lin(xs(3), W(3, 2, 1))), proj("c", "t2", lin(xs(3), W(3, 2, 2))), select="SELECT graph_id, node_id, round(a.x0 + b.x0 + c.x0, 6) AS x0, round(a.x1 + b.x1 + c.x1, 6) AS x1 FROM a JOIN b USING (graph_id, node_id) JOIN c USING (graph_id, node_id)"))


def _arma_sql() -> str:
    parts = [X.TRADE, NA]
    for k in range(2):
        parts += [proj(f"v{k}", "nodes", lin(xs(3), W(3, 2, 5 * k))), spmm(f"h{k}", "na", f"v{k}", 2), proj(f"w{k}", "nodes", lin(xs(3), W(3, 2, 5 * k + 1))), proj(f"s{k}", both(f"h{k}", f"w{k}", 2, 2), [act(c, "relu") for c in _add2(xs(2), xs(2, "y"))])]
    return q(*parts, select="SELECT graph_id, node_id, round((a.x0 + b.x0) / 2, 6) AS x0, round((a.x1 + b.x1) / 2, 6) AS x1 FROM s0 a JOIN s1 b USING (graph_id, node_id)")


_add("conv_arma", _conv("arma", lambda g: conv.arma_conv(g, 2, order=2), 2), _arma_sql())
_add("conv_appnp", _conv("appnp", lambda g: conv.appnp_conv(g, 2, 0.25, 2), 2), q(X.TRADE, GCN, proj("z0", "nodes", lin(xs(3), W(3, 2))), spmm("p1", "ahat", "z0", 2), proj("z1", both("p1", "z0", 2, 2), [f"(0.75 * x{i} + 0.25 * y{i})" for i in range(2)]), spmm("p2", "ahat", "z1", 2), proj("z2", both("p2", "z0", 2, 2), [f"(0.75 * x{i} + 0.25 * y{i})" for i in range(2)]), select=out_x("z2", 2)))
_add("conv_tag", _conv("tag", lambda g: conv.tag_conv(g, 2, 2), 2), q(X.TRADE, NA, spmm("h", "na", "nodes", 3, "dst"), proj("r", both("nodes", "h", 3, 3), lin(xs(3) + xs(3, "y") * 2, W(9, 2))), select=out_x("r", 2)))
_GTVW = "gw AS (SELECT e.graph_id, e.src, e.dst, e.w / greatest(abs(a.x0 - b.x0) + abs(a.x1 - b.x1), 0.001) AS w FROM edges e JOIN p a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN p b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"
_add("conv_gtv", lambda s, d: wide(conv.gtv_conv(X.turns(s, d), 2), 2), q(X.TURNS, proj("p", "nodes", lin(xs(2), W(2, 2))), _GTVW, deg("gw", "gd"), spmm("h", "gw", "p", 2), select="SELECT p.graph_id, p.node_id, " + ", ".join(f"round(p.x{i} - (gd.d * p.x{i} - h.x{i}), 6) AS x{i}" for i in range(2)) + " FROM p JOIN gd USING (graph_id, node_id) JOIN h USING (graph_id, node_id)"))
_TH = [[((5 * i + 3 * c) % 7 - 3) / 16 for i in range(3)] for c in range(2)]
_add("conv_diffusion", _conv("diffusion", lambda g: conv.diffusion_conv(g, 2, 2, activation=None), 2, X.turns), q(X.TURNS, NA, "v AS (SELECT graph_id, node_id, x0 + x1 AS s FROM nodes)", "m AS (SELECT e.graph_id, e.src AS node_id, " + ", ".join(f"sum((({_TH[c][0]}) * w * w + ({_TH[c][1]}) * w) * s) AS y{c}" for c in range(2)) + " FROM na e JOIN v ON v.graph_id = e.graph_id AND v.node_id = e.dst GROUP BY ALL)", "t AS (SELECT graph_id, sum(s) AS s FROM v GROUP BY 1)", select="SELECT v.graph_id, v.node_id, " + ", ".join(f"round(coalesce(y{c}, 0.0) + ({_TH[c][2]}) * t.s, 6) AS x{c}" for c in range(2)) + " FROM v JOIN t USING (graph_id) LEFT JOIN m USING (graph_id, node_id)"))

# -- message convolutions --------------------------------------------------------------------------------------------------

PAIR = "pr AS (SELECT e.graph_id, e.src, e.dst, e.e0, " + ", ".join(f"s.x{i} AS s{i}, t.x{i} AS t{i}" for i in range(3)) + " FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.dst)"


def gathered(out: str, exprs: list[str], src: str = "pr", how: str = "sum") -> str:
    n = len(exprs)
    return f"{out} AS (SELECT u.graph_id, u.node_id, " + ", ".join(f"coalesce(a{i}, 0.0) AS x{i}" for i in range(n)) + " FROM nodes u LEFT JOIN (SELECT graph_id, dst AS node_id, " + ", ".join(f"{how}({e}) AS a{i}" for i, e in enumerate(exprs)) + f" FROM {src} GROUP BY ALL) t USING (graph_id, node_id))"


def l2(cols: list[str]) -> str:
    return f"sqrt(greatest({' + '.join(f'{c} * {c}' for c in cols)}, 1e-12))"


_add_knn("conv_message_passing", lambda x: lambda s, d: wide(conv.message_passing(x(s, d)), 3), q(X.KNN, PAIR, gathered("h", xs(3, "s")), select=out_x("h", 3)))
_SAGE = lin(xs(3) + xs(3, "y"), W(6, 2))
_add_knn("conv_sage", lambda x: _conv("sage", lambda g: conv.sage_conv(g, 2, activation="relu"), 2, x), q(X.KNN, "le AS (SELECT graph_id, src, dst, w FROM edges UNION ALL SELECT graph_id, node_id, node_id, 1.0 FROM nodes)", spmm("h", "le", "nodes", 3, "dst", "", "avg"), proj("z", both("nodes", "h", 3, 3), _SAGE), proj("r", "z", [f"greatest(x{i} / {l2(xs(2))}, 0.0)" for i in range(2)]), select=out_x("r", 2)))
_add_knn("conv_gin", lambda x: _conv("gin", lambda g: conv.gin_conv(g, 2, 0.5, activation="relu"), 2, x), q(X.KNN, PAIR, gathered("h", xs(3, "s")), proj("r", both("nodes", "h", 3, 3), [act(c, "relu") for c in lin([f"(1.5 * x{i} + y{i})" for i in range(3)], W(3, 2))]), select=out_x("r", 2)))
_add_knn("conv_gin_batch", lambda x: _conv("gin_batch", lambda g: conv.gin_conv_batch(g, 2, 0.5, activation="relu"), 2, x), q(X.KNN, spmm("h", "edges", "nodes", 3), proj("r", both("nodes", "h", 3, 3), [act(c, "relu") for c in lin([f"(1.5 * x{i} + y{i})" for i in range(3)], W(3, 2))]), select=out_x("r", 2)))
_add_knn("conv_edge", lambda x: _conv("edge", lambda g: conv.edge_conv(g, 2, activation="relu", aggregate="max"), 2, x), q(X.KNN, PAIR, gathered("h", [act(c, "relu") for c in lin(xs(3, "t") + [f"(s{i} - t{i})" for i in range(3)], W(6, 2))], how="max").replace("0.0) AS x", f"{linalg.LOWEST}) AS x"), select=out_x("h", 2)))
_Z = xs(3, "t") + xs(3, "s") + ["e0"]
_add_knn("conv_crystal", lambda x: _conv("crystal", lambda g: conv.crystal_conv(g), 3, x), q(X.KNN, PAIR, gathered("h", [f"{act(a, 'sigmoid')} * {act(b, 'softplus')}" for a, b in zip(lin(_Z, W(7, 3, 0)), lin(_Z, W(7, 3, 1)), strict=True)]), proj("r", both("nodes", "h", 3, 3), _add2(xs(3), xs(3, "y"))), select=out_x("r", 3)))
_COS = f"({' + '.join(f's{i} * t{i}' for i in range(3))}) / {l2(xs(3, 's'))} / {l2(xs(3, 't'))}"


def weighed(score: str, src: str = "pr", out: str = "wt") -> str:
    return f"{out} AS (SELECT *, exp(sc - m) / (sum(exp(sc - m)) OVER (PARTITION BY graph_id, dst) + 1e-9) AS alpha FROM (SELECT *, max(sc) OVER (PARTITION BY graph_id, dst) AS m FROM (SELECT *, {score} AS sc FROM {src})))"


_add_knn("conv_agnn", lambda x: _conv("agnn", lambda g: conv.agnn_conv(g), 3, x), q(X.KNN, PAIR, weighed(_COS), gathered("h", [f"alpha * s{i}" for i in range(3)], "wt"), select=out_x("h", 3)))


def _gat_sql(select: str) -> str:
    parts = [X.KNN, "le AS (SELECT graph_id, src, dst FROM edges UNION ALL SELECT graph_id, node_id, node_id FROM nodes)"]
    for h in range(2):
        a, b = ([r[0] for r in W(2, 1, 3 * h + i)] for i in (1, 2))
        score = act("(" + " + ".join([f"t{i} * ({a[i]})" for i in range(2)] + [f"s{i} * ({b[i]})" for i in range(2)]) + ")", "leaky")
        parts += [proj(f"p{h}", "nodes", lin(xs(3), W(3, 2, 3 * h))), f"g{h} AS (SELECT e.graph_id, e.src, e.dst, " + ", ".join(f"s.x{i} AS s{i}, t.x{i} AS t{i}" for i in range(2)) + f" FROM le e JOIN p{h} s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN p{h} t ON t.graph_id = e.graph_id AND t.node_id = e.dst)", weighed(score, f"g{h}", f"w{h}"), gathered(f"h{h}", [f"alpha * s{i}" for i in range(2)], f"w{h}")]
    return q(*parts, select=select)


_add_knn("conv_gat", lambda x: _conv("gat", lambda g: conv.gat_conv(g, 2, 2), 4, x), _gat_sql("SELECT graph_id, node_id, round(a.x0, 6) AS x0, round(a.x1, 6) AS x1, round(b.x0, 6) AS x2, round(b.x1, 6) AS x3 FROM h0 a JOIN h1 b USING (graph_id, node_id)"))
_PRELU = lambda c: f"greatest({c}, 0.0)"
_add_knn("conv_general", lambda x: _conv("general", lambda g: conv.general_conv(g, 2), 2, x), q(X.KNN, PAIR, gathered("h", [_PRELU(c) for c in lin(xs(3, "s"), W(3, 2))]), select=out_x("h", 2)))
_ECCK = W(1, 6)
_add_knn("conv_ecc", lambda x: _conv("ecc", lambda g: conv.ecc_conv(g, 2), 2, x), q(X.KNN, PAIR, gathered("h", [" + ".join(f"s{i} * e0 * ({_ECCK[0][i * 2 + j]})" for i in range(3)) for j in range(2)]), proj("r", both("h", "nodes", 2, 3), _add2(xs(2), lin(xs(3, "y"), W(3, 2, 1)))), select=out_x("r", 2)))


def _gated_sql(c: int = 3, layers: int = 2) -> str:
    parts = [X.TURNS, "h0 AS (SELECT graph_id, node_id, x0, x1, 0.0::DOUBLE AS x2 FROM nodes)"]
    for k in range(layers):
        gate = [(lin(xs(c), W(c, c, 20 + i)), lin(xs(c, "y"), W(c, c, 30 + i))) for i in range(3)]
        z, r = ([act(f"({a} + {b})", "sigmoid") for a, b in zip(*gate[i], strict=True)] for i in (0, 1))
        new = [f"tanh({a} + {g} * {b})" for a, b, g in zip(*gate[2], r, strict=True)]
        parts += [proj(f"p{k}", f"h{k}", lin(xs(c), W(c, c, k))), spmm(f"m{k}", "edges", f"p{k}", c, "dst", "")]
        parts += [proj(f"h{k + 1}", both(f"m{k}", f"h{k}", c, c), [f"({u} * y{i} + (1 - {u}) * {v})" for i, (u, v) in enumerate(zip(z, new, strict=True))])]
    return q(*parts, select=out_x(f"h{layers}", c))


_add("conv_gated", lambda s, d: wide(conv.gated_conv(X.turns(s, d), 3, 2), 3), _gated_sql())
_XEIN = [f"s.x{i}" for i in range(2)] + [f"t.x{i}" for i in range(2)] + ["e.e0", "e.e1"] + [f"coalesce(r.e{i}, 0.0)" for i in range(2)]
_XEK = "k AS (SELECT e.graph_id, e.src, e.dst, " + ", ".join(f"greatest({c}, 0.0) AS k{i}" for i, c in enumerate(lin(_XEIN, W(8, 3)))) + " FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.dst LEFT JOIN edges r ON r.graph_id = e.graph_id AND r.src = e.dst AND r.dst = e.src)"


def _xenet_sum(out: str, into: str, layer: int) -> str:
    gate = act(lin(xs(3, "k"), W(3, 1, layer))[0], "sigmoid")
    sums = ", ".join(f"sum({gate} * k{i}) AS a{i}" for i in range(3))
    return f"{out} AS (SELECT u.graph_id, u.node_id, " + ", ".join(f"coalesce(a{i}, 0.0) AS x{i}" for i in range(3)) + f" FROM nodes u LEFT JOIN (SELECT graph_id, {into} AS node_id, {sums} FROM k GROUP BY ALL) t USING (graph_id, node_id))"


_XEOUT = lin(xs(2, "n.x") + xs(3, "i.x") + xs(3, "o.x"), W(8, 2, 3))
_add("conv_xenet", lambda s, d: wide(conv.xenet_conv(X.turns(s, d), 3, 2, 2)[0], 2), q(X.TURNS, _XEK, _xenet_sum("i", "dst", 1), _xenet_sum("o", "src", 2), select="SELECT n.graph_id, n.node_id, " + ", ".join(f"round({c}, 6) AS x{j}" for j, c in enumerate(_XEOUT)) + " FROM nodes n JOIN i USING (graph_id, node_id) JOIN o USING (graph_id, node_id)"))
_add("conv_xenet_edges", lambda s, d: conv.xenet_conv(X.turns(s, d), 3, 2, 2)[1].select("graph_id", "src", "dst", F.round(F.col("e")[0], 6).alias("x0"), F.round(F.col("e")[1], 6).alias("x1")), q(X.TURNS, _XEK, select="SELECT graph_id, src, dst, " + ", ".join(f"round({c}, 6) AS x{j}" for j, c in enumerate(lin(xs(3, "k"), W(3, 2, 4)))) + " FROM k"))


def _censnet(which: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        g = X.turns(s, d)
        upper = g.edges.where("src < dst").withColumn("node_id", F.col("src"))
        return wide(conv.censnet_conv(g, upper.select("graph_id", "node_id", F.col("e").alias("x")), 2, 2)[which], 2)

    return run


def _censnet_sql(nodes_out: bool) -> str:
    line_ = "lg AS (SELECT graph_id, src, dst, n - (CASE WHEN src = dst THEN 2 ELSE 0 END) AS w FROM (SELECT a.graph_id, a.edge_id AS src, b.edge_id AS dst, count(*)::DOUBLE AS n FROM inc a JOIN inc b USING (graph_id, node_id) GROUP BY ALL) WHERE n - (CASE WHEN src = dst THEN 2 ELSE 0 END) <> 0)"
    parts = [X.TURNS, INC, line_, "en AS (SELECT graph_id, src AS node_id, e0 AS x0, e1 AS x1 FROM edges WHERE src < dst)"]
    a, b, own, other, edges, layer = ("node_id", "edge_id", "nodes", "en", "edges", 0) if nodes_out else ("edge_id", "node_id", "en", "nodes", "lg", 5)
    parts += [f"fe AS (SELECT graph_id, src, dst, w FROM {edges} WHERE src <> dst OR {not nodes_out} UNION ALL SELECT graph_id, node_id, node_id, 1.0 FROM {own})", "fl AS (SELECT graph_id, src, dst, sum(w) AS w FROM fe GROUP BY ALL)"]
    parts += [f"fd AS (SELECT n.graph_id, n.node_id, coalesce(sum(e.w), 0.0) AS d FROM {own} n LEFT JOIN fl e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL)", norm("lap", "fl", "fd")]
    parts += [f"wt AS (SELECT graph_id, node_id AS k, {lin(xs(2), W(2, 1, layer))[0]} AS p FROM {other})"]
    parts += [f"cells AS (SELECT x.graph_id, x.{a} AS src, y.{a} AS dst, sum(p) AS c FROM inc x JOIN inc y ON x.graph_id = y.graph_id AND x.{b} = y.{b} JOIN wt ON wt.graph_id = x.graph_id AND wt.k = x.{b} GROUP BY ALL)"]
    parts += ["jn AS (SELECT l.graph_id, l.src, l.dst, l.w * c.c AS w FROM lap l JOIN cells c USING (graph_id, src, dst))", proj("pj", own, lin(xs(2), W(2, 2, layer + 1))), spmm("h", "jn", "pj", 2, universe=own)]
    return q(*parts, select=out_x("h", 2))


_add("conv_censnet", _censnet(0), _censnet_sql(True))
_add("conv_censnet_edges", _censnet(1), _censnet_sql(False))

# -- pools -----------------------------------------------------------------------------------------------------------------

for _name, _pool, _f in (("sum", pool.global_sum, "sum"), ("avg", pool.global_avg, "avg"), ("max", pool.global_max, "max")):
    _add(f"pool_global_{_name}", lambda s, d, p=_pool: wide(p(X.orders(s, d).nodes, 2), 2, ("graph_id",)), q(X.ORDERS, select=f"SELECT graph_id, round({_f}(x0), 6) AS x0, round({_f}(x1), 6) AS x1 FROM nodes GROUP BY 1"))
_HALF = lambda g: g.nodes.withColumn("x", F.transform("x", lambda v: v / 64))
_HX = "hn AS (SELECT graph_id, node_id, x0 / 64 AS x0, x1 / 64 AS x1 FROM nodes)"
_add("pool_global_attn", _O(lambda g: wide(pool.global_attention(_HALF(g), 2, 2), 2, ("graph_id",))), q(X.ORDERS, _HX, select="SELECT graph_id, " + ", ".join(f"round(sum({act(a, 'sigmoid')} * {b}), 6) AS x{i}" for i, (a, b) in enumerate(zip(lin(xs(2), W(2, 2, 0)), lin(xs(2), W(2, 2, 1)), strict=True))) + " FROM hn GROUP BY 1"))
_add("pool_global_attn_sum", _O(lambda g: wide(pool.global_attention_sum(_HALF(g), 2), 2, ("graph_id",))), q(X.ORDERS, _HX, f"sc AS (SELECT *, {lin(xs(2), W(2, 1))[0]} AS s FROM hn)", "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY graph_id)) AS e FROM sc)", select="SELECT graph_id, round(sum(e * x0) / (sum(e) + 1e-9), 6) AS x0, round(sum(e * x1) / (sum(e) + 1e-9), 6) AS x1 FROM e GROUP BY 1"))
_add("pool_sort", lambda s, d: wide(pool.sort_pool(X.turns(s, d).nodes, 2, 4), 2, ("graph_id", "pos")), q(X.TURNS, FRAME, "al AS (SELECT f.graph_id, f.pos AS id, coalesce(x0, 0.0) AS x0, coalesce(x1, 0.0) AS x1 FROM frame f LEFT JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.pos)", "rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY x1 DESC, id) - 1 AS pos FROM al)", "fr AS (SELECT DISTINCT graph_id, unnest(range(4)) AS pos FROM nodes)", select="SELECT graph_id, pos, coalesce(x0, 0.0) AS x0, coalesce(x1, 0.0) AS x1 FROM fr LEFT JOIN rk USING (graph_id, pos)"))
_TP = [r[0] for r in W(2, 1)]
_TN = max(sum(v * v for v in _TP), 1e-12) ** 0.5
_TOPSQL = "tk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS new_id FROM (SELECT v.*, row_number() OVER (PARTITION BY v.graph_id ORDER BY score DESC, v.node_id) AS r, n FROM sc v JOIN (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) USING (graph_id)) WHERE r <= ceil(0.5 * n))"
_TOPOUT = "SELECT graph_id, new_id AS node_id, round(x0 * tanh(score), 6) AS x0, round(x1 * tanh(score), 6) AS x1 FROM tk"
_add("pool_topk", lambda s, d: wide(pool.top_k_pool(X.turns(s, d), 0.5).nodes, 2), q(X.TURNS, f"sc AS (SELECT *, x0 * ({_TP[0] / _TN}) + x1 * ({_TP[1] / _TN}) AS score FROM nodes)", _TOPSQL, select=_TOPOUT))
_add("pool_topk_edges", lambda s, d: coo(pool.top_k_pool(X.turns(s, d), 0.5).edges), q(X.TURNS, f"sc AS (SELECT *, x0 * ({_TP[0] / _TN}) + x1 * ({_TP[1] / _TN}) AS score FROM nodes)", _TOPSQL, select="SELECT e.graph_id, a.new_id AS src, b.new_id AS dst, w FROM edges e JOIN tk a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN tk b ON b.graph_id = e.graph_id AND b.node_id = e.dst"))
_add("pool_sag", lambda s, d: wide(pool.sag_pool(X.turns(s, d), 0.5).nodes.select("graph_id", "node_id", "x"), 2), q(X.TURNS, EYE, PLUS, deg("looped", "ldeg"), norm_eps("aa", "looped", "ldeg"), proj("p", "nodes", lin(xs(2), W(2, 1))), spmm("h", "aa", "p", 1), "sc AS (SELECT n.*, round(h.x0, 9) AS score FROM nodes n JOIN h USING (graph_id, node_id))", _TOPSQL, select=_TOPOUT))
_SM = softmax(lin(xs(2), W(2, 2)))
SOFT = f"so AS (SELECT *, {named(_SM, 's')} FROM nodes)"
ES = "es AS (SELECT e.graph_id, e.w, a.s0 AS a0, a.s1 AS a1, b.s0 AS b0, b.s1 AS b1 FROM edges e JOIN so a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN so b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"
ESUM = "eg AS (SELECT graph_id, count(*)::DOUBLE AS m, sum(w * w) AS ww, sum(w * (a0 * b0 + a1 * b1)) AS ab, sum(w * (a0 * a0 + a1 * a1)) AS aa, sum(w * a0) AS d0, sum(w * a1) AS d1, sum(w * (abs(a0 - b0) + abs(a1 - b1))) AS tv FROM es GROUP BY 1)"
GRAM = "gr AS (SELECT graph_id, count(*)::DOUBLE AS n, sum(s0 * s0) AS g00, sum(s0 * s1) AS g01, sum(s1 * s1) AS g11, sum(s0) AS c0, sum(s1) AS c1 FROM so GROUP BY 1)"


def _loss(f: Callable[[GraphSet], pool.Pooled], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: (lambda p: p.losses.select("graph_id", *[F.round(n, 6).alias(n) for n in names]))(f(_scaled(X.turns(s, d))))


def _scaled(g: GraphSet) -> GraphSet:
    return g.with_x(g.nodes.withColumn("x", F.transform("x", lambda v: v / 16)), 2)


TS = X.TURNS.replace("floor(n / 64.0)::DOUBLE AS x0, (role = 'assistant')::INT::DOUBLE AS x1", "floor(n / 64.0)::DOUBLE / 16 AS x0, (role = 'assistant')::INT::DOUBLE / 16 AS x1")
_SG = "sqrt(g00 * g00 + 2 * g01 * g01 + g11 * g11)"
_R2 = 2**-0.5
_add("pool_mincut", _loss(lambda g: pool.mincut_pool(g, 2), "cut_loss", "ortho_loss"), q(TS, SOFT, ES, ESUM, GRAM, select=f"SELECT graph_id, round(-ab / aa, 6) AS cut_loss, round(sqrt(power(g00 / {_SG} - {_R2}, 2) + 2 * power(g01 / {_SG}, 2) + power(g11 / {_SG} - {_R2}, 2)), 6) AS ortho_loss FROM eg JOIN gr USING (graph_id)"))
_add("pool_dmon", _loss(lambda g: pool.dmon_pool(g, 2), "spectral_loss", "collapse_loss"), q(TS, SOFT, ES, ESUM, GRAM, select="SELECT graph_id, round(-(ab - (d0 * d0 + d1 * d1) / (2 * m)) / (2 * m), 6) AS spectral_loss, round(0.1 * (sqrt(c0 * c0 + c1 * c1) / n * sqrt(2.0) - 1), 6) AS collapse_loss FROM eg JOIN gr USING (graph_id)"))
_add("pool_justbalance", _loss(lambda g: pool.just_balance_pool(g, 2), "balance_loss"), q(TS, SOFT, GRAM, select="SELECT graph_id, round(-(sqrt(g00) + sqrt(g11)), 6) AS balance_loss FROM gr"))
_add("pool_cheeger", _loss(lambda g: pool.cheeger_pool(g, 2), "variation_loss", "balance_loss"), q(TS, SOFT, ES, ESUM, GRAM, "l AS (SELECT graph_id, node_id, 0 AS c, s0 AS s FROM so UNION ALL SELECT graph_id, node_id, 1, s1 FROM so)", "rk AS (SELECT l.*, row_number() OVER (PARTITION BY l.graph_id, c ORDER BY s DESC, node_id) AS r, n FROM l JOIN gr USING (graph_id))", "qt AS (SELECT graph_id, c, s AS q FROM rk WHERE r = floor(n / 2) + 1)", "aw AS (SELECT graph_id, sum(CASE WHEN s - q >= 0 THEN s - q ELSE q - s END) AS away FROM l JOIN qt USING (graph_id, c) GROUP BY 1)", select="SELECT graph_id, round(tv / (2 * m), 6) AS variation_loss, round((n - away) / n, 6) AS balance_loss FROM eg JOIN gr USING (graph_id) JOIN aw USING (graph_id)"))


def _pool_edges(f: Callable[[GraphSet], pool.Pooled]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: coo(f(_scaled(X.turns(s, d))).edges)


_add("pool_dmon_connect", _pool_edges(lambda g: pool.dmon_pool(g, 2)), q(TS, SOFT, ES, select=" UNION ALL ".join(f"SELECT graph_id, {i} AS src, {j} AS dst, round(sum(a{i} * w * b{j}), 6) AS w FROM es GROUP BY 1" for i in range(2) for j in range(2))))
_add("pool_mincut_reduce", lambda s, d: wide(pool.mincut_pool(_scaled(X.turns(s, d)), 2).nodes, 2), q(TS, SOFT, select=" UNION ALL ".join(f"SELECT graph_id, {i} AS node_id, round(sum(s{i} * x0), 6) AS x0, round(sum(s{i} * x1), 6) AS x1 FROM so GROUP BY 1" for i in range(2))))
_DSO = f"so AS (SELECT graph_id, node_id, {named(softmax(xs(2)), 's')} FROM h)"
_add("pool_diff", _loss(lambda g: pool.diff_pool(g, 2, 2), "link_loss", "entropy_loss"), q(TS, EYE, PLUS, deg("looped", "ldeg"), norm_eps("aa", "looped", "ldeg"), proj("p", "nodes", lin(xs(2), W(2, 2))), spmm("h", "aa", "p", 2), _DSO, ES, ESUM, GRAM, "en AS (SELECT graph_id, avg(-s0 * ln(s0 + 1e-7) - s1 * ln(s1 + 1e-7)) AS entropy FROM so GROUP BY 1)", select="SELECT graph_id, round(sqrt(greatest(0.0, ww - 2 * ab + g00 * g00 + 2 * g01 * g01 + g11 * g11)), 6) AS link_loss, round(entropy, 6) AS entropy_loss FROM eg JOIN gr USING (graph_id) JOIN en USING (graph_id)"))
_LAV = "lv AS (SELECT n.graph_id, n.node_id, n.x0, n.x1, sqrt(power(d.d * n.x0 - h.x0, 2) + power(d.d * n.x1 - h.x1, 2)) AS v FROM nodes n JOIN deg d USING (graph_id, node_id) JOIN h USING (graph_id, node_id))"
_LAL = "ld AS (SELECT l.graph_id, l.node_id, l.x0, l.x1, row_number() OVER (PARTITION BY l.graph_id ORDER BY l.node_id) - 1 AS cluster FROM lv l LEFT JOIN (SELECT e.graph_id, e.src AS node_id, max(o.v) AS o FROM edges e JOIN lv o ON o.graph_id = e.graph_id AND o.node_id = e.dst GROUP BY ALL) b USING (graph_id, node_id) WHERE b.o IS NULL OR l.v >= b.o)"
_LAC = f"cs AS (SELECT n.graph_id, n.node_id AS src, l.node_id AS dst, l.cluster, n.x0, n.x1, (n.x0 * l.x0 + n.x1 * l.x1) / {l2(['n.x0', 'n.x1'])} / {l2(['l.x0', 'l.x1'])} AS sc FROM nodes n JOIN ld l USING (graph_id))"
_LAP = "sm AS (SELECT *, exp(sc - m) / (sum(exp(sc - m)) OVER (PARTITION BY graph_id, src) + 1e-9) AS p FROM (SELECT *, max(sc) OVER (PARTITION BY graph_id, src) AS m FROM cs))"
#: Turns stand in chains of edges of weight 1, so the distance of two of them is the difference of their places.
_LAS = "sf AS (SELECT s.*, CASE WHEN l.node_id IS NOT NULL THEN (s.src = s.dst)::INT::DOUBLE WHEN s.src = s.dst THEN 0.0 ELSE s.p / abs(s.src - s.dst) END AS s FROM sm s LEFT JOIN ld l ON l.graph_id = s.graph_id AND l.node_id = s.src)"
_add("pool_la", lambda s, d: wide(pool.la_pool(_scaled(X.turns(s, d))).nodes, 2), q(TS, deg(), spmm("h", "edges", "nodes", 2), _LAV, _LAL, _LAC, _LAP, _LAS, select="SELECT graph_id, cluster AS node_id, round(sum(s * x0), 6) AS x0, round(sum(s * x1), 6) AS x1 FROM sf GROUP BY ALL"))

# -- models and measures ----------------------------------------------------------------------------------------------------

_add("model_gcn", lambda s, d: wide(models.gcn_model(conv.preprocess("gcn", _scaled(X.turns(s, d))), 2, 3), 2), q(TS, GCN, proj("p", "nodes", lin(xs(2), W(2, 3))), spmm("h", "ahat", "p", 3), proj("r", "h", [act(c, "relu") for c in xs(3)]), proj("p2", "r", lin(xs(3), W(3, 2, 1))), spmm("h2", "ahat", "p2", 2), proj("z", "h2", softmax(xs(2))), select=out_x("z", 2)))


def _general_sql(hidden: int = 4) -> str:
    relu = lambda cols: [act(c, "relu") for c in cols]
    parts, width = [TS, proj("c0", "nodes", relu(lin(xs(2), W(2, hidden))))], hidden
    for k in range(2):
        parts += [proj(f"p{k}", f"c{k}", relu(lin(xs(width), W(width, hidden, k + 1)))), spmm(f"z{k}", "edges", f"p{k}", hidden, "dst", "")]
        parts += [proj(f"c{k + 1}", both(f"z{k}", f"c{k}", hidden, width), xs(hidden) + xs(width, "y"))]
        width += hidden
    parts += ["rd AS (SELECT graph_id, 0::BIGINT AS node_id, " + ", ".join(f"sum(x{i}) AS x{i}" for i in range(width)) + " FROM c2 GROUP BY 1)"]
    parts += [proj("m1", "rd", relu(lin(xs(width), W(width, hidden, 7)))), proj("m2", "m1", lin(xs(hidden), W(hidden, 2, 8))), proj("out_", "m2", softmax(xs(2)))]
    return q(*parts, select=out_x("out_", 2))


_add("model_general_gnn", lambda s, d: wide(models.general_gnn(_scaled(X.turns(s, d)), 2, 4), 2), _general_sql())
_add("sgc_features", lambda s, d: wide(models.sgc_features(conv.preprocess("gcn", X.trade(s, d)), 2), 3), q(X.TRADE, GCN, spmm("h1", "ahat", "nodes", 3), spmm("h2", "ahat", "h1", 3), select=out_x("h2", 3)))
_add("khop_subgraph", lambda s, d: coo(models.k_hop_subgraph(X.trade(s, d).edges, 1, 2)), q(X.TRADE, "reached AS (SELECT 1::BIGINT AS n UNION SELECT dst FROM edges WHERE src = 1)", select="SELECT DISTINCT graph_id, src, dst, sign(w)::DOUBLE AS w FROM edges WHERE src IN (SELECT n FROM reached) OR dst IN (SELECT n FROM reached)"))
_WALK = """, walk AS (SELECT graph_id, node_id, node_id AS component FROM nodes
  UNION SELECT w.graph_id, b.dst, w.component FROM walk w JOIN b ON b.graph_id = w.graph_id AND b.src = w.node_id)
SELECT graph_id, node_id, min(component) AS component FROM walk GROUP BY 1, 2"""
_add_knn("connected_components", lambda x: lambda s, d: (lambda g: models.connected_components(g.edges, g.nodes))(x(s, d, 3)), q(X.KNN, "b AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges)", select="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + _WALK)
_MET = """c AS (SELECT o_orderpriority AS y, o_orderstatus AS c, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
a AS (SELECT y, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT c, sum(n) AS nb FROM c GROUP BY 1),
m AS (SELECT (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN a USING (y) JOIN b USING (c), t) AS mi, (SELECT -sum(na / t * ln(na / t)) FROM a, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM b, t) AS hb)"""
_add("cluster_metrics", lambda s, d: models.cluster_metrics(X.table(s, d, "orders").select(F.col("o_orderpriority").alias("y"), F.col("o_orderstatus").alias("c"))).select(*[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure", "nmi")]), q(_MET, select="SELECT round(mi / ha, 9) AS homogeneity, round(mi / hb, 9) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 9) AS v_measure, round(2 * mi / (ha + hb), 9) AS nmi FROM m"))
_add("mask_weights", _S(lambda g: models.mask_weights(g.nodes.select("graph_id", "node_id", (F.col("node_id") < 2).alias("mask")))), q(X.SESSIONS, select="SELECT graph_id, node_id, node_id < 2 AS mask, (node_id < 2)::INT / 2.0 AS sample_weight FROM nodes"))

_add("graph_masking", lambda s, d: wide(layouts.masked(layouts.padded_nodes(X.turns(s, d), True), 3), 2, ("graph_id", "pos")), q(X.TURNS, select="SELECT graph_id, node_id AS pos, x0, x1 FROM nodes"))
_add("sparse_dropout", _trade(lambda g: coo(linalg.sparse_dropout(g.edges, 0.5, 3))), q(X.TRADE, select=f"SELECT graph_id, src, dst, round(w / 0.5, 6) AS w FROM edges WHERE {draw(3, 'graph_id', 'src', 'dst')} >= 0.5"))
_add("flip_edges", lambda s, d: coo(T.flip_edges(X.turns(s, d).edges, X.turns(s, d).nodes, 0.1)), q(X.TURNS, f"fl AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b USING (graph_id) WHERE {draw(0, 'a.graph_id', 'a.node_id', 'b.node_id')} < 0.1)", select="SELECT graph_id, src, dst, w FROM edges e WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.graph_id = e.graph_id AND fl.src = e.src AND fl.dst = e.dst) UNION ALL SELECT graph_id, src, dst, 1.0 FROM fl WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE fl.graph_id = e.graph_id AND fl.src = e.src AND fl.dst = e.dst)"))
_add("random_graphs", lambda s, d: coo(T.random_graphs(s, 50, 20, 0.2).edges), f"WITH u AS (SELECT g AS graph_id, i AS src, j AS dst FROM range(50) a(g), range(20) b(i), range(20) c(j) WHERE i < j AND {draw(0, 'g', 'i', 'j', '1')} < 0.2) SELECT graph_id, src, dst, 1.0::DOUBLE AS w FROM u UNION ALL SELECT graph_id, dst, src, 1.0 FROM u")
_add("ds_shuffle", lambda s, d: X.turns(s, d).shuffled(1).counts(), q(X.TURNS, select=f"SELECT row_number() OVER (ORDER BY {draw(1, 'graph_id')}, graph_id) - 1 AS graph_id, n AS n_nodes, 2 * (n - 1) AS n_edges FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1)"))
_add("loader_shuffled", _O(lambda g: layouts.batches(g.nodes.select("graph_id").distinct(), 32, 2, True, 7)), q(X.ORDERS, select=f"SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY {draw(7, 'epoch', 'graph_id')}, graph_id) - 1) // 32 AS batch_id, graph_id FROM sizes, (VALUES (0), (1)) t(epoch)"))
#: Chains are bipartite: the largest eigenvalue of their normalised Laplacian is 2 (1 for a single node).
_add("largest_eigenvalue", lambda s, d: filters.largest_eigenvalue(filters.normalized_laplacian(X.turns(s, d).edges, X.turns(s, d).nodes)).select("graph_id", F.round("lmax", 6).alias("lmax")), q(X.TURNS, select="SELECT graph_id, CASE WHEN count(*) > 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS lmax FROM nodes GROUP BY 1"))
_add_knn("gat_attention", lambda x: lambda s, d: conv.gat_conv(x(s, d), 2, return_attention=True)[1].select("graph_id", "src", "dst", F.round("alpha", 6).alias("alpha")), _gat_sql("SELECT graph_id, src, dst, round(alpha, 6) AS alpha FROM w0"))

_WIDTHS = [3, 4, 2]
_add("mlp_model", _trade(lambda g: wide(models.mlp_model(g.nodes, 3, _WIDTHS[1:]), 2)), q(X.TRADE, proj("a", "nodes", [act(c, "relu") for c in lin(xs(3), W(3, 4))]), proj("b", "a", lin(xs(4), W(4, 2, 1))), select=out_x("b", 2)))
_add("binary_adjacency", _S(lambda g: coo(models.binary_adjacency(g.edges))), q(X.SESSIONS, select="SELECT graph_id, src, dst, 1.0::DOUBLE AS w FROM edges WHERE src <> dst"))

# -- hidden layers inside layers, and more layouts ------------------------------------------------------------------------------

_H = (4, 3)


def hidden(out: str, src: str, n: int, activation: str = "relu", first: int = 40) -> list[str]:
    """Hidden layers of the widths ``_H`` over x0 .. of ``src``."""
    parts, width = [], n
    for k, m in enumerate(_H):
        parts.append(proj(f"{out}{k}" if k < len(_H) - 1 else out, src if k == 0 else f"{out}{k - 1}", [act(c, activation) for c in lin(xs(width), W(width, m, first + k))]))
        width = m
    return parts


_HSOFT = f"so AS (SELECT hh.graph_id, hh.node_id, {named(softmax(lin(xs(3, 'hh.x'), W(3, 2))), 's')} FROM hh)"
_add("pool_mincut_mlp", _loss(lambda g: pool.mincut_pool(g, 2, mlp_hidden=_H), "cut_loss", "ortho_loss"), q(TS, *hidden("hh", "nodes", 2), _HSOFT, ES, ESUM, GRAM, select=f"SELECT graph_id, round(-ab / aa, 6) AS cut_loss, round(sqrt(power(g00 / {_SG} - {_R2}, 2) + 2 * power(g01 / {_SG}, 2) + power(g11 / {_SG} - {_R2}, 2)), 6) AS ortho_loss FROM eg JOIN gr USING (graph_id)"))
_add("pool_dmon_mlp", _loss(lambda g: pool.dmon_pool(g, 2, mlp_hidden=_H, mlp_activation="tanh"), "spectral_loss", "collapse_loss"), q(TS, *hidden("hh", "nodes", 2, "tanh"), _HSOFT, ES, ESUM, GRAM, select="SELECT graph_id, round(-(ab - (d0 * d0 + d1 * d1) / (2 * m)) / (2 * m), 6) AS spectral_loss, round(0.1 * (sqrt(c0 * c0 + c1 * c1) / n * sqrt(2.0) - 1), 6) AS collapse_loss FROM eg JOIN gr USING (graph_id)"))
_add("pool_justbalance_mlp", _loss(lambda g: pool.just_balance_pool(g, 2, mlp_hidden=_H), "balance_loss"), q(TS, *hidden("hh", "nodes", 2), _HSOFT, GRAM, select="SELECT graph_id, round(-(sqrt(g00) + sqrt(g11)), 6) AS balance_loss FROM gr"))
_add("pool_cheeger_mlp", _loss(lambda g: pool.cheeger_pool(g, 2, mlp_hidden=_H), "variation_loss"), q(TS, *hidden("hh", "nodes", 2), _HSOFT, ES, ESUM, select="SELECT graph_id, round(tv / (2 * m), 6) AS variation_loss FROM eg"))
_add("conv_appnp_mlp", _conv("appnp", lambda g: conv.appnp_conv(g, 2, 0.25, 1, mlp_hidden=_H), 2, lambda s, d: _scaled(X.turns(s, d))), q(TS, GCN, *hidden("hh", "nodes", 2), proj("z0", "hh", lin(xs(3), W(3, 2))), spmm("p1", "ahat", "z0", 2), proj("z1", both("p1", "z0", 2, 2), [f"(0.75 * x{i} + 0.25 * y{i})" for i in range(2)]), select=out_x("z1", 2)))
_EH = "eh AS (SELECT graph_id, src, dst, " + ", ".join(f"{c} AS h{i}" for i, c in enumerate([act(c, "relu") for c in lin(["e0", "e1"], W(2, 3, 40))])) + " FROM edges)"
_EK = W(3, 4)
_EM = [" + ".join(f"s.x{i} * (" + " + ".join(f"h{c} * ({_EK[c][i * 2 + j]})" for c in range(3)) + ")" for i in range(2)) for j in range(2)]
_add("conv_ecc_network", lambda s, d: wide(conv.ecc_conv(X.turns(s, d), 2, kernel_network=[3]), 2), q(X.TURNS, _EH, "m AS (SELECT e.graph_id, e.dst AS node_id, " + ", ".join(f"sum({c}) AS a{j}" for j, c in enumerate(_EM)) + " FROM eh e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.src GROUP BY ALL)", select="SELECT n.graph_id, n.node_id, " + ", ".join(f"round(coalesce(a{j}, 0.0) + {c}, 6) AS x{j}" for j, c in enumerate(lin(xs(2, "n.x"), W(2, 2, 1)))) + " FROM nodes n LEFT JOIN m USING (graph_id, node_id)"))
_XEK2 = _XEK.replace("k AS (", "k1 AS (", 1) + ", k AS (SELECT graph_id, src, dst, " + ", ".join(f"greatest({c}, 0.0) AS k{i}" for i, c in enumerate(lin(xs(3, "k"), W(3, 3, 50)))) + " FROM k1)"
_XEQ = [X.TURNS, _XEK2, _xenet_sum("i", "dst", 1), _xenet_sum("o", "src", 2)]
_add("conv_xenet_stacks", lambda s, d: wide(conv.xenet_conv(X.turns(s, d), [3, 3], 2, 2)[0], 2), q(*_XEQ, select="SELECT n.graph_id, n.node_id, " + ", ".join(f"round({c}, 6) AS x{j}" for j, c in enumerate(_XEOUT)) + " FROM nodes n JOIN i USING (graph_id, node_id) JOIN o USING (graph_id, node_id)"))
_add("conv_xenet_batch", lambda s, d: wide(conv.xenet_conv_batch(X.turns(s, d), [3, 3], 2, 2)[0], 2, ("graph_id", "pos")), q(*_XEQ, FRAME, select="SELECT f.graph_id, f.pos, " + ", ".join(f"coalesce(round({c}, 6), 0.0) AS x{j}" for j, c in enumerate(_XEOUT)) + " FROM frame f LEFT JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.pos LEFT JOIN i ON i.graph_id = f.graph_id AND i.node_id = f.pos LEFT JOIN o ON o.graph_id = f.graph_id AND o.node_id = f.pos"))
_add("conv_xenet_batch_edges", lambda s, d: wide(conv.xenet_conv_batch(X.turns(s, d), 3, 2, 2)[1], 2, ("graph_id", "i", "j"), "e"), q(X.TURNS, _XEK, select="SELECT graph_id, src AS i, dst AS j, " + ", ".join(f"round({c}, 6) AS x{j}" for j, c in enumerate(lin(xs(3, "k"), W(3, 2, 4)))) + " FROM k"))
_add("batch_edge_features", lambda s, d: wide(layouts.padded_edges(X.turns(s, d)), 2, ("graph_id", "i", "j"), "e"), q(X.TURNS, select="SELECT graph_id, src AS i, dst AS j, e0 AS x0, e1 AS x1 FROM edges"))


def _labels(s: SparkSession, d: str, nodes: bool) -> DataFrame:
    g = X.turns(s, d)
    if nodes:
        return wide(layouts.disjoint_labels(g.nodes.select("graph_id", "node_id", F.col("x").alias("y")), g), 2, ("row",), "y")
    return wide(layouts.disjoint_labels(g.nodes.groupBy("graph_id").agg(F.array(F.count("*").cast("double")).alias("y"))), 1, ("row",), "y")


_add("labels_disjoint_nodes", lambda s, d: _labels(s, d, True), q(X.TURNS, select="SELECT row_number() OVER (ORDER BY graph_id, node_id) - 1 AS row, x0, x1 FROM nodes"))
_add("labels_disjoint_graphs", lambda s, d: _labels(s, d, False), q(X.TURNS, select="SELECT row_number() OVER (ORDER BY graph_id) - 1 AS row, n AS x0 FROM (SELECT graph_id, count(*)::DOUBLE AS n FROM nodes GROUP BY 1)"))
_add("repeat_rows", _S(lambda g: linalg.repeat(g.nodes, F.col("node_id")).select("graph_id", "node_id", "copy", "place")), q(X.SESSIONS, select="SELECT graph_id, node_id, copy, row_number() OVER (ORDER BY graph_id, node_id, copy) - 1 AS place FROM (SELECT graph_id, node_id, unnest(range(node_id)) AS copy FROM nodes)"))
_add("reshape_cells", _S(lambda g: coo(linalg.reshape(g.edges, 5, 25))), q(X.SESSIONS, select="SELECT graph_id, (src * 5 + dst) // 25 AS src, (src * 5 + dst) % 25 AS dst, w FROM edges"))
_add("indices_to_mask_cells", _S(lambda g: linalg.indices_to_mask(g.edges.select("graph_id", "src", "dst"), g.edges.where("src < dst"), "graph_id", "src", "dst")), q(X.SESSIONS, select="SELECT graph_id, src, dst, src < dst AS mask FROM edges"))
_add("degree_matrix", _trade(lambda g: coo(filters.degree_matrix(g.edges, g.nodes))), q(X.TRADE, deg(), select="SELECT graph_id, node_id AS src, node_id AS dst, round(d, 6) AS w FROM deg WHERE d <> 0"))

#: The cells themselves of the four matrices that other queries sum up for each node.
for _name, _f, _sql in (
    ("norm_adj_sym", lambda g: filters.normalized_adjacency(g.edges, g.nodes), (deg(), norm("na"))),
    ("norm_adj_rw", lambda g: filters.normalized_adjacency(g.edges, g.nodes, False), (deg(), norm("na", sym=False))),
    ("normalize_a", lambda g: filters.normalize_a(g.edges, g.nodes), (deg(), norm_eps("na", "edges", "deg"))),
    ("gcn_filter", lambda g: filters.gcn_filter(g.edges, g.nodes), (GCN,)),
):
    _add(f"{_name}_cells", _trade(lambda g, f=_f: coo(f(g))), q(X.TRADE, *_sql, select=OUT_W.format("ahat" if _name == "gcn_filter" else "na")))

QUERIES |= file_queries.QUERIES
ORACLE |= file_queries.ORACLE
