"""Queries of readers and writers: the driver's tables are written in a format, read back, and compared with SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.shared import Rounds
from loomgraph.functions.vec import uniform
from loomgraph.operators import layouts
from loomgraph.operators import transforms as T
from loomgraph.operators.model import GraphSet
from loomgraph.plans import fixtures as X
from loomgraph.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _folder(spark: SparkSession, name: str) -> str:
    return Rounds(spark, "files").path(name)


def _owner() -> Column:
    """The graph that a file below graph_id=.. holds."""
    return F.regexp_extract("file", "graph_id=(-?[0-9]+)", 1).cast("long")


# -- tables and arrays ---------------------------------------------------------------------------------


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    files.write_csv(X.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, sep=";")
    return files.read_csv(s, path, "s_suppkey long, s_name string, s_acctbal double", sep=";")


_add("file_csv", _csv, "SELECT s_suppkey, s_name, s_acctbal FROM supplier")


def _txt(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "txt")
    files.write_txt(X.turns(s, d).nodes, path, ["graph_id", "node_id"])
    return files.read_txt(s, path, across=True).select("line", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


_add("file_txt", _txt, f"WITH {X.TURNS} SELECT row_number() OVER (ORDER BY graph_id, node_id) - 1 AS line, x0, x1 FROM nodes")


def _npy(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "npy")
    files.save_arrays(files.write_npy(X.turns(s, d).nodes, "graph_id"), "graph_id", path)
    cells = files.read_npy(s, f"{path}/*/*").select(_owner().alias("graph_id"), F.col("shape")[1].alias("n"), F.posexplode("data").alias("k", "v"))
    return cells.select("graph_id", F.floor(F.col("k") / F.col("n")).alias("pos"), (F.col("k") % F.col("n")).alias("dim"), "v")


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS pos FROM nodes)"
_add("file_npy", _npy, f"WITH {X.TURNS}, {_RANKED} SELECT graph_id, pos, 0 AS dim, x0 AS v FROM rk UNION ALL SELECT graph_id, pos, 1, x1 FROM rk")


def _npz(s: SparkSession, d: str) -> DataFrame:
    path, g = _folder(s, "npz"), X.turns(s, d)
    files.save_arrays(files.write_npz(g.edges, g.nodes), "graph_id", path)
    return files.csr_edges(files.read_npy(s, f"{path}/*/*"), graph_id=_owner())


_add("file_npz_csr", _npz, f"WITH {X.TURNS} SELECT graph_id, src, dst, w FROM edges")


# -- DOT ----------------------------------------------------------------------------------------------------


def _dot(s: SparkSession, d: str) -> GraphSet:
    path = _folder(s, "dot")
    files.write_dot(X.turns(s, d), path)
    return files.read_dot(s, f"{path}/*/*")


def _dot_edges(s: SparkSession, d: str) -> DataFrame:
    g = _dot(s, d)
    names = lambda c, to: g.nodes.select("graph_id", F.col("node_id").alias(c), F.col("name").cast("long").alias(to))
    return g.edges.join(names("src", "a"), ["graph_id", "src"]).join(names("dst", "b"), ["graph_id", "dst"]).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w")


#: Files are numbered in the order of their names.
_BY_NAME = "bn AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id::VARCHAR || '/') - 1 AS k FROM (SELECT DISTINCT graph_id FROM nodes))"
_add("file_dot_edges", _dot_edges, f"WITH {X.TURNS}, {_BY_NAME} SELECT k AS graph_id, src, dst, w FROM edges JOIN bn USING (graph_id)")
_add("file_dot_nodes", lambda s, d: _dot(s, d).nodes.select("graph_id", F.col("name").cast("long").alias("node_id"), F.element_at(F.split(F.translate(F.col("attrs")["x"], "[]", ""), " "), 1).cast("double").alias("x0")), f"WITH {X.TURNS}, {_BY_NAME} SELECT k AS graph_id, node_id, x0 FROM nodes JOIN bn USING (graph_id)")


# -- meshes and molecules ----------------------------------------------------------------------------------------


def _off(s: SparkSession, d: str) -> GraphSet:
    """A mesh for each conversation: turns are corners, three turns in a row a face."""
    path = _folder(s, "off")
    n = X.turns(s, d).nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "x"))).alias("v"))
    corners = F.transform("v", lambda v: F.concat_ws(" ", v["x"][0].cast("string"), v["x"][1].cast("string"), F.lit("0.0")))
    faces = F.when(F.size("v") > 2, F.transform(F.sequence(F.lit(0), F.size("v") - 3), lambda i: F.concat_ws(" ", F.lit("3"), i.cast("string"), (i + 1).cast("string"), (i + 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("OFF"), F.concat_ws(" ", F.size("v").cast("string"), F.size(faces).cast("string"), F.lit("0")))
    n.select("graph_id", F.array_join(F.concat(head, corners, faces), "\n").alias("value")).write.partitionBy("graph_id").text(path)
    g = files.read_off(s, f"{path}/*/*")
    own = g.graphs.select("graph_id", _owner().alias("_g"))
    swap = lambda df: df.join(own, "graph_id").drop("graph_id").withColumnRenamed("_g", "graph_id")
    return GraphSet(swap(g.nodes), swap(g.edges), None, 3)


_add("file_off_edges", lambda s, d: _off(s, d).edges.select("graph_id", "src", "dst", "w"), f"WITH {X.TURNS}, {_RANKED}, sz AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) SELECT a.graph_id, a.pos AS src, b.pos AS dst, 1.0::DOUBLE AS w FROM rk a JOIN rk b ON a.graph_id = b.graph_id AND abs(a.pos - b.pos) IN (1, 2) JOIN sz ON sz.graph_id = a.graph_id WHERE n > 2")
_add("file_off_nodes", lambda s, d: _off(s, d).nodes.select("graph_id", "node_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("x")[2].alias("x2")), f"WITH {X.TURNS}, {_RANKED} SELECT graph_id, pos AS node_id, x0, x1, 0.0::DOUBLE AS x2 FROM rk")


def _sdf(s: SparkSession, d: str) -> DataFrame:
    """A molecule for each conversation: users are carbon, assistants oxygen, successive turns are bonded."""
    path = _folder(s, "sdf")
    n = X.turns(s, d).nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "x"))).alias("v"))
    atom = F.transform("v", lambda v: F.concat(F.format_string("%10.4f%10.4f%10.4f", v["x"][0], v["x"][1], F.lit(0.5)), F.when(v["x"][1] > 0, F.lit(" O  ")).otherwise(F.lit(" C  ")), F.lit(" 0  0")))
    bond = F.when(F.size("v") > 1, F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.format_string("%3d%3d%3d%3d", i, i + 1, i % 3 + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.col("graph_id").cast("string"), F.lit("  turns"), F.lit(""), F.concat(F.format_string("%3d%3d", F.size("v"), F.size("v") - 1), F.lit("  0  0  0  0  0  0  0  0999 V2000")))
    tail = F.array(F.lit("M  CHG  1   1   0"), F.lit("M  END"), F.lit("> <TURNS>"), F.size("v").cast("string"), F.lit(""), F.lit(""))
    n.select(F.array_join(F.concat(head, atom, bond, tail), "\n").alias("value")).write.option("lineSep", "$$$$\n").text(path)
    return files.read_sdf(s, path)


_add("file_sdf_atoms", lambda s, d: _sdf(s, d).select(F.col("name").cast("long").alias("graph_id"), F.posexplode("atoms").alias("pos", "a")).select("graph_id", "pos", "a.atomic_num", F.col("a.coords")[0].alias("x0"), F.col("a.coords")[2].alias("x2")), f"WITH {X.TURNS}, {_RANKED} SELECT graph_id, pos, CASE WHEN x1 > 0 THEN 8 ELSE 6 END AS atomic_num, x0, 0.5::DOUBLE AS x2 FROM rk")
_add("file_sdf_fields", lambda s, d: _sdf(s, d).select(F.col("name").cast("long").alias("graph_id"), F.col("data")["TURNS"].cast("long").alias("turns"), F.size("properties").alias("n_properties"), F.size("bonds").alias("n_bonds")), f"WITH {X.TURNS} SELECT graph_id, count(*) AS turns, 1 AS n_properties, count(*) - 1 AS n_bonds FROM nodes GROUP BY 1")


def _molecules(s: SparkSession, d: str) -> DataFrame:
    g = files.molecules(_sdf(s, d))
    return g.edges.join(g.graphs.select("graph_id", F.col("name").cast("long").alias("_g")), "graph_id").select(F.col("_g").alias("graph_id"), "src", "dst", F.array_position("e", F.lit(1.0)).alias("bond"))


_add("file_sdf_molecules", _molecules, f"WITH {X.TURNS}, {_RANKED} SELECT a.graph_id, a.pos AS src, b.pos AS dst, (least(a.pos, b.pos) + 1) % 3 + 1 AS bond FROM rk a JOIN rk b ON a.graph_id = b.graph_id AND abs(a.pos - b.pos) = 1")
_CELL = lambda i, j: F.when((i + j) % 2 == 0, (i * j).cast("double")).otherwise(F.lit(0.0))


def _coulomb(s: SparkSession, d: str) -> DataFrame:
    n = X.turns(s, d).nodes.groupBy("graph_id").agg(F.count("*").cast("int").alias("n"))
    m = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: _CELL(i, j)))
    return files.coulomb(n.select("graph_id", m.alias("m"))).edges.select("graph_id", "src", "dst", F.col("e")[0].alias("v"))


_add("file_coulomb", _coulomb, f"WITH {X.TURNS}, sz AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) SELECT graph_id, i - 1 AS src, j - 1 AS dst, (i * j)::DOUBLE AS v FROM (SELECT graph_id, n, unnest(range(1, n + 1)) AS i FROM sz) JOIN (SELECT graph_id, unnest(range(1, n + 1)) AS j FROM sz) USING (graph_id) WHERE (i + j) % 2 = 0")


# -- collections -----------------------------------------------------------------------------------------------------


def _tu(s: SparkSession, d: str) -> GraphSet:
    """Conversations as a graph-classification collection: one attribute, roles as labels, length as the class."""
    path, g = _folder(s, "tu"), X.turns(s, d)
    first = layouts.offsets(g).select("graph_id", "offset")
    ids = first.select("graph_id").withColumn("g", F.row_number().over(X.Window.orderBy("graph_id")))
    one = lambda c: F.array(c.cast("string"))
    rows = g.nodes.join(first, "graph_id").join(ids, "graph_id").withColumn("row", F.col("offset") + F.col("node_id") + 1)
    put = lambda df, name, *order: files.write_txt(df, f"{path}/T_{name}.txt", order, sep=", ")
    put(rows.select("row", one(F.col("g")).alias("x")), "graph_indicator", "row")
    put(rows.select("row", one(F.col("x")[0]).alias("x")), "node_attributes", "row")
    put(rows.select("row", one(F.col("x")[1].cast("int")).alias("x")), "node_labels", "row")
    e = g.edges.join(first, "graph_id").select((F.col("src") + F.col("offset") + 1).alias("s"), (F.col("dst") + F.col("offset") + 1).alias("t"))
    put(e.select("s", "t", F.array(F.col("s").cast("string"), F.col("t").cast("string")).alias("x")), "A", "s", "t")
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    put(n.select("g", one((F.col("n") > 4).cast("int")).alias("x")), "graph_labels", "g")
    return files.read_tu(s, path, "T")


_DENSE = "dn AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS k, n FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1))"
_add("file_tu_nodes", lambda s, d: _tu(s, d).nodes.select("graph_id", "node_id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)]), f"WITH {X.TURNS}, {_DENSE} SELECT k AS graph_id, node_id, x0, (x1 = 0)::INT::DOUBLE AS x1, (x1 = 1)::INT::DOUBLE AS x2 FROM nodes JOIN dn USING (graph_id)")
_add("file_tu_edges", lambda s, d: _tu(s, d).edges.select("graph_id", "src", "dst", "w"), f"WITH {X.TURNS}, {_DENSE} SELECT k AS graph_id, src, dst, w FROM edges JOIN dn USING (graph_id)")
_add("file_tu_labels", lambda s, d: _tu(s, d).graphs.select("graph_id", F.element_at("y", -1).alias("y")), f"WITH {X.TURNS}, {_DENSE} SELECT k AS graph_id, (n > 4)::INT::DOUBLE AS y FROM dn")


def _node_link(s: SparkSession, d: str) -> GraphSet:
    """Nations, linked within a region; the test and validation flags follow regions."""
    path, n = _folder(s, "json"), X.table(s, d, "nation")
    region = F.col("n_regionkey")
    put = lambda df, name: df.select(F.to_json("j").alias("value")).write.text(f"{path}/{name}")
    nodes = n.agg(F.collect_list(F.struct(F.col("n_name").alias("id"), (region == 1).alias("val"), (region == 2).alias("test"))).alias("nodes"))
    two = n.select(F.col("n_name").alias("source"), "n_regionkey").join(n.select(F.col("n_name").alias("target"), "n_regionkey"), "n_regionkey").where("source < target")
    links = two.agg(F.collect_list(F.struct("source", "target")).alias("links"))
    put(nodes.join(links).select(F.struct("nodes", "links").alias("j")), "graph")
    entries = lambda v: n.agg(F.map_from_entries(F.collect_list(F.struct("n_name", v))).alias("j"))
    put(entries(F.col("n_nationkey")), "ids")
    put(entries(F.array(region.cast("double"), F.lit(1.0)).alias("v")), "classes")
    return files.read_node_link(s, f"{path}/graph", f"{path}/ids", f"{path}/classes")


_add("file_node_link_nodes", lambda s, d: _node_link(s, d).nodes.select("node_id", "mask_tr", "mask_va", "mask_te", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "SELECT n_nationkey AS node_id, n_regionkey NOT IN (1, 2) AS mask_tr, n_regionkey = 1 AS mask_va, n_regionkey = 2 AS mask_te, n_regionkey::DOUBLE AS y0, 1.0::DOUBLE AS y1 FROM nation")
_add("file_node_link_edges", lambda s, d: _node_link(s, d).edges.select("src", "dst", "w"), "SELECT a.n_nationkey AS src, b.n_nationkey AS dst, 1.0::DOUBLE AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")


def _roles(s: SparkSession, d: str) -> DataFrame:
    path, n = _folder(s, "roles"), X.table(s, d, "nation")
    role = F.when(F.col("n_nationkey") % 3 == 0, "tr").when(F.col("n_nationkey") % 3 == 1, "va")
    own = n.select(role.alias("role"), "n_nationkey").where("role IS NOT NULL").groupBy("role").agg(F.collect_list("n_nationkey").alias("ids"))
    own.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("role", "ids")))).alias("value")).write.text(path)
    return files.role_masks(n.select(F.col("n_nationkey").cast("long").alias("node_id")), s.read.text(path, wholetext=True))


_add("file_role_masks", _roles, "SELECT n_nationkey AS node_id, n_nationkey % 3 = 0 AS mask_tr, n_nationkey % 3 = 1 AS mask_va, false AS mask_te FROM nation")


def _citation(s: SparkSession, d: str) -> DataFrame:
    rows = X.table(s, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("label"))
    return files.citation_masks(rows, "label", 5, 20).select("node_id", "mask_tr", "mask_va", "mask_te")


_DRAW = f"(('0x' || substr(md5(concat_ws('|', 0, c_custkey)), 1, 12))::BIGINT / {float(1 << 48)})"
_add("file_citation_masks", _citation, f"WITH r AS (SELECT c_custkey, {_DRAW} AS h, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DRAW}, c_custkey) <= 5 AS tr FROM customer), v AS (SELECT *, NOT tr AND row_number() OVER (PARTITION BY tr ORDER BY h, c_custkey) <= 20 AS va FROM r) SELECT c_custkey AS node_id, tr AS mask_tr, va AS mask_va, NOT tr AND NOT va AS mask_te FROM v")
_add("file_edge_index", lambda s, d: files.from_edge_index(s, [{"num_nodes": 3, "edge_index": [[0, 1, 2], [1, 2, 0]], "node_feat": [[1], [2], [3]], "edge_feat": [[5], [6], [7]], "label": [1]}, {"num_nodes": 2, "edge_index": [[0], [1]], "node_feat": [[8], [9]], "edge_feat": [[4]], "label": [0]}]).edges.select("graph_id", "src", "dst", F.col("e")[0].alias("e0")), "SELECT * FROM (VALUES (0, 0, 1, 5.0::DOUBLE), (0, 1, 2, 6.0), (0, 2, 0, 7.0), (1, 0, 1, 4.0)) t(graph_id, src, dst, e0)")


def _grid(s: SparkSession, d: str) -> DataFrame:
    """The grid of an image: the eight nearest points of each, either way."""
    return T.symmetrised(T.knn_edges(T.grid_nodes(s, 12), 2, 8)).select("src", "dst", "w")


_PT = "p AS (SELECT i, (i % 12) * (1.0::DOUBLE / 11) AS x, (i // 12) * (1.0::DOUBLE / 11) AS y FROM range(144) t(i))"
_add("grid_edges", _grid, f"WITH {_PT}, n AS (SELECT a.i AS src, b.i AS dst, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.i) AS r FROM p a JOIN p b ON a.i <> b.i) SELECT src, dst, 1.0::DOUBLE AS w FROM n WHERE r <= 8 UNION SELECT dst, src, 1.0 FROM n WHERE r <= 8")
_add("grid_nodes", lambda s, d: T.grid_nodes(s, 12).select("node_id", F.round(F.col("x")[0], 9).alias("x0"), F.round(F.col("x")[1], 9).alias("x1")), f"WITH {_PT} SELECT i AS node_id, round(x, 9) AS x0, round(y, 9) AS x1 FROM p")


# -- layouts and sets without files ------------------------------------------------------------------------------------


def _put(s: SparkSession, d: str) -> DataFrame:
    """Every conversation of an even id is replaced by its first turn."""
    g = X.turns(s, d)
    first = GraphSet(g.nodes.where("graph_id % 2 = 0 AND node_id = 0"), g.edges.limit(0), None, 2, 2)
    return g.put(first).counts()


_add("ds_put", _put, f"WITH {X.TURNS} SELECT graph_id, CASE WHEN graph_id % 2 = 0 THEN 1 ELSE count(*) END AS n_nodes, CASE WHEN graph_id % 2 = 0 THEN 0 ELSE 2 * (count(*) - 1) END AS n_edges FROM nodes GROUP BY 1")
_add("loader_single", lambda s, d: layouts.single(X.trade(s, d), X.trade(s, d).nodes.select("graph_id", "node_id", (F.col("x")[1] * 2 + 1).alias("sample_weight"))).nodes.select("node_id", "sample_weight"), f"WITH {X.TRADE} SELECT node_id, x1 * 2 + 1 AS sample_weight FROM nodes")
_add("labels_padded", lambda s, d: layouts.padded_labels(X.turns(s, d).nodes.select("graph_id", "node_id", F.array(F.col("x")[1], 1 - F.col("x")[1]).alias("y")), 2).select("graph_id", "pos", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), f"WITH {X.TURNS}, {_RANKED}, fr AS (SELECT graph_id, unnest(range((SELECT max(pos) + 1 FROM rk))) AS pos FROM (SELECT DISTINCT graph_id FROM nodes)) SELECT fr.graph_id, fr.pos, coalesce(x1, 0.0) AS y0, coalesce(1 - x1, 0.0) AS y1 FROM fr LEFT JOIN rk USING (graph_id, pos)")
_add("uniform_draws", lambda s, d: X.table(s, d, "nation").select("n_nationkey", uniform(5, "n_nationkey").alias("u")), f"SELECT n_nationkey, ('0x' || substr(md5(concat_ws('|', 5, n_nationkey)), 1, 12))::BIGINT / {float(1 << 48)} AS u FROM nation")
