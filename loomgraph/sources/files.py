"""Readers and writers of graph files.  Paths are anything Spark reads; files are parsed in parallel."""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators.model import GraphSet
from loomgraph.operators.transforms import symmetrised

#: Chemical symbols in the order of atomic numbers from 1 (fixed values: the periodic table).
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


# -- tables ---------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def _records(spark: SparkSession, path: str, sep: str = "\n", across: bool = False) -> DataFrame:
    """(file, ordinal, value): records of text files between ``sep``, numbered from 0 in each file or ``across`` all.

    Files are split and read in parallel.  A row's number is the number of rows in the blocks before its own, which
    only (file, block) counts decide, and its distance from the first row of its block; contents are not exchanged.
    """
    text = spark.read.option("lineSep", sep).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value")
    blocks = rows.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy("file", "_block") if across else Window.partitionBy("file").orderBy("_block")
    blocks = blocks.select("file", "_block", "_first", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    return rows.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_row") - F.col("_first")).alias("ordinal"), "value")


def read_txt(spark: SparkSession, path: str, sep: str | None = None, across: bool = False) -> DataFrame:
    """(file, line, x): a row of numbers for each line, numbered from 0 within its file, or ``across`` files in the order of their names."""
    t = F.trim(F.regexp_replace("value", "\r$", ""))
    parts = F.split(t, r"\s+" if sep is None else re.escape(sep))
    return _records(spark, path, across=across).where(t != "").select("file", F.col("ordinal").alias("line"), F.transform(parts, lambda p: F.trim(p).try_cast("double")).alias("x"))


def write_txt(rows: DataFrame, path: str, order: Sequence[str], column: str = "x", sep: str = " ") -> None:
    rows.orderBy(*order).select(F.array_join(F.transform(column, lambda v: v.cast("string")), sep).alias("value")).write.mode("overwrite").text(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, shape, data) of the arrays of .npy and .npz files, data in row order; pickles are refused."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {k: loaded[k] for k in loaded.files} if hasattr(loaded, "files") else {"": loaded}
                yield pd.DataFrame({"file": p, "name": list(arrays), "shape": [list(a.shape) for a in arrays.values()], "data": [a.astype(float).ravel() for a in arrays.values()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, name string, shape array<long>, data array<double>")


def write_npy(rows: DataFrame, key: str, column: str = "x") -> DataFrame:
    """(key, content): each group's vectors as the bytes of a .npy file, ordered by their other key ``node_id``."""

    def dump(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack(pdf.sort_values("node_id")[column]), allow_pickle=False)
        return pd.DataFrame({key: [pdf[key].iat[0]], "content": [out.getvalue()]})

    return rows.select(key, "node_id", column).groupBy(key).applyInPandas(dump, f"{key} long, content binary")


def save_arrays(contents: DataFrame, key: str, path: str) -> None:
    """Write (key, content) as one file for each key below ``path``/key=..; readers of arrays ignore the line end behind them."""
    contents.select(key, F.col("content").cast("string").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_npz(edges: DataFrame, nodes: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, content): each graph's matrix as the data, indices and indptr of a compressed-rows .npz file."""

    def dump(k: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values(["src", "dst"])
        size = int(n["node_id"].max()) + 1 if len(n) else 0
        out = io.BytesIO()
        np.savez(out, adj_data=e["w"].to_numpy(float), adj_indices=e["dst"].to_numpy(np.int64), adj_indptr=np.searchsorted(e["src"].to_numpy(np.int64), np.arange(size + 1)))
        return pd.DataFrame({key: [k[0]], "content": [out.getvalue()]})

    pairs = edges.select(key, "src", "dst", "w").toDF(key, "src", "dst", "w").groupBy(key).cogroup(nodes.select(key, "node_id").toDF(key, "node_id").groupBy(key))
    return pairs.applyInPandas(dump, f"{key} long, content binary")


def numbered_files(rows: DataFrame) -> DataFrame:
    """(file, graph_id): distinct values of ``file``, numbered in their order; names alone meet in one task."""
    return rows.select("file").distinct().withColumn("graph_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)


def csr_edges(arrays: DataFrame, prefix: str = "adj_", graph_id: Column | None = None) -> DataFrame:
    """(graph_id, src, dst, w) of CSR matrices stored as data, indices and indptr in ``read_npy`` rows.

    A file is a graph; ``graph_id`` is an expression over ``file``, else files are numbered in their order.
    """
    one = lambda n: F.max(F.when(F.col("name") == prefix + n, F.col("data")))
    m = arrays.groupBy("file").agg(one("data").alias("d"), one("indices").alias("i"), one("indptr").alias("p"))
    m = m.join(numbered_files(arrays), "file") if graph_id is None else m.withColumn("graph_id", graph_id)
    rows = m.where(F.size("p") > 1).select("graph_id", "d", "i", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("src"))
    n = (F.col("p")[F.col("src") + 1] - F.col("p")[F.col("src")]).cast("int")
    at = (F.col("p")[F.col("src")] + 1).cast("int")
    cells = F.arrays_zip(F.slice("i", at, n).alias("dst"), F.slice("d", at, n).alias("w"))
    return rows.select("graph_id", "src", F.explode(cells).alias("c")).select("graph_id", F.col("src").cast("long").alias("src"), F.col("c.dst").cast("long").alias("dst"), F.col("c.w").alias("w"))


# -- meshes and molecules ---------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, file, value): whole text files, numbered in the order of their paths; contents stay where they are read."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.join(numbered_files(rows), "file")


def read_off(spark: SparkSession, path: str) -> GraphSet:
    """Meshes: vertices are nodes, sides of faces are edges of weight 1 in both directions.

    A face of four corners (a, b, c, d) stands for (a, b, c) and (a, b, d).
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    rows = _files(spark, path).withColumn("lines", F.transform(lines, lambda s: F.trim(s)))
    # some files write the counts behind the first word
    joined = F.length(F.col("lines")[0]) > 3
    rows = rows.withColumn("counts", F.when(joined, F.substr(F.col("lines")[0], F.lit(4))).otherwise(F.col("lines")[1])).withColumn("body", F.when(joined, F.slice("lines", 2, F.size("lines"))).otherwise(F.slice("lines", 3, F.size("lines"))))
    count = F.transform(F.split(F.trim("counts"), r"\s+"), lambda v: v.cast("int"))
    rows = rows.withColumn("nv", count[0]).withColumn("nf", count[1])
    number = lambda s, t: F.transform(F.split(s, r"\s+"), lambda v: v.cast(t))
    nodes = rows.select("graph_id", F.posexplode(F.slice("body", F.lit(1), F.col("nv"))).alias("node_id", "s")).select("graph_id", F.col("node_id").cast("long").alias("node_id"), F.slice(number("s", "double"), 1, 3).alias("x"))
    faces = rows.select("graph_id", F.explode(F.slice("body", F.col("nv") + 1, F.col("nf"))).alias("s")).select("graph_id", number("s", "long").alias("f"))
    f = F.col("f")
    three = F.array(F.array(f[1], f[2], f[3]))
    both = F.concat(three, F.when(f[0] == 4, F.array(F.array(f[1], f[2], F.get(f, F.lit(4))))).otherwise(F.array().cast("array<array<bigint>>")))
    tri = faces.select("graph_id", F.explode(both).alias("t"))
    t = F.col("t")
    sides = tri.select("graph_id", F.explode(F.array(*[F.struct(t[a].alias("src"), t[b].alias("dst")) for a, b in ((0, 1), (1, 2), (0, 2))])).alias("e")).select("graph_id", "e.src", "e.dst")
    return GraphSet(nodes, symmetrised(sides), rows.select("graph_id", "file"), 3)


def read_sdf(spark: SparkSession, path: str, amount: int | None = None) -> DataFrame:
    """(file, ordinal, name, atoms, bonds, properties, data) of every molecule; bonds count atoms from 0.

    Records are read by their end mark, so large files are split.  ``properties`` are the lines between bonds and
    ``M  END``.
    """
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^[ \t]*\n", F.lit(""))
    whole = _records(spark, path, "$$$$").withColumn("record", F.when(F.col("ordinal") > 0, record).otherwise(F.regexp_replace("value", "\r", "")))
    rows = whole.where(F.trim(F.regexp_replace("record", r"\s", "")) != "")
    rows = rows if amount is None else rows.where(F.col("ordinal") < amount)
    lines = F.split("record", "\n")
    rows = rows.withColumn("lines", lines).withColumn("na", F.trim(F.substring(F.get("lines", F.lit(3)), 1, 3)).cast("int")).withColumn("nb", F.trim(F.substring(F.get("lines", F.lit(3)), 4, 3)).cast("int"))
    number = F.array(*[F.lit(s) for s in SYMBOLS])
    cut = lambda s, a, n: F.trim(F.substring(s, a, n))

    def atom(s: Column) -> Column:
        symbol = cut(s, 31, 4)
        return F.struct(
            F.array(*[cut(s, a, 10).cast("double") for a in (1, 11, 21)]).alias("coords"),
            F.array_position(number, symbol).cast("int").alias("atomic_num"),
            F.coalesce(cut(s, 35, 2).try_cast("int"), F.lit(0)).alias("iso"),
            F.coalesce(cut(s, 37, 3).try_cast("int"), F.lit(0)).alias("charge"),
        )

    def bond(s: Column) -> Column:
        return F.struct((cut(s, 1, 3).cast("long") - 1).alias("start"), (cut(s, 4, 3).cast("long") - 1).alias("end"), cut(s, 7, 3).cast("int").alias("type"), F.coalesce(cut(s, 10, 3).try_cast("int"), F.lit(0)).alias("stereo"))

    found = F.regexp_extract_all("record", F.lit(r"(?m)^> *<([^>\n]+)>[^\n]*\n[^\n]*"), F.lit(0))
    key = lambda s: F.regexp_extract(s, r"^> *<([^>\n]+)>", 1)
    data = F.map_from_entries(F.transform(found, lambda s: F.struct(key(s).alias("k"), F.substring_index(s, "\n", -1).alias("v"))))
    return rows.select("file", "ordinal", F.trim(F.get("lines", F.lit(0))).alias("name"), F.transform(F.slice("lines", F.lit(5), F.col("na")), atom).alias("atoms"), F.transform(F.slice("lines", F.col("na") + 5, F.col("nb")), bond).alias("bonds"), F.slice("lines", F.col("na") + F.col("nb") + 5, F.greatest(F.array_position("lines", F.lit("M  END")).cast("int") - F.col("na") - F.col("nb") - 5, F.lit(0))).alias("properties"), data.alias("data"))


def molecules(sdf: DataFrame, atom_types: Sequence[int] = (1, 6, 7, 8, 9), bond_types: int = 4) -> GraphSet:
    """Molecules as graphs: x = one-hot atom, coordinates, charge, iso; e = one-hot bond, both directions."""
    keys = sdf.select("file", "ordinal").withColumn("graph_id", F.row_number().over(Window.orderBy("file", "ordinal")).cast("long") - 1)
    ids = sdf.join(keys, ["file", "ordinal"])
    a = ids.select("graph_id", F.posexplode("atoms").alias("node_id", "a"))
    types = F.array(*[(F.col("a.atomic_num") == t).cast("double") for t in atom_types])
    nodes = a.select("graph_id", F.col("node_id").cast("long").alias("node_id"), F.concat(types, F.col("a.coords"), F.array(F.col("a.charge").cast("double"), F.col("a.iso").cast("double"))).alias("x"))
    b = ids.select("graph_id", F.explode("bonds").alias("b")).select("graph_id", F.col("b.start").alias("src"), F.col("b.end").alias("dst"), V.one_hot(F.col("b.type") - 1, bond_types).alias("e"))
    edges = b.unionByName(b.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "e")).withColumn("w", F.lit(1.0))
    return GraphSet(nodes, edges.select("graph_id", "src", "dst", "w", "e"), ids.select("graph_id", "name", "data"), len(atom_types) + 5, bond_types)


def coulomb(matrices: DataFrame) -> GraphSet:
    """(graph_id, m array<array<double>>): every cell that is not zero is an edge with the cell as feature."""
    cells = matrices.select("graph_id", F.posexplode("m").alias("src", "r")).select("graph_id", "src", F.posexplode("r").alias("dst", "v")).where("v <> 0")
    edges = cells.select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(1.0).alias("w"), F.array("v").alias("e"))
    nodes = matrices.select("graph_id", F.posexplode("m").alias("node_id", "_r")).select("graph_id", F.col("node_id").cast("long").alias("node_id"), F.array().cast("array<double>").alias("x"))
    return GraphSet(nodes, edges, matrices.select("graph_id"), 0, 1)


# -- DOT ------------------------------------------------------------------------------------------------

_STATEMENT = re.compile(r'("(?:[^"\\]|\\.)*"|[\w.+-]+)(?:\s*(->|--)\s*("(?:[^"\\]|\\.)*"|[\w.+-]+))?\s*(?:\[((?:[^\]"]|"(?:[^"\\]|\\.)*")*)\])?\s*;?')
_ATTRIBUTE = re.compile(r'([\w.]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^\s,;]+)')


def dot_value(text: str):
    """A literal, a bracketed row of numbers, or the text itself."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        pass
    if text.startswith("[") and text.endswith("]"):
        try:
            return [float(v) for v in text[1:-1].split()]
        except ValueError:
            pass
    return text


def parse_dot(text: str) -> tuple[bool, list[tuple[str, dict[str, str]]], list[tuple[str, str, dict[str, str]]]]:
    """(directed, nodes, edges) of a Graphviz text; attribute values stay texts."""
    directed = bool(re.match(r"\s*(strict\s+)?digraph", text))
    body = text[text.index("{") + 1 : text.rindex("}")]
    bare = lambda s: s[1:-1].replace('\\"', '"') if s.startswith('"') else s
    nodes: dict[str, dict[str, str]] = {}
    edges = []
    for m in _STATEMENT.finditer(body):
        a, arrow, b, attributes = m.groups()
        own = {k: bare(v) for k, v in _ATTRIBUTE.findall(attributes or "")}
        if not arrow:
            if bare(a) not in ("graph", "node", "edge"):
                nodes.setdefault(bare(a), {}).update(own)
            continue
        nodes.setdefault(bare(a), {})
        nodes.setdefault(bare(b), {})
        edges.append((bare(a), bare(b), own))
    return directed, list(nodes.items()), edges


def read_dot(spark: SparkSession, path: str) -> GraphSet:
    """Nodes and edges with their attributes as ``attrs map<string,string>``; undirected edges go both ways."""
    kind = "graph_id long, node_id long, src long, dst long, name string, attrs map<string,string>"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, text in zip(f["graph_id"], f["value"], strict=True):
                directed, nodes, edges = parse_dot(text)
                at = {n: i for i, (n, _) in enumerate(nodes)}
                rows = [(g, at[n], None, None, n, a) for n, a in nodes]
                for a, b, own in edges:
                    rows += [(g, None, at[a], at[b], None, own)] + ([] if directed or a == b else [(g, None, at[b], at[a], None, own)])
                out = pd.DataFrame(rows, columns=["graph_id", "node_id", "src", "dst", "name", "attrs"])
                yield out.astype({"node_id": "Int64", "src": "Int64", "dst": "Int64"})

    rows = _files(spark, path).select("graph_id", "value").mapInPandas(parse, kind)
    weight = F.coalesce(F.try_element_at("attrs", F.lit("weight")).try_cast("double"), F.lit(1.0))
    nodes = rows.where("node_id IS NOT NULL").select("graph_id", "node_id", F.array().cast("array<double>").alias("x"), "name", "attrs")
    return GraphSet(nodes, rows.where("src IS NOT NULL").select("graph_id", "src", "dst", weight.alias("w"), "attrs"))


def write_dot(g: GraphSet, path: str, directed: bool = True) -> None:
    """One DOT file for each graph, below ``path``/graph_id=..."""
    arrow = "->" if directed else "--"
    nodes = g.nodes.select("graph_id", F.lit(0).alias("k"), F.concat(F.lit("  "), F.col("node_id").cast("string"), F.lit(' [x="['), F.array_join(F.transform("x", lambda v: v.cast("string")), " "), F.lit(']"];')).alias("s"))
    edges = g.edges if directed else g.edges.where("src <= dst")
    edges = edges.select("graph_id", F.lit(1).alias("k"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(f" {arrow} "), F.col("dst").cast("string"), F.lit(" [weight="), F.col("w").cast("string"), F.lit("];")).alias("s"))
    lines = nodes.unionByName(edges).groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda r: r["s"]), "\n").alias("b"))
    lines.select("graph_id", F.concat(F.lit("digraph {\n" if directed else "graph {\n"), "b", F.lit("\n}\n")).alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


# -- collections -------------------------------------------------------------------------------------------


def read_tu(spark: SparkSession, folder: str, name: str) -> GraphSet:
    """The text format of graph-classification collections: name_A, name_graph_indicator and optional files.

    Repeated edges and loops go; nodes are numbered in their graph from 0; labels become one-hot vectors
    behind the attributes; graph attributes are preferred to graph labels.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def table(suffix: str) -> DataFrame | None:
        p = f"{folder}/{name}_{suffix}.txt"
        return read_txt(spark, p, ",", across=True).select((F.col("line") + 1).cast("long").alias("row"), "x") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) else None

    def hot(rows: DataFrame) -> tuple[DataFrame, int]:
        values = sorted(r[0] for r in rows.select(F.col("x")[0]).distinct().collect())
        return rows.select("row", V.label_one_hot(F.col("x")[0], values).alias("x")), len(values)

    def joined(attributes: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame | None, int]:
        n = 0 if attributes is None else len(attributes.first()["x"])
        if labels is None:
            return attributes, n
        coded, m = hot(labels)
        if attributes is None:
            return coded, m
        return attributes.withColumnRenamed("x", "_a").join(coded, "row").select("row", F.concat("_a", "x").alias("x")), n + m

    owner = table("graph_indicator").select("row", (F.col("x")[0].cast("long") - 1).alias("graph_id"))
    first = owner.groupBy("graph_id").agg(F.min("row").alias("first"))
    local = owner.join(first, "graph_id").select("row", "graph_id", (F.col("row") - F.col("first")).alias("node_id"))
    x, n = joined(table("node_attributes"), table("node_labels"))
    nodes = local.join(x, "row", "left") if x is not None else local.withColumn("x", F.lit(None).cast("array<double>"))
    nodes = nodes.select("graph_id", "node_id", F.coalesce("x", F.array().cast("array<double>")).alias("x"))
    e, m = joined(table("edge_attributes"), table("edge_labels"))
    a = table("A").select("row", F.col("x")[0].cast("long").alias("s"), F.col("x")[1].cast("long").alias("d"))
    a = a.join(e, "row", "left") if e is not None else a.withColumn("x", F.lit(None).cast("array<double>"))
    a = a.where("s <> d").groupBy("s", "d").agg(F.min_by("x", "row").alias("e"))
    src, dst = local.select(F.col("row").alias("s"), "graph_id", F.col("node_id").alias("src")), local.select(F.col("row").alias("d"), F.col("node_id").alias("dst"))
    edges = a.join(src, "s").join(dst, "d").select("graph_id", "src", "dst", F.lit(1.0).alias("w"), F.coalesce("e", F.array().cast("array<double>")).alias("e"))
    y = table("graph_attributes")
    if y is None and (labels := table("graph_labels")) is not None:
        y = hot(labels)[0]
    graphs = owner.select("graph_id").distinct() if y is None else y.select((F.col("row") - 1).alias("graph_id"), F.col("x").alias("y"))
    return GraphSet(nodes, edges, graphs, n, m)


def read_node_link(spark: SparkSession, graph: str, id_map: str, class_map: str | None = None, features: DataFrame | None = None, n_features: int = 0) -> GraphSet:
    """A node-link JSON graph with its id and class maps: undirected edges of weight 1, masks from node flags."""
    schema = "nodes array<struct<id:string,val:boolean,test:boolean>>, links array<struct<source:string,target:string>>"
    j = spark.read.text(graph, wholetext=True).select(F.from_json("value", schema).alias("g"))
    number = spark.read.text(id_map, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("id", "node_id"))
    n = j.select(F.explode("g.nodes").alias("n")).select("n.id", F.coalesce("n.val", F.lit(False)).alias("mask_va"), F.coalesce("n.test", F.lit(False)).alias("mask_te")).join(number, "id")
    n = n.withColumn("mask_tr", ~F.col("mask_va") & ~F.col("mask_te"))
    if class_map is not None:
        c = spark.read.text(class_map, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "c"))
        c = c.select("id", F.coalesce(F.from_json("c", "array<double>"), F.array(F.col("c").try_cast("double"))).alias("y"))
        n = n.join(c, "id", "left")
    n = n.join(features, "node_id", "left") if features is not None else n.withColumn("x", F.array().cast("array<double>"))
    links = j.select(F.explode("g.links").alias("l")).select(F.col("l.source").alias("s"), F.col("l.target").alias("d"))
    ends = links.join(number.select(F.col("id").alias("s"), F.col("node_id").alias("src")), "s").join(number.select(F.col("id").alias("d"), F.col("node_id").alias("dst")), "d")
    zero = F.lit(0).cast("long")
    return GraphSet(n.withColumn("graph_id", zero).drop("id"), symmetrised(ends.select(zero.alias("graph_id"), "src", "dst")), None, n_features)


def role_masks(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Boolean masks mask_tr, mask_va, mask_te from ``roles`` (value: JSON {"tr": [ids], "va": .., "te": ..})."""
    r = roles.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("role", "ids")).select("role", F.explode("ids").alias("node_id"))
    wide = r.groupBy("node_id").agg(*[F.max((F.col("role") == k).cast("int")).alias(f"mask_{k}") for k in ("tr", "va", "te")])
    return nodes.join(wide, "node_id", "left").select(*nodes.columns, *[F.coalesce(F.col(f"mask_{k}") == 1, F.lit(False)).alias(f"mask_{k}") for k in ("tr", "va", "te")])


def citation_masks(nodes: DataFrame, label: str, per_class: int = 20, n_validation: int = 500, seed: int = 0) -> DataFrame:
    """A stratified split: ``per_class`` nodes of each label train, ``n_validation`` of the rest validate, others test."""
    h = V.uniform(seed, "node_id")
    own = nodes.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(h, "node_id")))
    own = own.withColumn("mask_tr", F.col("_r") <= per_class)
    rest = own.where(~F.col("mask_tr")).orderBy(h, "node_id").limit(n_validation).select("node_id").withColumn("_v", F.lit(True))
    own = own.join(F.broadcast(rest), "node_id", "left").withColumn("mask_va", F.col("_v").isNotNull())
    return own.withColumn("mask_te", ~F.col("mask_tr") & ~F.col("mask_va")).drop("_r", "_v")


def read_mesh_tree(spark: SparkSession, folder: str, split: str = "train") -> GraphSet:
    """OFF files below class/split/: meshes with the one-hot class of their folder as label."""
    g = read_off(spark, f"{folder}/*/{split}/*.off")
    own = g.graphs.withColumn("class", F.element_at(F.split("file", "/"), -3))
    classes = sorted(r[0] for r in own.select("class").distinct().collect())
    return GraphSet(g.nodes, g.edges, own.withColumn("y", V.label_one_hot(F.col("class"), classes)), 3)


def from_edge_index(spark: SparkSession, graphs: Sequence[dict]) -> GraphSet:
    """From objects with edge_index (2 x m), node_feat, edge_feat and label arrays."""
    nodes, edges, ys = [], [], []
    for g, d in enumerate(graphs):
        feats = d.get("node_feat")
        for i in range(d["num_nodes"]):
            nodes.append((g, i, [float(v) for v in feats[i]] if feats is not None else []))
        e = d.get("edge_feat")
        for k, (s, t) in enumerate(zip(*d["edge_index"], strict=True)):
            edges.append((g, int(s), int(t), 1.0, [float(v) for v in e[k]] if e is not None else []))
        ys.append((g, [float(v) for v in np.ravel(d["label"])] if d.get("label") is not None else None))
    n = len(nodes[0][2]) if nodes else 0
    return GraphSet(spark.createDataFrame(nodes, "graph_id long, node_id long, x array<double>"), spark.createDataFrame(edges, "graph_id long, src long, dst long, w double, e array<double>"), spark.createDataFrame(ys, "graph_id long, y array<double>"), n, len(edges[0][4]) if edges else 0)
