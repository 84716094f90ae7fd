"""Files written by the test, read back as graphs."""

import io
import json

import numpy as np

from loomgraph.operators.model import GraphSet
from loomgraph.sources import files


def pairs(df):
    return sorted((r["graph_id"], r["src"], r["dst"]) for r in df.collect())


def test_off(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF\n4 2 0\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n3 0 1 2\n3 1 2 3\n")
    (tmp_path / "b.off").write_text("OFF4 1 0\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n4 0 1 2 3\n")
    g = files.read_off(spark, str(tmp_path / "*.off"))
    assert g.nodes.count() == 8
    want = {0: {(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)}, 1: {(0, 1), (1, 2), (0, 2), (1, 3), (0, 3)}}
    assert pairs(g.edges) == sorted((k, *e) for k, v in want.items() for s in v for e in (s, s[::-1]))


def test_sdf(spark, tmp_path):
    atom = lambda x, s: f"{x:10.4f}{0:10.4f}{1:10.4f} {s:<3} 0  0\n"
    mol = "m1\n\n\n  2  1  0\n" + atom(0.5, "C") + atom(1.5, "O") + "  1  2  2  0\nM  END\n> <id>\n77\n\n$$$$\n"
    (tmp_path / "m.sdf").write_text(mol + mol.replace("m1", "m2"))
    rows = files.read_sdf(spark, str(tmp_path / "m.sdf"))
    first = rows.orderBy("ordinal").first()
    assert [a["atomic_num"] for a in first["atoms"]] == [6, 8] and first["atoms"][0]["coords"] == [0.5, 0.0, 1.0]
    assert (first["bonds"][0]["start"], first["bonds"][0]["end"], first["bonds"][0]["type"]) == (0, 1, 2)
    assert first["data"] == {"id": "77"} and files.read_sdf(spark, str(tmp_path / "m.sdf"), 1).count() == 1
    g = files.molecules(rows)
    assert pairs(g.edges) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)] and g.edges.first()["e"] == [0, 1, 0, 0]
    assert g.nodes.where("graph_id = 0 AND node_id = 1").first()["x"] == [0, 0, 0, 1, 0, 1.5, 0, 1, 0, 0]


def test_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text('graph G {\n a [size=2, name="x y"];\n b; c;\n a -- b [weight=2.5];\n b -- c;\n}\n')
    g = files.read_dot(spark, str(tmp_path / "g.dot"))
    assert pairs(g.edges) == [(0, 0, 1), (0, 1, 0), (0, 1, 2), (0, 2, 1)]
    assert g.nodes.where("name = 'a'").first()["attrs"] == {"size": "2", "name": "x y"}
    assert files.dot_value("[1 2.5]") == [1.0, 2.5] and files.dot_value("3") == 3 and files.dot_value("q r") == "q r"
    files.write_dot(GraphSet.from_arrays(spark, [{"x": [[1], [2]], "a": [[0, 1], [0, 0]]}]), str(tmp_path / "out"))
    assert pairs(files.read_dot(spark, str(tmp_path / "out")).edges) == [(0, 0, 1)]


def test_numeric_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(2, 3))
    np.savez(tmp_path / "m.npz", adj_data=[1.0, 2.0], adj_indices=[1, 0], adj_indptr=[0, 1, 2])
    one = files.read_npy(spark, str(tmp_path / "a.npy")).first()
    assert one["shape"] == [2, 3] and one["data"] == [0, 1, 2, 3, 4, 5]
    e = files.csr_edges(files.read_npy(spark, str(tmp_path / "m.npz")))
    assert sorted((r["src"], r["dst"], r["w"]) for r in e.collect()) == [(0, 1, 1.0), (1, 0, 2.0)]
    g = GraphSet.from_arrays(spark, [{"x": [[1, 2], [3, 4]], "a": [[0, 1], [1, 0]]}])
    assert np.load(io.BytesIO(files.write_npy(g.nodes, "graph_id").first()["content"])).tolist() == [[1, 2], [3, 4]]
    (tmp_path / "t.txt").write_text("1 2\n3 4\n")
    assert [r["x"] for r in files.read_txt(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == [[1, 2], [3, 4]]
    files.write_csv(g.edges.select("src", "dst"), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "src long, dst long").count() == 2


def test_tu(spark, tmp_path):
    put = lambda n, t: (tmp_path / f"T_{n}.txt").write_text(t)
    put("A", "1, 2\n2, 1\n1, 2\n3, 3\n4, 5\n")
    put("graph_indicator", "1\n1\n1\n2\n2\n")
    put("node_labels", "0\n1\n0\n2\n2\n")
    put("graph_labels", "-1\n1\n")
    g = files.read_tu(spark, str(tmp_path), "T")
    assert pairs(g.edges) == [(0, 0, 1), (0, 1, 0), (1, 0, 1)] and g.n_features == 3
    assert g.nodes.where("graph_id = 1 AND node_id = 0").first()["x"] == [0, 0, 1]
    assert {r["graph_id"]: r["y"] for r in g.graphs.collect()} == {0: [1, 0], 1: [0, 1]}


def test_node_link(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "test": True}, {"id": "b", "val": True}, {"id": "c"}], "links": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}, {"source": "b", "target": "c"}]}))
    (tmp_path / "i.json").write_text(json.dumps({"a": 0, "b": 1, "c": 2}))
    (tmp_path / "c.json").write_text(json.dumps({"a": [1, 0], "b": [0, 1], "c": [1, 1]}))
    g = files.read_node_link(spark, *(str(tmp_path / f"{n}.json") for n in "gic"))
    assert pairs(g.edges) == [(0, 0, 1), (0, 1, 0), (0, 1, 2), (0, 2, 1)]
    rows = {r["node_id"]: r for r in g.nodes.collect()}
    assert rows[0]["mask_te"] and rows[1]["mask_va"] and rows[2]["mask_tr"] and rows[0]["y"] == [1, 0]


def test_adapters(spark):
    g = files.from_edge_index(spark, [{"num_nodes": 2, "edge_index": [[0, 1], [1, 0]], "node_feat": [[1], [2]], "edge_feat": [[5], [6]], "label": [1]}])
    assert pairs(g.edges) == [(0, 0, 1), (0, 1, 0)]
    q = files.coulomb(spark.createDataFrame([(0, [[1.0, 0.0], [2.0, 3.0]])], "graph_id long, m array<array<double>>"))
    assert pairs(q.edges) == [(0, 0, 0), (0, 1, 0), (0, 1, 1)]
    n = spark.createDataFrame([(0, i, i % 2) for i in range(40)], "graph_id long, node_id long, y long")
    m = files.citation_masks(n, "y", 5, 10)
    assert m.where("mask_tr").count() == 10 and m.where("mask_va").count() == 10 and m.where("mask_te").count() == 20


def test_stream_of_edges(spark, tmp_path):
    from loomgraph.streaming.live import windowed_degrees

    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS src, 2L AS dst, 2.0D AS w UNION ALL SELECT timestamp'2024-01-01 00:20:00', 1L, 3L, 1.0D")
    rows.write.parquet(str(tmp_path / "in"))
    q = windowed_degrees(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["src"], r["n"], r["weight"]) for r in spark.sql("SELECT * FROM live").collect()] == [(1, 2, 3.0)]
