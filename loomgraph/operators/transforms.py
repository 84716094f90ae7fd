"""Graph-to-graph transforms and ways to build edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vec as V
from loomgraph.operators import filters, linalg
from loomgraph.operators.model import GraphSet


def constant(g: GraphSet, value: float) -> GraphSet:
    return g.with_x(g.nodes.withColumn("x", F.concat("x", F.array(F.lit(float(value))))), g.n_features + 1)


def _with_column(g: GraphSet, values: DataFrame, part: Callable[[str], Column], width: int = 1) -> GraphSet:
    """``values`` (graph_id, node_id, v) behind every node's features."""
    joined = g.nodes.join(values, ["graph_id", "node_id"], "left")
    return g.with_x(joined.withColumn("x", F.concat("x", part("v"))).drop("v"), g.n_features + width)


def degree_one_hot(g: GraphSet, max_degree: int) -> GraphSet:
    """One-hot of the integer row sum; a larger degree raises."""
    d = filters.degrees(g.edges, g.nodes).withColumn("v", F.col("d").cast("int")).drop("d")
    return _with_column(g, d, lambda c: V.one_hot(F.col(c), max_degree + 1), max_degree + 1)


def max_degree(g: GraphSet) -> DataFrame:
    return filters.degrees(g.edges, g.nodes).groupBy("graph_id").agg(F.max("d").alias("max_degree"))


def clustering_coefficient(g: GraphSet) -> GraphSet:
    """Share of linked pairs among a node's neighbours in the undirected simple graph; 0 under two neighbours."""
    e = g.edges.where("src <> dst AND w <> 0")
    u = e.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = u.unionByName(u.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
    k = both.groupBy("graph_id", F.col("a").alias("node_id")).agg(F.count("*").alias("k"))
    # a triangle is found once: a < b < c
    bc = u.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c"))
    ac = u.select("graph_id", "a", F.col("b").alias("c"))
    tri = u.join(bc, ["graph_id", "b"]).join(ac, ["graph_id", "a", "c"])
    t = tri.select("graph_id", F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("t"))
    v = k.join(t, ["graph_id", "node_id"], "left").where("k > 1").select("graph_id", "node_id", (2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("v"))
    return _with_column(g, v, lambda c: F.array(F.coalesce(F.col(c), F.lit(0.0))))


def normalize_one(g: GraphSet) -> GraphSet:
    """Rows divided by their sums; rows of sum 0 stay."""
    s = V.total(V.items("x", g.n_features))
    return g.with_x(g.nodes.withColumn("x", V.vec([p / F.when(s == 0, F.lit(1.0)).otherwise(s) for p in V.items("x", g.n_features)])), g.n_features)


def normalize_sphere(g: GraphSet) -> GraphSet:
    """(x - mean of the nodes) / largest absolute value before centring; all zeros stay zeros."""
    n = g.n_features
    stats = g.nodes.groupBy("graph_id").agg(*[F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(n)], F.max(F.greatest(*[F.abs(F.col("x")[i]) for i in range(n)]) if n > 1 else F.abs(F.col("x")[0])).alias("_s"))
    x = V.vec([(F.col("x")[i] - F.col(f"_m{i}")) / F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s")) for i in range(n)])
    return g.with_x(g.nodes.join(stats, "graph_id").withColumn("x", x).select(*g.nodes.columns), n)


def one_hot_labels(rows: DataFrame, label: Column, depth: int | None = None, labels: Sequence | None = None) -> DataFrame:
    if depth is None and labels is None:
        raise ValueError("depth or labels are needed")
    return rows.withColumn("y", V.one_hot(label.cast("int"), depth) if depth is not None else V.label_one_hot(label, labels))


def gcn_filter(g: GraphSet, symmetric: bool = True) -> GraphSet:
    return g.with_edges(filters.gcn_filter(g.edges, g.nodes, symmetric))


def normalize_adj(g: GraphSet, symmetric: bool = True) -> GraphSet:
    return g.with_edges(filters.normalized_adjacency(g.edges, g.nodes, symmetric))


def sgc_filter(g: GraphSet, k: int) -> GraphSet:
    """The adjacency squared k - 1 times (2^(k-1) hops)."""
    a = g.edges
    for _ in range(k - 1):
        a = linalg.spspmm(a, a)
    return g.with_edges(a)


def _smallest() -> Callable:
    """The eigenvector of the smallest eigenvalue of a symmetric matrix among vectors orthogonal to those held.

    Lanczos' method: every vector is made orthogonal to all before it, and a full basis begins again with its better half.
    It goes on until the vector is right to about 1e-10, or to 1e-14 over the gap to the next value.  As in other
    functions for workers, what goes there is built here, so workers need not import this package.
    """

    def smallest(times: Callable, held: np.ndarray) -> np.ndarray:
        n = held.shape[1]
        most = min(300, max(40, 2**24 // n), n - len(held))  # 128 MB, but for more than 400,000 nodes
        basis, t, kept = np.empty((most + 1, n)), np.zeros((most, most)), 0

        def clear(v: np.ndarray, rows: int) -> np.ndarray:
            """Takes from v its parts along the vectors held and along the basis; returns the latter."""
            parts = np.zeros(rows)
            for _ in range(2):
                v -= (held @ v) @ held
                h = basis[:rows] @ v
                v -= h @ basis[:rows]
                parts += h
            return parts

        v = np.random.default_rng(len(held)).standard_normal(n)
        clear(v, 0)
        basis[0] = v / np.linalg.norm(v)
        while True:
            for at in range(kept, most):
                v = times(basis[at])
                t[: at + 1, at] = t[at, : at + 1] = clear(v, at + 1)
                rest = np.linalg.norm(v)
                last = rest < 1e-13  # the basis holds a vector of every eigenvalue
                if last or at % 20 == 19 or at + 1 == most:
                    values, y = np.linalg.eigh(t[: at + 1, : at + 1])
                    gap = values[1] - values[0] if at else 0.0
                    if last or at + 1 == n - len(held) or rest * abs(y[-1, 0]) <= max(1e-14, min(1e-12, 1e-10 * gap)):
                        v = y[:, 0] @ basis[: at + 1]
                        return v / np.linalg.norm(v)
                basis[at + 1] = v / rest
            kept = most // 2
            for c in range(0, n, 4096):
                basis[:kept, c : c + 4096] = y[:, :kept].T @ basis[:most, c : c + 4096]
            basis[kept] = basis[most]
            t[:] = 0
            t[np.arange(kept), np.arange(kept)] = values[:kept]

    return smallest


def laplacian_pe(g: GraphSet, k: int, dense: int = 500) -> GraphSet:
    """The k eigenvectors of smallest magnitude of the normalised Laplacian; the largest entry is positive.

    A graph is solved in one task; 0 < k < n.  Graphs of up to ``dense`` nodes, and those with negative weights or
    without symmetry, take a dense solver.  For all others memory grows with nodes and edges: eigenvalue 0 has one
    vector for each component, sqrt(degree) (that of more nodes first, then that of the smallest node), and the next
    ones come from ``_smallest``, which needs the more products the nearer the eigenvalues lie to each other.
    """
    smallest = _smallest()
    lap = filters.normalized_laplacian(g.edges, g.nodes).select(*filters.COO, F.lit(None).cast("double").alias("d"))
    ids = filters.degrees(g.edges, g.nodes).select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("w"), "d")

    def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The smallest number in the component of each node."""
        low = np.arange(n)
        while not np.array_equal(low[i], low[j]):
            a, b = low[i], low[j]
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(low[low], low):
                low = low[low]
        return low

    def sparse(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray | None:
        """Eigenvectors as rows; None where 0 is not known to be the least possible eigenvalue."""
        cells, at = np.unique(np.concatenate([i * n + j, j * n + i]), return_inverse=True)
        i, j, w = cells // n, cells % n, np.bincount(at, np.concatenate([w, w]) / 2)
        root = np.sqrt(np.where(d > 0, d, 1.0))
        rest = np.bincount(i, w * root[j], n) / root
        if not (np.isfinite(w).all() and (w[i != j] <= 0).all() and (d >= 0).all() and (rest >= -1e-10).all()):
            return None
        off = (i != j) & (w != 0)
        low = components(n, i[off], j[off])
        size, most = np.bincount(low, minlength=n), np.zeros(n)
        np.maximum.at(most, low, rest)
        null = np.flatnonzero((size > 0) & (most <= 1e-10))
        null = null[np.argsort(-size[null], kind="stable")][:k]
        held = np.where(low == null[:, None], root, 0.0)
        held /= np.linalg.norm(held, axis=1, keepdims=True)
        rows, starts = np.unique(i, return_index=True)

        def times(v: np.ndarray) -> np.ndarray:
            out = np.zeros(n)
            out[rows] = np.add.reduceat(w * v[j], starts)
            return out

        while len(held) < k:
            held = np.vstack([held, smallest(times, held)])
        return held

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["src"])
        n = len(names)
        if not 0 < k < n:
            raise ValueError("k lies between 0 and the number of nodes")
        i, j, w, d = np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"]), pdf["w"].to_numpy(), np.zeros(n)
        own = pdf["d"].notna().to_numpy()
        d[i[own]] = pdf["d"].to_numpy()[own]
        found = sparse(n, i, j, w, d) if n > dense else None
        if found is None:
            m = np.zeros((n, n))
            np.add.at(m, (i, j), w)
            values, vectors = np.linalg.eigh((m + m.T) / 2)
            found = vectors[:, np.argsort(np.abs(values), kind="stable")[:k]].T
        vectors = found.T * np.sign(found[np.arange(k), np.argmax(np.abs(found), axis=1)])
        return pd.DataFrame({"graph_id": pdf["graph_id"].iat[0], "node_id": names, "v": list(vectors)})

    pe = lap.unionByName(ids).groupBy("graph_id").applyInPandas(solve, "graph_id long, node_id long, v array<double>")
    return _with_column(g, pe, F.col, k)


def _triangulate(p: np.ndarray) -> set[tuple[int, int]]:
    """Edges of a Delaunay triangulation of points in the plane; of equal points the first takes part.

    Points are added one after the other in rounds that double, each round from cell to cell, so walks to the
    triangle of a point are short.  A vertex at infinity (-1) closes the hull.  Coordinates become integers, so all
    tests are exact; points in line are joined in their order, and of points on one circle either diagonal may stay.
    """
    _, firsts = np.unique(p + 0.0, axis=0, return_index=True)
    firsts = firsts[np.isfinite(p[firsts]).all(axis=1)]
    ratios = {i: [float(v).as_integer_ratio() for v in p[i]] for i in firsts.tolist()}
    scale = max((d for r in ratios.values() for _, d in r), default=1)  # powers of two, so each divides the largest
    at = {i: (x[0] * (scale // x[1]), y[0] * (scale // y[1])) for i, (x, y) in ratios.items()}

    def turn(a: int, b: int, c: int) -> int:
        (ax, ay), (bx, by), (cx, cy) = at[a], at[b], at[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def conflict(a: int, b: int, c: int, q: int) -> bool:
        """Whether q lies inside the circle of the triangle; for an edge of the hull, outside of it or on it."""
        if a < 0 or b < 0 or c < 0:
            u, v = (b, c) if a < 0 else (c, a) if b < 0 else (a, b)
            side = turn(u, v, q)
            if side:
                return side > 0
            (ux, uy), (vx, vy), (qx, qy) = at[u], at[v], at[q]
            return (ux - qx) * (vx - qx) + (uy - qy) * (vy - qy) < 0
        qx, qy = at[q]
        ax, ay, bx, by, cx, cy = at[a][0] - qx, at[a][1] - qy, at[b][0] - qx, at[b][1] - qy, at[c][0] - qx, at[c][1] - qy
        return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    xy = p[firsts]
    side = max(1, int(len(firsts) ** 0.5 / 2))
    cells = np.minimum(((xy / 2 - xy.min(axis=0, initial=np.inf) / 2) / np.maximum(np.ptp(xy / 2, axis=0), 1e-300) * side).astype(int), side - 1) if len(firsts) else np.zeros((0, 2), int)
    back = np.where(cells[:, 0] % 2 == 1, side - cells[:, 1], cells[:, 1])
    rounds = -np.random.default_rng(0).geometric(0.5, len(firsts))
    order = firsts[np.lexsort((firsts, back, cells[:, 0], rounds))].tolist()
    third = next((i for i in range(2, len(order)) if turn(order[0], order[1], order[i])), None)
    if third is None:
        line = sorted(order, key=lambda i: at[i])
        return {(min(e), max(e)) for e in zip(line, line[1:], strict=False)}
    a, b, c = order[0], order[1], order.pop(third)
    if turn(a, b, c) < 0:
        a, b = b, a
    apex: dict[tuple[int, int], int] = {}  # directed edge -> third corner of the triangle on its left

    def put(u: int, v: int, w: int) -> None:
        apex[u, v], apex[v, w], apex[w, u] = w, u, v

    for t in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
        put(*t)
    last = (a, b)
    for q in order[2:]:
        u, v = last
        w = apex[u, v]
        while w >= 0:  # walk to the triangle that holds q, or to the edge of the hull that sees it
            if turn(v, w, q) < 0:
                u, v = w, v
            elif turn(w, u, q) < 0:
                u, v = u, w
            elif turn(u, v, q) < 0:
                u, v = v, u
            else:
                break
            w = apex[u, v]
        rim, todo = [], [(u, v), (v, w), (w, u)]
        for e in todo:
            del apex[e]
        while todo:
            u, v = todo.pop()
            w = apex.get((v, u), -2)
            if w != -2 and conflict(v, u, w, q):
                del apex[v, u], apex[u, w], apex[w, v]
                todo += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            put(u, v, q)
            if u >= 0 and v >= 0:
                last = (u, v)
    return {(min(u, v), max(u, v)) for u, v in apex if u >= 0 and v >= 0}


def delaunay(g: GraphSet) -> GraphSet:
    """Edges of the Delaunay triangulation of 2-D features, both directions, weight 1."""
    if g.n_features != 2:
        raise ValueError("two features are needed")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        ids = pdf["node_id"].to_numpy()
        pairs = _triangulate(np.stack(pdf["x"]).astype(float)) if len(ids) > 2 else {(i, j) for j in range(len(ids)) for i in range(j)}
        rows = [(s, d) for a, b in sorted(pairs) for s, d in ((ids[a], ids[b]), (ids[b], ids[a]))]
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iat[0]] * len(rows), "src": [r[0] for r in rows], "dst": [r[1] for r in rows], "w": [1.0] * len(rows)})

    return g.with_edges(g.nodes.select("graph_id", "node_id", "x").groupBy("graph_id").applyInPandas(solve, "graph_id long, src long, dst long, w double"))


# -- building edges ------------------------------------------------------------------------------


def symmetrised(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, weight 1, once."""
    e = edges.select("graph_id", "src", "dst")
    return e.unionByName(linalg.transpose(e)).distinct().withColumn("w", F.lit(1.0))


def _packed(k: int, steps: int = 0) -> Callable:
    """Rows (graph_id, node_id, x, pack) of one pack as one row: ids, vectors and the cells that hold a value, as bytes.

    Of equal vectors the k + 1 of smallest id come among the first ``kept`` rows, which are enough as candidates.  Vectors
    are stored as bytes where all entries are multiples of 1/64 below 2, else as float32 where nothing is lost, else as
    float64; ``known`` is empty where every cell holds a value.  With ``steps`` entries are rounded to multiples of
    1 / steps, halves upwards, within the bounds of a long and with 0 for NaN, as ``floor`` does.  The functions that go to workers are built here and below,
    so workers need not import this package.
    """

    def first_copies(ids, x, known):
        """The rows of a pack without more than k + 1 equal ones, where its ids differ."""
        if len(ids) <= k + 1 or len(np.unique(ids)) < len(ids) or not x.shape[1]:
            return np.ones(len(ids), dtype=bool)
        rows = np.ascontiguousarray(np.hstack([x, known.astype(np.float64)]))
        _, kind = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.argsort(kind, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids)) - np.searchsorted(kind[order], kind[order])
        return place <= k

    def narrowed(x):
        with np.errstate(all="ignore"):
            steps = x * 64
            if np.all(np.abs(steps) <= 127) and np.array_equal(steps, np.rint(steps)):
                return "int8", steps.astype(np.int8)
            short = x.astype(np.float32)
            return ("float32", short) if np.array_equal(short, x, equal_nan=True) else ("float64", x)

    def pack(rows: pa.Table) -> pa.Table:
        x = rows["x"].combine_chunks()
        lengths = np.array([0 if n is None else n for n in pc.list_value_length(x).to_pylist()], dtype=np.int64)
        width = int(lengths.max(initial=0))
        flat = x.drop_null().flatten()
        has = np.arange(width) < lengths[:, None]
        values, known = np.zeros((len(x), width)), np.zeros((len(x), width), dtype=bool)
        values[has], known[has] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
        if steps:
            with np.errstate(all="ignore"):
                values = np.clip(np.nan_to_num(np.floor(values * steps + 0.5), nan=0.0), -(2.0**63), 2.0**63) / steps
        ids = rows["node_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        first = first_copies(ids[order], values[order], known[order])
        order = np.concatenate([order[first], order[~first]])
        kind, cells = narrowed(values[order])
        names = ["graph_id", "pack", "ids", "kept", "kind", "x", "known"]
        cells = [rows["graph_id"][0].as_py(), rows["pack"][0].as_py(), ids[order].tobytes(), int(first.sum()), kind, cells.tobytes(), b"" if known.all() else known[order].tobytes()]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([c], t) for n, c, t in zip(names, cells, types, strict=True)})

    return pack


def _nearest_in_packs(k: int, ends: int = 0, rows_at_once: int = 128) -> Callable:
    """The k nearest nodes for each node of a pack, which comes before the packs of its candidates.

    ``ends``: so many first components of both nodes come along, as s and t.

    One product of matrices bounds all distances to a pack of candidates; only those within its rounding error of the
    k-th so far are computed again, term by term, so distances and ties are exact.  The product is in single precision,
    and in double where that leaves too many.  Vectors with gaps, infinities or very large entries, or of another
    length, are compared without that bound.  Products and comparisons are written into the same memory again and
    again: fresh pages would cost as much as the products.
    """
    groups = 16 * (k + 1)
    memory = {}

    def space(kind, rows, columns):
        if kind not in memory or len(memory[kind]) < rows * columns:
            memory[kind] = np.empty(rows * columns, kind)
        return memory[kind][: rows * columns].reshape(rows, columns)

    def load(ids, kind, x, known):
        """Ids, cells as they are stored, and where they hold a value; None: everywhere."""
        ids = np.frombuffer(ids, np.int64)
        x = np.frombuffer(x, kind).reshape(len(ids), -1)
        return ids, x, np.frombuffer(known, bool).reshape(x.shape) if known else None

    def reals(x):
        return x.astype(np.float64) / 64 if x.dtype == np.int8 else x.astype(np.float64)

    def cells(x, known):
        return reals(x), np.ones(x.shape, dtype=bool) if known is None else known

    def widened(m, width):
        return m if m.shape[1] == width else np.hstack([m, np.zeros((len(m), width - m.shape[1]), m.dtype)])

    def regular(x, known):
        big = np.abs(x).max(axis=1, initial=0.0)
        return known.all(axis=1) & (big < 1e150) & (x.shape[1] > 0)

    def exact(x_a, known_a, x_b, known_b, i, j):
        """Distances of the pairs (i, j), summed in the order of components, and whether any component is known in both."""
        total, some = np.zeros(len(i)), np.zeros(len(i), dtype=bool)
        whole = known_a.all() and known_b.all()
        for at in range(0, len(i), 4096):
            p, q = i[at : at + 4096], j[at : at + 4096]
            gap = x_a[p] - x_b[q]
            gap *= gap
            if whole:
                some[at : at + 4096] = x_a.shape[1] > 0
            else:
                both = known_a[p] & known_b[q]
                gap[~both] = 0.0
                some[at : at + 4096] = both.any(axis=1)
            part = total[at : at + 4096]
            for column in np.ascontiguousarray(gap.T):
                part += column
        return total, some

    def best(i, ids, d2, some, *held):
        """The k nearest of each i: numbers, then NaN, then nothing; ties to the smaller id."""
        order = np.lexsort((ids, d2, i) if some.all() else (ids, np.where(some, d2, 0.0), ~some, i))
        order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
        return tuple(c[order] for c in (i, ids, d2, some, *held))

    def within(x, own, y, norms, bound, rank, kind):
        """Pairs of x and y that may lie within the bound, or among the ``rank`` nearest where that is less."""
        width, far = x.shape[1], float(np.sqrt(norms.max()))
        left = np.hstack([x, np.ones((len(x), 1))]).astype(kind)
        right = np.hstack([-2.0 * y, norms[:, None]]).astype(kind)
        slack = (8 * width + 64) * (6e-8 if kind is np.float32 else 2.3e-16) * (np.sqrt(own) + far) ** 2 + (1e-30 if kind is np.float32 else 1e-300)
        i, j = [], []
        for start in range(0, len(x), rows_at_once):
            part = slice(start, start + rows_at_once)
            d2 = np.matmul(left[part], right.T, out=space(kind, len(left[part]), len(right)))
            limit = bound[part] - own[part]
            if not np.isfinite(limit).all():
                n = len(y) // groups  # the least of n candidates each; their rank-th is a bound as well
                lows = d2[:, : n * groups].reshape(len(d2), n, groups).min(axis=1) if n > 1 and rank <= groups else d2
                limit = np.minimum(limit, np.partition(lows, rank - 1, axis=1)[:, rank - 1] if rank <= lows.shape[1] else np.inf)
            hits = np.flatnonzero(np.less_equal(d2, (limit + slack[part]).astype(kind)[:, None], out=space(bool, *d2.shape)))
            if kind is np.float32 and len(hits) > 8 * rank * len(d2):
                return within(x, own, y, norms, bound, rank, np.float64)
            i.append(start + hits // len(y))
            j.append(hits % len(y))
        return np.concatenate(i), np.concatenate(j)

    def counted(x, y, bound, rank):
        """Of two packs of whole 64ths, what ``within`` finds, and the distances.

        All sums are whole numbers below 2^24, so they are exact in single precision and nothing is computed again.
        """
        n, width = y.shape
        left = np.ones((len(x), width + 1), np.float32)
        left[:, :width] = x
        right = np.zeros((n + -n % 8, width + 1), np.float32)
        right[:n, :width] = y
        right[:n, width] = np.einsum("ij,ij->i", right[:n, :width], right[:n, :width])
        right[n:, width] = 2.0**25  # farther than any limit
        right[:, :width] *= -2
        own = np.einsum("ij,ij->i", left[:, :width], left[:, :width])
        limits = np.minimum(bound * 4096 - own, 2.0**24)
        i, j, found = [], [], []
        for start in range(0, len(x), rows_at_once):
            part = slice(start, start + rows_at_once)
            d2 = np.matmul(left[part], right.T, out=space(np.float32, len(left[part]), len(right)))
            limit = limits[part]
            if (limit == 2.0**24).any():
                m = n // groups
                lows = d2[:, : m * groups].reshape(len(d2), m, groups).min(axis=1) if m > 1 and rank <= groups else d2[:, :n]
                limit = np.minimum(limit, np.partition(lows, rank - 1, axis=1)[:, rank - 1] if rank <= lows.shape[1] else np.inf)
            near = np.less_equal(d2, limit.astype(np.float32)[:, None], out=space(bool, *d2.shape)).reshape(-1)
            hits = (np.flatnonzero(near.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)  # eight cells at once
            hits = hits[near[hits]]
            i.append(start + hits // len(right))
            j.append(hits % len(right))
            found.append(d2.reshape(-1)[hits])
        i = np.concatenate(i)
        return i, np.concatenate(j), (np.concatenate(found).astype(np.float64) + own[i]) / 4096

    def begin(a):
        none = np.zeros(0, dtype=np.int64)
        held = (np.zeros((0, ends)), np.zeros((0, ends), dtype=bool)) if ends else ()
        return {"rows": a, "best": (none, none, np.zeros(0), np.zeros(0, dtype=bool), *held), "bound": np.full(len(a[0]), np.inf)}

    def beginning(x, known):
        """The first components, and whether they hold a value."""
        values, has = cells(x[:, :ends], None if known is None else known[:, :ends])
        return widened(values, ends), widened(has, ends)

    def between(a, b, bound):
        """Pairs of rows that may be among the nearest, not all with another id, in parts: i, j, distances, whether there is any."""
        (ids_a, x_a, known_a), (ids_b, x_b, known_b) = a, b
        if x_a.dtype == x_b.dtype == np.int8 and known_a is None and known_b is None and 0 < x_a.shape[1] == x_b.shape[1] <= 256 and len(ids_a) and len(ids_b):
            i, j, d2 = counted(x_a, x_b, bound, k + int(np.unique(ids_b, return_counts=True)[1].max()))
            yield i, j, d2, np.ones(len(i), dtype=bool)
            return
        (x_a, known_a), (x_b, known_b), width = cells(x_a, known_a), cells(x_b, known_b), max(x_a.shape[1], x_b.shape[1])
        x_a, known_a, x_b, known_b = widened(x_a, width), widened(known_a, width), widened(x_b, width), widened(known_b, width)
        plain_a, plain_b = regular(x_a, known_a), regular(x_b, known_b)
        clean, rest, near, odd = np.flatnonzero(plain_a), np.flatnonzero(~plain_a), np.flatnonzero(plain_b), np.flatnonzero(~plain_b)
        parts = [(rest[s : s + rows_at_once], np.arange(len(ids_b))) for s in range(0, len(rest), rows_at_once)] + [(clean, odd)]
        pairs = [(np.repeat(p, len(q)), np.tile(q, len(p))) for p, q in parts if len(p) and len(q)]
        if len(clean) and len(near):
            x, y = x_a[clean], x_b[near]
            own, norms = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            rank = k + int(np.unique(ids_b[near], return_counts=True)[1].max())  # a node is no neighbour of its own
            small = max(np.abs(x).max(), np.abs(y).max()) < 1e15
            i, j = within(x, own, y, norms, bound[clean], rank, np.float32 if small else np.float64)
            pairs.append((clean[i], near[j]))
        for i, j in pairs:
            other = ids_a[i] != ids_b[j]
            with np.errstate(all="ignore"):
                yield i[other], j[other], *exact(x_a, known_a, x_b, known_b, i[other], j[other])

    def offer(state, b):
        """Takes a pack of candidates."""
        ids_a, ids_b = state["rows"][0], b[0]
        begins = beginning(*b[1:]) if ends else ()
        for i, j, d2, some in between(state["rows"], b, state["bound"]):
            other = ids_a[i] != ids_b[j]
            i, j, d2, some = i[other], j[other], d2[other], some[other]
            if len(i):
                found = best(*(np.concatenate(c) for c in zip(state["best"], (i, ids_b[j], d2, some, *(c[j] for c in begins)), strict=True)))
                state["best"] = found
                last = np.flatnonzero(np.bincount(found[0], minlength=len(ids_a)) == k)
                d2 = np.where(found[3], found[2], np.inf)[np.searchsorted(found[0], last, side="right") - 1]
                state["bound"][last] = np.where(np.isnan(d2), np.inf, d2)

    def lists(values, has):
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, ends, dtype=np.int32), pa.array(values.reshape(-1), mask=~has.reshape(-1)))

    def rows(graph, state):
        i, ids, d2, some, *held = state["best"]
        found = {"graph_id": pa.array(np.full(len(i), graph), pa.int64()), "src": state["rows"][0][i], "dst": ids, "d2": pa.array(d2, mask=~some)}
        if ends:
            found |= {"s": lists(*(c[i] for c in beginning(*state["rows"][1:]))), "t": lists(*held)}
        return pa.record_batch(found)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            for r in range(batch.num_rows):
                graph, pack, candidate, ids, kept, *stored = (batch.column(c)[r].as_py() for c in range(8))
                if not candidate:
                    if state:
                        yield rows(key[0], state)
                    key, state = (graph, pack), begin(load(ids, *stored))
                elif key == (graph, pack):  # else that pack is empty
                    offer(state, tuple(m if m is None else m[:kept] for m in load(ids, *stored)))
        if state:
            yield rows(key[0], state)

    return nearest


def knn_edges(nodes: DataFrame, n: int, k: int, pack: int = 2048, steps: int = 0, ends: int = 0) -> DataFrame:
    """Directed edges (weight 1, d2) to the k nearest other nodes of the same graph, ties to the smaller id.

    All pairs of a graph are compared, pack by pack of about ``pack`` nodes.  Components that are null or missing on
    one side do not count; a distance without any component is null and comes last, after NaN.  ``steps``: vectors are
    rounded to multiples of 1 / steps first.  ``ends``: so many first components of both nodes follow, as s and t.
    """
    x = F.col("x") if dict(nodes.dtypes)["x"] in ("array<float>", "array<double>") else F.col("x").cast("array<double>")
    rows = nodes.where("graph_id IS NOT NULL AND node_id IS NOT NULL").select("graph_id", "node_id", x.alias("x"))
    packs = rows.groupBy("graph_id").agg(F.ceil(F.count("*") / pack).cast("long").alias("packs"))
    dealt = rows.join(packs, "graph_id").withColumn("pack", F.pmod(F.xxhash64("node_id"), F.col("packs")))
    packed = dealt.select("graph_id", "node_id", "x", "pack").groupBy("graph_id", "pack").applyInArrow(_packed(k, steps), "graph_id long, pack long, ids binary, kept long, kind string, x binary, known binary")
    cells = ["ids", "kept", "kind", "x", "known"]
    # a pack goes to its own task, before all candidates, and as candidates to the task of each pack of its graph
    goals = packed.join(packs, "graph_id").withColumn("_to", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("packs") - 1)))
    sent = goals.select("graph_id", F.when(F.col("_to") < 0, F.col("pack")).otherwise(F.col("_to")).alias("pack"), (F.col("_to") >= 0).alias("candidate"), *cells)
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    sent = sent.repartition(tasks, "graph_id", "pack").sortWithinPartitions("graph_id", "pack", "candidate")
    both = ["s", "t"] if ends else []
    found = sent.mapInArrow(_nearest_in_packs(k, ends), "graph_id long, src long, dst long, d2 double" + "".join(f", {c} array<double>" for c in both))
    return found.select("graph_id", "src", "dst", F.lit(1.0).alias("w"), "d2", *both)


def grid_nodes(spark, side: int) -> DataFrame:
    """Points of the unit square, ``side`` by ``side``."""
    step = 1.0 / max(1, side - 1)
    rows = spark.range(side * side).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node_id"))
    return rows.withColumn("x", F.array(F.pmod("node_id", F.lit(side)) * step, F.floor(F.col("node_id") / side) * step))


def flip_edges(edges: DataFrame, nodes: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Toggles a share ``p`` of all cells of each graph's matrix, chosen by hash."""
    cells = nodes.select("graph_id", F.col("node_id").alias("src")).join(nodes.select("graph_id", F.col("node_id").alias("dst")), "graph_id")
    flip = cells.where(V.uniform(seed, "graph_id", "src", "dst") < p).withColumn("_f", F.lit(True))
    both = edges.select(*filters.COO).join(flip, ["graph_id", "src", "dst"], "full")
    return both.withColumn("w", F.when(F.col("_f").isNotNull() & F.col("w").isNotNull(), 0.0).when(F.col("w").isNotNull(), F.col("w")).otherwise(1.0)).drop("_f").where("w <> 0")


def random_graphs(spark, n_graphs: int, n_nodes: int, p: float, seed: int = 0) -> GraphSet:
    """Undirected random graphs with a one-hot colour of three as features; hashes make them reproducible."""
    h = lambda *c: V.uniform(seed, *c)
    nodes = spark.range(n_graphs * n_nodes).select(F.floor(F.col("id") / n_nodes).alias("graph_id"), F.pmod("id", F.lit(n_nodes)).alias("node_id"))
    nodes = nodes.withColumn("x", V.one_hot(F.floor(h("graph_id", "node_id") * 3).cast("int"), 3))
    a, b = nodes.select("graph_id", F.col("node_id").alias("src")), nodes.select("graph_id", F.col("node_id").alias("dst"))
    upper = a.join(b, "graph_id").where("src < dst").where(h("graph_id", "src", "dst", 1) < p)
    return GraphSet(nodes, symmetrised(upper), None, 3)


def reordered(edges: DataFrame) -> DataFrame:
    """Edges in row order; a range-partitioned sort, so the order holds over all partitions."""
    return edges.orderBy("graph_id", "src", "dst")
