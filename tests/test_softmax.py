"""A softmax over segments makes its rows once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import catalogue
from loomgraph.operators import linalg

DATA = "/root/testdata/sf0.001"
#: Queries with a softmax over neighbours, by the number of their finding, and how many scores they have.
SOFTMAXES = {
    14: ("segment_softmax", 1),
    2: ("conv_agnn", 1),
    6: ("conv_gat", 2),
    12: ("gat_attention", 1),
}


@pytest.mark.parametrize("name, scores", SOFTMAXES.values())
def test_rows_of_a_softmax_are_made_once(spark, name, scores):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("EXP(") == scores


def test_softmax_of_a_hub_of_rows_without_keys_and_of_odd_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, 7, float(v)) for i, v in enumerate(rng.normal(size=3000) * 300)] + [(0, i, 8, 5.0) for i in (1, 1, 2)]
    rows += [(1, 1, 7, None), (1, 2, 7, 2.0), (1, 3, 9, -1e300), (None, 1, 7, 1.0), (0, 1, None, 1.0)]
    got = linalg.segment_softmax(spark.createDataFrame(rows, "graph_id long, src long, dst long, s double"), "dst", F.col("s")).collect()
    want = []
    for g, src, dst, s in rows:
        if g is None or dst is None:
            continue
        same = np.array([r[3] for r in rows if r[0] == g and r[2] == dst and r[3] is not None])
        want.append((g, src, dst, s, None if s is None else np.exp(s - same.max()) / (np.exp(same - same.max()).sum() + 1e-9)))
    key = lambda r: (*r[:3], r[3] or 0.0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:4] == b[:4] and a["alpha"] == (b[4] if b[4] is None else pytest.approx(b[4], rel=1e-12))
    assert set(got[0].asDict()) == {"graph_id", "src", "dst", "s", "alpha"}
