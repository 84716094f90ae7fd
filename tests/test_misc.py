from pathlib import Path

from loomgraph.functions import misc


def test_helpers(spark, tmp_path):
    assert misc.flatten([["b", [7]], [], 0, [[[None]], 2.5]]) == ["b", 7, 0, None, 2.5]
    assert misc.pad_jagged([[5, 8], [], [6]]) == [[5, 8], [0, 0], [6, 0]]
    run = misc.init_logging("t", str(tmp_path))
    misc.log("hello", echo=False)
    assert (Path(run) / "log.txt").read_text() == "hello\n"
    misc.tic()
    assert misc.toc() >= 0
    assert "Range" in misc.plan_text(spark.range(3))
