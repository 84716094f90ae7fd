"""Small helpers: ragged arrays, run logs, timers, plans as text."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

_TIMES: list[float] = []


def flatten(values: Iterable) -> list:
    """Depth-first items of nested lists and tuples."""
    return [x for v in values for x in (flatten(v) if isinstance(v, (list, tuple)) else [v])]


def pad_jagged(rows: Sequence[Sequence[float]], width: int = -1) -> list[list[float]]:
    """Rows of zeros-padded numbers; -1 takes the width of the first row."""
    if not rows:
        raise ValueError("no rows")
    n = len(rows[0]) if width == -1 else width
    return [[*r, *[0.0] * (n - len(r))] for r in rows]


def init_logging(name: str, folder: str = "logs") -> Path:
    """A folder for a run, with log.txt in it that ``log`` appends to."""
    run = Path(folder) / f"{time.strftime('%Y-%m-%d-%H-%M-%S')}-{name}"
    run.mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("loomgraph")
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    logger.addHandler(logging.FileHandler(run / "log.txt"))
    logger.setLevel(logging.INFO)
    return run


def log(message: str, echo: bool = True) -> None:
    logging.getLogger("loomgraph").info(message)
    if echo:
        print(message)


def tic() -> None:
    _TIMES.append(time.perf_counter())


def toc() -> float:
    """Seconds since the last ``tic``."""
    return time.perf_counter() - _TIMES.pop()


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
