"""Vectors as array<double> columns and small literal matrices.

All helpers build built-in expressions.  Dimensions are known when a plan is built, so products with a
literal matrix become plain arithmetic that whole-stage code generation compiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]
EPSILON = 1e-7


def dyadic(n_in: int, n_out: int, layer: int = 0) -> list[list[float]]:
    """A reproducible weight matrix of eighths: W[i][j] = ((7 i + 13 j + 3 layer) mod 11 - 5) / 8."""
    return [[((7 * i + 13 * j + 3 * layer) % 11 - 5) / 8 for j in range(n_out)] for i in range(n_in)]


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A number in [0, 1) that only the seed and the keys decide: the first 48 bits of an MD5 digest."""
    text = F.concat_ws("|", *[(F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string") for k in (seed, *keys)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def items(x: Column | str, n: int) -> list[Column]:
    c = F.col(x) if isinstance(x, str) else x
    return [c[i] for i in range(n)]


def vec(parts: Sequence[Column]) -> Column:
    return F.array(*parts) if parts else F.array().cast("array<double>")


def total(parts: Sequence[Column]) -> Column:
    parts = list(parts)
    out = parts[0] if parts else F.lit(0.0)
    for p in parts[1:]:
        out = out + p
    return out


def affine(parts: Sequence[Column], w: Matrix, b: Sequence[float] | None = None) -> list[Column]:
    """x W + b for a row vector x."""
    out = [total([p * F.lit(float(w[i][j])) for i, p in enumerate(parts)]) for j in range(len(w[0]))]
    return [o + F.lit(float(b[j])) for j, o in enumerate(out)] if b is not None else out


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def l2_normalised(parts: Sequence[Column]) -> list[Column]:
    """x / sqrt(max(sum of squares, 1e-12))."""
    norm = F.sqrt(F.greatest(dot(parts, parts), F.lit(1e-12)))
    return [p / norm for p in parts]


def softmax(parts: Sequence[Column]) -> list[Column]:
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    e = [F.exp(p - top) for p in parts]
    z = total(e)
    return [x / z for x in e]


ACTIVATIONS = {
    "linear": lambda c: c,
    "relu": lambda c: F.greatest(c, F.lit(0.0)),
    "leaky_relu": lambda c: F.when(c > 0, c).otherwise(c * 0.2),
    "elu": lambda c: F.when(c > 0, c).otherwise(F.exp(c) - 1),
    "sigmoid": lambda c: 1 / (1 + F.exp(-c)),
    "tanh": F.tanh,
    "softplus": lambda c: F.log1p(F.exp(c)),
}


def prelu(alpha: float = 0.0):
    return lambda c: F.greatest(c, F.lit(0.0)) + F.lit(alpha) * F.least(c, F.lit(0.0))


def activate(parts: Sequence[Column], name) -> list[Column]:
    """``name``: None, a name of ``ACTIVATIONS``, "softmax" (over the vector), "prelu" or a callable."""
    if name == "softmax":
        return softmax(parts)
    f = name if callable(name) else prelu() if name == "prelu" else ACTIVATIONS[name or "linear"]
    return [f(p) for p in parts]


def mlp(parts: Sequence[Column], layers: Sequence[tuple[Matrix, Sequence[float] | None, object]]) -> list[Column]:
    """Dense layers (weights, bias, activation) in turn."""
    for w, b, act in layers:
        parts = activate(affine(parts, w, b), act)
    return list(parts)


def dense(parts: Sequence[Column], widths: Sequence[int], layer: int = 0, activation: object = "relu") -> tuple[list[Column], int]:
    """Hidden layers of reproducible weights, numbered from ``layer`` on, and the width that comes out."""
    parts = list(parts)
    for i, m in enumerate(widths):
        parts = activate(affine(parts, dyadic(len(parts), m, layer + i)), activation)
    return parts, len(parts)


def batch_norm(parts: Sequence[Column], mean, var, gamma=None, beta=None, epsilon: float = 1e-3) -> list[Column]:
    """Inference form with given statistics."""
    n = len(list(parts))
    gamma, beta = gamma or [1.0] * n, beta or [0.0] * n
    return [(p - m) / F.sqrt(F.lit(v + epsilon)) * g + b for p, m, v, g, b in zip(parts, mean, var, gamma, beta, strict=True)]


def one_hot(index: Column, depth: int) -> Column:
    """Negative indexes count from the end; indexes outside of the depth raise."""
    at = F.when(index < 0, index + depth).otherwise(index)
    row = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == at).cast("double"))
    return F.when((at >= 0) & (at < depth), row).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), index.cast("string"))))


def label_one_hot(value: Column, labels: Sequence) -> Column:
    """Unknown labels raise."""
    known = F.array(*[F.lit(v) for v in labels])
    at = F.array_position(known, value)
    return F.when(at > 0, one_hot((at - 1).cast("int"), len(labels))).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), value.cast("string"))))


def pad(x: Column, n: int) -> Column:
    """Zeros behind a vector, up to length n."""
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(x), F.lit(0))))
