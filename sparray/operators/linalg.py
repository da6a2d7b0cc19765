"""Matrix product with quantised weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, dtypes
from ..plans.expr import _ids
from .tensor import SMALL, Tensor


def dequantized(weights: Tensor, divisor: float = 0) -> Column:
    """The weights as doubles; a positive divisor is a plain one."""
    value = codec.decode(F.col("value"), weights.kind)
    return value / codec.double(divisor) if divisor > 0 else value


def dequantize_matmul(activations: Tensor, weights: Tensor, divisor: float = 0) -> Tensor:
    """activations [m, k] times weights [k, n]: a join on k and one sum per cell, added up before it is shuffled."""
    m, k = activations.sizes if len(activations.sizes) == 2 else (1, activations.size)
    k2, n = weights.sizes if len(weights.sizes) == 2 else (weights.size, 1)
    if k != k2:
        raise ValueError(f"{activations.sizes} and {weights.sizes} have no common inner size")
    div = lambda c, d: F.call_function("div", c, F.lit(d))
    a = activations.decoded().select(div(F.col("idx"), k).alias("i"), F.pmod("idx", F.lit(k)).alias("k"), F.col("value").alias("a"))
    w = weights.frame.select(div(F.col("idx"), n).alias("k"), F.pmod("idx", F.lit(n)).alias("j"), dequantized(weights, divisor).alias("w"))
    cells = a.join(F.broadcast(w) if weights.counted and weights.size <= SMALL else w, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("w")).alias("value"))
    frame = cells.select((F.col("i") * F.lit(n) + F.col("j")).alias("idx"), "value")
    return Tensor(frame, (m, n), dtypes.dynamic(), next(_ids), ("@", activations, weights))


def rows_times_matrix(rows: DataFrame, vector: str, matrix: list[list[float]]) -> Column:
    """A vector column [k] times a small constant matrix [k, n], row by row and without a shuffle."""
    columns = [F.array(*[codec.double(x) for x in column]) for column in zip(*matrix, strict=True)]
    dot = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: x.cast("double") * y), codec.double(0), lambda s, x: s + x)
    return F.array(*[dot(c) for c in columns])
