"""Dense tensors: a DataFrame (idx BIGINT, value) in row-major order, with the shape on the driver.

Reshape changes nothing but the shape; transpose, slice and broadcast are arithmetic on idx. Element-wise operations keep
their operands, so that a chain is one expression over its tensors: one projection if there is only one, else one join by
position, rounded once at the end, and differentiable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.dtypes import DType
from ..plans.arrays import array_of
from ..plans.expr import OPERATORS, Binary, Expr, Variable, _ids

#: A tensor of at most this many elements is sent to every task, if its rows are known to be as many as its shape says.
SMALL = 1_000_000


class NotInNumpy(TypeError, ValueError):
    """The elements' type is none of numpy's."""


def strides(shape: Sequence[int]) -> tuple[int, ...]:
    """Elements from one index to the next along each axis, row-major."""
    return tuple(math.prod(shape[i + 1 :]) for i in range(len(shape)))


def common_shape(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    """The shape that both broadcast to; axes are aligned at the right."""
    n = max(len(a), len(b))
    out = []
    for x, y in zip((1,) * (n - len(a)) + tuple(a), (1,) * (n - len(b)) + tuple(b), strict=True):
        if x != y and 1 not in (x, y):
            raise ValueError(f"shapes {tuple(a)} and {tuple(b)} do not broadcast")
        out.append(y if x == 1 else x)
    return tuple(out)


def coordinates(idx: Column, shape: Sequence[int]) -> list[Column]:
    """The index along each axis of a row-major position."""
    return [F.pmod(F.call_function("div", idx, F.lit(s)), F.lit(d)) for s, d in zip(strides(shape), shape, strict=True)]


def position(at: Sequence[Column], steps: Sequence[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for c, s in zip(at, steps, strict=True):
        if s:
            out = out + c * F.lit(s)
    return out


@dataclass(frozen=True, eq=False)
class Tensor:
    frame: DataFrame
    sizes: tuple[int, ...]
    kind: DType
    id: int
    #: What an operation's result was made of; a view is a tensor of its own.
    parts: tuple[str, Tensor, Tensor] | None = None
    #: Whether the library made the rows itself, so that there is one a position.
    counted: bool = False

    # ---- sources ----

    @staticmethod
    def from_values(engine, values: Sequence[float], shape: Sequence[int], dtype: str = "float", bits: int = 32, name: str = "tensor", scale: int = 0) -> Tensor:
        if len(values) != math.prod(shape):
            raise ValueError(f"{len(values)} values for the shape {tuple(shape)}")
        frame, kind = array_of(engine.spark, values, dtype, bits, scale or None)
        return Tensor(frame, tuple(shape), kind, next(_ids), counted=True)

    @staticmethod
    def from_frame(frame: DataFrame, shape: Sequence[int], kind: DType) -> Tensor:
        """A tensor of a DataFrame (idx, value) whose values have the stored form of the type."""
        return Tensor(frame.select("idx", "value"), tuple(shape), kind, next(_ids))

    @staticmethod
    def from_mmap(engine, path: str, count: int, shape: Sequence[int], dtype: str = "float", bits: int = 32, name: str = "tensor", scale: int = 1) -> Tensor:
        """A file of packed patterns."""
        from ..sources.packed import read_packed

        if count < math.prod(shape):
            raise ValueError(f"{count} values for the shape {tuple(shape)}")
        frame, kind = read_packed(engine.spark, path, math.prod(shape), dtype, bits, scale)
        return Tensor(frame, tuple(shape), kind, next(_ids), counted=True)

    # ---- shape ----

    @property
    def shape(self) -> list[int]:
        return list(self.sizes)

    @property
    def size(self) -> int:
        return math.prod(self.sizes)

    def reshape(self, shape: Sequence[int]) -> Tensor:
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.sizes} has {self.size} elements, {tuple(shape)} has {math.prod(shape)}")
        return replace(self, sizes=tuple(shape), parts=None)

    def transpose(self) -> Tensor:
        """All axes in reverse."""
        at, shape = coordinates(F.col("idx"), self.sizes), self.sizes[::-1]
        return replace(self, frame=self.frame.select(position(at[::-1], strides(shape)).alias("idx"), "value"), sizes=shape, parts=None)

    def slice_and_dice(self, ranges: Sequence[tuple[int, int, int]]) -> Tensor:
        """(start, stop, step) along the first axes; the others stay whole."""
        whole = [(int(a), min(int(b), d), int(s)) for (a, b, s), d in zip(ranges, self.sizes, strict=False)]
        if len(ranges) > len(self.sizes) or any(a < 0 or s < 1 for a, _, s in whole):
            raise ValueError(f"ranges {list(ranges)} do not fit the shape {self.sizes}")
        whole += [(0, d, 1) for d in self.sizes[len(whole) :]]
        shape = tuple(max(0, -(-(b - a) // s)) for a, b, s in whole)
        at = coordinates(F.col("idx"), self.sizes)
        kept = F.lit(True)
        for c, (a, b, s) in zip(at, whole, strict=True):
            kept = kept & (c >= a) & (c < b) & (F.pmod(c - a, F.lit(s)) == 0)
        moved = [F.call_function("div", c - a, F.lit(s)) for c, (a, _, s) in zip(at, whole, strict=True)]
        return replace(self, frame=self.frame.where(kept).select(position(moved, strides(shape)).cast("bigint").alias("idx"), "value"), sizes=shape, parts=None)

    def broadcast_to(self, shape: Sequence[int]) -> Tensor:
        shape = tuple(shape)
        if common_shape(self.sizes, shape) != shape:
            raise ValueError(f"{self.sizes} does not broadcast to {shape}")
        if shape == self.sizes:
            return self
        own = (1,) * (len(shape) - len(self.sizes)) + self.sizes
        steps = [0 if d == 1 else s for d, s in zip(own, strides(own), strict=True)]
        spark = self.frame.sparkSession
        wanted = spark.range(math.prod(shape)).withColumnRenamed("id", "idx")
        wanted = wanted.withColumn("source", position(coordinates(F.col("idx"), shape), steps))
        source = self.frame.select(F.col("idx").alias("source"), "value")
        joined = wanted.join(F.broadcast(source) if self.counted and self.size <= SMALL else source, "source")
        return replace(self, frame=joined.select("idx", "value"), sizes=shape, parts=None)

    def tile(self, repeat: int) -> Tensor:
        """The elements repeated end to end, as one axis."""
        copies = F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))) if repeat > 0 else F.explode(F.array().cast("array<int>"))
        frame = self.frame.select("idx", "value", copies.alias("copy")).select((F.col("idx") + F.col("copy") * F.lit(self.size)).cast("bigint").alias("idx"), "value")
        return replace(self, frame=frame, sizes=(self.size * max(0, repeat),), parts=None)

    # ---- arithmetic ----

    def _with(self, op: str, other: object) -> Tensor:
        if not isinstance(other, Tensor):
            raise TypeError(f"a tensor combines with tensors, not {type(other).__name__}")
        made = Tensor(self.frame, common_shape(self.sizes, other.sizes), self.kind.result(), next(_ids), (op, self, other))
        leaves: list[tuple[Tensor, Variable]] = []
        return replace(made, frame=_over(made._expression(made.sizes, leaves), leaves), counted=all(t.counted for t, _ in leaves))

    def _expression(self, shape: tuple[int, ...], leaves: list[tuple[Tensor, Variable]]) -> Expr:
        """The tree of operations at a shape; ``leaves`` gathers its tensors, each with the variable that stands for it."""
        if self.parts and self.parts[0] in OPERATORS:
            op, left, right = self.parts
            return Binary(op, left._expression(shape, leaves), right._expression(shape, leaves))
        for t, v in leaves:
            if t.frame is self.frame and t.id == self.id and t.sizes == self.sizes:
                return v
        own = next(_ids) if any(v.id == self.id for _, v in leaves) else self.id  # another view of the same tensor
        name = f"t{len(leaves)}"
        leaves.append((self, Variable(own, name, self.kind, F.col(name), self.broadcast_to(shape).frame, math.prod(shape))))
        return leaves[-1][1]

    def _made_of(self, id: int, op: str) -> bool:
        """Whether the tensor with an id went into an operation of a kind below."""
        return bool(self.parts) and any(t.id == id and self.parts[0] == op or self.parts[0] == op and t._holds(id) or t._made_of(id, op) for t in self.parts[1:])

    def _holds(self, id: int) -> bool:
        return self.id == id or bool(self.parts) and any(t._holds(id) for t in self.parts[1:])

    def __add__(self, other):
        return self._with("+", other)

    def __sub__(self, other):
        return self._with("-", other)

    def __mul__(self, other):
        return self._with("*", other)

    def __truediv__(self, other):
        return self._with("/", other)

    @staticmethod
    def dequantize_matmul(activations: Tensor, weights: Tensor, divisor: float = 0) -> Tensor:
        """activations [m, k] times quantised weights [k, n]."""
        from .linalg import dequantize_matmul

        return dequantize_matmul(activations, weights, divisor)

    def as_expr(self) -> Variable:
        """The elements as an array for expressions and derivatives; views keep the tensor's identity."""
        return Variable(self.id, "tensor", self.kind, F.col("value"), self.frame, self.size)

    def grad(self, of, wrt: Tensor | None = None) -> Tensor:
        """Of an operation's result: its derivative with respect to the tensor ``of``, element by element. Of any tensor:
        the derivative of the function ``of`` (of expressions) at its elements, with respect to ``wrt`` or itself."""
        if isinstance(of, Tensor):
            if self._made_of(of.id, "@"):
                raise NotImplementedError("no derivative of a matrix product")
            leaves: list[tuple[Tensor, Variable]] = []
            found = self._expression(self.sizes, leaves).grad(of.id)
            return Tensor(_over(found, leaves), self.sizes, found.dtype.result(), next(_ids), counted=all(t.counted for t, _ in leaves))
        out = of(self.as_expr()).grad((wrt or self).id).execute()
        return Tensor(out.frame, self.sizes, out.kind, next(_ids), counted=self.counted)

    def execute(self, engine=None, device: str = "cpu") -> Tensor:
        if engine is not None:
            engine.hold(self.frame)
        return self

    # ---- sinks ----

    def decoded(self) -> DataFrame:
        return self.frame.select("idx", codec.decode(F.col("value"), self.kind).alias("value"))

    def numpy(self, engine=None) -> list:
        """The elements as nested lists on the driver."""
        flat = [r["value"] for r in self.decoded().orderBy("idx").collect()]
        for d in self.sizes[:0:-1]:
            flat = [flat[i : i + d] for i in range(0, len(flat), d)] if d else []
        return flat

    def __array__(self, dtype=None, copy=None):
        """For types that numpy has; others raise."""
        import numpy as np

        names = {("float", 32): "float32", ("float", 64): "float64", ("dynamic_float", 64): "float64"} | {("int", b): f"int{b}" for b in (8, 16, 32, 64)}
        if self.kind.unsigned or (self.kind.kind, self.kind.bits) not in names:
            raise NotInNumpy(f"numpy has no type for {self.kind}")
        rows = self.frame.orderBy("idx").select("value").collect()
        return np.array([r["value"] for r in rows], dtype=dtype or names[self.kind.kind, self.kind.bits]).reshape(self.sizes)

    @property
    def __array_interface__(self) -> dict:
        """numpy's protocol over the collected elements, for the types that it has: 32 and 64-bit floats that kept their
        sign, and 8 to 64-bit integers."""
        if self.kind.unsigned:
            raise NotInNumpy("a float array that gave its sign bit away has no numpy type")
        if (self.kind.kind, self.kind.bits) not in {("float", 32), ("float", 64)} | {("int", b) for b in (8, 16, 32, 64)}:
            raise NotInNumpy(f"numpy has no type for {self.kind}")
        object.__setattr__(self, "_numpy", self.__array__())  # lives as long as this tensor, which numpy holds
        return self._numpy.__array_interface__


def _over(e: Expr, leaves: list[tuple[Tensor, Variable]]) -> DataFrame:
    """An expression's values over its tensors, joined by position."""
    joined = None
    for t, v in leaves:
        part = v.frame.select("idx", F.col("value").alias(v.name))
        few = t.counted and v.size <= SMALL
        joined = part if joined is None else joined.join(F.broadcast(part) if few else part, "idx")
    return joined.select("idx", e.to_column().alias("value"))


def range_tensor(spark: SparkSession, shape: Sequence[int], kind: DType) -> Tensor:
    """0, 1, 2, ... of a shape."""
    frame = spark.range(math.prod(shape)).select(F.col("id").alias("idx"), codec.encode(F.col("id"), kind).alias("value"))
    return Tensor(frame, tuple(shape), kind, next(_ids), counted=True)
