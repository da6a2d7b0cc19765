"""Lazy typed arithmetic: a tree of variables, constants and + - * / that lowers to one Column.

The leftmost leaf decides the type of the result, and whether the whole tree is computed on integers (wrapping at 64 bits
on the way, at the type's width at the end) or on doubles (rounded to the type once, at the end).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, dtypes
from ..functions.dtypes import DType

_ids = itertools.count(1)
OPERATORS = ("+", "-", "*", "/")


@dataclass(frozen=True, eq=False)
class Expr:
    """An expression. Build leaves with var(), col() and const(); combine them with operators."""

    def __add__(self, other):
        return binary("+", self, other)

    def __radd__(self, other):
        return binary("+", other, self)

    def __sub__(self, other):
        return binary("-", self, other)

    def __rsub__(self, other):
        return binary("-", other, self)

    def __mul__(self, other):
        return binary("*", self, other)

    def __rmul__(self, other):
        return binary("*", other, self)

    def __truediv__(self, other):
        return binary("/", self, other)

    def __rtruediv__(self, other):
        return binary("/", other, self)

    # ---- leaves ----

    @staticmethod
    def const(value: float) -> Const:
        return Const(float(value), dtypes.dynamic())

    @staticmethod
    def col(column: str | Column, dtype: str | DType = "dynamic_float", bits: int = 32, scale: int = 1, stored: bool = False, integral: bool = False, frame: DataFrame | None = None) -> Variable:
        """A column of a table as a variable. stored: it holds the type's stored form already; integral: it is an integer
        column, which is wrapped without a detour over doubles. Types sized by their data need ``frame`` to look at."""
        c = F.col(column) if isinstance(column, str) else column
        kind = dtype if isinstance(dtype, DType) else dtypes.named(dtype, bits, scale)
        if not isinstance(dtype, DType) and kind.kind in (dtypes.SCALABLE_INT, dtypes.SCALABLE_FLOAT):
            if frame is None:
                raise ValueError(f"{dtype} is sized by its data: pass the DataFrame as frame")
            kind = codec.sized(frame, c, kind.kind)
        if not stored:
            c = codec.encode_integer(c, kind) if integral and kind.kind in (dtypes.INT, dtypes.SCALABLE_INT) and not kind.wide else codec.encode(c, kind)
        return Variable(next(_ids), str(column) if isinstance(column, str) else "column", kind, c)

    @staticmethod
    def var(engine, name: str, values: Sequence[float], dtype: str = "float", bits: int = 32, scale: int = 1) -> Variable:
        """An array of its own, one row per position."""
        from .arrays import array_of

        frame, kind = array_of(engine.spark, values, dtype, bits, scale)
        return Variable(next(_ids), name, kind, F.col("value"), frame, len(values))

    @staticmethod
    def array(frame: DataFrame, idx: str, column: str, size: int, dtype: str | DType = "dynamic_float", bits: int = 32, scale: int = 1) -> Variable:
        """A column of a table as an array of its own: ``idx`` tells the positions, ``size`` how many there are."""
        v = Expr.col(column, dtype, bits, scale, frame=frame)
        return Variable(v.id, column, v.kind, F.col("value"), frame.select(F.col(idx).cast("bigint").alias("idx"), v.column.alias("value")), size)

    # ---- what follows from the tree ----

    @property
    def dtype(self) -> DType:
        raise NotImplementedError

    def leaves(self) -> list[Variable]:
        raise NotImplementedError

    def grad(self, wrt: Expr | int, broadcast: bool = True) -> Expr:
        """The derivative with respect to a variable, or to the variable with an id."""
        from .autodiff import derivative

        if not isinstance(wrt, int) and getattr(wrt, "id", None) is None:
            raise ValueError("a derivative is taken with respect to a variable")
        found = derivative(self, wrt if isinstance(wrt, int) else wrt.id)
        return Spread(found, tuple(self.leaves())) if broadcast and not found.leaves() else found

    def to_column(self, raw_fixed_point: bool = False) -> Column:
        """The stored form of the result, as one Column over the variables' columns."""
        from .lowering import lower

        return lower(self, raw_fixed_point)

    def to_double(self, raw_fixed_point: bool = False) -> Column:
        """The result as plain doubles."""
        return codec.decode(self.to_column(raw_fixed_point), self.dtype.result())

    def execute(self, engine=None, device: str = "cpu") -> Variable:
        """The result as a new variable; what it reads is joined by position, and computed when it is looked at."""
        from .arrays import evaluate

        return evaluate(self, engine)

    def unpack(self, engine=None, limit: int | None = None) -> list[float]:
        """The values, in order, as doubles on the driver."""
        from .arrays import values_of

        return values_of(self, limit)


@dataclass(frozen=True, eq=False)
class Variable(Expr):
    id: int
    name: str
    kind: DType
    column: Column
    frame: DataFrame | None = None
    size: int | None = None

    @property
    def dtype(self) -> DType:
        return self.kind

    def leaves(self) -> list[Variable]:
        return [self]


@dataclass(frozen=True, eq=False)
class Const(Expr):
    value: float
    kind: DType

    @property
    def dtype(self) -> DType:
        return self.kind

    def leaves(self) -> list[Variable]:
        return []


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    @property
    def dtype(self) -> DType:
        return self.left.dtype

    def leaves(self) -> list[Variable]:
        return list({v.id: v for v in (*self.left.leaves(), *self.right.leaves())}.values())


@dataclass(frozen=True, eq=False)
class Spread(Expr):
    """An expression without variables at the length of some variables (a constant derivative)."""

    inner: Expr
    like: tuple[Variable, ...]

    @property
    def dtype(self) -> DType:
        return self.inner.dtype

    def leaves(self) -> list[Variable]:
        return list(self.like)


def coerce(x: object) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise TypeError(f"an expression takes expressions and numbers, not {type(x).__name__}")
    return Expr.const(x)


def binary(op: str, left: object, right: object) -> Expr:
    return Binary(op, coerce(left), coerce(right))


def simplified(e: Expr) -> Expr:
    """Constants folded, and x+0, x-0, x*1, x/1 dropped; 0*x stays unless it is 0 for every x (it isn't for infinities).
    What is dropped on the left stays if it decides the type."""
    if not isinstance(e, Binary):
        return e
    left, right = simplified(e.left), simplified(e.right)
    if isinstance(left, Const) and isinstance(right, Const) and not (e.op == "/" and right.value == 0):
        a, b = left.value, right.value
        return Const(a + b if e.op == "+" else a - b if e.op == "-" else a * b if e.op == "*" else a / b, left.kind)
    if isinstance(right, Const) and (e.op in "+-" and right.value == 0 or e.op in "*/" and right.value == 1):
        return left
    if isinstance(left, Const) and left.kind == right.dtype and (e.op == "+" and left.value == 0 or e.op == "*" and left.value == 1):
        return right
    return Binary(e.op, left, right)

