"""From an expression tree to a Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codec, wide
from ..functions.dtypes import FIXED, DType
from .expr import Binary, Const, Expr, Spread, Variable


def lower(e: Expr, raw_fixed_point: bool = False) -> Column:
    kind = e.dtype
    inner = e.inner if isinstance(e, Spread) else e
    if isinstance(inner, Variable):
        return wrap_result(inner.column, kind)
    if kind.wide:
        return wide.evaluate(inner, kind)
    if kind.integral:
        return wrap_result(_whole(inner, kind, raw_fixed_point).column, kind)
    if isinstance(inner, Const) and not kind.exact_double:
        return codec.double(codec.quantized(inner.value, kind.exponent, kind.mantissa))
    out = _real(inner)
    return out if kind.exact_double else codec.quantize_float(out, kind.exponent, kind.mantissa)


def wrap_result(c: Column, kind: DType) -> Column:
    if not kind.integral or kind.wide:
        return c
    return codec.wrap_int(c, kind.result().bits)


def _real(e: Expr) -> Column:
    if isinstance(e, Variable):
        return codec.decode(e.column, e.kind)
    if isinstance(e, Const):
        return codec.double(e.value)
    if isinstance(e, Spread):
        return _real(e.inner)
    a, b = _real(e.left), _real(e.right)
    if e.op == "/":
        return codec.ieee_div(a, b)
    return a + b if e.op == "+" else a - b if e.op == "-" else a * b


@dataclass(frozen=True)
class _Whole:
    """An integer column, the bits it needs at most, and how many decimal places it carries."""

    column: Column
    width: int
    scale: int = 0


def _whole(e: Expr, root: DType, raw: bool) -> _Whole:
    fixed = root.kind == FIXED
    if isinstance(e, Variable):
        if e.kind.integral and not e.kind.wide:
            scale = e.kind.scale if e.kind.kind == FIXED else 0
            return _Whole(e.column.cast("bigint"), e.kind.bits, scale if fixed else 0) if fixed or not scale else _Whole(codec.rounded_int(codec.decode(e.column, e.kind)), 64)
        value = codec.decode(e.column, e.kind)
        return _Whole(codec.rounded_int(value * codec.double(10**root.scale)), 64, root.scale) if fixed and not raw else _Whole(codec.rounded_int(value), 64)
    if isinstance(e, Const):
        if fixed and not raw and not float(e.value).is_integer():
            return _Whole(F.lit(round(e.value * 10**root.scale)).cast("bigint"), 64, root.scale)
        n = int(e.value)
        return _Whole(F.lit(n).cast("bigint"), min(64, n.bit_length() + 1))
    if isinstance(e, Spread):
        return _whole(e.inner, root, raw)
    a, b = _whole(e.left, root, raw), _whole(e.right, root, raw)
    if fixed and not raw:
        return _fixed(e.op, a, b, root.scale)
    if e.op == "/":
        return _Whole(codec.truncated_div(codec.wrap_int(a.column, 64), b.column), min(64, a.width + 1))
    width = a.width + b.width if e.op == "*" else max(a.width, b.width) + 1
    return _Whole(codec.wrapped(e.op, a.column, b.column, width), min(64, width))


def _fixed(op: str, a: _Whole, b: _Whole, scale: int) -> _Whole:
    """Fixed point with its scale kept: sums at the larger scale, products and quotients brought back to the root's."""
    if op in "+-":
        top = max(a.scale, b.scale)
        up = lambda x: x.column if x.scale == top else codec.wrapped("*", x.column, F.lit(10 ** (top - x.scale)).cast("bigint"))
        return _Whole(codec.wrapped(op, up(a), up(b)), 64, top)
    if op == "*":
        if not a.scale or not b.scale:
            return _Whole(codec.wrapped("*", a.column, b.column), 64, a.scale + b.scale)
        product = codec.exact(a.column) * codec.exact(b.column)
        spare = a.scale + b.scale - scale
        if spare <= 0:
            return _Whole(codec.wrap64(product), 64, a.scale + b.scale)
        return _Whole(codec.rounded_div(product, F.lit(10**spare).cast("bigint")), 64, scale)
    shift = scale + b.scale - a.scale
    if abs(shift) > 18:
        raise ValueError(f"a quotient of scales {a.scale} and {b.scale} at scale {scale} needs more than 38 digits")
    up = codec.exact(a.column) * F.lit(10 ** max(0, shift)).cast("decimal(19,0)")
    down = codec.exact(b.column) * F.lit(10 ** max(0, -shift)).cast("decimal(19,0)")
    return _Whole(codec.rounded_div(up, down), 64, scale)
