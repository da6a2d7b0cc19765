"""Numbers of more than 64 bits: no built-in type holds them, so integers are decimal strings, wrapped to their width as
they are stored, and an Arrow function computes on whole batches with Python's integers. Arithmetic is modulo 2**128, as
the library defines it for all wider types. limbs() gives the bit pattern of any number as 64-bit limbs, lowest first."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtypes import FIXED, DType

MODULUS = 2**128


def signed(v: int, bits: int) -> int:
    bits = min(bits, 128)
    v %= 1 << bits
    return v - (1 << bits) if v >> (bits - 1) else v


def wrapped(v: int, bits: int) -> int:
    """v in two's complement of any width."""
    v &= (1 << bits) - 1
    return v - (1 << bits) if v >> (bits - 1) else v


def stored(v: Column, bits: int) -> Column:
    """Numbers of any type, decimal strings among them, as the decimal strings of wide integers; fractions are cut off."""

    @F.pandas_udf("string")
    def wrap(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else str(wrapped(int(x) if x.lstrip("-").isdigit() else int(Decimal(x)), bits)))

    return wrap(v.cast("string"))


def float_pattern(v: float, kind: DType) -> int:
    """The bit pattern of a double as a float of any width; a double fills 52 bits of a wider mantissa."""
    e, m = kind.exponent, kind.mantissa
    bias, top = 2 ** (e - 1) - 1, 2**e - 1
    sign = 0 if kind.unsigned or not v < 0 else 1 << (e + m)
    if v != v or math.isinf(v):
        return sign | top << m
    if v == 0:
        return 0
    fraction, power = math.frexp(abs(v))
    power += bias - 1
    if power >= top:
        return sign | top << m
    if power < 1:
        return 0
    whole = int(fraction * 2**53) - 2**52  # the 52 bits of the fraction
    near = whole << (m - 52) if m >= 52 else min((whole + (1 << (51 - m))) >> (52 - m), (1 << m) - 1)
    return sign | power << m | near


def float_value(p: int, kind: DType) -> float:
    e, m = kind.exponent, kind.mantissa
    bias, top = 2 ** (e - 1) - 1, 2**e - 1
    sign = -1.0 if not kind.unsigned and p >> (e + m) & 1 else 1.0
    power, fraction = p >> m & top, p & ((1 << m) - 1)
    if power == top:
        return sign * math.inf
    if not power and not fraction:
        return 0.0
    try:
        return sign * math.ldexp(1 + math.ldexp(fraction >> max(0, m - 52), -min(m, 52)), power - bias)
    except OverflowError:
        return sign * math.inf


def _floating(kind: DType) -> bool:
    return bool(kind.exponent)


def limbs(v: Column, kind: DType) -> Column:
    """array<bigint>: the pattern of plain numbers (of decimal strings, for wide integers) as so many 64-bit limbs as the
    width needs, lowest first; an integer's sign fills the last one."""
    n, scale = -(-kind.bits // 64), 10**kind.scale if kind.kind == FIXED else 1

    def pattern(x: str) -> int:
        if _floating(kind):
            return float_pattern(float(x), kind)
        if scale > 1:
            return wrapped(int((Decimal(x) * scale).to_integral_value(rounding="ROUND_HALF_UP")), kind.bits)
        return wrapped(int(x) if x.lstrip("-").isdigit() else int(Decimal(x)), kind.bits)

    @F.pandas_udf("array<bigint>")
    def split(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else [wrapped(pattern(x) >> (64 * i), 64) for i in range(n)])

    return split(v.cast("string"))


def of_limbs(v: Column, kind: DType) -> Column:
    """The numbers that limbs stand for, as strings: of integers the digits, of floats and fixed point a double's."""

    def value(parts: list[int]) -> str:
        p = sum((int(x) & (2**64 - 1)) << (64 * i) for i, x in enumerate(parts)) & ((1 << kind.bits) - 1)
        if _floating(kind):
            return repr(float_value(p, kind))
        whole = wrapped(p, kind.bits)
        return repr(whole / 10**kind.scale) if kind.kind == FIXED else str(whole)

    @F.pandas_udf("string")
    def join(series: pd.Series) -> pd.Series:
        return series.map(lambda x: None if x is None else value(list(x)))

    return join(v)


def apply(op: str, a: int, b: int) -> int:
    if op == "/":
        x, y = a % MODULUS, b % MODULUS
        return x // y if y else 0
    return (a + b if op == "+" else a - b if op == "-" else a * b) % MODULUS


def evaluate(e, kind: DType) -> Column:
    """The expression's result as a decimal string, wrapped to its type."""
    leaves = e.leaves()

    plan = strip(e)

    @F.pandas_udf("string")
    def compute(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns, strict=True):
            if any(v is None or v != v for v in values):
                out.append(None)
                continue
            row = {i: int(v) for i, v in enumerate(values)}
            out.append(str(signed(walk(plan, row), kind.bits)))
        return pd.Series(out)

    return compute(*[v.column.cast("decimal(38,0)").cast("string") if not v.kind.wide else v.column for v in leaves])


def strip(e) -> tuple:
    """The tree as nested tuples: ("v", place), ("c", n), (op, left, right)."""
    places = {v.id: i for i, v in enumerate(e.leaves())}

    def go(node) -> tuple:
        if hasattr(node, "column"):
            return ("v", places[node.id])
        if hasattr(node, "value"):
            return ("c", int(node.value))
        return (node.op, go(node.left), go(node.right))

    return go(e)


def walk(plan: tuple, row: dict[int, int]) -> int:
    if plan[0] == "v":
        return row[plan[1]]
    if plan[0] == "c":
        return plan[1]
    return apply(plan[0], walk(plan[1], row), walk(plan[2], row))
