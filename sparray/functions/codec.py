"""Column expressions for encoding, decoding and wrapping numbers of the library's types.

Everything here is built-in expressions, so a whole computation stays one projection. Nothing depends on the session's
ANSI setting: integers wrap without overflowing on the way, divisions by zero are guarded, casts are clamped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtypes import FIXED, INT, SCALABLE_FLOAT, SCALABLE_INT, DType

INF, NAN = float("inf"), float("nan")
_2_63, _2_64 = 2**63, 2**64


def double(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v computed once, for long expressions that f refers to often."""
    return F.element_at(F.transform(F.array(v), f), 1)


def _two_to(n: int) -> float:
    return INF if n > 1023 else 2.0**n if n > -1075 else 0.0


def binary_exponent(a: Column) -> Column:
    """floor(log2(a)) of a positive finite double, as a double, put right where the logarithm is rounded."""
    guess = F.floor(F.log2(a)).cast("double")
    ratio = a / F.pow(double(2), guess)
    return F.when(ratio >= 2.0, guess + 1.0).when(ratio < 1.0, guess - 1.0).otherwise(guess)


def quantize_float(v: Column, exponent: int, mantissa: int, strict: bool = False) -> Column:
    """v as a float of so many exponent and mantissa bits: halves away from zero, a full mantissa stays full, too small is
    zero, too large infinite. NaN stays NaN, or becomes infinite if strict."""
    if exponent >= 11 and mantissa >= 52:
        out = F.when(v == 0.0, double(0)).otherwise(v)
    else:
        bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
        low, high, steps = _two_to(1 - bias), _two_to(top - bias), float(2**mantissa)
        a, sign = F.abs(v), F.when(v < 0.0, double(-1)).otherwise(double(1))
        inside = (a >= low) & (a < high)
        x = F.when(inside, binary_exponent(F.when(inside, a).otherwise(double(1)))).otherwise(double(0))
        scale = F.pow(double(2), x)
        fraction = F.least(F.round((a / scale - 1.0) * steps), double(steps - 1)) / steps
        out = F.when(a >= high, sign * INF).when(a < low, double(0)).otherwise(sign * (1.0 + fraction) * scale)
    return F.when(F.isnan(v), double(INF if strict else NAN)).otherwise(out)


def quantized(v: float, exponent: int, mantissa: int) -> float:
    """quantize_float() of one number, on the driver."""
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
    if v != v or math.isinf(v):
        return v
    a = abs(v)
    if a < _two_to(1 - bias):
        return 0.0
    if a >= _two_to(top - bias):
        return math.copysign(INF, v)
    scale = 2.0 ** (math.frexp(a)[1] - 1)
    steps = 2**mantissa
    near = math.floor((Fraction(a) / Fraction(scale) - 1) * steps + Fraction(1, 2))
    return math.copysign(float((1 + Fraction(min(near, steps - 1), steps)) * Fraction(scale)), v)


def float_bits(v: Column, exponent: int, mantissa: int, unsigned: bool = False) -> Column:
    """The bit pattern (BIGINT) of v as such a float; at most 63 bits in all."""
    if exponent + mantissa + (not unsigned) > 63:
        raise ValueError("bit patterns of more than 63 bits are limbs: see wide.limbs()")
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1

    def pattern(q: Column) -> Column:
        a = F.abs(q)
        safe = F.when((a > 0.0) & (a < INF), a).otherwise(double(1))
        body = let(binary_exponent(safe), lambda x: (x + bias).cast("bigint") * 2**mantissa + F.round((safe / F.pow(double(2), x) - 1.0) * float(2**mantissa)).cast("bigint"))
        magnitude = F.when(a == INF, F.lit(top * 2**mantissa)).when(a == 0.0, F.lit(0)).otherwise(body).cast("bigint")
        return magnitude if unsigned else magnitude + F.when(q < 0.0, F.lit(2 ** (exponent + mantissa))).otherwise(F.lit(0))

    return let(quantize_float(v, exponent, mantissa, strict=True), pattern)


def float_of_bits(p: Column, exponent: int, mantissa: int, unsigned: bool = False) -> Column:
    """The double that a bit pattern stands for."""
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
    field = F.shiftright(p, mantissa).bitwiseAND(F.lit(top))
    fraction = p.bitwiseAND(F.lit(2**mantissa - 1)).cast("double") / float(2**mantissa)
    sign = double(1) if unsigned else F.when(F.shiftright(p, exponent + mantissa).bitwiseAND(F.lit(1)) == 1, double(-1)).otherwise(double(1))
    return F.when(field == top, sign * INF).when((field == 0) & (fraction == 0.0), double(0)).otherwise(sign * (1.0 + fraction) * F.pow(double(2), field.cast("double") - bias))


def wrap_int(v: Column, bits: int) -> Column:
    """The low bits of a BIGINT as a two's-complement number."""
    return v if bits >= 64 else F.shiftright(F.shiftleft(v, 64 - bits), 64 - bits)


def wrap64(v: Column) -> Column:
    """A DECIMAL(38, 0) modulo 2**64, as a signed BIGINT."""
    m = F.lit(Decimal(_2_64))
    low = F.pmod(v, m)
    return F.when(low >= F.lit(Decimal(_2_63)), low - m).otherwise(low).cast("bigint")


def wrapped(op: str, a: Column, b: Column, width: int = 64) -> Column:
    """a op b on BIGINTs modulo 2**64; width: bits that the exact result needs, if fewer than 64 are known to do."""
    if width < 64:
        x, y = a, b
    else:
        x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    exact = x + y if op == "+" else x - y if op == "-" else x * y
    return exact if width < 64 else wrap64(exact)


def truncated_div(a: Column, b: Column) -> Column:
    """a / b on BIGINTs, towards zero; a zero divisor is an error."""
    return F.call_function("div", a, b)


def exact(v: Column) -> Column:
    """A BIGINT as a decimal; the product of two is exact."""
    return v.cast("decimal(19,0)")


def rounded_div(a: Column, b: Column) -> Column:
    """The quotient of a decimal of at most 38 digits and an integer, rounded to the nearest integer, halves away from
    zero, modulo 2**64; a zero divisor is an error whatever the session says."""
    b = b.cast("decimal(38,0)")
    half = F.call_function("div", F.abs(b), F.lit(2)).cast("decimal(19,0)")
    near = F.when(a < 0, a - half).otherwise(a + half).cast("decimal(38,0)")
    quotient = F.call_function("div", near, F.when(b == 0, F.lit(1)).otherwise(b).cast("decimal(38,0)"))
    return F.when(b == 0, F.raise_error(F.lit("division of a fixed-point number by zero")).cast("bigint")).otherwise(quotient)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b on doubles with infinities and NaN, whatever the session says of division by zero."""
    zero = F.when((a == 0.0) | F.isnan(a), double(NAN)).when(a > 0.0, double(INF)).otherwise(double(-INF))
    return F.when(b == 0.0, zero).otherwise(a / F.when(b == 0.0, double(1)).otherwise(b))


def rounded_int(v: Column) -> Column:
    """A double to the nearest BIGINT, halves away from zero; NaN is 0 and what is too large is clamped."""
    near = F.round(v)
    safe = F.when(F.isnan(v) | (near >= float(_2_63)) | (near < -float(_2_63)), double(0)).otherwise(near)
    return F.when(F.isnan(v), F.lit(0).cast("bigint")).when(near >= float(_2_63), F.lit(_2_63 - 1)).when(near < -float(_2_63), F.lit(-_2_63)).otherwise(safe.cast("bigint"))


def encode(v: Column, dtype: DType) -> Column:
    """A plain number as the library stores it: quantised DOUBLE, wrapped BIGINT, scaled BIGINT, or STRING beyond 64 bits."""
    if dtype.wide:
        from .wide import stored

        return stored(v, dtype.bits)
    if dtype.kind == FIXED:
        return rounded_int(v.cast("double") * double(10**dtype.scale))
    if dtype.kind in (INT, SCALABLE_INT):
        return wrap_int(rounded_int(v.cast("double")), dtype.bits)
    return quantize_float(v.cast("double"), dtype.exponent, dtype.mantissa)


def encode_integer(v: Column, dtype: DType) -> Column:
    """Like encode() for a column that is integral already and never passes through a double."""
    return wrap_int(v.cast("bigint"), dtype.bits)


def decode(v: Column, dtype: DType) -> Column:
    """What is stored as a plain DOUBLE."""
    if dtype.kind == FIXED:
        return v.cast("double") / double(10**dtype.scale)
    return v.cast("double")


# ---- types sized by their data -----------------------------------------------------------------------------------------


def int_width(v: Column) -> Column:
    """Bits of the signed integer nearest to v: the magnitude's and one for the sign; zero takes two."""
    a = F.abs(rounded_int(v.cast("double")))
    return F.when(a == 0, F.lit(2)).otherwise(F.length(F.bin(a)) + 1).cast("int")


def float_config(v: Column, unsigned: bool) -> tuple[Column, Column]:
    """(bits, exponent bits) that one value asks for."""
    v = v.cast("double")
    a = F.abs(v)
    plain = F.isnan(v) | (a == 0.0) | (a == INF)
    size = F.abs(binary_exponent(F.when(plain, double(1)).otherwise(a)))
    x = binary_exponent(F.when(plain, double(1)).otherwise(a))
    exponent = let(x, _exponent_for)
    # the mantissa's widths by the size of the exponent (fixed values)
    mantissa = let(size, lambda n: F.when(n <= 4, 8).when(n <= 10, 16).when(n <= 20, 24).when(n <= 40, 32).otherwise(40))
    sign = 0 if unsigned else 1
    bits = F.least(F.greatest(exponent + mantissa + sign, F.lit(8)), F.lit(64))
    bits = F.greatest(bits, exponent + sign + 1)
    return F.when(plain, 8).otherwise(bits).cast("int"), F.when(plain, 4).otherwise(exponent).cast("int")


def _exponent_for(x: Column) -> Column:
    """The fewest exponent bits whose range holds a binary exponent."""
    out = F.lit(15)
    for e in range(14, 1, -1):
        bias = 2 ** (e - 1) - 1
        out = F.when((x >= 1 - bias) & (x <= 2**e - 2 - bias), F.lit(e)).otherwise(out)
    return out


def never_negative(v: Column) -> Column:
    """An aggregate: no value is negative and none is NaN."""
    return F.coalesce(F.bool_and((v.cast("double") >= 0.0) & ~F.isnan(v.cast("double"))), F.lit(True))


def sized(df, v: Column, kind: str) -> DType:
    """The type that a column's values ask for, by one aggregate over them."""
    if kind == SCALABLE_INT:
        width = df.agg(F.max(int_width(v)).alias("w")).first()["w"]
        return DType(SCALABLE_INT, width or 2)
    signed, unsigned = float_config(v, False), float_config(v, True)
    parts = {"s": never_negative(v), "b1": F.max(signed[0]), "e1": F.max(signed[1]), "b0": F.max(unsigned[0]), "e0": F.max(unsigned[1])}
    r = df.agg(*[c.alias(n) for n, c in parts.items()]).first()
    n = "0" if r["s"] else "1"
    exponent = max(r[f"e{n}"] or 4, 4)
    bits = min(64, max(r[f"b{n}"] or 8, 8, exponent + (not r["s"]) + 1))
    return DType(SCALABLE_FLOAT, bits, exponent, unsigned=bool(r["s"]))


