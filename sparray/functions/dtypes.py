"""Numeric types: floats and integers of any width, decimal fixed point, and types sized by their data."""

from __future__ import annotations

from dataclasses import dataclass, replace

FLOAT, INT, DYNAMIC, FIXED, SCALABLE_INT, SCALABLE_FLOAT = "float", "int", "dynamic_float", "floating_int", "scalable_int", "scalable_float"
KINDS = (FLOAT, INT, DYNAMIC, FIXED, SCALABLE_INT, SCALABLE_FLOAT)


def exponent_width(bits: int) -> int:
    """Exponent bits of a float of a total width (fixed values)."""
    return next((e for top, e in ((16, 5), (32, 8), (64, 11), (128, 15)) if bits <= top), 19)


@dataclass(frozen=True)
class DType:
    """A type. exponent: of floats; scale: decimal places of fixed point; unsigned: a float whose sign bit went to the
    mantissa because no value of the array is negative."""

    kind: str
    bits: int
    exponent: int = 0
    scale: int = 0
    unsigned: bool = False

    @property
    def integral(self) -> bool:
        """Whether expressions rooted in this type are computed on integers."""
        return self.kind in (INT, FIXED, SCALABLE_INT)

    @property
    def mantissa(self) -> int:
        return self.bits - self.exponent - (0 if self.unsigned else 1)

    @property
    def exact_double(self) -> bool:
        """Whether every double is a value of this float type."""
        return self.exponent >= 11 and self.mantissa >= 52

    @property
    def wide(self) -> bool:
        return self.kind == INT and self.bits > 64

    def result(self) -> DType:
        """The type of an expression with this leftmost type: integers sized by their data are widened."""
        return DType(INT, 64) if self.kind == SCALABLE_INT else self

    def without_sign(self, unsigned: bool) -> DType:
        return replace(self, unsigned=unsigned) if self.exponent else self


def floating(bits: int = 32, unsigned: bool = False) -> DType:
    return DType(FLOAT, bits, exponent_width(bits), unsigned=unsigned)


def integer(bits: int) -> DType:
    if bits < 1:
        raise ValueError("an integer has at least one bit")
    return DType(INT, bits)


def dynamic() -> DType:
    return DType(DYNAMIC, 64, 11)


def fixed(scale: int) -> DType:
    return DType(FIXED, 64, scale=scale)


def named(kind: str, bits: int = 32, scale: int | None = 1) -> DType:
    """The type of a name as users write it; types sized by their data take ``bits`` until the data say otherwise."""
    if kind == FLOAT:
        return floating(bits)
    if kind == INT:
        return integer(bits)
    if kind == DYNAMIC:
        return dynamic()
    if kind == FIXED:
        return fixed(1 if scale is None else scale)
    if kind == SCALABLE_INT:
        return DType(SCALABLE_INT, bits)
    if kind == SCALABLE_FLOAT:
        return DType(SCALABLE_FLOAT, bits, 4)
    raise ValueError(f"unknown dtype {kind!r}; one of {', '.join(KINDS)}")
