"""Symbolic derivatives."""

from __future__ import annotations

from ..functions import dtypes
from .expr import Binary, Const, Expr, Spread, Variable, simplified


def derivative(e: Expr, wrt: int) -> Expr:
    """de/dwrt, simplified; its type is a 32-bit float."""
    return simplified(_typed(_rule(e, wrt)))


def _number(v: float) -> Const:
    return Const(v, dtypes.floating(32))


def _rule(e: Expr, wrt: int) -> Expr:
    if isinstance(e, Variable):
        return _number(1.0 if e.id == wrt else 0.0)
    if isinstance(e, Const):
        return _number(0.0)
    if isinstance(e, Spread):
        return _rule(e.inner, wrt)
    if not isinstance(e, Binary):
        raise NotImplementedError(f"no derivative of {type(e).__name__}")
    a, b, da, db = e.left, e.right, _rule(e.left, wrt), _rule(e.right, wrt)
    if e.op in "+-":
        return _join(e.op, da, db)
    if e.op == "*":
        return _join("+", _times(da, b), _times(a, db))
    if _zero(db):
        return Binary("/", da, b)
    return Binary("/", _join("-", _times(da, b), _times(a, db)), Binary("*", b, b))


def _zero(e: Expr) -> bool:
    return isinstance(e, Const) and e.value == 0.0


def _times(a: Expr, b: Expr) -> Expr:
    """A product in which a derivative that is constantly 0 or 1 is dropped."""
    for x, y in ((a, b), (b, a)):
        if _zero(x):
            return _number(0.0)
        if isinstance(x, Const) and x.value == 1.0:
            return y
    return Binary("*", a, b)


def _join(op: str, a: Expr, b: Expr) -> Expr:
    return a if _zero(b) else b if _zero(a) and op == "+" else Binary(op, a, b)


def _typed(e: Expr) -> Expr:
    """The same value with a leading float constant, which gives the derivative its type."""
    return e if isinstance(e, Const) else Binary("*", _number(1.0), e)
