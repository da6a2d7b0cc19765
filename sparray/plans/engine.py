"""The session as users see it: an engine, execution modes and traced functions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .expr import Expr

MODES = ("default", "eager", "hyper", "xtreme")


class Engine:
    """Holds the Spark session. All modes and devices give the same results; eager computes results at once."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._held: list[DataFrame] = []

    @property
    def eager(self) -> bool:
        return current_mode() == "eager"

    def hold(self, frame: DataFrame) -> None:
        """In eager mode, compute a result at once and keep it until release()."""
        if self.eager:
            frame.persist().count()
            self._held.append(frame)

    def release(self) -> None:
        """Give up the results that eager mode has kept; they are computed anew if they are looked at again."""
        while self._held:
            self._held.pop().unpersist()


_mode = ["default"]


def current_mode() -> str:
    return _mode[-1]


@contextmanager
def mode(name: str) -> Iterator[str]:
    """A hint for what is executed inside; an unknown one is the default, which holds again afterwards."""
    _mode.append(name if name in MODES else "default")
    try:
        yield current_mode()
    finally:
        _mode.pop()


def traced(function: Callable[..., Expr], *args: object) -> Expr:
    """The expression that a function makes of its arguments: lists become 32-bit float arrays, numbers constants."""
    engine, rest = args[0], args[1:]
    made = [a if isinstance(a, Expr) else Expr.var(engine, f"arg_{i}", a) if isinstance(a, list | tuple) else Expr.const(a) for i, a in enumerate(rest)]
    return function(*made)


def compile(function: Callable[..., Expr] | None = None, *, device: str = "cpu") -> Callable:
    """A function of expressions, called with an engine and arrays or numbers. It is traced once a call into one Column;
    no Python runs per row. Without an engine in front the plain function is called."""

    def wrap(f: Callable[..., Expr]) -> Callable:
        @functools.wraps(f)
        def call(*args: object) -> object:
            if not args or not isinstance(args[0], Engine):
                return f(*args)
            return traced(f, *args).execute(args[0], device)

        return call

    return wrap(function) if function else wrap
