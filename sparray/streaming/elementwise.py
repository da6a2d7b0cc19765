"""Expressions over streams: they are stateless, so they are one projection of every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.expr import Expr


def select(frame: DataFrame, keep: list[str], **expressions: Expr) -> DataFrame:
    """The kept columns and each expression under its name; frame may be a stream or a table."""
    return frame.select(*keep, *[e.to_column().alias(name) for name, e in expressions.items()])
