"""Arrays of their own: DataFrames (idx BIGINT, value), and expressions over several of them joined by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, dtypes, wide
from ..functions.dtypes import DType
from .expr import Expr, Variable, _ids


def array_of(spark: SparkSession, values: Sequence[float], dtype: str | DType, bits: int = 32, scale: int | None = 1) -> tuple[DataFrame, DType]:
    """(idx, value) in the stored form of the type. A float array without a negative value gives its sign bit away."""
    kind = dtype if isinstance(dtype, DType) else dtypes.named(dtype, bits, scale)
    if kind.wide:
        rows = [(i, str(wide.wrapped(int(v), kind.bits))) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "idx bigint, value string"), kind
    raw = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx bigint, value double")
    if kind.kind in (dtypes.SCALABLE_INT, dtypes.SCALABLE_FLOAT):
        kind = codec.sized(raw, F.col("value"), kind.kind)
    elif kind.exponent:
        kind = kind.without_sign(all(v >= 0 for v in values))
    return raw.select("idx", codec.encode(F.col("value"), kind).alias("value")), kind


def evaluate(e: Expr, engine=None) -> Variable:
    leaves = e.leaves()
    if not leaves:
        if engine is None:
            raise ValueError("a constant expression needs an engine to become an array")
        frame = engine.spark.range(1).select(F.col("id").alias("idx"), e.to_column().alias("value"))
        return Variable(next(_ids), "result", e.dtype.result(), F.col("value"), frame, 1)
    if any(v.frame is None for v in leaves):
        raise ValueError("columns of a table are not an array: select to_column() from the table")
    size = max(v.size for v in leaves)
    if any(v.size not in (1, size) for v in leaves):
        raise ValueError(f"arrays of different lengths: {sorted({v.size for v in leaves})}")
    joined, held = None, {}
    for v in leaves:
        name = f"v{v.id}"
        if v.size == 1 and size > 1:
            held[v.id] = F.lit(v.frame.select(v.column).first()[0])  # one value
            continue
        part = v.frame.select("idx", v.column.alias(name))
        joined = part if joined is None else joined.join(part, "idx")
        held[v.id] = F.col(name)
    plan = _bound(e, held)
    frame = joined.select("idx", plan.to_column().alias("value"))
    result = Variable(next(_ids), "result", e.dtype.result(), F.col("value"), frame, size)
    if engine is not None:
        engine.hold(frame)
    return result


def _bound(e: Expr, columns: dict) -> Expr:
    """The expression over the columns of the joined arrays."""
    from dataclasses import replace

    from .expr import Binary, Spread

    if isinstance(e, Variable):
        return replace(e, column=columns[e.id])
    if isinstance(e, Binary):
        return replace(e, left=_bound(e.left, columns), right=_bound(e.right, columns))
    if isinstance(e, Spread):
        return replace(e, inner=_bound(e.inner, columns))
    return e


def values_of(e: Expr, limit: int | None = None) -> list[float]:
    v = e if isinstance(e, Variable) else evaluate(e)
    rows = v.frame if limit is None else v.frame.where(F.col("idx") < limit)
    return [r[0] for r in rows.orderBy("idx").select(codec.decode(v.column, v.kind)).collect()]
