"""Files of packed bit patterns, and columns of stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, dtypes
from ..functions.bits import unpack_bits
from ..functions.dtypes import DType
from ..functions.wide import float_value, wrapped

#: Patterns that a worker unpacks at a time; a multiple of eight, so that a step begins at a whole byte.
STEP = 65_536
#: The same for patterns wider than 64 bits, which become Python integers.
WIDE_STEP = 1024


def read_packed(spark: SparkSession, path: str, count: int, dtype: str | DType, bits: int = 32, scale: int = 1) -> tuple[DataFrame, DType]:
    """(idx, value) of the first ``count`` patterns of a file; floats keep their sign bit."""
    kind = dtype if isinstance(dtype, DType) else dtypes.named(dtype, bits, scale)
    width = kind.bits

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                for start in range(0, count, STEP):
                    n = min(STEP, count - start)
                    part = bytes(raw[start * width // 8 : -(-(start + n) * width // 8)])
                    found = np.frombuffer(part, "<i8", n) if width == 64 else np.array(unpack_bits(part, width, n), dtype=object)
                    yield pa.RecordBatch.from_pydict({"idx": pa.array(range(start, start + n), pa.int64()), "pattern": pa.array([int(x) - (1 << 64) * (int(x) >> 63 & (int(x) > 0)) for x in found], pa.int64())})

    def wide_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                for start in range(0, count, WIDE_STEP):
                    n = min(WIDE_STEP, count - start)
                    found = unpack_bits(bytes(raw[start * width // 8 : -(-(start + n) * width // 8)]), width, n)
                    values = [float_value(x, kind) for x in found] if kind.exponent else [str(wrapped(x, width)) for x in found]
                    yield pa.RecordBatch.from_pydict({"idx": pa.array(range(start, start + n), pa.int64()), "value": pa.array(values)})

    content = spark.read.format("binaryFile").load(path).select("content")
    if width > 64:
        return content.mapInArrow(wide_values, f"idx bigint, value {'double' if kind.exponent else 'string'}"), kind
    raw = content.mapInArrow(patterns, "idx bigint, pattern bigint")
    p = F.col("pattern")
    if kind.kind in (dtypes.INT, dtypes.SCALABLE_INT, dtypes.FIXED):
        value = codec.wrap_int(p, width)
    else:
        value = codec.float_of_bits(p, kind.exponent, kind.mantissa)
    return raw.select("idx", value.alias("value")), kind


def stored_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of a Parquet table; only these are read."""
    return spark.read.parquet(path).select(*columns)
