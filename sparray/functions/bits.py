"""Packing numbers of any bit width into bytes, lowest bit first, and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(values: Sequence[int], width: int) -> bytes:
    """Unsigned patterns of ``width`` bits, one after another."""
    total = 0
    if width > 62:
        for i, v in enumerate(values):
            total |= (int(v) & ((1 << width) - 1)) << (i * width)
        return total.to_bytes(-(-len(values) * width // 8), "little")
    patterns = np.asarray(values, dtype=np.int64)
    bits = (patterns[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> list[int]:
    if width > 62:
        total = int.from_bytes(data, "little")
        return [(total >> (i * width)) & ((1 << width) - 1) for i in range(count)]
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(axis=1).tolist()


def packed(values: Column, width: int) -> Column:
    """An array<bigint> of patterns as binary."""
    @F.pandas_udf("binary")
    def pack(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if v is None else pack_bits(v, width))

    return pack(values)


def unpacked(data: Column, width: int, count: Column) -> Column:
    """Binary as an array<bigint> of ``count`` patterns."""
    @F.pandas_udf("array<bigint>")
    def unpack(series: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else unpack_bits(d, width, int(n)) for d, n in zip(series, counts, strict=True)])

    return unpack(data, count)
