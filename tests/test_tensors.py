"""Tensors, matrix product, packed files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from sparray import Engine, Expr, Tensor, dequantize_matmul
from sparray.functions import bits, dtypes
from sparray.operators.tensor import common_shape, strides
from sparray.streaming import elementwise


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def tensor(engine, values, shape, dtype="float", n=32):
    return Tensor.from_values(engine, values, shape, dtype, n)


def test_broadcast_and_chain(engine):
    a, b = tensor(engine, [1, 2, 3], [3, 1]), tensor(engine, [10, 20], [1, 2])
    assert (a + b).numpy() == [[11, 21], [12, 22], [13, 23]]
    assert ((a + b) * a).numpy() == [[11, 21], [24, 44], [39, 69]]
    assert (a - b).shape == [3, 2]
    with pytest.raises(TypeError):
        a + 1
    with pytest.raises(ValueError, match="broadcast"):
        a + tensor(engine, [1, 2], [2, 1])


def test_index_algebra(engine):
    t = tensor(engine, [0, 1, 2, 3, 4, 5], [2, 3])
    assert t.reshape([3, 2]).numpy() == [[0, 1], [2, 3], [4, 5]]
    assert t.transpose().numpy() == [[0, 3], [1, 4], [2, 5]]
    assert t.slice_and_dice([(0, 2, 1), (0, 3, 2)]).numpy() == [[0, 2], [3, 5]]
    assert t.slice_and_dice([(1, 9, 1)]).numpy() == [[3, 4, 5]]
    assert t.slice_and_dice([(2, 2, 1)]).shape == [0, 3]
    assert t.transpose().transpose().numpy() == t.numpy()
    assert tensor(engine, [7], [1], "int", 8).tile(3).numpy() == [7, 7, 7]
    assert t.tile(0).numpy() == []
    with pytest.raises(ValueError):
        t.reshape([4, 2])
    with pytest.raises(ValueError):
        tensor(engine, [1], [2])
    assert strides((2, 3, 4)) == (12, 4, 1) and common_shape((3, 1), (2,)) == (3, 2)


def test_three_axes(engine):
    t = tensor(engine, list(range(24)), [2, 3, 4])
    whole = [[[i * 12 + j * 4 + k for k in range(4)] for j in range(3)] for i in range(2)]
    assert t.numpy() == whole
    assert t.transpose().numpy() == [[[whole[i][j][k] for i in range(2)] for j in range(3)] for k in range(4)]


def test_matmul(engine):
    ones = tensor(engine, [1] * 8, [1, 8])
    weights = tensor(engine, [1, 2, 3, 4, -1, -2, -3, -4], [8, 1], "int", 3)
    assert dequantize_matmul(ones, weights).numpy() == [[-8]]
    assert Tensor.dequantize_matmul(ones, weights, 2).numpy() == [[-4]]
    with pytest.raises(ValueError, match="inner"):
        dequantize_matmul(ones, ones)


def test_gradient_keeps_identity(engine):
    t = tensor(engine, [1, 2, 3, 4], [2, 2])
    assert t.grad(lambda x: x * x).numpy() == [[2, 4], [6, 8]]


def test_numpy_protocol(engine):
    import numpy as np

    assert np.array(tensor(engine, [1, -2], [2], "int", 16)).dtype == np.int16
    with pytest.raises(TypeError):
        np.array(tensor(engine, [1, 2], [2]))  # its sign bit is gone


@pytest.mark.parametrize(("values", "width"), [([5, 2, 7, 1, 0, 4, 6, 3], 3), ([2047, 1024, 0, 512, 123, 999], 11), ([0, 1, 127, 255], 8), ([0, 0x1234, 0xDEADBEEF, 0xFFFFFFFF], 32), ([1 << 100, (1 << 127) + 5], 128), ([], 5)])
def test_packing(values, width):
    data = bits.pack_bits(values, width)
    assert len(data) == math.ceil(len(values) * width / 8)
    assert bits.unpack_bits(data, width, len(values)) == values


def test_packed_file(engine, tmp_path):
    path = tmp_path / "p.bin"
    path.write_bytes(bits.pack_bits([5, 2, 7, 1, 0, 4, 6, 3], 3))
    t = Tensor.from_mmap(engine, f"file://{path}", 8, [2, 4], "int", 3)
    assert t.numpy() == [[-3, 2, -1, 1], [0, -4, -2, 3]]
    import numpy as np

    path.write_bytes(np.array([1.5, -2.25, 0], dtype=np.float32).tobytes())
    assert Tensor.from_mmap(engine, f"file://{path}", 3, [3], "float", 32).numpy() == [1.5, -2.25, 0]


def test_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    out = elementwise.select(stream, ["event_id"], z=Expr.col("value") * 2 + 1)
    q = out.writeStream.format("memory").queryName("elementwise").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["z"] for r in spark.table("elementwise").collect()}
    assert got == {r["event_id"]: r["value"] * 2 + 1 for r in source.collect()}


def test_large_side_is_joined_not_broadcast(spark):
    big = Tensor.from_frame(spark.range(10).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("value")), (2_000_000,), dtypes.dynamic())
    plan = (big + big).frame._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_chain_is_one_expression(engine):
    """A tensor with itself is one projection, a chain one join, and its derivative is that of the whole."""
    a, b = tensor(engine, [1, 2, 3, 4], [2, 2]), tensor(engine, [5, 6], [1, 2])
    assert "Join" not in (a + a * a).frame._jdf.queryExecution().optimizedPlan().toString()
    assert ((a + b) * a - b).numpy() == [[1, 10], [19, 34]]
    assert ((a + b) * a).grad(a).numpy() == [[7, 10], [11, 14]]
    assert ((a + b) * a).grad(b).numpy() == [[1, 2], [3, 4]]
    assert (a * a.transpose()).numpy() == [[1, 6], [6, 16]]
    product = dequantize_matmul(a, tensor(engine, [1, 0, 0, 1], [2, 2], "int", 8))
    assert (product + b).numpy() == [[6, 8], [8, 10]]
    with pytest.raises(NotImplementedError):
        (product + b).grad(a)


def test_array_interface(engine):
    import numpy as np

    held = tensor(engine, [-1, 2, 3, 4], [2, 2])
    assert held.__array_interface__["typestr"] == "<f4" and np.asarray(held).tolist() == [[-1, 2], [3, 4]]
    for other in (tensor(engine, [1, 2], [2]), tensor(engine, [1, 2], [2], "int", 11), tensor(engine, [1, 2], [2], "floating_int")):
        with pytest.raises(ValueError, match="numpy"):
            other.__array_interface__


def test_eager_is_released(engine):
    from sparray import mode

    with mode("eager"):
        out = (Expr.var(engine, "x", [1, 2, 3]) * 2).execute(engine)
    assert out.frame.is_cached and out.unpack() == [2, 4, 6]
    engine.release()
    assert not out.frame.is_cached


def test_wide_packed_file(engine, tmp_path):
    from sparray.functions.wide import float_pattern

    values = [3 * 2**68 + 7, -5, 2**70 - 1]
    path = tmp_path / "wide.bin"
    path.write_bytes(bits.pack_bits([v & (2**70 - 1) for v in values], 70))
    assert [r["value"] for r in Tensor.from_mmap(engine, str(path), 3, (3,), "int", 70).frame.orderBy("idx").collect()] == [str(v - 2**70 if v >= 2**69 else v) for v in values]
    kind = dtypes.floating(128)
    path.write_bytes(bits.pack_bits([float_pattern(v, kind) for v in (1.5, -0.1, 0.0)], 128))
    assert Tensor.from_mmap(engine, str(path), 3, (3,), "float", 128).numpy() == [1.5, -0.1, 0.0]
