"""Arrays, types, derivatives and traced functions on small made-up values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparray import Engine, Expr, compile, mode
from sparray.functions import codec, dtypes
from sparray.plans.expr import Binary, Const, simplified


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def arrays(engine, *values, dtype="float", bits=32, scale=1):
    return [Expr.var(engine, f"x{i}", v, dtype, bits, scale) for i, v in enumerate(values)]


@pytest.mark.parametrize(
    ("values", "kind", "expression", "wanted"),
    [
        (([1, 2, 3], [4, 5, 6]), {"dtype": "float"}, lambda x, y: (x + y) * 2.5, [12.5, 17.5, 22.5]),
        (([5, -10, 15], [10, 20, 30]), {"dtype": "int", "bits": 16}, lambda a, b: a * b, [50, -200, 450]),
        (([1.25, 2.5, 3.75], [0.75, 1.5, 2.25]), {"dtype": "floating_int", "scale": 2}, lambda a, b: a + b, [2, 4, 6]),
        (([1.5, 3, 4.5], [1.5, 3, 4.5]), {"dtype": "float"}, lambda a, b: a + b, [3, 6, 9]),
        (([5, -10, 15], [2, 3, 4]), {"dtype": "scalable_int"}, lambda a, b: a * b, [10, -30, 60]),
        (([1.5, 32.25, 0.125], [2, 0.5, 8]), {"dtype": "scalable_float"}, lambda a, b: a * b, [3, 16.125, 1]),
        (([2.0**40], [2.0**40]), {"dtype": "int", "bits": 64}, lambda a, b: a * b, [0]),
        (([2**40], [2**40]), {"dtype": "int", "bits": 128}, lambda a, b: a * b, [2.0**80]),
        (([2**50], [2**50]), {"dtype": "int", "bits": 256}, lambda a, b: a * b * a, [0]),
        (([1.25, 2.5], [4, 2]), {"dtype": "float", "bits": 128}, lambda a, b: a * b, [5, 5]),
        (([1, 2, 3], [4, 5, 6]), {"dtype": "float"}, lambda a, b: a - b, [-3, -3, -3]),
        (([7, -7], [-2, 2]), {"dtype": "int", "bits": 32}, lambda a, b: a / b, [-3, -3]),
        (([1, 2, 3], [10]), {"dtype": "float"}, lambda a, b: a + b, [11, 12, 13]),
        (([], []), {"dtype": "float"}, lambda a, b: a * b, []),
        (([1, 2], [0, 0]), {"dtype": "float", "bits": 64}, lambda a, b: a / b, [math.inf, math.inf]),
    ],
)
def test_arithmetic(engine, values, kind, expression, wanted):
    assert expression(*arrays(engine, *values, **kind)).unpack(engine) == wanted


def test_widths_sized_by_data(engine):
    assert arrays(engine, [5, -10, 15], dtype="scalable_int")[0].kind.bits == 5
    assert arrays(engine, [2, 3, 4], dtype="scalable_int")[0].kind.bits == 4
    found = [arrays(engine, v, dtype="scalable_float")[0].kind for v in ([1.5, 32.25, 0.125], [2.0, 0.5, 8.0])]
    assert [(k.bits, k.exponent) for k in found] == [(20, 4), (11, 4)]
    (x,) = arrays(engine, [32.25], dtype="scalable_float")
    assert (x * x).unpack(engine) == [math.inf]  # beyond the type's exponent


def test_derivatives(engine):
    x, y = arrays(engine, [2.0], [3.0])
    assert ((x + y) * x).grad(x).unpack(engine) == [7]
    a, b = arrays(engine, [2.0, 4.0], [4.0, 2.0])
    assert (a / b).grad(a).unpack(engine) == [0.25, 0.5]
    assert (a / b).grad(b).unpack(engine) == [-0.125, -1.0]
    assert (a + b).grad(a).unpack(engine) == [1.0, 1.0]  # a constant one, at the arrays' length
    with pytest.raises(ValueError, match="variable"):
        (a + b).grad(a + b)


def test_traced_and_modes(engine):
    @compile
    def f(x, y):
        return (x + y) * 3.0

    @compile(device="gpu")
    def g(x, k):
        return x * k

    assert f(engine, [1, 2, 3], [4, 5, 6]).unpack() == [15, 21, 27]
    assert g(engine, [1, 2, 3], 2).unpack() == [2, 4, 6]
    assert f(1, 2) == 9
    for m in ("default", "eager", "hyper", "xtreme", "unknown"):
        with mode(m):
            a, b = arrays(engine, [1, 2, 3], [4, 5, 6])
            assert (a + b).execute(engine).unpack() == [5, 7, 9]


def test_errors(engine):
    a, b = arrays(engine, [1, 2], [1, 2, 3])
    with pytest.raises(ValueError, match="lengths"):
        (a + b).execute(engine)
    with pytest.raises(TypeError):
        a + "1"
    with pytest.raises(ValueError, match="unknown dtype"):
        Expr.var(engine, "x", [1], "complex")


def test_simplified():
    x = Expr.col("x")
    assert simplified(x * 1.0) is x and simplified(x + 0) is x
    assert isinstance(simplified(x * 0), Binary)  # infinity times zero is no zero
    folded = simplified(Expr.const(2) * Expr.const(3))
    assert isinstance(folded, Const) and folded.value == 6


def quantized(v, e, m):
    """The rounding rule, restated on Python's floats."""
    bias, top = 2 ** (e - 1) - 1, 2**e - 1
    a = abs(v)
    if a >= (math.inf if top - bias > 1023 else 2.0 ** (top - bias)):
        return math.copysign(math.inf, v)
    if a < 2.0 ** (1 - bias):
        return 0.0
    f, x = math.frexp(a)
    x -= 1
    n = (f * 2 - 1) * 2**m
    n = min(math.floor(n + 0.5), 2**m - 1)
    return math.copysign((1 + n / 2**m) * 2.0**x, v)


@pytest.mark.parametrize(("e", "m"), [(5, 10), (8, 23), (8, 24), (4, 7)])
def test_quantize_float(spark, e, m):
    r = random.Random(e * 100 + m)
    values = [0.0, 1.9999999999, 16777217.0, -3.5, 1e300, -1e300, 1e-300, 65504.0, 2.0**-14]
    values += [r.uniform(-1, 1) * 2.0 ** r.randint(-30, 30) for _ in range(400)] + [2.0**k for k in range(-20, 20)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["q"] for r in frame.select("i", codec.quantize_float(F.col("v"), e, m).alias("q")).orderBy("i").collect()]
    assert got == [quantized(v, e, m) for v in values]


def test_bit_patterns(spark):
    values = [0.0, 1.0, -1.5, 0.333, 65504.0, 1e9, -1e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    p = codec.float_bits(F.col("v"), 5, 10)
    rows = frame.select("v", p.alias("p")).withColumn("back", codec.float_of_bits(F.col("p"), 5, 10)).collect()
    import numpy as np

    for r in rows:
        with np.errstate(over="ignore"):
            assert r["p"] == int(np.float16(r["v"]).view(np.uint16)) and r["back"] == float(np.float16(r["v"]))


def test_wrap_and_rounding(spark):
    r = spark.sql("select 70000L a, 4L b, double('NaN') n, 3e19D big, -2.5D h").select(
        codec.wrap_int(F.col("a"), 16).alias("a"), codec.wrap_int(F.col("b"), 3).alias("b"), codec.rounded_int(F.col("n")).alias("n"), codec.rounded_int(F.col("big")).alias("big"), codec.rounded_int(F.col("h")).alias("h")
    ).first()
    assert tuple(r) == (4464, -4, 0, 2**63 - 1, -3)
    top = 2**63 - 1
    frame = spark.createDataFrame([(top, top), (-top - 1, -1), (top, 1)], "a bigint, b bigint")
    signed = lambda v: (v + 2**63) % 2**64 - 2**63
    for op, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b)):
        got = [tuple(x) for x in frame.select("a", "b", codec.wrapped(op, F.col("a"), F.col("b")).alias("z")).collect()]
        assert all(z == signed(f(a, b)) for a, b, z in got)


def test_plan_is_one_projection(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    e = (Expr.col("l_extendedprice") + Expr.col("l_quantity")) * 2.5
    plan = items.select(e.to_column().alias("z"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1 and "Exchange" not in plan and "l_discount" not in plan
    assert not dtypes.floating(32).exact_double


def test_fixed_point_is_exact_and_wraps(spark):
    """Against Python's integers: products and quotients at scale 2, beyond 64 bits too; zero divisors raise."""
    pairs = [(150, 250), (400_000_000_000_000_000, 300_000_000_000_000_000), (100, 3 * 10**18), (9007199254740993, 100), (-155, 10), (1, -3), (-(2**63), 7), (2**63 - 1, 2**63 - 1), (5, 2), (0, 9)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a bigint, b bigint")
    a, b = (Expr.col(c, dtypes.fixed(2), stored=True) for c in "ab")
    signed = lambda v: (v + 2**63) % 2**64 - 2**63
    near = lambda n, d: (abs(n) + abs(d) // 2) // abs(d) * (1 if n * d >= 0 else -1)
    got = df.select("i", (a * b).to_column().alias("p"), (a / b).to_column().alias("q")).orderBy("i").collect()
    assert [r["p"] for r in got] == [signed(near(x * y, 100)) for x, y in pairs]
    assert [r["q"] for r in got] == [signed(near(x * 100, y)) for x, y in pairs]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="(?i)by zero"):
            df.select((a / Expr.col("i", dtypes.fixed(2))).to_column()).collect()
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_limbs(spark):
    """Patterns of any width against the definitions, and back."""
    import struct

    from sparray.functions import wide

    values = [0.0, 1.0, -2.5, 1e300, -1e-300, 0.1, float("inf"), 3.141592653589793]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for kind in (dtypes.floating(64), dtypes.floating(128), dtypes.floating(80), dtypes.floating(200)):
        rows = df.select("v", wide.limbs(F.col("v"), kind).alias("l")).select("v", "l", wide.of_limbs(F.col("l"), kind).cast("double").alias("b")).collect()
        assert all(r["v"] == r["b"] and len(r["l"]) == -(-kind.bits // 64) for r in rows)
        if kind.bits == 64:
            assert [r["l"][0] for r in rows] == [struct.unpack("<q", struct.pack("<d", r["v"]))[0] for r in rows]
    whole = spark.createDataFrame([(s,) for s in ("5", "-1", str(2**100 + 5), str(-(2**69)), str(15 * 10**37), None)], "v string")
    for n in (70, 128, 200):
        kind = dtypes.integer(n)
        for r in whole.select("v", wide.of_limbs(wide.limbs(F.col("v"), kind), kind).alias("b"), wide.limbs(F.col("v"), kind).alias("l"), Expr.col("v", kind).to_column().alias("s")).collect():
            want = None if r["v"] is None else str((int(r["v"]) + 2 ** (n - 1)) % 2**n - 2 ** (n - 1))
            assert r["b"] == want and r["s"] == want
            assert r["l"] is None or sum((x % 2**64) << (64 * i) for i, x in enumerate(r["l"])) == int(want) % 2 ** (64 * len(r["l"]))
    fixed = dtypes.fixed(2)
    assert [r[0] for r in spark.createDataFrame([("1.25",), ("-0.5",)], "v string").select(wide.of_limbs(wide.limbs(F.col("v"), fixed), fixed)).collect()] == ["1.25", "-0.5"]


def test_entry_without_a_dependency(tmp_path):
    """Something that the subpackage needs is missing: the library's own queries are still there."""
    import os
    import subprocess
    import sys

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and len(e.oracle_sql()) >= 40 and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, cwd=tmp_path).returncode == 0
