"""The library's queries for the driver, and their SQL. Rows keep a key, so each is compared value by value."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits as packing
from .functions import codec, dtypes, wide
from .operators import linalg
from .operators.tensor import Tensor, range_tensor
from .plans.engine import MODES, Engine, mode, traced
from .plans.engine import compile as compiled
from .plans.expr import Expr
from .storage import shared_root

ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ITEM, *[c.alias(n) for n, c in columns.items()])


def price() -> Expr:
    return Expr.col("l_extendedprice")


def quantity() -> Expr:
    return Expr.col("l_quantity")


def item_sql(expression: str, name: str = "z") -> str:
    return f"SELECT {', '.join(ITEM)}, {expression} AS {name} FROM lineitem"


# ---- element-wise ------------------------------------------------------------------------------------------------------


@query(item_sql("(l_extendedprice + l_quantity) * 2.5::DOUBLE"))
def fused_affine(spark, sf_dir):
    return items(spark, sf_dir, z=((price() + quantity()) * 2.5).to_column())


@query(item_sql("l_extendedprice + l_quantity"))
def ew_add(spark, sf_dir):
    return items(spark, sf_dir, z=(price() + quantity()).to_column())


@query(item_sql("l_extendedprice - l_quantity"))
def ew_sub(spark, sf_dir):
    return items(spark, sf_dir, z=(price() - quantity()).to_column())


@query(item_sql("l_extendedprice * l_quantity"))
def ew_mul(spark, sf_dir):
    return items(spark, sf_dir, z=(price() * quantity()).to_column())


@query(item_sql("l_extendedprice / l_quantity"))
def ew_div(spark, sf_dir):
    return items(spark, sf_dir, z=(price() / quantity()).to_column())


@query(f"SELECT {', '.join(ITEM)}, 1.0::DOUBLE - l_discount AS a, 1.0::DOUBLE / l_quantity AS b, 3.0::DOUBLE + l_tax AS c, 2.0::DOUBLE * l_tax AS d FROM lineitem")
def reflected_ops(spark, sf_dir):
    discount, tax = Expr.col("l_discount"), Expr.col("l_tax")
    return items(spark, sf_dir, a=(1.0 - discount).to_column(), b=(1 / quantity()).to_column(), c=(3 + tax).to_column(), d=(2 * tax).to_column())


@query(item_sql("CASE WHEN l_discount = 0 THEN CASE WHEN l_tax - 0.04::DOUBLE = 0 THEN 'nan' WHEN l_tax - 0.04::DOUBLE > 0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END"))
def div_by_zero_ieee(spark, sf_dir):
    q = ((Expr.col("l_tax") - 0.04) / Expr.col("l_discount")).to_column()
    said = F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == -float("inf"), "-inf").otherwise("finite")
    return items(spark, sf_dir, z=said)


def _wrap_sql(x: str, bits: int) -> str:
    half, full = 2 ** (bits - 1), 2**bits
    return f"((((({x})::HUGEINT + {half}) % {full}) + {full}) % {full} - {half})::BIGINT"


@query(f"SELECT p_partkey, {_wrap_sql(_wrap_sql('round(p_retailprice)', 16) + ' * ' + _wrap_sql('p_partkey', 16), 16)} AS z FROM part")
def int16_wrap_mul(spark, sf_dir):
    z = Expr.col("p_retailprice", "int", 16) * Expr.col("p_partkey", "int", 16, integral=True)
    return table(spark, sf_dir, "part").select("p_partkey", z.to_column().alias("z"))


@query(f"SELECT p_partkey, {_wrap_sql('p_size', 3)} AS z FROM part")
def int3_wrap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Expr.col("p_size", "int", 3, integral=True).to_column().alias("z"))


@query(f"SELECT o_orderkey, {_wrap_sql('(o_orderkey + 4000000007)::HUGEINT * ' + '(o_custkey + 6000000011)::HUGEINT', 64)} AS z FROM orders")
def int64_wrap_mul(spark, sf_dir):
    a, b = (Expr.col(F.col(c) + F.lit(n), "int", 64, integral=True) for c, n in (("o_orderkey", 4000000007), ("o_custkey", 6000000011)))
    return table(spark, sf_dir, "orders").select("o_orderkey", (a * b).to_column().alias("z"))


@query("SELECT p_partkey, ((p_size - 25)::BIGINT // (CASE WHEN p_partkey % 7 < 3 THEN p_partkey % 7 - 4 ELSE p_partkey % 7 END)::BIGINT)::BIGINT AS z FROM part")
def int_div_trunc(spark, sf_dir):
    k = F.col("p_partkey") % 7
    a, b = Expr.col(F.col("p_size") - 25, "int", 32, integral=True), Expr.col(F.when(k < 3, k - 4).otherwise(k), "int", 32, integral=True)
    return table(spark, sf_dir, "part").select("p_partkey", (a / b).to_column().alias("z"))


@query(f"SELECT p_partkey, {_wrap_sql(_wrap_sql('p_size', 8) + ' * p_partkey', 8)} AS a, {_wrap_sql('p_partkey * ' + _wrap_sql('p_size', 8), 32)} AS b FROM part")
def mixed_width_left_type(spark, sf_dir):
    size, key = Expr.col("p_size", "int", 8, integral=True), Expr.col("p_partkey", "int", 32, integral=True)
    return table(spark, sf_dir, "part").select("p_partkey", (size * key).to_column().alias("a"), (key * size).to_column().alias("b"))


@query("SELECT c_custkey, (round(c_acctbal * 100) + round(c_acctbal * 100))::BIGINT AS z FROM customer")
def fixed_point_add(spark, sf_dir):
    a = Expr.col("c_acctbal", "floating_int", scale=2)
    return table(spark, sf_dir, "customer").select("c_custkey", (a + a).to_column().alias("z"))


@query("SELECT c_custkey, (round(c_acctbal * 100) * 3)::BIGINT AS a, (round(c_acctbal * 100) + 3)::BIGINT AS b FROM customer")
def fixed_point_scale_const(spark, sf_dir):
    a = Expr.col("c_acctbal", "floating_int", scale=2)
    return table(spark, sf_dir, "customer").select("c_custkey", (a * 3).to_column(raw_fixed_point=True).alias("a"), (a + 3).to_column(raw_fixed_point=True).alias("b"))


@query("SELECT CASE WHEN max(abs(round(o_totalprice))) = 0 THEN 2 ELSE length(ltrim(bin(max(abs(round(o_totalprice)))::BIGINT), '0')) + 1 END::INTEGER AS bits FROM orders")
def scalable_int_bits(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max(codec.int_width(F.col("o_totalprice"))).alias("bits"))


@query("SELECT o_orderkey, (round(o_totalprice)::HUGEINT * o_custkey)::BIGINT AS z FROM orders")
def scalable_int_mul(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    z = Expr.col("o_totalprice", "scalable_int", frame=orders) * Expr.col("o_custkey", "scalable_int", frame=orders)
    return orders.select("o_orderkey", z.to_column().alias("z"))


_LADDER = " ".join(f"WHEN x BETWEEN {1 - (2 ** (e - 1) - 1)} AND {2**e - 2 - (2 ** (e - 1) - 1)} THEN {e}" for e in range(2, 15))


@query(f"""
WITH v AS (SELECT event_id, floor(log2(value)) AS x FROM events),
c AS (SELECT event_id, CASE {_LADDER} ELSE 15 END AS e, CASE WHEN abs(x) <= 4 THEN 8 WHEN abs(x) <= 10 THEN 16 WHEN abs(x) <= 20 THEN 24 WHEN abs(x) <= 40 THEN 32 ELSE 40 END AS m FROM v)
SELECT event_id, greatest(8, e + m + 1)::INTEGER AS bits, e::INTEGER AS exponent FROM c
""")
def scalable_float_config(spark, sf_dir):
    bits, exponent = codec.float_config(F.col("value"), unsigned=False)
    return table(spark, sf_dir, "events").select("event_id", bits.alias("bits"), exponent.alias("exponent"))


def _quantize_sql(source: str, key: str, v: str, e: int, m: int) -> str:
    bias, top = 2 ** (e - 1) - 1, 2**e - 1
    return f"""
WITH a AS (SELECT {key}, {v}::DOUBLE AS v, abs({v})::DOUBLE AS a FROM {source}),
b AS (SELECT *, CASE WHEN a < pow(2::DOUBLE, {1 - bias}) OR a >= pow(2::DOUBLE, {top - bias}) THEN 0 ELSE floor(log2(a)) END AS x0 FROM a),
c AS (SELECT *, CASE WHEN a / pow(2::DOUBLE, x0) >= 2 THEN x0 + 1 WHEN a / pow(2::DOUBLE, x0) < 1 AND a >= pow(2::DOUBLE, {1 - bias}) THEN x0 - 1 ELSE x0 END AS x FROM b)
SELECT {key}, CASE WHEN a >= pow(2::DOUBLE, {top - bias}) THEN CASE WHEN v < 0 THEN '-Infinity'::DOUBLE ELSE 'Infinity'::DOUBLE END WHEN a < pow(2::DOUBLE, {1 - bias}) THEN 0::DOUBLE
  ELSE (CASE WHEN v < 0 THEN -1::DOUBLE ELSE 1::DOUBLE END) * (1 + least(round((a / pow(2::DOUBLE, x) - 1) * {2**m}::DOUBLE), {2**m - 1}::DOUBLE) / {2**m}::DOUBLE) * pow(2::DOUBLE, x) END AS z FROM c
"""


@query(_quantize_sql("events", "event_id", "value", 5, 10))
def quantize_f16(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Expr.col("value", "float", 16).to_column().alias("z"))


@query(_quantize_sql("customer", "c_custkey", "c_acctbal", 8, 23))
def quantize_f32(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Expr.col("c_acctbal", "float", 32).to_column().alias("z"))


@query(_quantize_sql("events", "event_id", "value", 8, 24))
def quantize_f32_stolen(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Expr.col("value", dtypes.floating(32, unsigned=True)).to_column().alias("z"))


@query("""
SELECT 'c_acctbal' AS name, bool_and(c_acctbal >= 0 AND NOT isnan(c_acctbal)) AS unsigned FROM customer
UNION ALL SELECT 'value', bool_and(value >= 0 AND NOT isnan(value)) FROM events UNION ALL SELECT 'l_discount', bool_and(l_discount >= 0 AND NOT isnan(l_discount)) FROM lineitem
""")
def sign_steal_flag(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(codec.never_negative(F.col(c)).alias("unsigned")).select(F.lit(c).alias("name"), "unsigned") for t, c in (("customer", "c_acctbal"), ("events", "value"), ("lineitem", "l_discount"))]
    return parts[0].union(parts[1]).union(parts[2])


_F16 = _quantize_sql("events", "event_id", "value", 5, 10)


@query(f"""
WITH q AS ({_F16}), x AS (SELECT event_id, z, CASE WHEN z > 0 THEN floor(log2(z)) ELSE 0 END AS x FROM q)
SELECT event_id, (CASE WHEN z = 0 THEN 0 ELSE (x + 15) * 1024 + round((z / pow(2::DOUBLE, x) - 1) * 1024) END)::BIGINT AS pattern, z AS back FROM x
""")
def float_encode_bits(spark, sf_dir):
    pattern = codec.float_bits(F.col("value"), 5, 10)
    return table(spark, sf_dir, "events").select("event_id", pattern.alias("pattern")).withColumn("back", codec.float_of_bits(F.col("pattern"), 5, 10))


# ---- derivatives and traced functions ----------------------------------------------------------------------------------


def _gradient(spark, sf_dir, make: Callable[[Expr, Expr], Expr], by: int) -> DataFrame:
    x, y = price(), quantity()
    found = make(x, y).grad((x, y)[by])
    return items(spark, sf_dir, z=found.to_double())


def _gradient_sql(expression: str) -> str:
    inner = _quantize_sql(f"(SELECT {', '.join(ITEM)}, {expression} AS g FROM lineitem)", ", ".join(ITEM), "g", 8, 23)
    return inner


@query(_gradient_sql("(l_extendedprice + l_quantity) + l_extendedprice"))
def grad_product(spark, sf_dir):
    return _gradient(spark, sf_dir, lambda x, y: (x + y) * x, 0)


@query(_gradient_sql("(0::DOUBLE - l_extendedprice) / (l_quantity * l_quantity)"))
def grad_quotient(spark, sf_dir):
    return _gradient(spark, sf_dir, lambda x, y: x / y, 1)


@query(_gradient_sql("1::DOUBLE"))
def grad_sum(spark, sf_dir):
    return _gradient(spark, sf_dir, lambda x, y: x + y, 0)


@query(_gradient_sql("0::DOUBLE"))
def grad_const(spark, sf_dir):
    return _gradient(spark, sf_dir, lambda x, y: Expr.const(5.0) + y, 0)


@query(item_sql("(l_extendedprice + l_quantity) * 3::DOUBLE"))
def compile_udf(spark, sf_dir):
    e = traced(lambda x, y, k: (x + y) * k, Engine(spark), price(), quantity(), 3.0)
    return items(spark, sf_dir, z=e.to_column())


# ---- tensors -----------------------------------------------------------------------------------------------------------

DIMS = 64
_ELEMENTS = "(SELECT vec_id * 64 + k AS idx, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS k))"


def embedding_tensor(spark: SparkSession, sf_dir: str) -> Tensor:
    """embeddings as a [n, 64] tensor of doubles; vec_id is the row."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    elements = vectors.select("vec_id", F.posexplode("embedding").alias("k", "v")).select((F.col("vec_id") * DIMS + F.col("k")).alias("idx"), F.col("v").cast("double").alias("value"))
    return Tensor.from_frame(elements, (n, DIMS), dtypes.dynamic())


@query(f"SELECT idx, value FROM {_ELEMENTS}")
def tensor_reshape(spark, sf_dir):
    t = embedding_tensor(spark, sf_dir)
    return t.reshape((t.sizes[0] * 8, 8)).decoded()


@query(f"SELECT (idx % 64) * (SELECT count(*) FROM embeddings) + idx // 64 AS idx, value FROM {_ELEMENTS}")
def tensor_transpose(spark, sf_dir):
    return embedding_tensor(spark, sf_dir).transpose().decoded()


@query(f"SELECT ((idx // 64 - 1) // 3) * 31 + (idx % 64 - 2) // 2 AS idx, value FROM {_ELEMENTS} WHERE idx // 64 BETWEEN 1 AND 399 AND (idx // 64 - 1) % 3 = 0 AND idx % 64 >= 2 AND idx % 2 = 0")
def tensor_slice(spark, sf_dir):
    return embedding_tensor(spark, sf_dir).slice_and_dice([(1, 400, 3), (2, 100, 2)]).decoded()


@query(f"SELECT idx, value + (idx % 64) AS value FROM {_ELEMENTS}")
def tensor_broadcast_row(spark, sf_dir):
    return (embedding_tensor(spark, sf_dir) + range_tensor(spark, (1, DIMS), dtypes.dynamic())).decoded()


@query(f"SELECT idx, value * (idx // 64) AS value FROM {_ELEMENTS}")
def tensor_broadcast_col(spark, sf_dir):
    t = embedding_tensor(spark, sf_dir)
    return (t * range_tensor(spark, (t.sizes[0], 1), dtypes.dynamic())).decoded()


@query("SELECT n.n_nationkey * 5 + r.r_regionkey AS idx, (n.n_nationkey + 10 * r.r_regionkey)::DOUBLE AS value FROM nation n CROSS JOIN region r")
def tensor_outer_add(spark, sf_dir):
    kind = dtypes.integer(32)
    n = Tensor.from_frame(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.col("n_nationkey").cast("bigint").alias("value")), (25, 1), kind)
    r = Tensor.from_frame(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("idx"), (F.col("r_regionkey") * 10).cast("bigint").alias("value")), (1, 5), kind)
    return (n + r).decoded()


@query("SELECT (r_regionkey + 5 * k)::BIGINT AS idx, r_regionkey::DOUBLE AS value FROM region, (SELECT unnest(range(3)) AS k)")
def tensor_tile(spark, sf_dir):
    r = Tensor.from_frame(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("idx"), F.col("r_regionkey").cast("bigint").alias("value")), (5,), dtypes.integer(32))
    return r.tile(3).decoded()


@query("""
WITH a AS (SELECT vec_id, k, round(embedding[k + 1]::DOUBLE * 127)::BIGINT AS a FROM embeddings, (SELECT unnest(range(64)) AS k)),
w AS (SELECT i // 2 AS k, i % 2 AS j, ((i * 7 + 3) % 8 - CASE WHEN (i * 7 + 3) % 8 >= 4 THEN 8 ELSE 0 END)::BIGINT AS w FROM (SELECT unnest(range(128)) AS i))
SELECT (a.vec_id * 2 + w.j)::BIGINT AS idx, sum(a.a * w.w)::DOUBLE AS value FROM a JOIN w ON a.k = w.k GROUP BY a.vec_id, w.j
""")
def dequant_matmul_int(spark, sf_dir):
    t = embedding_tensor(spark, sf_dir)
    rounded = Tensor.from_frame(t.frame.select("idx", codec.rounded_int(F.col("value") * 127.0).cast("double").alias("value")), t.sizes, dtypes.dynamic())
    raw = spark.range(DIMS * 2).select(F.col("id").alias("idx"), codec.wrap_int((F.col("id") * 7 + 3) % 8, 3).alias("value"))
    return linalg.dequantize_matmul(rounded, Tensor.from_frame(raw, (DIMS, 2), dtypes.integer(3))).frame


@query("SELECT p_partkey, p_size::BIGINT AS z FROM part")
def pack_unpack_roundtrip(spark, sf_dir):
    groups = table(spark, sf_dir, "part").groupBy((F.floor(F.col("p_partkey") / 1000)).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_size").cast("bigint").alias("s")))).alias("rows"))
    keys, sizes = F.transform("rows", lambda r: r["p_partkey"]), F.transform("rows", lambda r: r["s"])
    data = groups.select(keys.alias("keys"), packing.packed(sizes, 6).alias("data"))
    back = data.select("keys", packing.unpacked(F.col("data"), 6, F.size("keys")).alias("sizes"))
    return back.select(F.explode(F.arrays_zip("keys", "sizes")).alias("r")).select(F.col("r.keys").alias("p_partkey"), F.col("r.sizes").alias("z"))


@query("SELECT i::BIGINT AS idx, ((i * 37) % 2048)::BIGINT - CASE WHEN (i * 37) % 2048 >= 1024 THEN 2048 ELSE 0 END AS value FROM (SELECT unnest(range(1000)) AS i)")
def mmap_source(spark, sf_dir):
    """Patterns of 11 bits, written as a file where the session's shared folder is, and read back."""
    path = f"{shared_root(spark)}/packed/{os.urandom(8).hex()}.bin"
    data = packing.pack_bits([(i * 37) % 2048 for i in range(1000)], 11)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(data))
    stream.close()
    return Tensor.from_mmap(Engine(spark), path, 1000, (1000,), "int", 11).frame


@query(f"SELECT {', '.join(ITEM)}, {', '.join(f'(l_extendedprice + l_quantity) * 2.5::DOUBLE AS {m}' for m in MODES)} FROM lineitem")
def mode_equivalence(spark, sf_dir):
    out = {}
    for m in MODES:
        with mode(m):
            out[m] = ((price() + quantity()) * 2.5).to_column()
    return items(spark, sf_dir, **out)


@query("SELECT o_orderkey, ((o_orderkey + 1)::HUGEINT * (o_custkey + 3)::HUGEINT * 1000000007::HUGEINT)::VARCHAR AS z FROM orders")
def int128_mul(spark, sf_dir):
    a, b = Expr.col(F.col("o_orderkey") + 1, "int", 128), Expr.col(F.col("o_custkey") + 3, "int", 128)
    return table(spark, sf_dir, "orders").select("o_orderkey", (a * b * 1000000007).to_column().alias("z"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 127)))::DOUBLE AS a, 2 * list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 127)))::DOUBLE AS b FROM embeddings")
def row_matmul(spark, sf_dir):
    rounded = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 127.0)).alias("v"))
    cells = rounded.select("vec_id", linalg.rows_times_matrix(rounded, "v", [[1.0, 2.0]] * DIMS).alias("c"))
    return cells.select("vec_id", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


# ---- arrays, wide numbers, fixed point, tensors as expressions ---------------------------------------------------------


@query("SELECT i AS idx, (i % 7 + 3 * i) * 2.5::DOUBLE + 10 AS value FROM (SELECT unnest(range(2000)) AS i)")
def array_join(spark, sf_dir):
    """Arrays of their own, joined by position; one of length 1 goes with every element."""
    engine = Engine(spark)
    x = Expr.var(engine, "x", [float(i % 7) for i in range(2000)], "dynamic_float")
    y = Expr.var(engine, "y", [3.0 * i for i in range(2000)], "dynamic_float")
    ten = Expr.var(engine, "ten", [10.0], "dynamic_float")
    return ((x + y) * 2.5 + ten).execute(engine).frame


@query("SELECT i AS idx, (i * 3 + 0.5)::DOUBLE AS value FROM (SELECT unnest(range(100)) AS i)")
def array_unpack(spark, sf_dir):
    """The values as a list on the driver, up to a limit."""
    engine = Engine(spark)
    x = Expr.var(engine, "x", [float(i) for i in range(300)], "dynamic_float")
    found = (x * 3 + 0.5).unpack(engine, limit=100)
    return spark.createDataFrame(list(enumerate(found)), "idx bigint, value double")


@query("SELECT i AS idx, (i * i + 2 * i)::DOUBLE AS value FROM (SELECT unnest(range(50)) AS i)")
def compile_lists(spark, sf_dir):
    """A compiled function called with an engine and a list."""
    engine = Engine(spark)
    return traced_square(engine, [float(i) for i in range(50)]).frame.select("idx", F.col("value").cast("double").alias("value"))


@compiled
def traced_square(x):
    return x * x + 2 * x


@query("SELECT o_orderkey, (o_totalprice + o_custkey) * 2.5::DOUBLE AS z, 4 AS n FROM orders")
def mode_execute(spark, sf_dir):
    """Every mode executes; each row with its result and how many modes gave it."""
    frame, engine, found = table(spark, sf_dir, "orders"), Engine(spark), None
    size = frame.count()
    for m in MODES:
        with mode(m):
            x, y = (Expr.array(frame, "o_orderkey", c, size) for c in ("o_totalprice", "o_custkey"))
            out = ((x + y) * 2.5).execute(engine).frame
        found = out if found is None else found.union(out)
    met = found.groupBy("idx", "value").agg(F.count("*").cast("int").alias("n"))
    return met.select(F.col("idx").alias("o_orderkey"), F.col("value").alias("z"), "n")


def _scaled(kind: str, scale: int, op: str) -> Callable:
    def run(spark, sf_dir):
        a, b = Expr.col("l_extendedprice", kind, scale=scale), Expr.col("l_quantity", kind, scale=scale)
        return items(spark, sf_dir, z=(a * b if op == "*" else a / b).to_column())

    return run


@query(item_sql("(round(l_extendedprice * 100)::HUGEINT * round(l_quantity * 100)::HUGEINT // 100)::BIGINT"))
def fixed_point_mul(spark, sf_dir):
    """Products of numbers with two decimal places keep them; quantities are whole, so none is rounded."""
    return _scaled("floating_int", 2, "*")(spark, sf_dir)


@query(item_sql("((2 * round(l_extendedprice * 100)::HUGEINT * 100 + round(l_quantity * 100)::HUGEINT) // (2 * round(l_quantity * 100)::HUGEINT))::BIGINT"))
def fixed_point_div(spark, sf_dir):
    """Quotients are exact before they are rounded to two places, halves away from zero."""
    return _scaled("floating_int", 2, "/")(spark, sf_dir)


@query(item_sql("(round(l_extendedprice * 100)::HUGEINT * 90071992547409931 % 18446744073709551616 - CASE WHEN round(l_extendedprice * 100)::HUGEINT * 90071992547409931 % 18446744073709551616 >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)::BIGINT"))
def fixed_point_wrap(spark, sf_dir):
    """What needs more than 64 bits wraps; the raw integers are multiplied."""
    a = Expr.col("l_extendedprice", "floating_int", scale=2)
    b = Expr.col(F.lit(90071992547409931), dtypes.fixed(2), stored=True)
    return items(spark, sf_dir, z=(a * b).to_column(raw_fixed_point=True))


@query("SELECT o_orderkey, (((o_orderkey::HUGEINT * 1000000000000000000 + 590295810358705651712) % 1180591620717411303424) - 590295810358705651712)::VARCHAR AS z FROM orders")
def int70_wrap(spark, sf_dir):
    """Products at 70 bits, in two's complement."""
    return table(spark, sf_dir, "orders").select("o_orderkey", (Expr.col("o_orderkey", "int", 70) * 10**18).to_column().alias("z"))


@query("SELECT i AS idx, (((i::HUGEINT * 100000000000000000000 + 590295810358705651712) % 1180591620717411303424) - 590295810358705651712)::VARCHAR AS value FROM (SELECT unnest(range(200)) AS i)")
def int70_var(spark, sf_dir):
    """An array is wrapped to its width as it is stored."""
    return Expr.var(Engine(spark), "x", [i * 10**20 for i in range(200)], "int", 70).frame


@query("SELECT o_orderkey, ((o_orderkey + 1)::HUGEINT * (o_custkey + 3)::HUGEINT * 1000000007::HUGEINT // (o_custkey + 11)::HUGEINT)::VARCHAR AS z FROM orders")
def int128_div(spark, sf_dir):
    a, b, c = (Expr.col(F.col(n) + k, "int", 128) for n, k in (("o_orderkey", 1), ("o_custkey", 3), ("o_custkey", 11)))
    return table(spark, sf_dir, "orders").select("o_orderkey", (a * b * 1000000007 / c).to_column().alias("z"))


@query(item_sql("((floor(log2(l_extendedprice)) + 1023)::BIGINT * 4503599627370496 + ((l_extendedprice / pow(2, floor(log2(l_extendedprice))) - 1) * 4503599627370496)::BIGINT)"))
def float64_bits(spark, sf_dir):
    """The bit pattern of a 64-bit float, as one limb."""
    return items(spark, sf_dir, z=wide.limbs(F.col("l_extendedprice"), dtypes.floating(64))[0])


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS z FROM orders")
def float128_roundtrip(spark, sf_dir):
    """A 128-bit float as two limbs, and back."""
    kind = dtypes.floating(128)
    return table(spark, sf_dir, "orders").select("o_orderkey", wide.of_limbs(wide.limbs(F.col("o_totalprice"), kind), kind).cast("double").alias("z"))


@query("SELECT o_orderkey, (o_custkey - 500)::VARCHAR AS z, CASE WHEN o_custkey < 500 THEN -1 ELSE 0 END::BIGINT AS high FROM orders")
def int_limbs(spark, sf_dir):
    """A 128-bit integer as two limbs, the sign extended to the upper one, and back."""
    kind = dtypes.integer(128)
    limbs = wide.limbs((F.col("o_custkey") - 500).cast("string"), kind)
    return table(spark, sf_dir, "orders").select("o_orderkey", wide.of_limbs(limbs, kind).alias("z"), limbs[1].alias("high"))


def _keys(spark, sf_dir, name, key, scale=1):
    return Tensor.from_frame(table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("idx"), (F.col(key) * scale + 1).cast("double").alias("value")), (table(spark, sf_dir, name).count(),), dtypes.dynamic())


@query("SELECT (n.n_nationkey * 5 + r.r_regionkey)::BIGINT AS idx, ((n.n_nationkey + 1) - (r.r_regionkey * 10 + 1))::DOUBLE AS value FROM nation n, region r")
def tensor_sub(spark, sf_dir):
    n, r = _keys(spark, sf_dir, "nation", "n_nationkey"), _keys(spark, sf_dir, "region", "r_regionkey", 10)
    return (n.reshape((25, 1)) - r.reshape((1, 5))).decoded()


@query("SELECT (n.n_nationkey * 5 + r.r_regionkey)::BIGINT AS idx, (n.n_nationkey + 1)::DOUBLE / (r.r_regionkey * 10 + 1)::DOUBLE AS value FROM nation n, region r")
def tensor_div(spark, sf_dir):
    n, r = _keys(spark, sf_dir, "nation", "n_nationkey"), _keys(spark, sf_dir, "region", "r_regionkey", 10)
    return (n.reshape((25, 1)) / r.reshape((1, 5))).decoded()


@query("SELECT n_nationkey::BIGINT AS idx, (2 * (n_nationkey + 1) + 3 * n_nationkey + 1)::DOUBLE AS value FROM nation")
def tensor_grad(spark, sf_dir):
    """The derivative of a tensor expression, x * x + x * y, with respect to x."""
    x, y = _keys(spark, sf_dir, "nation", "n_nationkey"), _keys(spark, sf_dir, "nation", "n_nationkey", 3)
    return (x * x + x * y).grad(x).decoded().select("idx", F.col("value").cast("double").alias("value"))


@query("SELECT (i * 2)::BIGINT AS idx, (i + 1 + i * 2)::DOUBLE AS value FROM (SELECT unnest(range(3)) AS i) UNION ALL SELECT (i * 2 + 1)::BIGINT, (i + 1 + i * 2 + 1)::DOUBLE FROM (SELECT unnest(range(3)) AS i)")
def tensor_values(spark, sf_dir):
    """Tensors of values on the driver: [3, 1] and [3, 2]."""
    engine = Engine(spark)
    return (Tensor.from_values(engine, [1, 2, 3], [3, 1]) + Tensor.from_values(engine, list(range(6)), [3, 2])).decoded()


@query("SELECT i::BIGINT AS idx, (2 * (i + 1) + 5)::DOUBLE AS value FROM (SELECT unnest(range(2)) AS i)")
def matmul_in_expression(spark, sf_dir):
    """[1, 1] times [[1, 2], [1, 2]], and 5 added."""
    engine = Engine(spark)
    product = Tensor.dequantize_matmul(Tensor.from_values(engine, [1, 1], [1, 2]), Tensor.from_values(engine, [1, 2, 1, 2], [2, 2], "int", 8))
    return (product + Tensor.from_values(engine, [5], [1])).decoded()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
