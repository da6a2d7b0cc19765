"""Shared helpers: tables in the cluster's shared folder, text normalisation, size figures."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparray.storage import shared_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of the white space class [\x20\x09-\x0D], as one string.
BLANKS = " \t\n\x0b\x0c\r"

_scratch: list[str] = []
#: Rows of a few numbers each that are broadcast at most: some 40 MB.
FITTING = 400_000


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/sparray/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; this cuts lineage and survives lost executors.
    Inside a ``scratch`` the table goes at its end, unless it is to be kept."""
    spark = df.sparkSession
    path = f"{_scratch[-1]}/{name}-{uuid.uuid4().hex}" if _scratch and not keep else new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end; only what was kept may be read after it."""
    _scratch.append(new_path(spark, "scratch"))
    try:
        yield
    finally:
        _delete(spark, _scratch.pop())


def remove(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nobody reads any more."""
    for folder in {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def fitting(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, to be joined: broadcast if its counted rows are few enough, else merged."""
    return F.broadcast(df) if df.limit(FITTING + 1).count() <= FITTING else df.hint("merge")


_holder: list[tuple[str, Callable[[], None]]] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """A Python worker lives through many operators, and keeps the caches of one at a time: ``name`` is at work now, and
    the caches of the operator before it, if another, are emptied."""
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((name, clear))
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII strings take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(name: str) -> Column:
    """The column of that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, *names: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """df with its columns called c0, c1, ..., so that no name clashes with another or needs quoting; what the columns
    ``names`` are called now; and the old names. Columns named as one of ``without``, which a result adds, are left out."""
    taken = {c.lower() for c in without} - {n.lower() for n in names}
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    old = [df.columns[i] for i in kept]
    out = out.select(*[F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(kept)])
    at = lambda n: old.index(n) if n in old else [c.lower() for c in old].index(n.lower())
    return out, [f"c{at(n)}" for n in names], old


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
