"""Connected components by alternating large and small stars, with every step written to the shared folder.

The smallest label of a node's neighbours is aggregated map-side and written before it is joined to the edges, so the
join of a node with very many edges can be split at run time. Nothing is collected but a count and a checksum a round.
Once a count shows that no more than FITTING edges are left, a few MB, one task finishes them by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FITTING, materialize, remove


def _joined(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, m): each edge's larger end with the smallest label at its other end; and the table of labels."""
    stored = materialize(least, "smallest")
    return edges.join(stored.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), stored


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked, used = _joined(both.where(F.col("v") > F.col("u")), both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    out = materialize(linked.distinct(), "edges")
    remove(used)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked, used = _joined(down, down.groupBy("u").agg(F.min("v").alias("m")))
    own = used.select("u", F.col("m").alias("v"))
    out = materialize(linked.union(own).where(F.col("u") != F.col("v")).distinct(), "edges")
    remove(used)
    return out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of edges."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (t := top.setdefault(x, x)) != x:
            top[x] = x = top[t]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = sorted((root(u), root(v)))
            top[b] = a
    linked = [(x, r) for x in top if (r := root(x)) != x]
    yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in linked], pa.int64()), "v": pa.array([r for _, r in linked], pa.int64())})


def components(edges: DataFrame, fitting: int = FITTING) -> DataFrame:
    """(u, v): for each node that is not the smallest of its component, that smallest node."""
    edges = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    known = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == known or not state["n"]:
            return edges
        known, old = state, edges
        if state["n"] <= fitting:
            edges = materialize(edges.repartition(1).mapInArrow(_united, "u bigint, v bigint"), "edges")
            remove(old)
            return edges
        large = large_star(edges)
        edges = small_star(large)
        remove(old)
        remove(large)
