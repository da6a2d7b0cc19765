"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists, in blocks.

Candidates are dealt once into blocks of bounded size, which stay where they are; queries go to them in batches of bounded
size. A block keeps, per dimension, its members sorted by that component. The lists are read in parallel from the ends
that some query's weights ask for, some depth at a time; every member met is scored in full once for the queries still
active, and a query is finished in a block when the score that an unmet member could have at most is below its kth best.
That bound is the sum over dimensions of the weight times the value at the present depth. A task carries its queries'
best from block to block, so that later blocks end sooner, or are skipped where the bound at their ends is too low.
Equal scores go to the smaller id, so a query stops only when the bound is strictly below its kth score. The tasks' best
are merged by a window that holds k rows a task and query at most.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither as queries nor as
candidates; shorter vectors count as filled with zeros; rows that share an id count once, with their smallest vector;
rows with a null id take no part; fewer than k candidates give all there are; an empty table gives an empty result.
Scores are exact integers; if components are so large that one could exceed 64 bits, an error says so. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted

K = 20
#: Rows of one block of candidates and of one block of queries.
BLOCK = 8192
QUERIES = 4096
#: Depths at which the bound is looked at, as shares of the block.
DEPTHS = (1 / 2048, 1 / 512, 1 / 128, 1 / 32, 1 / 8, 1 / 2, 1.0)


class Best:
    """The best k found so far of each query of a batch."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.owner = np.full((queries, k), -1, dtype=np.int64)
        self.held = np.zeros((queries, k), dtype=bool)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, owner, score)"""
        where = np.nonzero(self.held)
        return where[0], self.owner[where], self.score[where]


class SortedLists:
    """A block's members and its sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")  # ascending

    def bounds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """The most that a member not met in the first ``depth`` of any list's ends can score, per query."""
        n, dims = self.vectors.shape
        low = self.vectors[self.lists[min(depth, n - 1)], np.arange(dims)]
        high = self.vectors[self.lists[max(n - 1 - depth, 0)], np.arange(dims)]
        return np.where(queries > 0, queries * high, queries * low).sum(axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, found: Best) -> int:
        """Adds this block's members to the queries' best; returns the number of scores taken."""
        n = len(self.ids)
        k = found.score.shape[1]
        met = np.zeros(n, dtype=bool)
        active = self._open(queries, found, np.arange(len(queries)), 0)
        scored, at = 0, 0
        for share in DEPTHS:
            depth = min(n, max(1, int(np.ceil(n * share))))
            if depth <= at or not len(active):
                continue
            high = self.lists[n - depth : n - at, (queries[active] > 0).any(axis=0)]
            low = self.lists[at:depth, (queries[active] < 0).any(axis=0)]
            front = np.unique(np.concatenate((low.ravel(), high.ravel())))
            new = front[~met[front]]
            met[new] = True
            if len(new):
                self._score(new, query_ids, queries, active, found.score, found.owner, found.held, k)
                scored += len(new) * len(active)
            at = depth
            if met.all():
                break
            active = self._open(queries, found, active, at)
        # members that no list was read down to have no weighted component for any query left, and score 0
        if len(active) and not met.all():
            rest = np.flatnonzero(~met)
            self._score(rest, query_ids, queries, active, found.score, found.owner, found.held, k)
            scored += len(rest) * len(active)
        return scored

    def _open(self, queries: np.ndarray, found: Best, active: np.ndarray, depth: int) -> np.ndarray:
        """Those of the active queries that a member beyond this depth could still matter to."""
        limit = self.bounds(queries[active], depth)
        return active[~(found.held[active, -1] & (found.score[active, -1] > limit))]

    def _score(self, new: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, active: np.ndarray, best: np.ndarray, owner: np.ndarray, held: np.ndarray, k: int) -> None:
        vectors, ids = self.vectors[new], self.ids[new]
        exact = self.vectors.shape[1] * float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
        kind = np.float32 if exact < 2**24 else np.float64 if exact < 2**53 else np.int64
        step = max(1, 4_000_000 // max(1, len(new)))
        turned = np.ascontiguousarray(vectors.T.astype(kind))
        for i in range(0, len(active), step):
            some = active[i : i + step]
            scores = queries[some].astype(kind) @ turned
            for row, q in enumerate(some):
                own = scores[row]
                worst = best[q, k - 1]
                # equal scores count too: a smaller id may come later
                good = np.flatnonzero(own >= worst) if held[q, k - 1] else np.arange(len(own))
                if len(good) > 4 * k:
                    edge = np.partition(own[good], len(good) - k - 1)[len(good) - k - 1]  # one more: the query itself may be among them
                    good = good[own[good] >= edge]
                good = good[ids[good] != query_ids[q]]
                if not len(good):
                    continue
                known = held[q]
                all_ids = np.concatenate((owner[q][known], ids[good]))
                all_scores = np.concatenate((best[q][known], own[good].astype(np.int64)))
                top = np.lexsort((all_ids, -all_scores))[:k]
                owner[q, : len(top)], best[q, : len(top)], held[q, : len(top)] = all_ids[top], all_scores[top], True


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def packed_blocks(rows: DataFrame, n_blocks: int, dims: int) -> DataFrame:
    """(block, ids, vectors): one row of bounded size per block, dealt by id."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(part), dims), dtype=np.int64)
        for i, v in enumerate(part["v"]):
            vectors[i, : len(v)] = v
        return pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(one, "block int, ids binary, vectors binary")


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best other rows. vector's components become floor(scale * x)."""
    exact = F.transform(quoted(vector).cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint"))
    rows = vectors.where(usable(quoted(vector).cast("array<double>")) & quoted(key).isNotNull()).select(quoted(key).cast("bigint").alias("id"), exact.alias("v"), is_query.alias("q"))
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    widest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("q"), F.max(F.size("v")).alias("dims"), F.max(widest).alias("widest"), F.max(F.when(F.col("q"), widest)).alias("weight")).first()
    dims = size["dims"] or 0
    if dims * (size["widest"] or 0) * (size["weight"] or 0) >= 2.0**63:
        raise ValueError("components are so large that a score could exceed 64 bits")
    n_blocks, n_batches = max(1, -(-size["n"] // BLOCK)), max(1, -(-(size["q"] or 0) // QUERIES))
    blocks = materialize(packed_blocks(rows.select("id", "v"), n_blocks, dims).select("ids", "vectors"), "blocks")
    queries = materialize(packed_blocks(rows.where("q").select("id", "v"), n_batches, dims), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def of(batch: int) -> DataFrame:
        """The stated queries of a batch, some 2 MB for 64 dimensions, against all rows."""
        r = queries.where(F.col("block") == batch).first()
        sent = vectors.sparkSession.sparkContext.broadcast((bytes(r["ids"]), bytes(r["vectors"])) if r else (b"", b""))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids = np.frombuffer(sent.value[0], np.int64)
            weights = np.frombuffer(sent.value[1], np.int64).reshape(len(query_ids), dims)
            found = Best(len(query_ids), k)
            for batch in batches:
                for ids, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    SortedLists(ids, np.frombuffer(held, np.int64).reshape(len(ids), dims)).search(query_ids, weights, found)
            which, owner, score = found.rows()
            yield pa.RecordBatch.from_pydict({"query_id": query_ids[which], "vec_id": owner, "score": score})

        best = blocks.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if n_batches == 1:
        return of(0)
    # batch after batch, each over the whole cluster
    return reduce(DataFrame.union, [materialize(of(b), "best") for b in range(n_batches)])
