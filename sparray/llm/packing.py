"""Best-fit packing planned over the histogram of lengths.

Documents are encoded once, cut into pieces of at most ``capacity`` tokens, and written as a table of piece lengths and
checksums. The driver sees only how many pieces have each length (at most ``capacity`` numbers) and plans best-fit
decreasing over these counts: sequences with the same space left are one group, and a step moves as many of them as it
can. The plan says which ranks within a length go to which sequences; pieces take their slots by a join on rank within
length. Ranks are counted inside small salted parts of each length and moved by the parts' running totals, so a length
that a third of all pieces share is no hot key.

Defined results: a null or empty text is the end token alone; rows that share an id are packed each; an empty table
packs into nothing. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, quoted
from .encoding import WIDTH, encoder

CAPACITY = 2048
END = b"\0\0\0\0"
STEP = 64
#: Parts into which the pieces of a length are dealt for ranking, at least; beyond, about SALTED pieces of all a part.
SALTS = 256
SALTED = 100_000

#: A piece's fields; the last one only where ids are kept.
FIELDS = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}


def cut(documents: Iterable[bytes], capacity: int, fields: list[str]) -> pa.ListArray:
    """The pieces of documents, each given as its ids without the end token."""
    step, ends = WIDTH * capacity, [0]
    columns: dict[str, list] = {f: [] for f in FIELDS}
    piece, start, length, crc, kept = columns.values()
    for ids in documents:
        ids += END
        for k, at in enumerate(range(0, len(ids), step)):
            part = ids[at : at + step] if len(ids) > step else ids
            piece.append(k)
            start.append(k * capacity)
            length.append(len(part) // WIDTH)
            crc.append(zlib.crc32(part))
            if "ids" in fields:
                kept.append(part)
        ends.append(len(piece))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(columns[f], FIELDS[f]) for f in fields], fields))


def pieces_of(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's pieces."""
    fields = [f for f in FIELDS if keep_ids or f != "ids"]

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(vocabulary)
        for batch in batches:
            yield cut((ids for i in range(0, len(batch), STEP) for ids in coder.encode(batch.slice(i, STEP).to_pylist())), capacity, fields)

    kind = "array<struct<" + ",".join(f"{f}:{TYPES[FIELDS[f]]}" for f in fields) + ">>"
    found = F.arrow_udf(pieces, kind)(quoted(text))
    # a plain inline would have a filter inferred that encodes once more
    return docs.select(quoted(doc_id).alias("doc_id"), found.alias("p")).select("doc_id", F.inline_outer("p"))


@dataclass(frozen=True)
class Slots:
    """Ranks [first, last) of a length go to the sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan_bound(capacity: int = CAPACITY) -> int:
    """The most rows that a plan has, whatever it packs. A row either uses up a length (at most ``capacity`` rows), or
    uses up a group of sequences. A group begins as one of a length's new sequences, as those that a row has filled
    further, or as the rest of those. A row that uses up a group begins one at most, with less space; rests come with a
    used up length only. So there are at most two new lines of groups a length, each of them ending after as many rows as
    pieces fit in one sequence, ``capacity / length``: in all 2 * capacity * (1 + 1/2 + ... + 1/capacity), and a row each
    that uses up the length."""
    return capacity + math.ceil(2 * capacity * (1 + math.log(capacity)))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slots], int]:
    """Best-fit decreasing over counts; the slots, and the number of sequences."""
    slots: list[Slots] = []
    spaces: list[int] = []  # the spaces that sequences have left, sorted
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by space left: (first sequence, how many)
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in groups:
                insort(spaces, space)
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[k]
            else:
                space = capacity
                first, n = opened, -(-(count - rank) // (capacity // length))
                opened += n
            # best fit goes on filling a sequence while the length still fits
            each = min(space // length, count - rank)
            used = min(n, (count - rank) // each)
            slots.append(Slots(length, rank, rank + used * each, first, each, capacity - space))
            rank += used * each
            put(space - each * length, first, used)
            put(space, first + used, n - used)
    return slots, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column ``length`` of 1 to ``capacity``) and for each its sequence_id and its offset there, in place of
    columns of these names; all others are kept whatever their names. pieces is written once."""
    named, (length,), columns = numbered(pieces, "length", without=("sequence_id", "offset"))
    named = named.withColumn("len", F.col(length).cast("bigint"))
    stored = materialize(named.withColumn("row", F.monotonically_increasing_id()), "pieces")
    spark = stored.sparkSession
    histogram = {r["len"]: r["n"] for r in stored.groupBy("len").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots, _ = plan(histogram, capacity)
    salts = max(SALTS, sum(histogram.values()) // SALTED)
    dealt = stored.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("len", "salt").agg(F.count("*").alias("n")).select("len", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("within", F.row_number().over(Window.partitionBy("len", "salt").orderBy("row")))
    ranks = ranked.join(parts, ["len", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    planned = spark.createDataFrame([(s.length, s.first, s.last, s.sequence, s.each, s.offset) for s in slots], "length bigint, first bigint, last bigint, sequence bigint, each bigint, base bigint")
    # the plan's size follows the capacity, not the data: see plan_bound()
    placed = ranks.join(F.broadcast(planned), (F.col("len") == F.col("length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    within = F.col("rank") - F.col("first")
    return placed.select(
        *[f"c{i}" for i in range(len(columns))],
        (F.col("sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("base") + F.pmod(within, F.col("each")) * F.col("len")).alias("offset"),
    ).toDF(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences as binary little-endian ids; packed must hold ``ids``. A group is one
    sequence, so at most ``capacity`` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
