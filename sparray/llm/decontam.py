"""Benchmark decontamination: a broadcast hash set of the test items' normalised word windows.

Training texts are scanned window by window: a rolling hash is looked up in the set of the items' hashes, every hit is
verified word by word, and the words inside verified hits are marked. The items come in blocks of bounded bytes; one
block is broadcast at a time, and if there are several, the texts are written once, and their hits block by block as
narrow rows that are merged per text, so the size of the benchmark is not bounded.

Defined results: null or empty texts have no words and no hits; an item without words has no window; an item of fewer
words than a window is one window; hits of an item with a null id mark words but are not counted among the items;
repeated rows are judged each; an empty table or benchmark gives no hits. Texts are scanned whole, however long, some
megabytes at a time; other columns are kept whatever their names, but for one that is named as the marks to add.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, quoted

WINDOW = 13
#: Bytes of item text in one broadcast block. Built, a block is about twelve times as large, in each Python worker.
BLOCK_BYTES = 8_000_000
#: Windows of training text that are hashed at a time.
ROWS = 100_000
#: Bytes of training text that one step of the scan holds as words.
STEP_BYTES = 4_000_000

#: Separators become blanks, A-Z become a-z, the rest stays: words are runs of digits, letters and non-ASCII bytes.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_END = b" \x00 "


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class WindowSet:
    """The distinct windows of the items as sorted arrays: hashes, the numbers of their words, and the items that hold
    them. About 12 bytes and 4 a word for each window, besides the words themselves."""

    def __init__(self, items: Iterable[tuple[object, str | None]], size: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: list[str | None] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            self.items.append(None if item_id is None else str(item_id))
            if words:
                n = min(size, len(words))
                found[n].append((np.lib.stride_tricks.sliding_window_view(np.array(words, dtype=np.uint32), n), len(self.items) - 1))
        self.sets = {n: self._sorted(n, parts) for n, parts in found.items()}

    @classmethod
    def _sorted(cls, n: int, parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
        """(hashes, windows, first place of each one's owners, owners)"""
        rows = np.ascontiguousarray(np.concatenate([w for w, _ in parts]))
        owner = np.repeat(np.array([k for _, k in parts]), [len(w) for w, _ in parts])
        hashes = cls.hash_rows(rows)
        order = np.lexsort((*rows.T, hashes))  # the same windows side by side, whatever else has their hash
        rows, owner, hashes = rows[order], owner[order], hashes[order]
        fresh = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        number = np.cumsum(fresh) - 1
        pairs = np.unique(np.stack((number, owner), axis=1), axis=0)
        starts = np.searchsorted(pairs[:, 0], np.arange(number[-1] + 2))
        return hashes[fresh], rows[fresh], starts, pairs[:, 1]

    @staticmethod
    def hash_rows(rows: np.ndarray) -> np.ndarray:
        """Hash of each row of word numbers, modulo 2**64."""
        out = np.zeros(len(rows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rows.shape[1]):
                words = rows[:, k].astype(np.uint64)
                out = out * np.uint64(0xD1342543DE82EF95) + ((words * np.uint64(0x9E3779B97F4A7C15)) ^ (words >> np.uint64(7)))
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each normalised text: its words, the merged [start, end) word ranges inside hits, the items hit."""
        words = _END.join(texts).split()
        numbers = np.fromiter(map(self.ids.get, words, _zeros()), dtype=np.uint32, count=len(words))
        ends = np.array([i for i, w in enumerate(words) if w == b"\x00"] if len(texts) > 1 else [], dtype=np.int64)
        starts = np.concatenate(([0], ends + 1))
        sizes = np.concatenate((ends, [len(words)])) - starts
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        owners: dict[int, set[int]] = defaultdict(set)
        held = np.concatenate(([0], np.cumsum(numbers != 0)))
        for n, (known, rows, first, owner) in self.sets.items():
            if len(words) < n:
                continue
            full = np.flatnonzero(held[n:] - held[:-n] == n)  # windows made of the items' words alone
            if not len(full):
                continue
            own = np.lib.stride_tricks.sliding_window_view(numbers, n)
            got = np.concatenate([self.hash_rows(own[full[i : i + ROWS]]) for i in range(0, len(full), ROWS)])
            low, high = np.searchsorted(known, got, "left"), np.searchsorted(known, got, "right")
            for i, a, b in zip(full[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for w in range(a, b):
                    if np.array_equal(rows[w], own[i]):
                        k = int(np.searchsorted(starts, i, side="right")) - 1
                        hits[k].append((i - int(starts[k]), i - int(starts[k]) + n))
                        owners[k].update(owner[first[w] : first[w + 1]].tolist())
        return [(int(sizes[k]), merged(hits.get(k, [])), owners.get(k, set())) for k in range(len(texts))]


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


MARKS = "struct<n_words:bigint,ranges:array<struct<from:bigint,to:bigint>>,items:array<string>>"
_MARKS = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string()))])


def steps(texts: Iterable[bytes], limit: int = STEP_BYTES) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _marker(spark, items: list[tuple[object, str | None]], size: int):
    sent = spark.sparkContext.broadcast(WindowSet(items, size))

    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = sent.value
        for batch in batches:
            out = []
            for part in steps((t or "").encode("utf-8", "surrogatepass").translate(NORMAL) for t in _strings(batch)):
                for n, ranges, owners in windows.scan(part):
                    names = {windows.items[k] for k in owners} - {None}
                    out.append({"n_words": n, "ranges": [{"from": a, "to": b} for a, b in ranges], "items": sorted(names)})
            yield pa.array(out, _MARKS)

    return F.arrow_udf(mark, MARKS)


def _strings(array: pa.Array, size: int = 256) -> Iterator[str | None]:
    for i in range(0, len(array), size):
        yield from array.slice(i, size).to_pylist()


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items on the driver in blocks of about BLOCK_BYTES; one block at a time where there are several."""
    items = benchmark.select(quoted(item_id).alias("i"), quoted(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    if n <= 1:
        yield [(r["i"], r["t"]) for r in items.collect()]
    for b in range(n if n > 1 else 0):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).collect()]


def with_marks(docs: DataFrame, benchmark: DataFrame, marks: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with a column ``marks``: n_words, the word ranges inside hits, the ids of the items hit, as sorted strings."""
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(marks, _marker(spark, first, window)(quoted(text)))
    own, (text,), names = numbered(docs, text, without=(marks,))
    stored = materialize(own.withColumn("row", F.monotonically_increasing_id()), "texts")
    found = None
    for block in itertools.chain((first, second), blocks):
        part = stored.select("row", _marker(spark, block, window)(F.col(text)).alias("m"))
        part = materialize(part if found is None else part.where(F.size("m.ranges") > 0), "marks")
        found = part if found is None else found.union(part)
    # one row a block at most is gathered for each text
    gathered = found.groupBy("row").agg(F.collect_list("m").alias("all"))
    merged_marks = gathered.select("row", F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], _both).alias("m"))
    return stored.join(merged_marks.hint("merge"), "row").drop("row").toDF(*names, marks)


def _both(a: Column, b: Column) -> Column:
    """Marks of two blocks of items as one: ranges merged, items united."""

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & (x["from"] <= last["to"]), joined).otherwise(F.concat(acc, F.array(x)))

    ranges = F.array_sort(F.concat(a["ranges"], b["ranges"]))
    empty = F.slice(ranges, 1, 0)
    return F.struct(a["n_words"].alias("n_words"), F.aggregate(ranges, empty, add).alias("ranges"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"))


def hit_words(marks: str) -> Column:
    return F.aggregate(quoted(marks)["ranges"], F.lit(0).cast("bigint"), lambda n, r: n + r["to"] - r["from"])


def contaminated(marks: str) -> Column:
    """At least one word in twenty stands inside a hit."""
    n_hit = hit_words(marks)
    return (n_hit > 0) & (20 * n_hit >= quoted(marks)["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **names) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") all docs with the words inside hits cut from the text."""
    columns = docs.columns
    marks = unused(columns, "marks")
    marked = with_marks(docs, benchmark, marks, text, **names)
    if remove == "documents":
        return marked.where(~contaminated(marks)).select(*map(quoted, columns))
    cut = F.arrow_udf(_cut, "string")(quoted(text), quoted(marks)["ranges"])
    return marked.withColumn(text, F.when(F.size(quoted(marks)["ranges"]) > 0, cut).otherwise(quoted(text))).select(*map(quoted, columns))


def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return pa.array([without_words(t, [(r["from"], r["to"]) for r in x or []]) for t, x in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], pa.string())


def without_words(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """text without the stretches from the first to the last letter of each word range."""
    if not text or not ranges:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    normal = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], normal.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def unused(columns: list[str], name: str) -> str:
    """A column name that no column has, however they are cased."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
