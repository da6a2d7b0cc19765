"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

The index of known lines is a list of runs, each a Parquet table of (128-bit hash of the line's key, the document that
holds it first), sorted by hash. Documents come in batches of ascending id. A batch keeps the smallest document of each
of its keys, merge-anti-joins these with the runs and adds what is new as a run of level 0; whenever a level has
``fanout`` runs, they are merged into one run of the next level. A line stays where (key, document) is the key's first
holder, so the join that marks lines is on key and document together and no frequent line makes a hot key.

Defined results: a null or empty text is one empty line; lines whose key has fewer than ``min_chars`` code points always
stay; rows with one id are one document and are all kept or cut alike; rows with a null id pass whole and hold no line
for others; an empty table gives an empty result. Other columns are kept whatever their names; a text of very many lines
is one row a line, and only what it loses comes back to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, materialize, numbered, remove

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row (doc, version, pos, h1, h2) for each line with a key long enough; version tells rows of one id apart."""
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = source.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineIndex:
    """Levelled sorted runs of (h1, h2, doc). add() takes a batch whose documents all come after those already in."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.merges = 0
        self.retired: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """The keys that are new with this batch, with their first document; they are in the index from now on."""
        first = lines.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
        for run in self.runs():
            first = first.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        new = materialize(first.select("h1", "h2", "doc").sortWithinPartitions("h1", "h2"), "line-run")
        self._put(new, 0)
        return new

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            both = reduce(DataFrame.union, old).repartition("h1", "h2").sortWithinPartitions("h1", "h2")
            self.merges += 1
            self._put(materialize(both, "line-run"), level + 1)
            self.retired += old

    def vacuum(self) -> None:
        """Delete the files of runs that have been merged; what add() returned before may be gone then."""
        for run in self.retired:
            remove(run)
        self.retired = []

    def first_holders(self) -> DataFrame:
        return reduce(DataFrame.union, self.runs())


def batch_bounds(docs: DataFrame, doc_id: str, batches: int) -> list:
    """Ids that part the documents into batches of about the same number of rows."""
    cuts = docs.select(F.percentile_approx(doc_id, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, version, pos) of every line to drop."""
    bounds = batch_bounds(docs, doc_id, batches)
    batch = reduce(lambda n, b: n + F.when(F.col("doc") > b, 1).otherwise(0), bounds, F.lit(0))
    lines = materialize(hashed_lines(docs, doc_id, text, min_chars).withColumn("batch", batch), "lines", "batch")
    index = LineIndex(docs.sparkSession, fanout)
    for b in range(len(bounds) + 1):
        index.add(lines.where(F.col("batch") == b))
        index.vacuum()
    return lines.join(index.first_holders(), ["h1", "h2", "doc"], "left_anti").select("doc", "version", "pos")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **parameters) -> DataFrame:
    """docs with repeated lines cut from the text, all columns kept, and the columns n_lines and n_dropped added, in place
    of columns of these names."""
    own, (doc_id, text), names = numbered(docs, doc_id, text, without=(n_lines, n_dropped))
    gone = dropped_lines(own, doc_id, text, **parameters).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    joined = own.join(gone, (F.col(doc_id) == F.col("doc")) & (F.xxhash64(text) == F.col("version")), "left")
    split = joined.select(*own.columns, "gone", lines_of(F.col(text)).alias("lines"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.concat_ws("\n", F.transform(numbers, lambda i: F.col("lines")[i]))
    cut = F.when(F.col("gone").isNull(), F.col(text)).otherwise(kept).alias(text)
    counts = [F.size("lines").cast("bigint"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")]
    return split.select(*[cut if c == text else F.col(c) for c in own.columns], *counts).toDF(*names, n_lines, n_dropped)
