"""Token counts from the exact histogram of encoded lengths.

The only thing that grows with the corpus is the encoding pass; it is aggregated map-side to one row per distinct
length. Totals, quantiles and truncated totals for every context limit are suffix sums over that histogram, taken in two
levels (inside stretches of lengths, and over the stretches), so no window holds more than one stretch.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table has an empty histogram.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted
from .encoding import encoder

#: Lengths in one stretch.
STRETCH = 1024
#: Texts encoded at a time.
STEP = 64


def token_length(text: Column, vocabulary: str) -> Column:
    """The number of token ids of each whole text."""

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(vocabulary)
        for batch in batches:
            yield pa.array([n for i in range(0, len(batch), STEP) for n in coder.lengths(batch.slice(i, STEP).to_pylist())], pa.int64())

    return F.arrow_udf(lengths, "bigint")(text)


def length_histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(length, n_docs): how many texts have each encoded length."""
    return docs.select(token_length(quoted(text), vocabulary).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with n_longer and tokens_longer: the documents longer than each length, and their tokens."""
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / STRETCH).alias("stretch"))
    inside = Window.partitionBy("stretch").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = h.groupBy("stretch").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch of lengths
    later = stretches.select("stretch", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    own = h.select("*", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("n_in"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in"))
    return own.join(later, "stretch").select("length", "n_docs", (F.col("n_in") + F.col("n_above")).alias("n_longer"), (F.col("t_in") + F.col("t_above")).alias("tokens_longer"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: documents that fit, tokens in all, tokens kept when each document
    is cut to the limit, tokens lost, and the share of documents that fit (so the limit is that quantile)."""
    sums = suffix_sums(histogram)
    total = histogram.agg(F.sum("n_docs").alias("n_all"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens"))
    joined = sums.join(F.broadcast(total))  # one row
    lost = F.col("tokens_longer") - F.col("length") * F.col("n_longer")
    return joined.select(
        F.col("length").alias("context_limit"), "n_docs", (F.col("n_all") - F.col("n_longer")).alias("n_fit"), "n_longer", "tokens",
        (F.col("tokens") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), ((F.col("n_all") - F.col("n_longer")) / F.col("n_all")).alias("share_fit"),
    )


def kept_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept at limits of one's own choice, lengths that occur or not, in one pass over the histogram."""
    kept = [F.coalesce(F.sum(F.least("length", F.lit(n)) * F.col("n_docs")), F.lit(0)).alias(str(n)) for n in limits]
    return histogram.agg(*kept).unpivot([], [str(n) for n in limits], "context_limit", "tokens_kept").withColumn("context_limit", F.col("context_limit").cast("bigint"))
