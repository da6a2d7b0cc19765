"""A corpus pipeline over documents: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
and reread before the next stage. All but the last return the columns of documents; the last returns the packed pieces.
A document without an id passes the stages by id (line dedup and near duplicates) as it is. Null, empty and very long
texts, repeated rows, empty tables and further columns of any name pass every stage as the operators' docstrings say: a
null or empty text is not toxic, is one empty line, has no near duplicate, is not contaminated, and packs as the end token
alone; repeated rows are scored each, are one document for line dedup, near duplicates (all rows of an id stay or go) and
are packed each; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparray.llm import decontam, line_dedup, ngram_join, packing, queries, toxicity
from sparray.llm.common import materialize, quoted, table

#: Near duplicates: five words a shingle, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold stay. All labels may be learnt from."""
    score = decontam.unused(docs.columns, "score")
    scored = docs.withColumn(score, toxicity.toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut; a document left without a line is dropped."""
    before, after = decontam.unused(docs.columns, "n_lines"), decontam.unused(docs.columns, "n_dropped")
    kept = line_dedup.dedup_lines(docs, n_lines=before, n_dropped=after).where(F.col(before) > F.col(after))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(after) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    classes = ngram_join.near_duplicates(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)
    gone = classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty stands inside a benchmark window are dropped."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces_of(docs, queries.vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first and last stages (a trained machine, a tokenizer) can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
