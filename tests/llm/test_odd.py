"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, an empty table, and further
columns whose names clash with the operators' own or hold dots."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparray.llm import decontam, line_dedup, ngram_join, packing, pii, queries, token_counts, toxicity
from tests.llm import brute

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000)) + "\n" + "a line that is told in many texts\n" * 3
TEXTS = [
    (1, "a line that is told in many texts\nand one of its own"), (1, "a line that is told in many texts\nand one of its own"), (2, None), (3, ""), (4, " \t\n"),
    (5, LONG), (6, LONG + " and a little more"), (7, "write to john@example.com"), (None, "a line that is told in many texts"), (None, None), (8, "same same"), (9, "same same"),
]
#: Names that operators use inside, in other cases too, and ones that need quoting.
NAMES = ["row", "first", "length", "rank", "N_LINES", "n_dropped", "gone", "lines", "cut", "marks", "pii_base_email", "a.b", "with `tick`", "score", "h1", "kind", "node", "raw", "c0", "sequence_id", "offset", "p", "n", "ids"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(i))
    return df


def without(df, *names):
    return [c for c in df.columns if c.lower() not in names]


OPERATORS = {
    "toxicity": (lambda d: d.withColumn("s", toxicity.toxicity(d, d.sparkSession.createDataFrame([(1, 0), (7, 1)], "doc_id bigint, toxic int"))), lambda d: [*d.columns, "s"]),
    "token counts": (lambda d: d.withColumn("tokens", token_counts.token_length(F.col("text"), queries.vocabulary())), lambda d: [*d.columns, "tokens"]),
    "line dedup": (line_dedup.dedup_lines, lambda d: [*without(d, "n_lines", "n_dropped"), "n_lines", "n_dropped"]),
    "near duplicates": (ngram_join.near_duplicates, lambda d: ["doc_id", "n_shingles", "component_id"]),
    "personal data": (lambda d: pii.redact(d), lambda d: d.columns),
    "spans": (lambda d: pii.with_spans(d), lambda d: [*without(d, *(f"pii_{p}_{k.name}" for p in ("base", "all") for k in pii.KINDS)), *(f"pii_{p}_{k.name}" for p in ("base", "all") for k in pii.KINDS)]),
    "spans cut": (lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([("i", "same same"), (None, "x")], "item_id string, text string"), remove="spans"), lambda d: d.columns),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, name):
    run, columns = OPERATORS[name]
    out = run(docs)
    assert out.columns == columns(docs) and out.count() == len(TEXTS)
    empty = run(docs.limit(0))
    assert empty.columns == columns(docs) and empty.count() == 0


def test_results(docs):
    """What the rows above come to."""
    kept = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    known = brute.kept_lines([(d, t) for d, t in TEXTS if d is not None])
    assert {k: v for k, v in kept.items() if k[0] is not None} == {(d, t if n else TEXTS[2][1] if d == 2 else t): (k, n) for d, (k, n, t) in known.items()} | {(2, None): (1, 0)}
    classes = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert classes[6] == 5 and classes[9] == 8 and classes[2] == 2 and classes[None] is None
    cut = {r["doc_id"]: r["text"] for r in OPERATORS["spans cut"][0](docs).collect() if r["doc_id"]}
    assert cut[8] == "" and cut[2] is None and cut[5] == LONG
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[7] == "write to [email]"


def test_packing_keeps_columns(docs):
    pieces = packing.pieces_of(docs, queries.vocabulary()).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2)).withColumn("first", F.lit(3)).withColumn("offset", F.lit(-1)).withColumn("c1", F.lit(4))
    out = packing.pack(pieces)
    assert out.columns == [*(c for c in pieces.columns if c != "offset"), "sequence_id", "offset"]
    assert out.count() == pieces.count() and out.where("offset < 0 or `a.b` <> 1 or row <> 2 or first <> 3 or c1 <> 4").count() == 0


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stage(spark, sf, docs, k):
    name, stage = pipeline.STAGES[k]
    before = docs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("lang", F.lit("en"))
    out = stage(spark, before, sf)
    if k < len(pipeline.STAGES) - 1:
        assert out.columns == before.columns
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    gone = {"toxicity": set(), "line dedup": set(), "near duplicates": {6, 9}, "benchmark decontamination": set(), "packing": set()}[name]
    assert {d for d, _ in TEXTS} - set(got) == gone
    assert got.count(1) == 2 and got.count(None) == 2
    assert stage(spark, before.limit(0), sf).count() == 0
