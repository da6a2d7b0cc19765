"""The pipeline's stages, each against brute force on its own input, and run() as their sum."""

import pytest

import corpus_pipeline as pipeline
from sparray.llm import toxicity
from sparray.llm.common import materialize
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        made = materialize(stage(spark, docs, sf), "test-stage")
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_toxicity(stages, spark, sf):
    _, before, after = stages[0]
    rows = [(r["text"], r["toxic"]) for r in before.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", "toxic").collect()]
    scorer = toxicity.Scorer(toxicity.train([(t, y) for t, y in rows if len(t) <= toxicity.TRAIN_CHARS]))
    kept = {d for d, t in texts(before) if scorer.scores([t])[0] < toxicity.THRESHOLD}
    assert {d for d, _ in texts(after)} == kept


def test_line_dedup(stages):
    _, before, after = stages[1]
    want = {d: t for d, (n, k, t) in brute.kept_lines(texts(before)).items() if n > k}
    assert dict(texts(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates(stages):
    _, before, after = stages[2]
    classes = brute.near_classes(texts(before), 5, 80, 100)
    assert {d for d, _ in texts(after)} == {c for _, c in classes.values()}


def test_decontamination(stages, spark, sf):
    _, before, after = stages[3]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    marks = brute.marks(texts(before), items)
    assert dict(texts(after)) == {d: t for d, t in texts(before) if not marks[d][4]}


def test_packing(stages):
    from tests.llm.test_texts import check_packing

    _, before, after = stages[4]
    check_packing(texts(before), [tuple(r) for r in after.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()], 2048)


def test_run_is_the_sum(stages, spark, sf):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(pipeline.run(spark, sf)) == rows(stages[-1][2])
