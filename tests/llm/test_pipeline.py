"""The pipeline's stages on whole small tables."""

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute


def test_stages_hand_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        kept[name] = out.count()
        if name != "piece_encoding":
            assert out.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in docs.join(out, "doc_id", "left_anti").collect()}
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "near_dedup":
            want = brute.near([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
        docs = out
    assert kept["line_dedup"] == kept["toxicity"] >= kept["near_dedup"] > 0 and kept["piece_encoding"] == kept["mixing"]


def test_run_ends_with_digests(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("before, most", [("10000", 500), ("0", 500), ("7", 7)])
def test_stages_get_small_batches(spark, sf, before, most):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for _, stage in corpus_pipeline.STAGES[::4]:
            spark.conf.set(key, before)
            stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            sizes = [r.n for r in spark.range(2100, numPartitions=1).mapInArrow(count, "n long").collect()]
            assert max(sizes) == most and sum(sizes) == 2100
    finally:
        spark.conf.unset(key)
