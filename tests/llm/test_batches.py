"""Whole texts go to Python workers a few rows at a time."""

import pyarrow as pa
import pytest

import corpus_pipeline
from loomquery.llm.common import BATCH_ROWS, materialize, table
from loomquery.llm.queries import word_tokenizer
from loomquery.llm.tokenfile import write_ids

DATA = "/root/testdata/sf0.001"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("step", ["quality_classifier", "simhash_near_dedup", "packing", "token_files"])
def test_texts_go_a_few_at_a_time(spark, tmp_path, step):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    docs = table(spark, DATA, "documents").limit(60)
    found = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, 10_000)
        if step == "token_files":
            write_ids(docs, str(tmp_path / "ids"), word_tokenizer())
        else:
            materialize(dict(corpus_pipeline.STAGES)[step](spark, docs, DATA), "test")
        seen = [r["n"] for r in spark.range(0, 1700, 1, 1).mapInArrow(sizes, "n long").collect()]
        assert sum(seen) == 1700 and max(seen) <= BATCH_ROWS
        spark.conf.set(ROWS, 7)  # fewer, if the session says so
        corpus_pipeline.packing(spark, docs, DATA)
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, found)
