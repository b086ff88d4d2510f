"""From documents to packed sequences. Each stage calls one of the training-data operators on all that the stage before it kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomquery.llm.common import keep_columns, new_path, remove, scratch, table, written
from loomquery.llm.linededup import line_dedup
from loomquery.llm.mixing import mix
from loomquery.llm.packing import pack
from loomquery.llm.quality import good
from loomquery.llm.queries import word_tokenizer
from loomquery.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go."""
    return good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of texts; all documents stay."""
    return line_dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn and repeated to their sources' targets; the rows come shard by shard, shuffled within."""
    mixed = mix(docs)
    return mixed.select(*keep_columns(mixed, "mix_epoch", "mix_shard", "mix_order"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096."""
    return pack(docs, word_tokenizer(), cache_words=100_000)  # the earlier stages' memory is still held


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_chunks), ("simhash_near_dedup", simhash_near_dedup), ("source_mixing", source_mix), ("packing", packing)]
#: Learned scores, hashed fingerprints, hashed draws and a tokenizer are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are a Parquet table in the shared folder. A stage's own tables go when its result is written, and that result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
