"""The queries of the training-data operators, as registered in __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .graph_ann import nearest
from .htmlcut import extracted
from .linededup import line_report
from .mixing import mix_plan
from .mtree import top_k
from .packing import pack
from .quality import classified
from .simhash import classes
from .tokenfile import round_trip
from .warc import AUDIT_SQL, audited, damaged


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audited(pages, damaged(pages))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op6_nearest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), k=2, shingle=3)


def op9_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op10_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_nbsvm, op3_line_chunks, op4_warc_fixity, op5_pack_sequences, op6_nearest_graph, op7_token_files, op8_simhash_near_dedup, op9_html_mincut, op10_topk_mtree)}

#: Only what SQL can express.
ORACLE: dict[str, str] = {
    "op4_warc_fixity": AUDIT_SQL,
    "op10_topk_mtree": """
        WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM p q JOIN p c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
