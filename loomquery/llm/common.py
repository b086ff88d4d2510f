"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at a time. Spark's 10,000 are some 30 MB of text: the worker holds them twice, and the JVM's buffers outside its heap, which it keeps, are of the next power of two.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where it is unset (a local session), a temporary one is set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


_scratch: ContextVar[str] = ContextVar("scratch", default="tables")


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder that does not exist yet, in the shared one."""
    return f"{shared_dir(spark)}/llm/{_scratch.get()}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation of what came before."""
    return written(df, new_path(df.sparkSession, tag))


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder through Spark's file system, wherever it is; true if it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within go when it ends. What is to be read later must be written elsewhere by then (new_path taken before)."""
    name = f"scratch-{uuid.uuid4().hex}"
    token = _scratch.set(name)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, f"{shared_dir(spark)}/llm/{name}")


def bounded(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has no more than so many (narrow) rows, and the sum of weight (such as the sizes of an array column) is no more either; else as it is. df should be materialized: it is counted."""
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if weight is None else weight), F.lit(0))).first()
    return F.broadcast(df) if max(n, held) <= rows else df


def in_small_batches(texts: DataFrame) -> DataFrame:
    """texts, as they are; from now on this session's Arrow batches hold BATCH_ROWS rows at most. They are cut when a result is computed, so the setting stays."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return texts


def keep_columns(df: DataFrame, *drop: str) -> list[str]:
    """The columns of df but for those named like an output of the operator, which replace them."""
    gone = {c.lower() for c in drop}
    return [c for c in df.columns if c.lower() not in gone]
