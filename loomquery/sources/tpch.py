"""The keys of the test tables, verified on them. lineitem has none."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from .catalog import Catalog, ForeignKey

PRIMARY = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn")}
FOREIGN = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations"]


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    """A table's schema, read from its footers once a session."""
    return spark.read.parquet(path).schema


def catalog(spark: SparkSession, folder: str, tables: list[str] | None = None) -> Catalog:
    names = tables or TABLES
    keys = tuple(ForeignKey(a, (b,), c, (d,)) for a, b, c, d in FOREIGN if a in names and c in names)
    path = lambda t: f"{folder}/{t}.parquet"
    frames = {t: spark.read.schema(_schema(spark, path(t))).parquet(path(t)) for t in names}
    return Catalog.of(frames, primary_keys=PRIMARY, foreign_keys=keys)
