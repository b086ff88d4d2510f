"""Text embedding by feature hashing, and cosine top-k over vector columns."""

from __future__ import annotations

import math
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.types import family

DIMENSION, SEED = 384, 42
TOKEN_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT = 2.0, 0.5, 3.0
LEAST_SIMILARITY = 0.05
#: Fixed values, as the hashes of embeddings depend on them. Endings cut from words, each from words longer than its number, and what takes their place.
ENDINGS = (("ing", 4, ""), ("ed", 3, ""), ("tion", 5, ""), ("ies", 3, "y"))


def murmur3(data: bytes, seed: int = SEED) -> int:
    """MurmurHash3 x86 32 of any length, signed; Spark's own hash agrees with it for whole words of four bytes only."""
    full, h = 0xFFFFFFFF, seed

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & full
        return (k << 15 | k >> 17) * 0x1B873593 & full

    whole = len(data) & ~3
    for i in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & full) * 5 + 0xE6546B64 & full
    if data[whole:]:
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for by, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> by) * odd & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def stemmed(word: str) -> str:
    for end, longer, put in ENDINGS:
        if word.endswith(end) and len(word) > longer:
            return word[: -len(end)] + put
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


@cache
def _place(feature: str, size: int) -> tuple[int, float]:
    h = murmur3(feature.encode())
    return abs(h) % size, 1.0 if h >= 0 else -1.0


def embed(text: str | None, size: int = DIMENSION) -> list[float]:
    """A unit vector of hashed stems, their letter triples and pairs of neighbours; the first axis where there is nothing to hash."""
    stems = [stemmed(w) for w in re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text or "").lower())]
    weighed = {s: TOKEN_WEIGHT for s in stems}
    weighed |= {f"ng:{s[i : i + 3]}": GRAM_WEIGHT for s in stems for i in range(len(s) - 2)}
    weighed |= {f"bg:{a}_{b}": PAIR_WEIGHT for a, b in zip(stems, stems[1:])}
    out = [0.0] * size
    for feature in sorted(weighed):
        at, sign = _place(feature, size)
        out[at] += sign * weighed[feature]
    out = [math.copysign(math.log1p(abs(x)), x) for x in out]
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else [1.0] + [0.0] * (size - 1)


def with_embedding(df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    return df.withColumn(name, F.pandas_udf(lambda s: pd.Series([embed(t) for t in s]), "array<double>")(F.col(text)))


def describe(catalog, table: str) -> list[tuple[str, str]]:
    """(object, description) of a table and its columns, as text to embed."""
    t = catalog.table(table)
    keys = [f"{f.table} {' '.join(f.columns)} refers to {f.parent}" for f in catalog.foreign_keys if table.lower() in (f.table.lower(), f.parent.lower())]
    whole = f"table {t.name} columns {' '.join(t.df.columns)} key {' '.join(t.primary_key)} {' '.join(keys)}".strip()
    return [(t.name, whole), *[(f"{t.name}.{c.name}", f"column {c.name} of {t.name} type {c.dataType.simpleString()}{' key' if c.name in t.primary_key else ''}") for c in t.df.schema]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(df: DataFrame, vector: str, query: list[float], k: int, key: str, least: float | None = LEAST_SIMILARITY) -> DataFrame:
    """The k rows nearest to the query by cosine, then without those below least. Each task keeps k rows, so one row set of k a task is all that moves. Null and zero vectors have no similarity and take no part."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    length = math.sqrt(sum(x * x for x in query))
    near = df.withColumn("similarity", F.try_divide(dot(v, asked), F.sqrt(dot(v, v)) * F.lit(length)))
    top = near.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")).orderBy(F.desc("similarity"), key).limit(k)
    return top.where(F.col("similarity") >= least) if least is not None else top


ROLES = (("identifier", ("id", "key", "code", "identifier", "number", "no")), ("name", ("name", "title", "label")), ("description", ("description", "notes", "text", "comment", "summary")), ("category", ("type", "status", "category", "segment", "priority", "flag", "kind", "role")))


def role(catalog, table: str, column: str) -> str:
    """identifier, name, description, category, temporal, boolean, numeric or other: keys first, then the type, then the name."""
    t = catalog.table(table)
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column).lower())
    kind = family(t.df.schema[column].dataType)
    if column in t.primary_key or words and any(words[-1] == w or words[-1].endswith(w) and w == "key" for w in ROLES[0][1]):
        return "identifier"
    if kind in ("temporal", "boolean", "numeric"):
        return kind
    return next((r for r, names in ROLES[1:] if any(w.endswith(n) for w in words for n in names)), "other")


class VectorStore:
    """Embedded descriptions of catalogs, as Parquet in one folder a catalog and fingerprint."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, database: str, catalog) -> None:
        """Writes the catalog's descriptions; those of its older fingerprints go."""
        rows = [(o, d, embed(d)) for t in catalog.items.values() for o, d in describe(catalog, t.name)]
        frame = self.spark.createDataFrame(rows, "object string, description string, embedding array<double>")
        now = catalog.fingerprint()
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/database={database}/fingerprint={now}")
        for other in self.fingerprints(database):
            if other != now:
                self.purge(database, other)

    def search(self, database: str, catalog, text: str, k: int = 5) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.path}/database={database}/fingerprint={catalog.fingerprint()}")
        return cosine_top_k(frame, "embedding", embed(text), k, "object").select("object", "similarity")

    def fingerprints(self, database: str) -> list[str]:
        """The fingerprints whose vectors are stored."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/database={database}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName().partition("=")[2] for f in files.listStatus(where)] if files.exists(where) else []

    def purge(self, database: str, fingerprint: str | None = None) -> bool:
        """Deletes a database's vectors, or those of one fingerprint; true if there were any. Through Spark's file system, wherever the folder is."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/database={database}" + (f"/fingerprint={fingerprint}" if fingerprint else ""))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = df.where("vec_id = 7").first()["embedding"]
    return cosine_top_k(df, "embedding", query, 5, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


QUERIES = {"q_vector_topk": _topk_query}
ORACLE = {"q_vector_topk": "SELECT vec_id, round(s, 6) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY s DESC, e.vec_id LIMIT 5) WHERE s >= 0.05"}
