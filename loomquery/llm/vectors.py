"""Searching sharded indexes: what the graph search and the metric tree share.

Equal vectors are one class, of which only the smallest few ids can be among the nearest of any query;
so a vector that a third of all rows hold is one indexed point. A shard's index is one row of a table in the
shared folder. Queries meet a shard in parts of about PART_ROWS: shard and part are cogrouped, so that a
task decodes an index once for all queries of the part, and a shard that many queries ask is many tasks.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_ROWS = 8192
PART_ROWS = 1024

#: Given the queries and the score that each has to reach (-inf: none): for each its best rows and their scores.
Find = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def dump(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


def finite(vector: Column) -> Column:
    """True where no component is null, NaN or infinite; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def classes_of(points: DataFrame, k: int) -> DataFrame:
    """points: (vec_id, v). (v, ids, dim): each distinct vector with its k + 1 smallest ids, as one of them may be the query's own."""
    ranked = points.select("vec_id", "v", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id")).alias("n")).where(f"n <= {k + 1}")
    return ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("v", "ids", F.size("v").alias("dim"))


def asked_of(points: DataFrame, every: int) -> DataFrame:
    """(vec_id, v, dim): the queries, those whose vec_id is divisible by every; of rows that repeat one, the least vector."""
    return points.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def indexed(classes: DataFrame, k: int, index: Callable[[int, int, np.ndarray], bytes], tag: str) -> DataFrame:
    """classes: (v, ids, dim, shard). (dim, shard, index, ids): each shard's index, made by index(dim, shard, vectors), whose rows are in the order of their first ids."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[i[0] for i in rows["ids"]]).sort_values("first", ignore_index=True)
        ids = np.full((len(rows), k + 1), -1, np.int64)
        for i, found in enumerate(rows["ids"]):
            ids[i, : len(found)] = found
        held = np.array([len(i) for i in rows["ids"]])
        dim, shard = int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0])
        return pd.DataFrame({"dim": [dim], "shard": [shard], "index": [index(dim, shard, np.stack(rows["v"].to_numpy()))], "ids": [dump(ids=ids, held=held)]})

    return materialize(classes.select("v", "ids", "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, index binary, ids binary"), f"{tag}-index")


def visit(indexes: DataFrame, jobs: DataFrame, k: int, opened: Callable[[bytes], Find], score_type: str, tag: str) -> DataFrame:
    """jobs: (dim, shard, part, vec_id, v, least), queries and the shards that they ask. (query_id, vec_id, score): of each the k best ids of the shard that reach its least score (null: any)."""

    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(index) and len(asked):
            ids, find = load(index["ids"].iloc[0]), opened(index["index"].iloc[0])
            found = find(np.stack(asked["v"].to_numpy()).astype(np.float64), asked["least"].astype(float).fillna(-np.inf).to_numpy())
            for q, (rows, scores) in zip(asked["vec_id"].tolist(), found):
                held = ids["held"][rows]
                flat = np.arange(ids["ids"].shape[1]) < held[:, None]
                got, score = ids["ids"][rows][flat], np.repeat(scores, held)
                best = np.lexsort((got, -score))
                best = best[got[best] != q]
                best = best[np.sort(np.unique(got[best], return_index=True)[1])][:k]  # an id that repeats counts once, at its best
                out.append(pd.DataFrame({"query_id": q, "vec_id": got[best], "score": score[best]}))
        return pd.concat(out[1:] or out)

    key = ["dim", "shard", "part"]
    parted = jobs.select(*[F.col(c).alias(c) for c in key]).distinct().join(indexes, ["dim", "shard"])
    found = parted.groupBy(*key).cogroup(jobs.select(*key, "vec_id", "v", "least").groupBy(*key)).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    return materialize(found, f"{tag}-found")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query; an id counts once, ties go to the smaller."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(f"rank <= {k}")
