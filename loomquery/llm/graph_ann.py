"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard.

A shard's graph is built by inserting its points in batches of doubling size: greedy beam searches from
the medoid propose neighbours, relaxed distance pruning keeps edges of diverse directions, and edges back
are pruned alike. A query walks each shard's graph with a beam. Everything runs over blocks of points at
once in numpy; scores are the exact cosines of the vectors as given, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import PART_ROWS, SHARD_ROWS, Find, asked_of, classes_of, dump, finite, indexed, load, ranked, visit


@dataclass(frozen=True)
class GraphParams:
    degree: int = 32
    beam_build: int = 64
    beam_search: int = 160
    alpha: float = 1.2
    batch: int = 256
    wide: int = 4  # nodes expanded at a time in each search
    seed: int = 1


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query: the beam's nodes and squared distances, nearest first (node -1 where there is none), and the nodes expanded."""
    n, rows = len(q), np.arange(len(q))
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # stands for no node
    seen[:, entry] = True
    nodes, dist = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = entry, 2 - 2 * (q @ x[entry]), False
    walked = []
    live = rows
    while len(live):
        # The first few nodes of each beam that are not yet expanded.
        fresh = ~done[live]
        order = np.cumsum(fresh, axis=1)
        pick = fresh & (order <= wide)
        r, c = np.nonzero(pick)
        slot = order[r, c] - 1
        now = np.full((len(live), wide), -1)
        now[r, slot] = nodes[live[r], c]
        done[live[r], c] = True
        step = np.full((n, wide), -1)
        step[live] = now
        walked.append(step)
        new = np.full((len(live), wide, edges.shape[1]), -1)
        for w in range(wide):
            cand = np.where(now[:, w, None] >= 0, edges[now[:, w]], -1)
            cand = np.where(seen[live[:, None], cand], -1, cand)
            seen[live[:, None], cand] = True
            new[:, w] = cand
        seen[:, -1] = True
        new = new.reshape(len(live), -1)
        r, c = np.nonzero(new >= 0)
        far = np.full(new.shape, np.inf, np.float32)
        far[r, c] = 2 - 2 * np.einsum("ij,ij->i", x[new[r, c]], q[live[r]])
        # Close up the new ones before they are merged.
        most = int((new >= 0).sum(axis=1).max(initial=0))
        if most:
            if most < new.shape[1]:
                front = np.argpartition(far, most - 1, axis=1)[:, :most]
                new, far = np.take_along_axis(new, front, 1), np.take_along_axis(far, front, 1)
            all_n, all_d = np.concatenate([nodes[live], new], 1), np.concatenate([dist[live], far], 1)
            all_f = np.concatenate([done[live], new < 0], 1)
            top = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            nodes[live], dist[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_n, all_d, all_f))
        live = live[~done[live].all(axis=1)]
    return nodes, dist, np.concatenate(walked, axis=1)


def prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of at: up to degree of its candidates (-1: none). The nearest is kept, and all that are alpha times nearer to it than to the point are dropped, again and again."""
    cand = np.where(cand == at[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    near = x[cand]
    dist = np.where(cand >= 0, 2 - 2 * np.einsum("bcd,bd->bc", near, x[at]), np.inf)
    alive, rows = cand >= 0, np.arange(len(at))
    out = np.full((len(at), degree), -1)
    for slot in range(degree):
        if not alive.any():
            break
        pick = np.argmin(np.where(alive, dist, np.inf), axis=1)
        some = alive[rows, pick]
        out[some, slot] = cand[rows, pick][some]
        apart = 2 - 2 * np.einsum("bcd,bd->bc", near, near[rows, pick])
        alive &= ~((alpha * alpha * apart <= dist) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, p: GraphParams) -> tuple[np.ndarray, int]:
    """x: unit vectors. Edges (points, degree), -1 where there are fewer, and the entry node."""
    n = len(x)
    edges = np.full((n, p.degree), -1)
    mean = x.mean(axis=0)
    entry = int(np.argmax(x @ mean))
    order = np.random.default_rng(p.seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        nodes, _, walked = beam_search(x, edges, entry, x[batch], p.beam_build, p.wide)
        edges[batch] = prune(x, batch, np.concatenate([nodes, walked], axis=1), p.degree, p.alpha)
        # Edges back, with the points that get them in order.
        src = np.repeat(batch, p.degree)
        dst = edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order_back = np.argsort(dst, kind="stable")
        src, dst = src[order_back], dst[order_back]
        got, first, count = np.unique(dst, return_index=True, return_counts=True)
        for part in np.array_split(np.argsort(count, kind="stable"), max(1, len(got) // 256)):
            most = int(count[part].max())
            back = np.full((len(part), most), -1)
            spread = np.arange(most) < count[part][:, None]
            back[spread] = src[(first[part][:, None] + np.arange(most))[spread]]
            both = np.concatenate([edges[got[part]], back], axis=1)
            held = (both >= 0).sum(axis=1)
            full = held > p.degree
            if (~full).any():
                some = both[~full]
                some = np.take_along_axis(some, np.argsort(some < 0, axis=1, kind="stable"), 1)
                some = some[:, : p.degree]
                edges[got[part][~full], : some.shape[1]] = some
            if full.any():
                edges[got[part][full]] = prune(x, got[part][full], both[full], p.degree, p.alpha)
        at += len(batch)
        size = min(p.batch, 2 * size)
    return edges, entry


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest(points: DataFrame, every: int = 50, k: int = 5, p: GraphParams = GraphParams(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """points: (vec_id, embedding). Of each vec_id divisible by every: the k nearest found among all other rows, by cosine: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Only vectors of one length
    are compared. Equal vectors tie, and ties go to the smaller vec_id. vec_id is a key: of rows that repeat one, any
    vector is a candidate and the least is the query. An empty table gives no rows. Extra columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    valid = points.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v"))).where(F.exists("v", lambda x: x != 0))

    def index(_dim: int, _shard: int, vectors: np.ndarray) -> bytes:
        edges, entry = build_graph(_units(vectors).astype(np.float32), p)
        return dump(vectors=vectors, edges=edges.astype(np.int32), entry=np.array(entry))

    def opened(blob: bytes) -> Find:
        held = load(blob)
        units = _units(held["vectors"])
        x, edges = units.astype(np.float32), held["edges"].astype(np.int64)

        def find(queries: np.ndarray, _: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            asked, out = _units(queries), []
            for at in range(0, len(asked), p.batch):
                q = asked[at : at + p.batch]
                nodes, _, _ = beam_search(x, edges, int(held["entry"]), q.astype(np.float32), max(p.beam_search, 2 * k), p.wide)
                for one, row, raw in zip(q, nodes, queries[at : at + p.batch]):
                    rows = row[row >= 0]
                    rough = units[rows] @ one
                    rows = rows[np.argsort(-rough, kind="stable")[: 4 * k + 4]]
                    near = held["vectors"][rows]
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        score = (near @ raw) / (np.sqrt((near * near).sum(axis=1)) * np.sqrt(raw @ raw))
                    score = np.where(np.isfinite(score), score, units[rows] @ one)
                    best = np.lexsort((rows, -score))[: k + 1]  # rows are in the order of their first ids
                    out.append((rows[best], score[best]))
            return out

        return find

    # Every query walks every shard, as the method has it; rows are dealt by hash.
    classes = materialize(classes_of(valid, k), "graph-classes")
    shards = max(1, -(-classes.count() // shard_rows))
    indexes = indexed(classes.withColumn("shard", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(shards))), k, index, "graph")
    asked = materialize(asked_of(valid, every), "graph-queries")
    parts = max(1, -(-asked.count() // PART_ROWS))
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    jobs = asked.select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(None).cast("double").alias("least"), shard)
    return ranked(visit(indexes, jobs, k, opened, "double", "graph"), k)
