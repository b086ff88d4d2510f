"""Exact top-k by integer inner product: best-first search in an M-tree.

Vectors become integers, floor(scale * x). One more component, sqrt(M - |x|^2) with M the greatest squared
norm of all, gives all points one length, so the nearest by Euclidean distance to (q, 0) have the largest
inner products: |q|^2 + M - 2 q.x is the squared distance. Over that metric stands a tree of pages.

The top of the tree is a fixed number of pivots at most, fitted on a bounded sample. Each vector goes to its
nearest pivot's cell, and a cell is dealt into shards of some SHARD_ROWS; a shard is a subtree with a covering
radius around the pivot. Within it an entry holds its object, the radius that covers its page below, and its
distance to the page's own object. A block of queries goes down together: pages are taken by their least
possible distance, nearest first; a query leaves the block where that is over its k-th best, and stored
distances to the parent rule out entries by the triangle inequality before any distance is computed.

A query first asks the shard of its own cell. Its k-th best there goes with it to the others, and cells whose
covering radius leaves nothing as good are never asked. Scores are exact integers; bounds have a margin for rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import PART_ROWS, SHARD_ROWS, Find, asked_of, classes_of, dump, finite, indexed, load, ranked, visit

LEAF = 512
FANOUT = 32
#: Queries that go down a tree together.
BLOCK = 512
#: Cells of each length of vectors, and rows that their pivots are fitted on: neither grows with the table.
MAX_CELLS = 1024
SAMPLE_ROWS = 8192
#: A shard's number is its cell's times this, plus its place in the cell.
CELL = 1 << 32


def spread(y: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n rows of y that stand apart: each drawn by its squared distance to the nearest of those before it."""
    rng, chosen = np.random.default_rng(seed), [0]
    near = ((y - y[0]) ** 2).sum(axis=1)
    for _ in range(n - 1):
        total = near.sum()
        if total <= 0:
            break
        chosen.append(int(min(np.searchsorted(np.cumsum(near), rng.random() * total, side="right"), len(y) - 1)))
        near = np.minimum(near, ((y - y[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(sorted(set(chosen)))


def nearest_of(y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each row's nearest pivot."""
    half = (pivots**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - y[at : at + 4096] @ pivots.T, axis=1) for at in range(0, len(y), 4096)] or [np.zeros(0, np.int64)])


def lift(z: np.ndarray, most: float | None = None) -> np.ndarray:
    """z with the component that makes all rows as long as the longest, or of squared length most."""
    z = z.astype(np.float64)
    norm = (z**2).sum(axis=1)
    most = norm.max(initial=0) if most is None else most
    return np.concatenate([z, np.sqrt(np.maximum(0, most - norm))[:, None]], axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def build_tree(y: np.ndarray) -> dict[str, np.ndarray]:
    """The pages over points y. A page is a range of entries; an entry has an object, a radius, a distance to the page's object, and a page below (-1: the entry is the object itself)."""
    start, stop, leaf = [], [], []
    entry: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    used = 0

    def reserve() -> int:
        start.append(0), stop.append(0), leaf.append(False)
        return len(start) - 1

    todo = [(reserve(), np.arange(len(y)), -1)]
    while todo:
        page, members, parent = todo.pop()
        to_parent = lambda objects: _apart(y[objects], y[parent]) if parent >= 0 else np.zeros(len(objects))
        pivots = members[spread(y[members], min(FANOUT, -(-2 * len(members) // LEAF)))] if len(members) > LEAF else members[:1]
        if len(pivots) < 2:
            rows = (members, np.zeros(len(members)), to_parent(members), np.full(len(members), -1))
            leaf[page] = True
        else:
            which = nearest_of(y[members], y[pivots])
            below = np.array([reserve() for _ in pivots])
            parts = [members[which == i] for i in range(len(pivots))]
            radius = np.array([_apart(y[m], y[o]).max(initial=0) for m, o in zip(parts, pivots)])
            todo += list(zip(below, parts, pivots))
            rows = (pivots, radius, to_parent(pivots), below)
        start[page], stop[page] = used, used + len(rows[0])
        used += len(rows[0])
        entry.append(rows)
    objects, radius, parent_apart, below = (np.concatenate(c) for c in zip(*entry))
    return {"start": np.array(start), "stop": np.array(stop), "leaf": np.array(leaf), "object": objects, "radius": radius, "apart": parent_apart, "below": below}


def small(z: np.ndarray) -> np.ndarray:
    """z in the narrowest type that holds it."""
    most = int(np.abs(z).max(initial=0))
    return z.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


class Tree:
    """held: the pages, the points z as integers, and most, the squared length of all lifted points."""

    def __init__(self, held: dict[str, np.ndarray]) -> None:
        self.t, self.z, self.most = held, held["z"].astype(np.int64), float(held["most"])
        self.entries = self.z[held["object"]]  # page by page, so a page is a slice
        self.pages = list(zip(held["start"].tolist(), held["stop"].tolist(), held["leaf"].tolist()))
        self.computed = 0  # distances so far

    def best(self, q: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of each query's k best (ties: smaller rows) that reach its least score."""
        q = q.astype(np.int64)
        least = np.full(len(q), -np.inf) if least is None else least
        return [x for at in range(0, len(q), BLOCK) for x in self._block(q[at : at + BLOCK], k, least[at : at + BLOCK])]

    def _block(self, q: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        t, size = self.t, (q.astype(np.float64) ** 2).sum(axis=1)
        exact = (size.max() * self.most) ** 0.5 < 2**52  # then products in double precision are whole and exact
        kind = np.float64 if exact else np.int64
        none = -np.inf if exact else np.iinfo(np.int64).min
        q, entries = q.astype(kind), self.entries.astype(kind, copy=False)
        base = size + self.most
        slack = 1e-7 * np.sqrt(1 + base)  # a squared distance is right to some 1e-15 of base, its root to half as many digits
        rows, scores = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), none, kind)
        floor = np.where(np.isfinite(least), least, none).astype(kind)  # what a row has to reach

        def over(score: np.ndarray, which: slice | np.ndarray) -> np.ndarray:
            known = score > none
            far = np.sqrt(np.maximum(0.0, base[which] - 2.0 * np.where(known, score, 0).astype(np.float64)))
            return np.where(known, far + slack[which], np.inf)

        worst = over(floor, slice(None))
        every = np.arange(len(q))
        queue: list[tuple] = [(0.0, 0, 0, every, np.zeros(len(q)), np.full(len(q), np.nan))]
        made = 0
        while queue:
            _, _, page, who, low, parent = heapq.heappop(queue)
            live = low <= worst[who]
            who, parent = who[live], parent[live]
            if not len(who):
                continue
            a, b, leaf = self.pages[page]
            # The triangle inequality over the stored distances to the page's object.
            need = np.ones((len(who), b - a), bool)
            if parent[0] == parent[0]:
                need = np.abs(parent[:, None] - t["apart"][a:b]) - t["radius"][a:b] <= worst[who][:, None] + slack[who][:, None]
            take = np.flatnonzero(need.any(axis=0))
            if not len(take):
                continue
            some = need.any(axis=1)
            if not some.all():
                who, need = who[some], need[some]
            need = need[:, take]
            take += a
            product = q[who] @ entries[take].T
            self.computed += product.size
            if leaf:
                product = np.where(need, product, none)
                reach = floor[who]
                if product.shape[1] > k:  # k of this page reach so much
                    reach = np.maximum(reach, np.partition(product, -k, axis=1)[:, -k])
                hit = (product >= reach[:, None]) & need
                count = hit.sum(axis=1)
                r = np.flatnonzero(count)
                if not len(r):
                    continue
                who, hit, wide = who[r], hit[r], int(count.max())
                new_rows, new_scores = np.full((len(r), k + wide), np.iinfo(np.int64).max), np.full((len(r), k + wide), none, kind)
                new_rows[:, :k], new_scores[:, :k] = rows[who], scores[who]
                i, j = np.nonzero(hit)
                place = k + np.arange(len(i)) - np.repeat(np.cumsum(count[r]) - count[r], count[r])
                new_rows[i, place], new_scores[i, place] = t["object"][take][j], product[r][hit]
                top = np.lexsort((new_rows, -new_scores), axis=1)[:, :k]
                rows[who], scores[who] = np.take_along_axis(new_rows, top, 1), np.take_along_axis(new_scores, top, 1)
                floor[who] = np.maximum(floor[who], scores[who, -1])
                worst[who] = over(floor[who], who)
            else:
                d = np.sqrt(np.maximum(0.0, base[who, None] - 2.0 * product.astype(np.float64)))
                low = np.maximum(0.0, d - t["radius"][take] - slack[who, None])
                go = need & (low <= worst[who][:, None])
                for c in np.flatnonzero(go.any(axis=0)):
                    these, made = go[:, c], made + 1
                    heapq.heappush(queue, (float(low[these, c].min()), made, int(t["below"][take[c]]), who[these], low[these, c], d[these, c]))
        held = rows < np.iinfo(np.int64).max
        return [(row[h], score[h].astype(np.int64)) for row, score, h in zip(rows, scores, held)]


def _cells(whole: DataFrame, count: int, most: float, shard_rows: int) -> dict[int, np.ndarray]:
    """By length of vectors: lifted pivots, of a sample of some SAMPLE_ROWS rows, moved to the middle of what lies nearest to them."""
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    some = whole.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS).select("v").toPandas()["v"]
    by: dict[int, list[np.ndarray]] = {}
    for v in some:
        by.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in by.items():
        y = lift(np.unique(np.stack(rows), axis=0), most)
        pivots = y[spread(y, max(1, min(MAX_CELLS, len(y), count // shard_rows)))]
        for _ in range(5):
            which = nearest_of(y, pivots)
            pivots = np.stack([y[which == i].mean(axis=0) if (which == i).any() else p for i, p in enumerate(pivots)])
        out[dim] = pivots
    return out


def _part(jobs: DataFrame) -> DataFrame:
    """jobs with part: the queries of a shard in parts of about PART_ROWS."""
    sizes = jobs.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    return jobs.join(sizes, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")


def top_k(points: DataFrame, every: int = 20, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """points: (vec_id, embedding). Of each vec_id divisible by every: the k largest integer inner products with all other rows: query_id, rank, vec_id, score.

    Vectors that are null or hold null or non-finite components take no part; zero vectors do. Only vectors of one length
    are compared. Ties go to the smaller vec_id. vec_id is a key: of rows that repeat one, any vector is a candidate and
    the least is the query. Scores beyond a long are not provided for. An empty table gives no rows. Extra columns are ignored.
    """
    valid = points.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & finite(F.col("x")))
    whole = valid.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    count, most = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    pivots = _cells(whole, count, most, shard_rows)  # MAX_CELLS rows a length of vectors
    origin = lambda dim: pivots[dim] if dim in pivots else lift(np.zeros((1, dim)), most)

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int64)
        length = vectors.map(len).to_numpy()
        for dim in set(length.tolist()):
            out[length == dim] = nearest_of(lift(np.stack(vectors[length == dim]), most), origin(dim))
        return pd.Series(out)

    classes = materialize(classes_of(whole, k).withColumn("cell", cell("v")), "mtree-classes")
    subs = materialize(classes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("subs")), "mtree-cells")
    in_cell = lambda of: (F.col("cell") * CELL + F.pmod(F.xxhash64(of, F.lit(7)), F.col("subs"))).alias("shard")

    def index(dim: int, shard: int, vectors: np.ndarray) -> bytes:
        z = vectors.astype(np.int64)
        y = lift(z, most)
        return dump(z=small(z), most=np.array(most), reach=np.array(_apart(y, origin(dim)[shard // CELL]).max()), **build_tree(y))

    def opened(blob: bytes) -> Find:
        tree = Tree(load(blob))
        return lambda queries, least: tree.best(queries, k + 1, least)

    indexes = indexed(classes.join(subs, ["dim", "cell"]).select("v", "ids", "dim", in_cell("v")), k, index, "mtree")
    asked = asked_of(whole, every).withColumn("cell", cell("v")).join(subs, ["dim", "cell"])
    first = materialize(asked.select("dim", "vec_id", "v", "cell", in_cell("vec_id"), F.lit(None).cast("double").alias("least")), "mtree-first")
    near = visit(indexes, _part(first), k, opened, "long", "mtree-near")
    reach = F.pandas_udf(lambda blobs: pd.Series([float(load(b)["reach"]) for b in blobs]), "double")
    shards = materialize(indexes.select("dim", "shard", reach("index").alias("reach")), "mtree-shards")
    if shards.limit(2).count() < 2:
        return ranked(near, k)
    # At most MAX_CELLS rows a length of vectors.
    held = {(r["dim"], r["cell"]): r["reach"] for r in shards.groupBy("dim", F.floor(F.col("shard") / CELL).alias("cell")).agg(F.max("reach").alias("reach")).collect()}

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that may hold something as good as the k-th best so far."""
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                cells = np.array(sorted(c for d, c in held if d == dim))
                far = np.array([held[dim, c] for c in cells])
                z = np.stack(rows["v"].to_numpy()).astype(np.float64)
                middle = origin(dim)[cells]
                base = (z**2).sum(axis=1) + most
                d = np.sqrt(np.maximum(0, (z**2).sum(axis=1)[:, None] + (middle**2).sum(axis=1) - 2 * (z @ middle[:, :-1].T)))
                least = rows["least"].astype(float).fillna(-np.inf).to_numpy()
                worst = np.where(np.isfinite(least), np.sqrt(np.maximum(0, base - 2 * np.where(np.isfinite(least), least, 0))), np.inf)
                i, j = np.nonzero(d - far <= (worst + 1e-7 * np.sqrt(1 + base))[:, None])
                for at in range(0, len(i), 10_000):
                    one, other = i[at : at + 10_000], j[at : at + 10_000]
                    yield rows.iloc[one].assign(cell=cells[other])

    kth = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("kth"))
    known = first.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("dim", "vec_id", "v", F.col("shard").alias("home"), F.col("kth").alias("least"), "cell")
    wide = known.mapInPandas(reached, "dim int, vec_id long, v array<long>, home long, least double, cell long")
    jobs = wide.join(shards.select("dim", "shard", F.floor(F.col("shard") / CELL).alias("cell")), ["dim", "cell"]).where("shard <> home").select("dim", "shard", "vec_id", "v", "least")
    far = visit(indexes, _part(materialize(jobs, "mtree-jobs")), k, opened, "long", "mtree-far")
    return ranked(near.union(far), k)
