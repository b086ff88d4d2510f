"""Quality classifier: Naive Bayes support vectors.

A text's features are the indicators of its n-grams (bytes: 3; words: 1 and 2; any word repeated in a row), hashed to 2**BITS places.
Over the training rows each place has a log-count ratio between the classes; indicators scaled by these
ratios go to a linear hinge-loss model fitted by dual coordinate descent. A logistic curve, fitted on
training rows that the model has not seen, turns margins into scores from 0 to 1.

The fit takes at most SAMPLE_ROWS labelled rows, those whose ids hash least, and of these as many as have
SAMPLE_PLACES places together, so it costs the same for any corpus; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialize
from .vectors import dump, load

BITS = 18
SAMPLE_ROWS = 10_000
SAMPLE_PLACES = 64_000_000
RUN = 6
_PRIME = 0x100000001B3
_UNPRIME = pow(_PRIME, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PART = 1 << 18


class _Powers:
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            n = min(2 * n, max(n, _PART))
            fill = lambda p: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, p, np.uint64), dtype=np.uint64)])
            cls.up, cls.down = fill(_PRIME), fill(_UNPRIME)
        return cls.up[: n + 1], cls.down[: n + 1]


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * kind)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | bytes | None, part: int = _PART) -> np.ndarray:
    """The sorted places of a whole text's n-grams, each once. It is read in parts for bounded memory; what crosses a cut (a trigram, a word, a pair of words, a run) is carried over."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    a, found = np.frombuffer(raw, np.uint8), []
    once = np.unique if len(a) > part else lambda x: x  # of one part all is made unique together
    begun, long = 0, 0  # hash and length of a word that the last part broke off
    last, run = np.zeros(0, np.uint64), 0  # the last whole word, and how often it has stood in a row
    for at in range(0, len(a), part):
        here, wide = a[at : at + part], a[max(0, at - 2) : at + part].astype(np.uint64)
        if len(wide) >= 3:
            found.append(once(_place(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], 0)))
        inside = np.concatenate([[False], ~_SPACE[here], [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = turn[::2], turn[1::2]
        up, down = _Powers.of(len(here))
        summed = np.concatenate([[np.uint64(0)], np.cumsum((here.astype(np.uint64) + np.uint64(1)) * up[: len(here)], dtype=np.uint64)])
        h = (summed[stop] - summed[start]) * down[start]
        if long and inside[1]:  # the word goes on
            h[0] = np.uint64((begun + pow(_PRIME, long, 1 << 64) * int(h[0])) % (1 << 64))
        elif long:
            h = np.concatenate([[np.uint64(begun)], h])
        more = bool(inside[-2]) and at + part < len(a)
        long = (long if len(start) == 1 and start[0] == 0 else 0) + int(stop[-1] - start[-1]) if more else 0
        begun, h = (int(h[-1]), h[:-1]) if more else (0, h)
        if not len(h):
            continue
        found.append(once(_place(h, 1)))
        both = np.concatenate([last, h])
        found.append(once(_place(both[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + both[1:], 2)))
        # A word that stands RUN times in a row, whichever it is.
        other = np.flatnonzero(np.concatenate([[True], h[:-1] != h[1:], [True]]))
        runs = np.diff(other)
        runs[0] += run if len(last) and last[0] == h[0] else 0
        if runs.max() >= RUN:
            found.append(_place(np.array([1], np.uint64), 3))
        last, run = h[-1:], int(runs[-1])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights on the indicators and a bias: min |w|^2/2 + sum cost * hinge over rows scaled by r, by dual coordinate descent."""
    w, bias = np.zeros(len(r)), 0.0
    dual = np.zeros(len(rows))
    length = np.array([float((r[f] ** 2).sum()) + 1.0 for f in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, rf = rows[i], r[rows[i]]
            slope = y[i] * (float(w[f] @ rf) + bias) - 1.0
            new = min(max(dual[i] - slope / length[i], 0.0), cost[i])
            if step := new - dual[i]:
                dual[i] = new
                w[f] += step * y[i] * rf
                bias += step * y[i]
                most = max(most, abs(step) * length[i] ** 0.5)
        if most < 1e-3:
            break
    return w * r, bias


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    size = 1 << BITS
    good, bad = np.ones(size), np.ones(size)
    for f, label in zip(rows, y):
        (good if label > 0 else bad)[f] += 1
    # The share of a class's rows that hold the n-gram, smoothed by one.
    return np.log(good / (1 + (y > 0).sum())) - np.log(bad / (1 + (y < 0).sum()))


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed targets."""
    goal = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    prior = np.clip((y > 0).mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    a, b = 0.0, float(np.log(prior / (1 - prior)))
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((s - goal) * margin).sum() + 1e-3 * a, (s - goal).sum()])
        v = s * (1 - s) + 1e-9
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.02, rounds: int = 8) -> dict[str, np.ndarray]:
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():  # nothing to learn from: the one class, or a half
        prior = 0.5 if not len(y) else (len(y) * (y[0] > 0) + 1) / (len(y) + 2)
        return {"w": np.zeros(1 << BITS, np.float32), "bias": np.array([0.0, 0.0, np.log(prior / (1 - prior))])}
    weight = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def trained(at: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in at]
        return descend(some, y[at], ratios(some, y[at]), weight[at], rounds)

    part = np.arange(len(rows)) % 5
    seen, unseen = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    if len(set(y[seen])) < 2 or len(unseen) == 0:
        seen = unseen = np.arange(len(rows))
    w, bias = trained(seen)
    a, b = logistic(np.array([w[rows[i]].sum() + bias for i in unseen]), y[unseen])
    w, bias = trained(np.arange(len(rows)))
    return {"w": w.astype(np.float32), "bias": np.array([bias, max(a, 1e-6), b])}


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents from whose labels nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> bytes:
    """The model, from at most sample_rows labelled documents that are not held out. Of repeated labels the larger mean class counts; null ids and labels are passed over."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    chosen = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = F.broadcast(materialize(chosen, "quality-sample"))  # sample_rows at most
    places = F.pandas_udf(lambda texts: pd.Series([features(t).tobytes() for t in texts]), "binary")
    taken = in_small_batches(docs).select(F.col("doc_id").alias("id"), "text").join(chosen, "id").repartition("id")
    rows = materialize(taken.select("id", "y", F.xxhash64("text").alias("h"), places("text").alias("f")), "quality-features")
    # The first rows by hash that fit: a running sum over at most sample_rows numbers (a repeated id counts with the least text hash, as in the fit).
    sizes = rows.groupBy("id").agg(F.min_by(F.octet_length("f"), "h").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(sizes.select("id", upto.alias("upto")).where(F.col("upto") <= 4 * SAMPLE_PLACES).select("id")), "id", "left_semi")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "id"]).drop_duplicates("id")
        model = fit([np.frombuffer(f, np.int32) for f in group["f"]], group["y"].to_numpy())
        return pd.DataFrame({"model": [dump(**model)]})

    made = materialize(rows.select("id", "y", "h", "f").groupBy().applyInPandas(train, "model binary"), "quality-model").first()
    return made["model"] if made else dump(**fit([], np.zeros(0)))


def score(docs: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """docs with a column of that name: from 0 to 1, higher where label 1 is likelier. Empty and null texts get what the bias says."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = load(sent.value)
        w, (bias, a, b) = held["w"], held["bias"]
        for texts in batches:
            margin = np.array([w[features(t)].sum(dtype=np.float64) for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35))))

    return in_small_batches(docs).withColumn(name, F.pandas_udf(of, "double")(F.col("text")))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from the threshold on). Repeated rows are scored each; extra columns are ignored."""
    model = learn(docs, labels, sample_rows=sample_rows)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those scored below the threshold, columns as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return score(whole, learn(docs, labels, sample_rows=sample_rows)).where(F.col("score") >= threshold).select("doc.*")
