"""Packing documents into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows, which are sequences of their own; what
remains of it is one shorter piece. The pieces, a few numbers each, are dealt evenly to shards; each
shard places its pieces from the longest down, each into the open window with the least room that
holds it, found in a segment tree indexed by remaining capacity. A shard gets some SHARD_PIECES
pieces at any size of corpus, so that windows fill and a task's memory is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize
from .tokens import CACHE_WORDS, encoder

SHARD_PIECES = 40_000
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("deal", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Open windows by remaining capacity: a segment tree of counts whose leaves are capacities."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the smallest room of at least so much; None if there is none."""
        count, at = self.count, least + self.leaves
        while not count[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room, up = at - self.leaves, at
        while up:
            count[up] -= 1
            up >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """lengths, not increasing and at most window: the window and the offset of each, and the number of windows."""
    tree, made, windows, offsets = RoomTree(window), 0, [], []
    for n in lengths:
        if (found := tree.take(n)) is None:
            found, made = (window, made), made + 1
        room, which = found
        windows.append(which)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, which)
    return windows, offsets, made


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, deal): full windows and the rest of each row of docs. deal spreads the pieces evenly, copies too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(tokenizer, cache_words).batch, 0
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):  # few texts at a time as Python objects
            out: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                row += 1
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((doc_id, start, len(part), zlib.crc32(part), len(ids), row * 0x9E3779B1 + start // window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, PIECE.types)], schema=PIECE)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, kind)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_pieces: int = SHARD_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Per piece of each row of docs: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens (end id included), sequence_id and offset (gapless from 0 in each sequence).

    A null or empty text is its end id alone. Repeated rows are packed each on its own; a null doc_id stays null.
    Ties in length are placed by doc_id, start and crc. An empty table gives no pieces. Extra columns are ignored.
    cache_words: words whose ids a worker remembers; they change its time and memory, never its result.
    """
    cut = materialize(pieces(docs, tokenizer, window, end_id, cache_words), "pack-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        windows, offsets, _ = best_fit(shard["length"].tolist(), window)
        base = int(shard["shard"].iloc[0]) << 32
        return shard.assign(sequence_id=np.asarray(windows, np.int64) + base, offset=np.asarray(offsets, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(shards))).groupBy("shard").applyInPandas(place, PACKED)
