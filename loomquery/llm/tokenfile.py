"""Token-id files: whole texts as ids, range-coded in checksummed blocks, in ascending order of doc_id.

Rows are dealt to parts by ranges of doc_id and sorted within, tokenized and coded where they lie. A part is
written as segments of whole documents, up to SEGMENT_IDS ids each (one group of the coder's blocks) unless a document
is longer: the coded blocks (idcoder) beside the directory of the segment's documents. The file's container is Parquet, so that Spark's committer and any
store it writes to take care of lost executors. A reader needs one segment at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, new_path
from .idcoder import BLOCK, GROUP, decode, encode
from .tokens import encoder

SEGMENT_IDS = GROUP * BLOCK
#: Words whose ids a worker remembers here: twice as many as elsewhere, some 240 MB, as a part is longer than what their smaller number lasts for.
WORDS = 1_200_000
SEGMENT = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blocks", pa.binary())])
SEGMENT_SQL = "part long, segment long, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, blocks binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, parts: int | None = None) -> None:
    """Writes the ids of every row of docs, each followed by end_id, under path.

    A null text is empty: its end id alone. Repeated rows are written each; rows that share a doc_id are in the order of
    their texts' hashes, null doc_ids come first. Extra columns are ignored.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, size, segment, first
            ids = np.concatenate(held)
            row = [[part], [segment], [first], [len(ids)], [names], [[len(h) for h in held]], [encode(ids)]]
            segment, first = segment + 1, first + len(ids)
            held, names, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, SEGMENT.types)], schema=SEGMENT)

        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):  # few texts at a time as Python objects
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer, WORDS).batch(batch.column(1).cast(pa.binary()).to_pylist())):
                if held and size + len(ids) >= SEGMENT_IDS:
                    yield flush()
                held.append(np.append(ids, np.uint32(end_id)))
                names.append(doc_id)
                size += len(held[-1])
        if held:
            yield flush()

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(code, SEGMENT_SQL).write.parquet(path)


def read_ids(spark: SparkSession, path: str, body: bool = False) -> DataFrame:
    """Per document of the files under path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with body its ids. Damaged blocks raise an error that names them."""
    kind = "doc_id long, part long, in_part long, n_tokens long, ids_crc32 long" + ", ids array<long>" * body
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "part", "in_part", "n_tokens", "ids_crc32")] + [("ids", pa.list_(pa.int64()))] * body)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                ids = np.ascontiguousarray(decode(one["blocks"].as_py()), "<u4")
                names, sizes = one["doc_ids"].as_py(), np.array(one["doc_tokens"].as_py(), np.int64)
                stops = np.cumsum(sizes)
                starts = stops - sizes
                if (stops[-1] if len(stops) else 0) != len(ids):
                    raise ValueError("the directory does not match the ids")
                cols = [names, [one["part"].as_py()] * len(names), starts + one["first_id"].as_py(), sizes, [zlib.crc32(ids[a:b]) for a, b in zip(starts, stops)]]
                if body:
                    cols.append([ids[a:b].astype(np.int64) for a, b in zip(starts, stops)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    stored = spark.read.schema(SEGMENT_SQL).parquet(path)
    # A row a part: the running sum is over few rows.
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rows = stored.mapInArrow(read, kind).join(before, F.col("part") == F.col("p"))
    return rows.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * body)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Per row of docs: doc_id, start, n_tokens, ids_crc32, read back from files written in the shared folder. Nulls and repeated rows: see write_ids."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
