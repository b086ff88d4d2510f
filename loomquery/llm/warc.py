"""WARC records and their fixity audit by Merkle trees.

Pages become WARC records, dealt by hash into archives of about ARCHIVE_RECORDS and laid end to end there.
Every record is hashed; ordered offset ranges of an archive are hashed over what they hold: a range of RANGE
bytes over its records, sixteen such over their hashes, and so on to an archive's root, and sixteen archives
together on to one root. Two replicas are compared root against root; only the children of nodes that differ
are looked at, down to the records. As nodes stand for offset ranges, a lost record spoils its own ranges only.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

ARCHIVE_RECORDS = 2048
RANGE = 1 << 16
FAN = 16
DATE = "2020-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 resource record as text (its UTF-8 bytes are the record). A null html is an empty payload; a null url leaves the target out."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")), F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digits(rows: int) -> int:
    """Hexadecimal digits of a hash that make archives of about ARCHIVE_RECORDS."""
    n = 0
    while 16**n * ARCHIVE_RECORDS < rows:
        n += 1
    return n


def catalog(pages: DataFrame) -> DataFrame:
    """(page_id, archive, at, length, sha): where each page's record lies. Within an archive records are in the order of their hashes."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = materialize(pages.select("page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("sha")), "warc-hashes")
    archive = F.substring("sha", 1, digits(hashed.count()))
    order = Window.partitionBy("archive").orderBy("sha", "page_id")
    return hashed.withColumn("archive", archive).withColumn("at", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def _parents(nodes: DataFrame) -> DataFrame:
    """(archive, node, sha) one level up: the ordered children's places and hashes, hashed."""
    child = F.struct("node", "sha", "archive")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["archive"], c["node"].cast("string"), c["sha"])), "\n")
    return nodes.groupBy(F.col("up_archive").alias("archive"), F.col("up").alias("node")).agg(F.sha2(joined, 256).alias("sha"))


def levels(most: int, wide: int) -> list[tuple[int | None, int]]:
    """How nodes are gathered, level by level: (bytes of an offset range, archive digits); within archives first, then over archives."""
    out: list[tuple[int | None, int]] = [(RANGE, wide)]
    size = RANGE
    while size < most:
        size *= FAN
        out.append((size, wide))
    return out + [(None, n) for n in range(wide - 1, -1, -1)]


def _tree(records: DataFrame, steps: list[tuple[int | None, int]], tag: str) -> list[DataFrame]:
    """Nodes of each level, from the records (level 0) to the root, each with its parent's place."""
    made, last = [], records.select("archive", F.col("at").alias("node"), F.concat_ws("-", F.col("length").cast("string"), "sha").alias("sha"))
    before = 1
    for size, wide in steps:
        up = F.floor(F.col("node") * before / size).cast("long") if size else F.lit(0).cast("long")
        last = materialize(last.select("archive", "node", "sha", F.substring("archive", 1, wide).alias("up_archive"), up.alias("up")), tag)
        made.append(last)
        last, before = _parents(last), size or 1
    return [*made, materialize(last.select("archive", "node", "sha", F.lit("").alias("up_archive"), F.lit(0).cast("long").alias("up")), tag)]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, second: (archive, at, length, sha) of two replicas. The records in which they differ: archive, at, status: changed, missing (in the second) or extra.

    Records that share a place in one replica count as one whose hash is the greater. Two empty replicas differ in nothing.
    """
    one = [r.groupBy("archive", "at").agg(F.max("length").alias("length"), F.max("sha").alias("sha")) for r in (first, second)]
    both = one[0].union(one[1]).agg(F.max(F.col("at") + 1), F.max(F.length("archive"))).first()
    steps = levels(both[0] or 1, both[1] or 0)
    trees = [_tree(r, steps, f"warc-tree{i}") for i, r in enumerate(one)]
    open_nodes = None
    for a, b in zip(reversed(trees[0]), reversed(trees[1])):
        key = ["archive", "node"]
        if open_nodes is not None:  # only children of nodes that differ
            parents = bounded(open_nodes, 200_000).select(F.col("archive").alias("up_archive"), F.col("node").alias("up"))
            a, b = (x.join(parents, ["up_archive", "up"], "left_semi") for x in (a, b))
        a, b = (x.select(*key, F.col("sha").alias(n)) for x, n in ((a, "sha1"), (b, "sha2")))
        open_nodes = materialize(a.join(b, key, "full").where(~F.col("sha1").eqNullSafe(F.col("sha2"))), "warc-open")
    status = F.when(F.col("sha1").isNull(), "extra").when(F.col("sha2").isNull(), "missing").otherwise("changed")
    return open_nodes.select("archive", F.col("node").alias("at"), status.alias("status"))


def audited(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Per row of pages: page_id, archive, at, length, sha and status (ok, changed or missing) of its record in a replica.

    replica: (page_id, sha) of the records as the other side holds them, by the places of this side's catalog. Rows of
    pages equal in all columns are records of their own, after one another. Rows that share a page_id, null or not, are told
    apart by their hashes: a record that the replica holds as it is is ok, whatever happened to others of its page_id; those
    left over are changed as far as the replica has other records of that page_id, and else missing.
    Null columns: see record(). An empty table gives no rows. Extra columns are ignored.
    """
    held = materialize(catalog(pages), "warc-catalog")
    theirs = replica.select(F.col("page_id").alias("their_id"), F.col("sha").alias("their")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("their_id"))
    place = ["archive", "at", "length"]
    ok = held.join(theirs, same & (F.col("sha") == F.col("their")), "left_semi").select(*place, "sha")
    # What neither side finds on the other: few, numbered within a page_id.
    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    lost = held.join(theirs, same & (F.col("sha") == F.col("their")), "left_anti").withColumn("n", nth("page_id", "sha", "archive", "at"))
    other = theirs.join(held.select("page_id", "sha").distinct(), same & (F.col("sha") == F.col("their")), "left_anti").withColumn("m", nth("their_id", "their"))
    second = ok.union(lost.join(other, same & (F.col("n") == F.col("m"))).select(*place, "their"))
    bad = audit(held.select("archive", "at", "length", "sha"), second)
    return held.join(bad, ["archive", "at"], "left").select("page_id", "archive", "at", "length", "sha", F.coalesce("status", F.lit("ok")).alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica to audit: the record of every 97th page has a byte too many, and that of every 311th is missing."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    flipped = F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat(text, F.lit("\u0000"))).otherwise(text)
    return pages.where(F.coalesce(F.pmod("page_id", F.lit(311)) != 7, F.lit(True))).select("page_id", F.sha2(flipped.cast("binary"), 256).alias("sha"))


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, payload) of each record of a WARC file, plain or compressed as a whole or by record (offsets are then those of the plain file)."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = re.sub(rb"\r\n[ \t]+", b" ", raw[at:end]).split(b"\r\n")[1:]
        headers = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        size = int(headers.get("content-length", "0"))
        stop = end + 4 + size
        yield at, stop + 4 - at, headers, raw[end + 4 : stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, length, type, uri, payload): the records of WARC files, through Spark's own file reader."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"]):
                found = [(file, at, n, h.get("warc-type"), h.get("warc-target-uri"), body) for at, n, h, body in parse(bytes(raw))]
                yield pd.DataFrame(found, columns=["file", "at", "length", "type", "uri", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, at long, length long, type string, uri string, payload binary")


#: The result of op4 by plain comparison, for DuckDB.
AUDIT_SQL = f"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Date: {DATE}' || chr(13) || chr(10) || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '') || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
d AS (SELECT max(CASE WHEN n <= {ARCHIVE_RECORDS} THEN 0 ELSE CAST(ceil(ln(n / {ARCHIVE_RECORDS}.0) / ln(16)) AS INTEGER) END) AS k FROM (SELECT count(*) AS n FROM pages)),
h AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha FROM r),
a AS (SELECT page_id, substr(sha, 1, k) AS archive, length, sha FROM h, d)
SELECT page_id, archive, CAST(sum(length) OVER (PARTITION BY archive ORDER BY sha, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS at, length, sha,
    CASE WHEN page_id % 311 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'changed' ELSE 'ok' END AS status FROM a
"""
