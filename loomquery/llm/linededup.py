"""Line dedup by content-defined chunks of lines.

A text is cut at its line feeds. A rolling hash over the last WINDOW line hashes ends a chunk where it
falls in one of DIVISOR classes, so boundaries depend on the lines near them only and a passage is cut
alike wherever it stands. A line of at least LONG_WORDS words is a chunk of its own. These and the chunks of
several lines are compared over the whole corpus: first by hash, then byte by byte, as the texts themselves are grouping keys; texts
that share a hash are told apart.
Of equal chunks the first (least doc_id, of documents that share it the one whose text hashes least, then first in its text) stays; the others go.

A passage's first and last lines mostly lie in chunks that it shares with what stands around it. So pairs of neighbouring
lines are compared in the same way: a run of lines, LONG_WORDS words or more together, whose every pair stands at an
earlier place too goes as well. A line of a repeated pair's first place stays.

Everything is DataFrame and SQL functions. The texts of candidate chunks are shuffled once for the byte
comparison, and those documents that lose lines once more; a chunk that stands in a third of the documents is
counted before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, materialize


@dataclass(frozen=True)
class LineParams:
    window: int = 2  # lines that a boundary depends on
    divisor: int = 3  # one line in so many ends a chunk
    long_words: int = 50  # a single line of so many words counts as a passage
    long_lines: bool = True  # whether such a line is a chunk of its own; else only chunks and runs of several lines go
    seed: int = 42
    hash_bits: int = 63  # of a piece's hash; fewer only to see how texts that share one are told apart


def _long(line: Column, p: LineParams) -> Column:
    """True for a line of at least long_words words; short ones are told by their length alone."""
    return (F.length(line) >= 2 * p.long_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= p.long_words) if p.long_lines else F.lit(False)


def _hash(p: LineParams, pair: bool, text: Column) -> Column:
    return F.xxhash64(F.lit(p.seed + pair), text).bitwiseAND(F.lit((1 << p.hash_bits) - 1))


def _cut(text: Column, p: LineParams) -> Column:
    """The chunks of a text, as an array of (first line, lines, text). Joined by line feeds they are the text."""
    lines = F.split(text, "\n", -1)
    # One let after another: a transform over an array of one holds a value under a name.
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def chunks(lines: Column) -> Column:
        count = F.size(lines)
        hashes = F.transform(lines, lambda x: F.xxhash64(x))

        def ends(h: Column, long: Column) -> Column:
            rolled = lambda i: F.xxhash64(F.lit(p.seed), *[F.coalesce(F.get(h, i - k), F.lit(0).cast("long")) for k in range(p.window)])
            # A long line is a chunk of its own, wherever it stands.
            apart = lambda i: F.coalesce(F.get(long, i), F.lit(False))
            last = lambda i: (F.pmod(rolled(i), F.lit(p.divisor)) == 0) | (i == count - 1) | apart(i) | apart(i + 1)
            return F.filter(F.sequence(F.lit(0), count - 1), last)

        def sliced(e: Column) -> Column:
            first = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1) + 1)
            one = lambda end, i: F.struct(first(i).alias("first"), (end - first(i) + 1).alias("lines"), F.array_join(F.slice(lines, first(i) + 1, end - first(i) + 1), "\n").alias("text"))
            return F.transform(e, one)

        return let(hashes, lambda h: let(F.transform(lines, lambda x: _long(x, p)), lambda long: let(ends(h, long), sliced)))

    return let(lines, chunks)


def _pieces(docs: DataFrame, p: LineParams) -> DataFrame:
    """(id, key, c): of each document its chunks that may go and all pairs of neighbouring lines, with first line, lines, hash and text."""
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("text").alias("t"))
    may = lambda c: F.when(c["lines"] > 1, F.length(c["text"]) >= c["lines"]).otherwise(_long(c["text"], p))
    piece = lambda pair, first, lines, text: F.struct(F.lit(pair).alias("pair"), first.cast("int").alias("first"), lines.cast("int").alias("lines"), _hash(p, pair, text).alias("hash"), text.alias("text"))
    chunks = F.transform(F.filter(_cut(F.coalesce("t", F.lit("")), p), may), lambda c: piece(False, c["first"], c["lines"], c["text"]))

    def pairs(lines: Column) -> Column:
        return F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x, i: piece(True, i, F.lit(2), F.concat(x, F.lit("\n"), F.get(lines, i + 1))))

    both = F.concat(chunks, F.element_at(F.transform(F.array(F.split(F.coalesce("t", F.lit("")), "\n", -1)), pairs), 1))
    return whole.select("id", F.xxhash64("id", "t").alias("key"), F.explode(both).alias("c"))


def _runs(places: DataFrame, p: LineParams) -> DataFrame:
    """(id, key, lines): runs of neighbouring lines, long_words words or more together, whose every pair stands at an earlier place too.

    places: (id, key, hash, first, head, tail) of repeated pairs, with the words of their two lines. A line of a pair whose first place this is stays.
    """
    places = materialize(places.dropDuplicates(["id", "key", "first"]), "lines-pairs")
    keepers = bounded(materialize(places.groupBy("hash").agg(F.min(F.struct("id", "key", "first")).alias("keeper")), "lines-pair-keepers"), 1_000_000)
    places = places.join(keepers, "hash").withColumn("own", F.struct("id", "key", "first") == F.col("keeper"))
    later = places.where("not own").withColumn("run", F.col("first") - F.row_number().over(Window.partitionBy("id", "key").orderBy("first")))
    runs = later.groupBy("id", "key", "run").agg(F.min("first").alias("a"), F.max("first").alias("z"), (F.sum("head") + F.max_by("tail", "first")).alias("words")).where(F.col("words") >= p.long_words)
    runs = runs.select("id", "key", F.sequence("a", F.col("z") + 1).alias("lines"))
    own = places.where("own").groupBy("id", "key").agg(F.flatten(F.collect_list(F.array("first", F.col("first") + 1))).alias("stay"))
    return runs.join(own, ["id", "key"], "left").select("id", "key", F.array_except("lines", F.coalesce("stay", F.array().cast("array<int>"))).alias("lines")).where(F.size("lines") > 0)


def repeats(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(id, key, gone, pieces): of each document that loses lines, their numbers, and of how many chunks and runs they are. Documents are told apart by doc_id and text."""
    rows = _pieces(docs, p)
    places = materialize(rows.select("id", "key", "c.pair", "c.first", "c.lines", "c.hash"), "lines-places")
    twice = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    twice = bounded(materialize(twice, "lines-hashes"), 2_000_000)
    # Byte comparison: the text itself is the key.
    words = lambda line: F.when(F.col("pair"), F.regexp_count(line, F.lit(WORD))).otherwise(0)
    ends = [words(F.substring_index("text", "\n", 1)).alias("head"), words(F.substring_index("text", "\n", -1)).alias("tail")]
    same = rows.select("c.hash", "c.pair", "c.text").join(twice, "hash", "left_semi").groupBy("hash", "pair", "text").agg(F.count(F.lit(1)).alias("n")).select("hash", "n", *ends)
    kept = materialize(same.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), *[F.max(c).alias(c) for c in ("n", "head", "tail")]).where("n > 1"), "lines-kept")
    again = places.join(bounded(kept.where("texts = 1").select("hash", "head", "tail"), 1_000_000), "hash")
    shared = kept.where("texts > 1").select("hash")
    if shared.limit(1).count():
        # Hashes that several texts share, few at any size: their pieces are read again, with a digest of the text in the hash's place.
        apart = rows.select("id", "key", "c.*").join(bounded(shared, 1_000_000), "hash", "left_semi")
        apart = apart.select("id", "key", "pair", "first", "lines", F.sha2(F.concat(F.col("pair").cast("string"), F.col("text")).cast("binary"), 256).alias("sha"), *ends)
        apart = materialize(apart, "lines-apart")
        most = apart.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", (-1 - F.monotonically_increasing_id()).alias("hash"))
        again = again.unionByName(apart.join(bounded(materialize(most, "lines-told"), 1_000_000), "sha").select("id", "key", "pair", "first", "lines", "hash", "head", "tail"))
    found = materialize(again.where("not pair").groupBy("id", "key", "hash", "lines").agg(F.collect_set("first").alias("firsts")), "lines-found")
    keepers = bounded(materialize(found.groupBy("hash").agg(F.min(F.struct("id", "key")).alias("keeper")), "lines-keepers"), 1_000_000)
    # In the keeper the first of them stays.
    gone = F.when(F.struct("id", "key") != F.col("keeper"), F.col("firsts")).otherwise(F.array_except("firsts", F.array(F.array_min("firsts"))))
    chunks = found.join(keepers, "hash").select("id", "key", F.explode(gone).alias("first"), "lines").select("id", "key", F.sequence("first", F.col("first") + F.col("lines") - 1).alias("lines"))
    runs = _runs(again.where("pair").select("id", "key", "hash", "first", "head", "tail"), p)
    every = chunks.withColumn("chunk", F.lit(1)).unionByName(runs.withColumn("chunk", F.lit(0))).groupBy("id", "key").agg(
        F.flatten(F.collect_list(F.when(F.col("chunk") == 1, F.col("lines")))).alias("cut"), F.collect_list(F.when(F.col("chunk") == 0, F.col("lines"))).alias("runs"), F.sum("chunk").alias("n")
    )
    more = F.filter("runs", lambda r: F.size(F.array_except(r, F.col("cut"))) > 0)
    return every.select("id", "key", F.array_union("cut", F.flatten("runs")).alias("gone"), (F.col("n") + F.size(more)).alias("pieces"))


def _removed(docs: DataFrame, p: LineParams) -> DataFrame:
    """(doc, lines, gone, pieces, left): a document, its lines as an array, the numbers of those that go, and the text of the others."""
    gone = bounded(materialize(repeats(docs, p), "lines-gone"), 1_000_000, F.size("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("text").alias("t"))
    rows = whole.withColumn("key", F.xxhash64("id", "t")).join(gone, ["id", "key"], "left").withColumn("lines", F.split("t", "\n", -1))
    left = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n")
    return rows.select("doc", "lines", "gone", "pieces", F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("left"))


def line_dedup(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """docs with repeated chunks and runs of lines cut out of text; all rows and columns stay, n_chars (if there) follows the new text.

    A null text stays null, an empty one empty; a text may become empty. Rows that share doc_id and text are one
    document: each keeps what one of them keeps. A null doc_id is the largest. Chunks of empty lines stay.
    """
    rows = _removed(docs, p).select("doc", F.col("left").alias("new"))
    cols = [F.col("new").alias("text") if c == "text" else F.char_length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*cols)


def line_report(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """Per row of docs: doc_id, lines, removed_chunks (chunks, and runs of lines that take more than those), removed_lines, kept_chars and kept_crc32 of the text that stays (null text: no lines, null crc)."""
    rows = _removed(docs, p)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gone = F.when(F.col("gone").isNotNull(), F.size("gone"))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), number(F.when(F.col("lines").isNotNull(), F.size("lines"))).alias("lines"), number(F.col("pieces")).alias("removed_chunks"), number(gone).alias("removed_lines"), number(F.char_length("left")).alias("kept_chars"), F.crc32(F.col("left").cast("binary")).alias("kept_crc32"))
