"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks of about equal words. A source's target
fixes how many block draws it gets: whole passes over its blocks first, then a prefix of the
permuted blocks whose last one is cut between documents. The vector of block quotas is split
recursively: a node of the tree hands half of its draws to its left child, and how many of them
come from each source is a multivariate-hypergeometric draw (sequential selection sampling, so
exact). The leaves are the output shards; each takes the next, disjoint run of every source's
permuted blocks. Rows are shuffled within a shard by hash.

Everything is DataFrame and SQL functions. Randomness is hashed from the seed, so reruns agree.
The tree works on block counts, of which there are at most MAX_BLOCKS plus one a source: it does
not grow with the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, keep_columns, materialize

#: Blocks in all, beside one for each source: blocks grow with the corpus instead.
MAX_BLOCKS = 32768


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources by code point, null last, repeating
    cap: int = 3  # times a source, and so each of its documents, may be taken
    block_words: int = 65536  # in a block, at least
    block_docs: int = 4096  # in a block, about, at most
    shard_words: int = 4_000_000  # in an output shard, about
    max_shards: int = 4096
    seed: int = 42


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _named(docs: DataFrame, p: MixParams) -> DataFrame:
    """docs as one struct, with what the plan needs beside it; no column of docs can clash."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
        words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(p.seed), F.col("doc_id"), F.col("text")).alias("key"),
    )


def source_targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """sizes: (src, src_null, size). One row a source: its words, documents, weight and target. The sources by cap over weight reach their caps first, so running sums over them give the level at which the rest share."""
    by_name, by_ratio = Window.orderBy("src_null", "src"), Window.orderBy("ratio", "src_null", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    every = Window.partitionBy()
    return (
        sizes.groupBy("src", "src_null")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("src_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), (F.col("src_no") % len(p.weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * p.cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumns({"total": F.sum("source_size").over(every), "all_weights": F.sum("weight").over(every)})
        .withColumn("level", level)
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src_null", "src"))).over(every))
        .withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double"))))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(p.cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
        .withColumn("rest", F.when(F.col("passes") < p.cap, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
        .withColumn("block_size", F.greatest(F.lit(p.block_words), F.ceil(F.col("total") / MAX_BLOCKS)))
        .withColumn("docs_block", F.greatest(F.lit(p.block_docs), F.ceil(F.sum("n_docs").over(every) / MAX_BLOCKS)))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block_size")), F.ceil(F.col("n_docs") / F.col("docs_block"))).cast("long"))
        .select("src", "src_null", "src_no", "source_size", "total", "target", "passes", "rest", "blocks")
    )


def _split(level: int, seed: int) -> Column:
    """The left child's quota of each source: half of the node's draws, drawn without replacement. An inner fold over a source's draws lets each go left with probability (left places open) / (draws left)."""
    start = "named_struct('n', aggregate(quotas, 0L, (a, q) -> a + q), 'm', aggregate(quotas, 0L, (a, q) -> a + q) div 2, 'x', 0L, 'got', cast(array() as array<bigint>))"
    chance = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, i, j), 11) / 9007199254740992D)"
    step = f"(a, j) -> if({chance} * a.n < a.m, named_struct('n', a.n - 1L, 'm', a.m - 1L, 'x', a.x + 1L, 'got', a.got), named_struct('n', a.n - 1L, 'm', a.m, 'x', a.x, 'got', a.got))"
    draws = "if(quotas[i] > 0, sequence(1L, quotas[i]), cast(array() as array<bigint>))"
    one = f"aggregate({draws}, acc, {step}, a -> named_struct('n', a.n, 'm', a.m, 'x', 0L, 'got', array_append(a.got, a.x)))"
    return F.expr(f"aggregate(sequence(0, size(quotas) - 1), {start}, (acc, i) -> {one}, acc -> acc.got)")


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: (src_no, quota). For each of the 2**levels shards and each source: the number of draws."""
    tree = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("src_no", "quota"))), lambda x: x["quota"]).alias("quotas")).where(F.size("quotas") > 0).select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        tree = tree.select("node", "quotas", _split(level, seed).alias("left"))
        tree = tree.select("node", F.posexplode(F.array(F.col("left"), F.zip_with("quotas", "left", lambda q, x: q - x))).alias("side", "quotas")).select((F.col("node") * 2 + F.col("side")).alias("node"), "quotas")
    return tree.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("src_no", "quota"))


def _plan(docs: DataFrame, p: MixParams) -> DataFrame:
    """(doc, size, source_size, target, copies, shards): which copies of each document go to which shard."""
    named = _named(docs, p)
    narrow = materialize(named.select("src", "src_null", "size", "key"), "mix-sizes")
    sources = materialize(source_targets(narrow, p), "mix-sources")
    sources_hint = bounded(sources, 100_000)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0)
    levels = max(2, min(p.max_shards.bit_length() - 1, int(total // p.shard_words).bit_length()))
    source = ["src", "src_null"]
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("key")), F.col("blocks")).alias("block")
    in_blocks = lambda df: df.join(sources_hint, source).select(*df.columns, "src_no", "source_size", "target", "passes", "rest", block)

    permuted = Window.partitionBy("src_no").orderBy(F.xxhash64(F.lit(p.seed), F.col("src_no"), F.col("block")), "block")
    blocks = in_blocks(narrow).groupBy("src_no", "passes", "rest", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumns({"upto": F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(permuted) - 1, "held": F.count(F.lit(1)).over(Window.partitionBy("src_no"))})
    blocks = blocks.withColumn("part", F.when(F.col("upto") <= F.col("rest"), 2).when(F.col("upto") - F.col("words") < F.col("rest"), 1).otherwise(0))
    blocks = materialize(blocks, "mix-blocks")

    # In the one block of a source that is cut, the documents in hashed order are taken as long as they fit into what is left. Three
    # times over, those of the others that are not too large go on; at last the one that brings the sum nearest to the target.
    cut = bounded(materialize(blocks.where("part = 1").select("src_no", "block", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("room")), "mix-cut"), 100_000)
    units = in_blocks(narrow).join(cut, ["src_no", "block"]).groupBy("src_no", "block", "room", "key").agg(F.sum("size").alias("size")).withColumn("at", F.xxhash64(F.lit(p.seed), F.col("key"))).withColumn("took", F.lit(False))
    whole = Window.partitionBy("src_no", "block")
    running = whole.orderBy("at", "key").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(3):
        open_ = ~F.col("took") & (F.col("size") <= F.col("room"))
        units = units.withColumn("sum", F.sum(F.when(open_, F.col("size"))).over(running)).withColumn("new", open_ & (F.col("sum") <= F.col("room")))
        units = units.withColumns({"took": F.col("took") | F.col("new"), "room": F.col("room") - F.coalesce(F.sum(F.when(F.col("new"), F.col("size"))).over(whole), F.lit(0))})
    off = F.when(~F.col("took") & (F.col("size") > 0), F.struct(F.abs(F.col("room") - F.col("size")).alias("off"), "at", "key"))
    units = units.withColumn("last", F.min(off).over(whole))
    chosen = units.where(F.col("took") | (F.col("last.key") == F.col("key")) & (F.col("last.off") < F.col("room"))).select("src_no", "block", "key", F.lit(True).alias("chosen"))
    chosen = bounded(materialize(chosen, "mix-chosen"), 1_000_000)

    draws = blocks.select("src_no", "block", "rank", "held", "passes", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("epoch"), "part").where("epoch < passes or part > 0")
    draws = draws.select("src_no", "block", "epoch", (F.col("epoch") * F.col("held") + F.col("rank")).alias("draw"))
    quotas = split_quotas(draws.groupBy("src_no").agg(F.count(F.lit(1)).alias("quota")), levels, p.seed)
    # src_no among the sources with draws, as the tree's arrays have it.
    numbered = draws.groupBy("src_no").agg(F.count(F.lit(1)).alias("n")).select("src_no", (F.row_number().over(Window.orderBy("src_no")) - 1).alias("at"))
    upto = F.sum("quota").over(Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    runs = quotas.withColumnRenamed("src_no", "at").withColumn("upto", upto).where("quota > 0").select("at", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("draw"))
    placed = draws.join(numbered, "src_no").join(runs, ["at", "draw"]).groupBy("src_no", "block").agg(F.collect_list(F.struct("epoch", "shard")).alias("places"))
    plan = bounded(materialize(blocks.select("src_no", "block", "part").join(placed, ["src_no", "block"], "left"), "mix-plan"), 8 * MAX_BLOCKS, F.size("places"))

    more = F.when((F.col("part") == 2) | F.col("chosen"), 1).otherwise(0)
    rows = in_blocks(named).join(plan, ["src_no", "block"], "left").join(chosen, ["src_no", "block", "key"], "left").withColumn("copies", F.col("passes") + more)
    shards = F.transform(F.array_sort(F.filter(F.coalesce("places", F.array()), lambda x: x["epoch"] < F.col("copies"))), lambda x: x["shard"])
    return rows.select("doc", "key", "size", "source_size", "target", "copies", shards.alias("shards"))


def mix_plan(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken and the shards of its copies.

    A null text has no words. Null sources are one source, sorted last; the source of an empty table is none.
    Rows equal in doc_id and text share their fate. Documents without words are taken in whole passes only
    and count nothing. Extra columns of docs are ignored.
    """
    return _plan(docs, p).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: a row for each copy taken, with the columns of docs (those named mix_* are replaced), mix_epoch (which pass over its source), mix_shard, and mix_order, by which each shard is sorted. Null, empty and repeated rows: see mix_plan."""
    rows = _plan(docs, p).select("doc", "key", F.posexplode("shards").alias("mix_epoch", "mix_shard"))
    rows = rows.withColumn("mix_order", F.xxhash64(F.lit(p.seed), F.col("mix_shard"), F.col("mix_epoch"), F.col("key")))
    kept = [F.col(f"doc.`{c}`").alias(c) for c in keep_columns(docs, "mix_epoch", "mix_shard", "mix_order")]
    return rows.select(*kept, "mix_epoch", "mix_shard", "mix_order").repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
