"""SimHash near-duplicates: fingerprints, a binary-trie self-join, and connected components.

Fingerprints are hashed in Arrow batches. The join works on distinct fingerprints. Two that differ in
at most k bits agree in one of k + 1 bands of bits, so every fingerprint is sent to k + 1 groups, one
for each band's value. Within a group a binary trie over the fingerprints is joined with itself: pairs
of nodes go down together, the bits in which their prefixes differ are summed, and a pair is dropped
once the sum is over k. A group of more than GROUP_ROWS fingerprints is first split by the upper trie
nodes over its other bits: a fingerprint goes to each pair of nodes within k bits that holds its own.

A task returns links that span the components of its group (a forest, so at most one a fingerprint),
never all pairs. The forests are joined into components by contraction: each round's edges are those between what the rounds before joined.

Near copies of a lower similarity (near_items) differ in too many of 64 bits for k + 1 bands. There a set of
shingles has a SimHash of POOL bits, of which many fingerprints of 64 bits are drawn; in each of them the
same trie join gives the pairs that share its first bits and differ in few of the others, and the
shingle sets of these candidates are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_small_batches, materialize

#: Distinct fingerprints that one task joins; larger groups are split.
GROUP_ROWS = 200_000
BUCKET_ROWS = 50_000
SIGNS = ["s0", "s1", "s2", "s3"]
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; zero if it has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    one, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        h = np.array([one(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        for part in range(0, len(bits), 255):
            votes += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, name: str = "fingerprint_bits", shingle: int = 3) -> DataFrame:
    """docs with the SimHash of text as a signed long; a column of that name is replaced."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return docs.withColumn(name, bits(F.col("text")))


def _bands(k: int) -> list[tuple[int, int]]:
    """(shift, width) of k + 1 bands over 64 bits."""
    edges = [64 * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


#: Edges that one task joins into components: what is left when rounds have joined the others.
FEW = 20_000


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if np.array_equal(y, z):
                return y
            self.up[x] = z
            x = z

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]: the larger root is hung below the smaller until none differ."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


#: Pairs of numbers compared at a time.
PAIRS = 500_000


def trie_join(values: np.ndarray, other: np.ndarray | None, k: int, head: int = 0, signs: np.ndarray | None = None, most: int = 0, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member), as places in values (then other), that span the components of values under distances of at most k bits.

    values, other: sorted unsigned 64-bit numbers; with other, only pairs across the two count.
    Without other, only numbers that share their first head bits are paired: the join starts at those nodes.
    signs: a longer fingerprint of each number, in rows of 64-bit words: a pair must differ in at most so many bits of it too.
    pairs: all pairs (smaller place, larger place) instead of links that span them.
    A node is a range of the sorted numbers that share a prefix. Pairs of small nodes are compared outright.
    """
    every = values if other is None else np.concatenate([values, other])
    n, forest, leaf = len(values), _Forest(len(every)), 8
    found = [np.zeros(0, np.int64)]
    counted = np.bitwise_count

    def outright(a0, a1, b0, b1):
        # All pairs of each pair of nodes, some PAIRS at a time: by runs of node pairs, and large ones row by row.
        size = (a1 - a0) * (b1 - b0)
        large = size > PAIRS
        for i in np.flatnonzero(large):
            rows = max(1, PAIRS // int(b1[i] - b0[i]))
            for lo in range(int(a0[i]), int(a1[i]), rows):
                compare(np.array([lo]), np.array([min(lo + rows, int(a1[i]))]), b0[i : i + 1], b1[i : i + 1])
        small = np.flatnonzero(~large)
        if len(small):
            run = np.cumsum(size[small]) // PAIRS
            for part in np.split(small, np.flatnonzero(np.diff(run)) + 1):
                compare(a0[part], a1[part], b0[part], b1[part])

    def compare(a0, a1, b0, b1):
        size = (a1 - a0) * (b1 - b0)
        which = np.repeat(np.arange(len(a0)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        wide = (b1 - b0)[which]
        i, j = a0[which] + at // wide, b0[which] + at % wide
        near = (counted(every[i] ^ every[j]) <= k) & (i != j)
        i, j = i[near], j[near]
        if signs is not None:
            near = counted(signs[i] ^ signs[j]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[near], j[near]
        if pairs:
            found.append(np.minimum(i, j) * len(every) + np.maximum(i, j))
        else:
            forest.link(i, j)

    def middle(lo, hi, bit):
        """Where in each range the numbers with this bit begin; the ranges are disjoint or equal."""
        ones = np.concatenate([[0], np.cumsum((every >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[hi] - ones[lo])

    if other is None:
        edges = np.flatnonzero(np.diff(values >> np.uint64(64 - head))) + 1 if head else np.zeros(0, np.int64)
        lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        stack = [(63 - head, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    else:
        stack = [(63, *(np.array([x], np.int64) for x in (0, n, n, len(every), 0)))]
    while stack:
        bit, a0, a1, b0, b1, off = stack.pop()
        small = ((a1 - a0) <= leaf) & ((b1 - b0) <= leaf) | (bit < 0)
        if small.any():
            outright(a0[small], a1[small], b0[small], b1[small])
            big = ~small
            a0, a1, b0, b1, off = (x[big] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        if len(a0) > 200_000:  # depth first in blocks, so that the frontier stays bounded
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, off))), (bit, *(x[half:] for x in (a0, a1, b0, b1, off)))]
            continue
        am, bm = middle(a0, a1, bit), middle(b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        new = [(a0, am, b0, bm, off, None), (am, a1, bm, b1, off, None), (a0, am, bm, b1, off + 1, None), (am, a1, b0, bm, off + 1, ~same)]
        cols = [[], [], [], [], []]
        for c0, c1, d0, d1, o, keep in new:
            good = (c1 > c0) & (d1 > d0) & (o <= k)
            if keep is not None:
                good &= keep  # a node with itself: the mirrored pair is the same
            for col, x in zip(cols, (c0, c1, d0, d1, o)):
                col.append(x[good])
        stack.append((bit - 1, *(np.concatenate(c) for c in cols)))
    if pairs:
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(every)))
    member = np.arange(len(every))
    root = forest.roots(member)
    moved = root != member
    return root[moved], member[moved]


def _turn(bits: np.ndarray, by: int) -> np.ndarray:
    return bits << np.uint64(by) | bits >> np.uint64(64 - by) if by else bits


def _join_group(k: int, most: int, group: pd.DataFrame) -> pd.DataFrame:
    start, width = _bands(k)[int(group["band"].iloc[0])]
    bits = _turn(group["bits"].to_numpy(np.int64).view(np.uint64), 64 - (start + width))  # the band becomes the first bits
    one = group["lo"].iloc[0] == group["hi"].iloc[0]
    left = group["left"].to_numpy(bool)
    order = np.argsort(bits, kind="stable") if one else np.concatenate([s[np.argsort(bits[s], kind="stable")] for s in (np.flatnonzero(left), np.flatnonzero(~left))])
    signs = np.stack([group[c].to_numpy(np.int64).view(np.uint64) for c in SIGNS], axis=1)[order] if most else None
    bits, items = bits[order], group["item"].to_numpy(np.int64)[order]
    n = int(left.sum())
    a, b = trie_join(bits, None, k, width, signs, most) if one else trie_join(bits[:n], bits[n:], k, 0, signs, most)
    return pd.DataFrame({"a": items[a], "b": items[b]})


def links(distinct: DataFrame, k: int, most: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """distinct: (item, bits), and the SIGNS where most is given. (a, b): links between items that span every component of those whose bits are at most k apart (and whose signs are at most so many)."""
    held = ["item", "bits", *(SIGNS if most else [])]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for i, (a, w) in enumerate(_bands(k))])
    routed = materialize(distinct.select(*held, F.explode(bands).alias("at")).select(*held, "at.band", "at.value"), "simhash-bands")
    sizes = routed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Upper trie nodes for the split of a large group: the 12 bits that follow its band, round the end.
    turned = [F.shiftleft("bits", 64 - (a + w)).bitwiseOR(F.shiftrightunsigned("bits", a + w)) if a + w < 64 else F.col("bits") for a, w in _bands(k)]
    outside = F.element_at(F.array(*[F.shiftrightunsigned(F.shiftleft(x, w), 52) for x, (_, w) in zip(turned, _bands(k))]), F.col("band") + 1)
    depth = F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / group_rows)))).cast("int")
    masks = [[m for m in range(1 << d) if m.bit_count() <= k] for d in range(13)]
    offered = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in masks]), F.col("depth") + 1)
    rows = routed.join(sizes, ["band", "value"]).withColumn("depth", depth).withColumn("outside", outside)
    rows = rows.withColumn("node", F.expr("cast(outside div shiftleft(1, 12 - depth) as int)"))
    rows = rows.select(*held, "band", "value", "depth", "node", F.explode(offered).alias("mask")).withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    # Groups that need no split share a task, some BUCKET_ROWS together.
    buckets = max(1, routed.count() // BUCKET_ROWS)
    alone = F.col("depth") > 0
    bucket = F.when(alone, F.col("value")).otherwise(F.pmod(F.xxhash64("band", "value"), F.lit(buckets)))
    rows = rows.select(*held, "band", alone.alias("alone"), bucket.alias("bucket"), F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), (F.col("node") <= F.col("other")).alias("left"))
    rows = rows.withColumns({c: F.when(F.col("alone"), F.col(c)).otherwise(0) for c in ("lo", "hi")})
    return rows.groupBy("band", "alone", "bucket", "lo", "hi").applyInPandas(lambda group: _join_group(k, most, group), "a long, b long")


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, label) of edges (a, b)."""
    pairs = [x[["a", "b"]].to_numpy(np.int64) for x in batches]
    if pairs:
        node, at = np.unique(np.concatenate(pairs), return_inverse=True)
        at, forest = at.reshape(-1, 2), _Forest(len(node))
        forest.link(at[:, 0], at[:, 1])
        yield pd.DataFrame({"node": node, "label": node[forest.roots(np.arange(len(node)))]})


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, label) of every node of edges (a, b): the least node of its component.

    Each round hangs every node below the least of its neighbours and itself, and the edges go up with their ends. Those that
    became loops or equal go, so a round's joins are over what is left and not over all edges again. After the first round "least" is by a
    hash that each round draws anew, as a long path of rising nodes would lose one node a round. The last few edges are settled in one task.
    Then names come down the rounds again.
    """
    left = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, steps = materialize(left, "components-edges"), []
    while (n := left.count()) > few:
        if len(steps) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        by = (lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))), F.col(c))) if steps else F.col  # noqa: B023
        both = left.select(F.col("a").alias("node"), F.col("b").alias("y")).union(left.select("b", "a"))
        up = both.groupBy("node").agg(F.min_by("y", by("y")).alias("y")).select("node", F.when(by("y") < by("node"), F.col("y")).otherwise(F.col("node")).alias("label"))
        up = materialize(up, "components-labels")
        steps.append(up)
        ends = [up.select(F.col("node").alias(c), F.col("label").alias(f"{c}_up")) for c in ("a", "b")]
        risen = left.join(ends[0], "a").join(ends[1], "b").where("a_up != b_up")
        left = materialize(risen.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "components-edges")
    hashed = len(steps) > 1
    named = materialize(left.repartition(1).mapInPandas(_settle, "node long, label long"), "components-named") if n or not steps else steps.pop()
    for i, up in enumerate(reversed(steps), 1):
        above = named.select(F.col("node").alias("at"), F.col("label").alias("top"))
        named = up.join(above, F.col("label") == F.col("at"), "left").select("node", F.coalesce("top", "label").alias("label"))
        named = materialize(named, "components-named") if i % 8 == 0 or i == len(steps) else named
    if not hashed:
        return named
    # A root is the least of its component only by its last round's order.
    least = named.groupBy("label").agg(F.least(F.min("node"), F.col("label")).alias("least"))
    return materialize(named.join(least, "label").select("node", F.col("least").alias("label")), "components-labels")


def classes(docs: DataFrame, k: int = 2, shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach, its own included). Links are not expanded.

    Null and empty texts have the fingerprint zero and link like any other. Repeated rows are members of one
    class. A null doc_id is a row like any other, and never a component's id unless all its ids are null. Extra columns are ignored.
    """
    marked = materialize(with_fingerprint(docs.select("doc_id", "text"), "bits", shingle).select("doc_id", "bits"), "simhash")
    distinct = materialize(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    labels = components(materialize(links(distinct.withColumn("item", F.col("bits")), k), "simhash-links"))
    # Only fingerprints that have links need their component's least id; a component is counted before it is shuffled, and its id goes back by broadcast as long as there are not too many.
    linked = materialize(labels.join(distinct, F.col("bits") == F.col("node")).select("node", "label", "first_id"), "simhash-linked")
    least = bounded(materialize(linked.groupBy("label").agg(F.min("first_id").alias("component_id")), "simhash-least"), 1_000_000)
    found = linked.join(least, "label").select("node", "component_id")
    named = distinct.join(found, F.col("bits") == F.col("node"), "left").select("bits", F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    named = bounded(materialize(named, "simhash-classes"), 1_000_000)
    return marked.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits of a set's long SimHash, of which a table's fingerprint takes 64.
POOL = 1024
#: The share of bits in which two sets of similarity 0.8 differ: acos(2 * 0.8 / 1.8) / pi.
APART = 0.1515
#: Tables in whose first bits such a pair is expected to agree; exp(-HITS) of these pairs meet in none.
HITS = 10
#: Differing bits of POOL beyond which a pair is not compared in full: 7 standard deviations above APART.
FAR = 240
#: Fewer shingles than this have no near copy but an equal set (4 of 5 is the smallest similarity of 0.8).
LEAST_SET = 4
#: The first tables, whose candidates are grouped before the others' are told apart.
FIRST = 8
#: Sets of a band meet in blocks of at most so many items, and about so many shingles. Heads of more than WIDE items are not joined first.
WIDE, BLOCK, BLOCK_SHINGLES = 8192, 2048, 4_000_000
#: Bands of more items than this are candidates as they are, without a look at their long fingerprints.
SMALL = 32
#: A group of candidates of up to so many items, and about so many shingles, is dealt to one part; larger ones to up to PARTS, and each two parts meet.
PART, PART_SHINGLES, PARTS = 64, 1_000_000, 16
#: Shingles that so many of a block hold are counted by a matrix product, rarer ones pair by pair.
DENSE = 64


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of all words together if they are fewer, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """True if the Jaccard similarity of two shingle sets is at least 0.8."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def long_fingerprint(x: np.ndarray) -> np.ndarray:
    """The SimHash of POOL bits of a set of shingle hashes, as bytes; ties go by the least hash, so that no bit is likelier 0 than 1."""
    turns, votes, first = np.arange(1, POOL // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(POOL, np.int64), 0
    for at in range(0, len(x), 255):
        h = x[at : at + 255, None] + turns
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1)
        first = bits[0] if not at else first
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * votes + first > len(x))


def tables_for(n: int) -> tuple[int, int, int]:
    """(head, tables, k) for n sets: a pair meets in a table if the first head bits of its 64 agree and at most k of them differ. Some 4 to 8 unrelated sets share a head at any n; tables grow as n to the power 0.24."""
    head = min(36, max(8, n.bit_length() - 3))
    rest = 64 - head
    return head, int(np.ceil(HITS / (1 - APART) ** head)), int(np.ceil(rest * APART + 3 * (rest * APART * (1 - APART)) ** 0.5))


def drawn(tables: int) -> np.ndarray:
    """The 64 of POOL places that each table's fingerprint takes."""
    return np.argsort(np.random.default_rng(SEED).random((tables, POOL)), axis=1, kind="stable")[:, :64]


def _routed(sets: DataFrame, head: int, tables: range, of: int, buckets: int) -> DataFrame:
    """sets: (item, bits) and more. (bucket, item, value, more): each set's fingerprint in these of all tables; a bucket holds whole heads of one table."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = drawn(of)
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, POOL // 8), axis=1).T.copy()
            for t in tables if batch.num_rows else ():
                value = np.ascontiguousarray(np.packbits(bits[places[t]], axis=0).T).view(">u8")[:, 0].astype(np.uint64)
                bucket = (value >> np.uint64(64 - head)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                bucket = (bucket % np.uint64(buckets)).astype(np.int64) + t * buckets
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), pa.array(value.view(np.int64)), *batch.columns[2:]], names=["bucket", "item", "value", *batch.schema.names[2:]])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in sets.schema.fields[2:])
    return sets.mapInArrow(route, f"bucket long, item long, value long{more}")


def _bands_of(group: pd.DataFrame, head: int, k: int) -> pd.DataFrame:
    """One bucket with its bands: what the trie join links, and heads that over WIDE items share. Only bands of more than one item, and of more than one label where rows have labels."""
    value = group["value"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort([group["item"].to_numpy(np.int64), value])
    group, value = group.iloc[order], value[order]
    top = value >> np.uint64(64 - head)
    start = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    runs = np.diff(np.append(start, len(top)))
    size, root = np.repeat(runs, runs), np.repeat(start, runs)
    tree = np.flatnonzero((size > 1) & (size <= WIDE))
    if len(tree):
        a, b = trie_join(value[tree], None, k, head)
        root[tree] = tree
        root[tree[b]] = tree[a]
    label = group["label" if "label" in group else "item"].to_numpy(np.int64)
    mixed = np.zeros(len(root), bool)
    mixed[root[label != label[root]]] = True
    keep = mixed[root]
    return group[keep].assign(band=(group["bucket"].to_numpy(np.int64)[keep] << 32) + root[keep])


def _meet(group: pd.DataFrame, head: int, k: int, buckets: int) -> pd.DataFrame:
    """(a, b, band) of one bucket, of which a table has so many: each item of its bands with its band's first item. A row an item, whatever the band's size."""
    held = _bands_of(group, head, k)
    return pd.DataFrame({"a": held["item"], "b": held.groupby("band")["item"].transform("first"), "band": held["band"]})


def _close(group: pd.DataFrame) -> pd.DataFrame:
    """(item, band, size, bits): (a, b, band), links that span what is joined in each band by pairs of alike sizes whose long fingerprints differ in at most FAR bits. Bands of over SMALL items are joined as they are."""
    group = group.sort_values(["band", "item"])
    item, band, size = (group[c].to_numpy(np.int64) for c in ("item", "band", "size"))
    bits = np.frombuffer(b"".join(group["bits"]), np.uint64).reshape(len(item), POOL // 64)
    start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(item) else np.zeros(0, np.int64)
    runs = np.diff(np.append(start, len(item)))
    forest, left = _Forest(len(item)), np.repeat(start + runs, runs) - np.arange(len(item))  # items of the band from each on
    large = np.flatnonzero(np.repeat(runs, runs) > SMALL)
    forest.link(np.repeat(start, runs)[large], large)
    i, by = np.flatnonzero(np.repeat(runs, runs) <= SMALL), 1
    while len(i := i[left[i] > by]):
        j = i + by
        alike = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
        for x in np.array_split(np.flatnonzero(alike), len(i) // 100_000 + 1):
            near = x[np.bitwise_count(bits[i[x]] ^ bits[j[x]]).sum(axis=1, dtype=np.int64) <= FAR]
            forest.link(i[near], j[near])
        by += 1
    root = forest.roots(np.arange(len(item)))
    moved = np.flatnonzero(root != np.arange(len(item)))
    return pd.DataFrame({"a": item[root[moved]], "b": item[moved], "band": band[moved]})


def similar_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that span the components of sets under a Jaccard similarity of at least 0.8, all pairs compared in full."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    both = np.zeros(n * n, np.float32)
    # Rare shingles: their holders, pair by pair.
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    rare = count[shingle] <= DENSE
    s, o = shingle[rare], owner[rare]
    held, some = [], 0
    for by in range(1, DENSE + 1):
        i = np.flatnonzero(s[:-by] == s[by:]) if by < len(s) else np.zeros(0, np.int64)
        held.append(o[i] * n + o[i + by])
        some += len(i)
        if held and (some > n * n or not len(i)):  # counted when there is enough to count
            both += np.bincount(np.concatenate(held), minlength=n * n)
            held, some = [], 0
        if not len(i):
            break
    both = both.reshape(n, n)
    # Common ones: a product of their incidence, some columns at a time.
    s, o = shingle[~rare], owner[~rare]
    column = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else s
    for at in range(0, int(column[-1]) + 1 if len(s) else 0, 1024):
        i = np.flatnonzero((column >= at) & (column < at + 1024))
        held = np.zeros((n, 1024), np.float32)
        held[o[i], column[i] - at] = 1
        both += np.triu(held @ held.T, 1)
    i, j = np.nonzero(5 * both >= 4 * (size[:, None] + size - both))
    apart = i < j
    forest = _Forest(n)
    forest.link(i[apart], j[apart])
    root = forest.roots(np.arange(n))
    moved = np.flatnonzero(root != np.arange(n))
    return root[moved], moved


def _crowd_links(crowd: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """crowd: (item, band), sets: (item, size, shingles). (a, b): links that span the components of the items of each band under a similarity of at least 0.8.

    A band's items are dealt into blocks, each compared in full by itself. Where a band has more than one block, one item
    of each component found so far meets those of the others; then the items outside the band's largest component
    meet all others, block by block: only pairs that are joined already are left out.
    """

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item").drop_duplicates("item")
        item = group["item"].to_numpy(np.int64)
        a, b = similar_forest([np.frombuffer(x, np.uint64) for x in group["shingles"]]) if len(item) > 1 else (np.zeros(0, int),) * 2
        return pd.DataFrame({"a": item[a], "b": item[b]})

    def met(rows: DataFrame, *key: str) -> DataFrame:
        return materialize(rows.select(*key, "item", "shingles").groupBy(*key).applyInPandas(join, "a long, b long").distinct(), "near-crowd")

    def dealt(rows: DataFrame, name: str, *key: str) -> DataFrame:
        """rows with a block each, and how many blocks there are for their key."""
        sizes = rows.groupBy(*key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias(f"{name}s"))
        return rows.join(sizes, list(key)).withColumn(name, F.pmod(F.xxhash64("item"), F.col(f"{name}s")).cast("int"))

    narrow = materialize(dealt(crowd.join(sets.select("item", "size"), "item"), "block", "band"), "near-dealt")
    edges = met(narrow.join(sets.select("item", "shingles"), "item"), "band", "block")
    wide = narrow.where("blocks > 1").select("item", "band", "size")
    if not wide.limit(1).count():
        return edges
    for last in (False, True):
        labels = components(edges).select(F.col("node").alias("item"), "label")
        named = materialize(wide.join(labels, "item", "left").withColumn("label", F.coalesce("label", "item")), "near-named")
        if not last:
            first = named.groupBy("band", "label").agg(F.min_by(F.struct("item", "size"), "item").alias("s")).select("band", "s.*")
            edges = edges.union(met(dealt(first, "block", "band").join(sets.select("item", "shingles"), "item"), "band", "block"))
    main = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("label", "n").alias("main"))
    split = dealt(named.join(main, "band").withColumn("minor", F.col("label") != F.col("main")), "block", "band", "minor")
    minors = split.where("minor").groupBy("band").agg(F.max("blocks").alias("minors"))
    majors = split.where("not minor").groupBy("band").agg(F.max("blocks").alias("majors"))
    split = split.join(minors, "band").join(majors, "band")
    # A block of the largest component meets each of the others' blocks; these meet one another too.
    others = F.when(F.col("minor"), F.concat(F.transform(F.sequence(F.lit(1), "majors"), lambda x: -x), F.sequence(F.lit(0), F.col("minors") - 1))).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    pairs = split.withColumn("own", F.when(F.col("minor"), F.col("block")).otherwise(-1 - F.col("block"))).withColumn("other", F.explode(others))
    pairs = pairs.select("band", "item", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return edges.union(met(pairs.join(sets.select("item", "shingles"), "item"), "band", "lo", "hi"))


def _group_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups: (item, label), sets: (item, size, shingles). (a, b): links that span the components of the items of each label under a similarity of at least 0.8; all its pairs are compared."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, one in group.sort_values("item").groupby(["label", "lo", "hi"]):
            item = one["item"].to_numpy(np.int64)
            i, j = similar_forest([np.frombuffer(x, np.uint64) for x in one["shingles"]]) if len(item) > 1 else (np.zeros(0, int),) * 2
            a.append(item[i])
            b.append(item[j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    parts = F.least(F.lit(PARTS), F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("size") / PART_SHINGLES))).cast("int")
    sized = groups.join(sets.select("item", "size"), "item")
    dealt = sized.join(sized.groupBy("label").agg(parts.alias("parts")), "label").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    dealt = materialize(dealt, "near-dealt")
    buckets = max(64, (dealt.where("parts = 1").agg(F.sum("size")).first()[0] or 0) // PART_SHINGLES)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    met = dealt.withColumn("other", F.explode(others)).select("item", "label", "parts", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    bucket = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(F.xxhash64("label", "lo", "hi"))
    rows = met.withColumn("bucket", bucket).join(sets.select("item", "shingles"), "item").select("bucket", "label", "lo", "hi", "item", "shingles")
    return materialize(rows.groupBy("bucket").applyInPandas(join, "a long, b long").distinct(), "near-group")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts' shingle sets have a similarity of at least 0.8."""

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(shingle_set(x), shingle_set(y)) for x, y in zip(left, right)], dtype=bool)

    side = lambda c: texts.select(F.col("item").alias(c), F.col("text").alias(f"text_{c}"))
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(close("text_a", "text_b")).select("a", "b"), "near-links")


def near_items(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, item) of every row, where key is the text's hash and item its shingle set's, and (node, label) of the items that have near copies.

    Two texts are near copies if the sets of their five-word shingles have a similarity of at least 0.8. What the trie join links in one
    of tables_for fingerprints drawn from the sets' long SimHash is a band, a row an item and never a row a pair; there the pairs whose long
    fingerprints are near are candidates, and links that span them come out. Sets that these join are a group, all pairs of which are compared
    shingle by shingle, so no other pair is linked. Bands within a group of the FIRST tables are passed over in the others. Groups too large for
    that are compared band by band.
    """

    def sign(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for t in texts:
            x = shingle_set(t)
            rows.append((_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)), len(x), long_fingerprint(x).tobytes()))
        return pd.DataFrame(rows, columns=["item", "size", "bits"])

    marked = in_small_batches(docs).select("doc_id", F.xxhash64("text").alias("key"), F.pandas_udf(sign, "item long, size long, bits binary")("text").alias("s")).select("doc_id", "key", "s.*")
    marked = materialize(marked, "near")
    distinct = materialize(marked.where("size > 0").groupBy("item").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", "bits")]), "near-distinct")
    n = distinct.count()
    head, tables, k = tables_for(n)
    buckets = max(1, n // BUCKET_ROWS)
    sets = distinct.where(F.col("size") >= LEAST_SET)

    def grouped(links: DataFrame) -> DataFrame:
        """(item, label, n, whole) of what the links join; whole: small enough to be compared in full."""
        named = components(links.select("a", "b")).withColumnRenamed("node", "item").join(distinct.select("item", "size"), "item")
        sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.sum("size") <= PARTS // 2 * BLOCK_SHINGLES).alias("fits"))
        return materialize(named.join(sizes, "label").select("item", "label", "n", (F.col("fits") & (F.col("n") <= PARTS // 2 * block)).alias("whole")), "near-groups")

    def bands(links: DataFrame, groups: DataFrame) -> DataFrame:
        """(item, band) of the links in groups that are not compared in full."""
        items = links.select(F.col("a").alias("item"), "band").union(links.select("b", "band")).distinct()
        return items.join(groups.where("not whole").select("item"), "item", "left_semi")

    def compared(groups: DataFrame, crowd: DataFrame) -> DataFrame:
        """Links within groups (item, label, n), and within crowds (item, band)."""
        groups, crowd = materialize(groups, "near-whole"), materialize(crowd, "near-crowds")
        wanted = groups.select("item").union(crowd.select("item")).distinct()
        keys = bounded(materialize(distinct.select("item", "key").join(wanted, "item"), "near-wanted"), 1_000_000)
        texts = materialize(docs.select(F.xxhash64("text").alias("key"), "text").join(keys, "key").dropDuplicates(["item"]).select("item", "text"), "near-texts")
        edges = _verified(groups.where("n = 2").groupBy("label").agg(F.min("item").alias("a"), F.max("item").alias("b")).select("a", "b"), texts)
        shingles = F.pandas_udf(lambda texts: pd.Series([shingle_set(t).tobytes() for t in texts]), "binary")
        more = groups.where("n > 2").select("item").union(crowd.select("item")).distinct()
        held = texts.join(more, "item").select("item", shingles("text").alias("shingles")).select("item", (F.octet_length("shingles") / 8).cast("long").alias("size"), "shingles")
        held = materialize(held, "near-sets")
        edges = edges.union(_group_links(groups.where("n > 2").select("item", "label"), held))
        return edges.union(_crowd_links(crowd, held, block)) if crowd.limit(1).count() else edges

    first = _routed(sets.select("item", "bits", "size", F.col("bits").alias("long")), head, range(min(FIRST, tables)), tables, buckets).withColumnRenamed("long", "bits")
    early = materialize(first.groupBy("bucket").applyInPandas(lambda group: _close(_bands_of(group, head, k)), "a long, b long, band long"), "near-early")
    before = grouped(early)
    labels, edges = before.where("whole").select("item", "label"), None
    if before.where("not whole").limit(1).count():  # pairs that are joined already need no comparison
        edges = compared(before.where("false"), bands(early, before))
        labels = labels.union(components(edges).select(F.col("node").alias("item"), "label"))
    later = _routed(sets.join(labels, "item", "left").select("item", "bits", F.coalesce("label", "item").alias("label")), head, range(min(FIRST, tables), tables), tables, buckets)
    met = materialize(later.groupBy("bucket").applyInPandas(lambda group: _meet(group, head, k, buckets), "a long, b long, band long"), "near-met")
    together = F.pmod(F.xxhash64("band"), F.lit(64 + met.count() // 10_000))
    late = met.select(F.col("a").alias("item"), "band").join(distinct.select("item", "size", "bits"), "item").withColumn("together", together).groupBy("together").applyInPandas(_close, "a long, b long, band long")
    late = materialize(late, "near-late")
    after = grouped(before.select(F.col("label").alias("a"), F.col("item").alias("b")).union(late.select("a", "b")))  # a link an item spans what the first tables joined
    # A group of the first tables that has grown too large is still compared by itself: its bands were passed over since.
    within = after.where("not whole").select("item").join(before.where("whole"), "item").select("item", "label", "n", "whole")
    found = compared(after.where("whole").union(within), bands(late, after))
    return marked.select("doc_id", "key", "item"), components(found.union(edges) if edges else found)


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without all but one row of each class of near copies: the one of the least (doc_id, hash of the text) stays, whole and once; a null doc_id is the largest.

    Null and empty texts are copies of one another. Rows that share a doc_id, null or not, are a class only if their texts are. Columns and null texts: as they are.
    """
    marked, labels = near_items(docs, block)
    linked = marked.join(bounded(labels, 1_000_000), F.col("item") == F.col("node"), "left").select("doc_id", "key", F.coalesce("label", "item").alias("label"))
    first = linked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s"))
    stays = bounded(materialize(first.select(F.col("s.doc_id").alias("stays"), F.col("s.key").alias("stays_key")), "near-stays"), 1_000_000)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    kept = held.join(stays, (F.col("key") == F.col("stays_key")) & F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    # Rows that repeat both are rare: they are put aside, and one of each stays.
    twice = materialize(marked.groupBy(F.col("doc_id").alias("many"), F.col("key").alias("many_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-repeated")
    if not twice.limit(1).count():
        return kept.select("doc.*")
    twice, same = bounded(twice, 1_000_000), (F.col("key") == F.col("many_key")) & F.col("id").eqNullSafe(F.col("many"))
    rest = kept.join(twice, same, "left_semi").dropDuplicates(["id", "key"])
    return kept.join(twice, same, "left_anti").select("doc.*").union(rest.select("doc.*"))
