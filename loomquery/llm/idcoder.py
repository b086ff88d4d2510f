"""A context-mixing range coder for token ids: blocks of ids, each coded on its own, many at once in numpy.

Ids go through in groups. In a group, neighbours that often stand together first become one symbol, in ROUNDS of pairs. Three
predictions of the next symbol are mixed into one distribution, which drives a range coder: order 2 and order 1 each foresee
the symbol that in this group most often follows the same two symbols (their hash) or the same one, and order 0 is a distribution over all
symbols. The mixture gives the foreseen symbols their predictions' weights on top of what order 0 gives them. A weight follows how
often a context's prediction holds in the group, in sixteenths, and a prediction is left out if it would not pay for its place. All that makes up
the mixture stands in the group's head, so nothing is left to learn while symbols go through. The HEAD most frequent ones
have an interval of their own; the others share one, and which of them it is takes a second step of the coder.

The numbers that stand in the file and all that the coder does with them are integers, so any machine decodes alike. Every block
starts from the same state, whatever stands before it, and has a checksum. The blocks of a group go through the coder side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDS3"
BLOCK = 2048  # a group takes GROUP times so many ids
GROUP = 1024
PER_BLOCK = 4  # a block has BLOCK symbols over this
HEAD = 16_383
ROUNDS = 2
ZERO = 18  # bits of the order-0 distribution
FULL = ZERO + 8  # bits of the coder's distribution: the three predictions share 256 parts
PAIRED = 18  # bits of the hash under which pairs are counted
TWO = 16  # bits of the hash of an order-2 context
MOST = 14  # sixteenths that a prediction weighs at the most: two leave order 0 four parts of 256
LEAST = 12  # times that a pair must stand together to become a symbol
_U = np.uint64
_WORD, _FULL = _U(32), _U(FULL)
_LOW = _U((1 << 32) - 1)


def _scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """0 and the running sums of counts, stretched to end at 2**bits and to rise by at least 1."""
    n, upto = len(counts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return np.arange(n + 1) + upto * ((1 << bits) - n) // max(1, int(upto[-1]))


def _paired(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair's bin (b is below n), whether it is the one pair that its bin stands for, and that pair of every bin as a * n + b."""
    kind, odd = (np.uint32, 0x9E3779B1) if (int(a.max()) + 1) * n < 1 << 32 else (np.uint64, 0x9E3779B97F4A7C15)
    pair = a.astype(kind) * kind(n)
    pair += b.astype(kind)
    h = (pair * kind(odd) >> kind(8 * pair.itemsize - PAIRED)).astype(np.int64)
    stands = np.zeros(1 << PAIRED, kind)
    stands[h] = pair
    return h, stands.take(h) == pair, stands


def _merged(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """s, of symbols below n, with frequent pairs as symbols from n on, and those pairs."""
    made = [np.zeros((0, 2), np.int64)]
    for _ in range(ROUNDS):
        if len(s) < 2 * LEAST:
            break
        one = np.bincount(s, minlength=n).astype(np.float64)
        h, own, stands = _paired(s[:-1], s[1:], n)
        count = np.bincount(h.compress(own), minlength=1 << PAIRED)
        bins = np.flatnonzero(count >= LEAST)
        c, (a, b) = count[bins].astype(np.float64), np.divmod(stands[bins].astype(np.int64), n)
        worth = np.zeros(1 << PAIRED, np.float32)
        worth[bins] = c * (np.log2(c * len(s) / (one[a] * one[b])) - 0.5)
        worth[worth <= 48] = 0
        score = np.zeros(len(s) + 1, np.float32)  # a place before the first and one after the last
        np.multiply(worth.take(h), own, out=score[1:-1])
        score[2:-1:2] *= np.float32(1.001)  # in runs of one symbol every other pair is taken
        i = np.flatnonzero((score[1:-1] > score[:-2]) & (score[1:-1] >= score[2:]))
        i = i[np.diff(i, prepend=-2) > 1]
        at = h[i]
        most = np.bincount(at, minlength=1 << PAIRED) >= LEAST // 2
        i, bins = i[most[at]], np.flatnonzero(most)
        if not len(bins):
            break
        made.append(np.stack(np.divmod(stands[bins].astype(np.int64), n), axis=1))
        name = np.zeros(1 << PAIRED, np.int32)
        name[bins] = np.arange(n, n + len(bins))
        new, stay = s.copy(), np.ones(len(s), bool)
        new[i], stay[i + 1] = name[h[i]], False
        s, n = new.compress(stay), n + len(bins)
    return s, np.concatenate(made)


def _foreseen(context: np.ndarray, n: int, x: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols, sixteenths): what most often follows in each of n contexts, where foreseeing it pays."""
    h, own, stands = _paired(context, x, len(upto) - 1)
    count = np.bincount(h.compress(own), minlength=1 << PAIRED)
    bins = np.flatnonzero(count > 2)
    before, after = np.divmod(stands[bins].astype(np.int64), len(upto) - 1)
    i = np.flatnonzero(after < len(upto) - 2)  # the last may stand for many
    best = np.zeros(n, np.int64)
    np.maximum.at(best, before[i], count[bins[i]] << 20 | after[i])
    at = np.flatnonzero(best)
    held, symbol = (best[at] >> 20).astype(np.float64), best[at] & 0xFFFFF
    every = np.bincount(context, minlength=n)[at]
    weight = np.clip(np.rint(16 * held / every), 1, MOST).astype(np.int64)
    zero = (upto[symbol + 1] - upto[symbol]) / (1 << ZERO)
    gain = held * np.log2((weight / 16 + (1 - weight / 16) * zero) / zero) + (every - held) * np.log2(1 - weight / 16)
    pays = gain > 32
    return at[pays], symbol[pays], weight[pays]


class _Model:
    """The mixture. Symbols are ranks by frequency; counts are theirs. one, two: what orders 1 and 2 foresee, as in _foreseen."""

    def __init__(self, counts: np.ndarray, one: tuple | None = None, two: tuple | None = None) -> None:
        self.symbols = min(len(counts), HEAD + 1)
        last = self.symbols - 1
        self.tail = len(counts) > self.symbols
        upto = _scaled(counts if not self.tail else np.append(counts[:last], counts[last:].sum()), ZERO)
        self.upto, self.size = upto.astype(np.int32), np.diff(upto).astype(np.int32)
        self.rest = _scaled(counts[last:], FULL) if self.tail else None
        self.start = len(counts)  # stands before a block's first symbol
        self.one, self.two = self._table(self.start + 1, one), self._table(1 << TWO, two)

    @staticmethod
    def _table(n: int, entries: tuple | None) -> np.ndarray:
        """For each context the symbol foreseen, and its weight below."""
        table = np.zeros(n, np.int32)
        if entries:
            table[entries[0]] = entries[1] << 4 | entries[2]
        return table

    @staticmethod
    def context(last1: np.ndarray, last2: np.ndarray) -> np.ndarray:
        return (last1.astype(np.uint32) * np.uint32(0x85EBCA6B) + last2.astype(np.uint32) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - TWO)

    def look(self, last1: np.ndarray, last2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Foreseen symbols k2 and k1, order 0's parts of 256, and the others' places in the mixture."""
        two, one = self.two.take(self.context(last1, last2)), self.one.take(last1)
        k2, k1 = two >> 4, one >> 4
        two &= 15
        one &= 15
        one *= k1 != k2  # one symbol foreseen twice counts as order 2's alone
        one *= 16 - two
        two <<= 4
        return k2, k1, 256 - two - one, two << ZERO, one << ZERO

    def span(self, look: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each symbol in the mixture."""
        k2, k1, w0, l2, l1 = look
        start, size = self.upto.take(x) * w0, self.size.take(x) * w0
        size += l1 * (k1 == x)
        size += l2 * (k2 == x)
        start += l1 * (k1 < x)
        start += l2 * (k2 < x)
        return start, size

    def find(self, look: tuple[np.ndarray, ...], v: np.ndarray) -> np.ndarray:
        """The symbols at places v of the mixture."""
        k2, k1, w0, l2, l1 = look
        from2 = v - self.upto.take(k2) * w0 - l1 * (k1 < k2)
        from1 = v - self.upto.take(k1) * w0 - l2 * (k2 < k1)
        v = v - np.minimum(np.maximum(from2, 0), l2) - np.minimum(np.maximum(from1, 0), l1)
        x = self.slots.take(v.view(np.uint32) // w0.view(np.uint32), mode="clip")
        np.copyto(x, k1, where=from1.view(np.uint32) < l1.view(np.uint32))
        np.copyto(x, k2, where=from2.view(np.uint32) < l2.view(np.uint32))
        return x

    def read_only(self) -> _Model:
        self.slots = np.repeat(np.arange(self.symbols, dtype=np.int32), self.size)
        return self


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in rising order, and the place of each id among them."""
    if int(ids.max()) >= 1 << 20:
        names, place = np.unique(ids, return_inverse=True)
        return names, place.astype(np.int32)
    seen = np.bincount(ids) > 0
    names = np.flatnonzero(seen)
    place = (np.cumsum(seen) - 1).astype(np.int32)
    return names, place[ids]


def _u4(*arrays: np.ndarray) -> bytes:
    return b"".join(struct.pack("<I", len(a)) + a.astype("<u4").tobytes() for a in arrays)


def _from_u4(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        out.append(np.frombuffer(data, "<u4", n, at + 4).astype(np.int64))
        at += 4 + 4 * n
    return out


def _encode_group(ids: np.ndarray, block: int) -> bytes:
    names, place = _counted(ids)
    s, pairs = _merged(place, len(names))
    counts = np.bincount(s, minlength=len(names) + len(pairs))
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.int32)
    rank[order] = np.arange(len(order))
    size = np.ones(len(counts), np.int64)
    for k, (a, b) in enumerate(pairs.tolist(), len(names)):
        size[k] = size[a] + size[b]
    n, ends = -(-len(s) // block), np.cumsum(size[s])
    m = len(s) - block * (n - 1)  # steps of the last block
    model = _Model(counts[order])
    grid = np.zeros((n, block), np.int32)
    grid.ravel()[: len(s)] = rank.take(s)
    grid = np.ascontiguousarray(grid.T[: len(s)])  # a row a step
    before = np.full((2, n), model.start, np.int32)
    last1, last2 = np.concatenate([before[:1], grid[:-1]]), np.concatenate([before, grid[:-2]])[: len(grid)]
    shared = np.minimum(grid, model.symbols - 1)
    one = _foreseen(last1.ravel(), model.start + 1, shared.ravel(), model.upto) if model.symbols > 2 else None
    two = _foreseen(model.context(last1, last2).ravel(), 1 << TWO, shared.ravel(), model.upto) if model.symbols > 2 else None
    model = _Model(counts[order], one, two)
    out, used, every = np.zeros((len(grid) * (2 if model.tail else 1) + 4) * n, _U), np.arange(n), np.arange(n)
    low, span = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)

    def put(i: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        part = span[i] >> _FULL
        was = low[i]
        now = was + part * start
        at = used[i]
        out[at] += now < was  # carried over: a word in front of each block takes what the first has over
        part *= size
        short = part < _WORD_FULL
        out[at + n] = now >> _WORD  # counts only where the block moves on
        used[i] = at + n * short
        shift = short * _WORD
        low[i], span[i] = now << shift, part << shift

    for t in range(len(grid)):
        i = slice(0, n if t < m else n - 1)
        x = shared[t, i]
        start, width = model.span(model.look(last1[t, i], last2[t, i]), x)
        put(i, start.astype(_U), width.astype(_U))
        if model.tail:
            j = np.flatnonzero(x == model.symbols - 1)
            y = grid[t, j] - (model.symbols - 1)
            put(j, model.rest[y].view(_U), (model.rest[y + 1] - model.rest[y]).view(_U))
    for shift in (32, 0):
        used += n
        out[used] = low >> _U(shift) & _LOW
    words = used // n
    out = out.reshape(-1, n)[: int(words.max()) + 1]
    for row in range(len(out) - 1, 0, -1):
        out[row - 1] += np.where(row <= words, out[row] >> _WORD, 0).astype(_U)
    out &= _LOW
    raw = np.ascontiguousarray(ids, "<u4")
    stops = np.append(ends[block - 1 :: block][: n - 1], len(ids)).tolist()
    sums = np.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *stops], stops)], "<u4")
    tables = [y for x in (one, two) for y in (x or (np.zeros(0, np.int64),) * 3)]
    tables[0], tables[3] = np.diff(tables[0], prepend=0), np.diff(tables[3], prepend=0)
    head = zlib.compress(_u4(np.diff(names.astype(np.int64), prepend=0), pairs[:, 0], pairs[:, 1], counts, *tables), 3)
    lead = struct.pack("<IIIII", len(ids), len(s), block, len(head), zlib.crc32(head))
    body = np.ascontiguousarray(out[1:].T.astype("<u4"))
    return lead + head + words.astype("<u4").tobytes() + sums.tobytes() + body[np.arange(body.shape[1]) < words[:, None]].tobytes()


_WORD_FULL = _U(1 << 32)


def _decode_group(data: memoryview, first: int) -> tuple[np.ndarray, int, int]:
    """The ids of the group at the start of data, its length and its blocks."""
    if len(data) < 20:
        raise ValueError("a group of blocks is cut off")
    total, symbols, block, size_head, sum_head = struct.unpack_from("<IIIII", data)
    head, at = data[20 : 20 + size_head], 20 + size_head
    n = -(-symbols // max(1, block))
    if len(data) < at + 8 * n or zlib.crc32(head) != sum_head or not 0 < n <= total:
        raise ValueError("the head of a group is damaged or cut off")
    names, left, right, counts, *tables = _from_u4(zlib.decompress(head))
    names = np.cumsum(names)
    words = np.frombuffer(data, "<u4", n, at).astype(np.int64)
    sums = np.frombuffer(data, "<u4", n, at + 4 * n)
    end = at + 8 * n + 4 * int(words.sum())
    if len(data) < end or (words < 2).any():
        raise ValueError("the blocks are cut off")
    # Each block reads on from its own place; a zero past the end is met only in damaged blocks.
    tape = np.concatenate([np.frombuffer(data, "<u4", int(words.sum()), at + 8 * n), np.zeros(4, "<u4")]).astype(_U)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    tables[0], tables[3] = np.cumsum(tables[0]), np.cumsum(tables[3])
    model = _Model(counts[order], tables[:3], tables[3:]).read_only()
    span, read = np.full(n, (1 << 64) - 1, _U), np.cumsum(words) - words
    code = tape[read] << _WORD | tape[read + 1]
    read = read + 2
    m, steps, last = symbols - block * (n - 1), min(block, symbols), model.symbols - 1
    grid = np.zeros((steps, n), np.int32)
    last1, last2 = np.full(n, model.start, np.int32), np.full(n, model.start, np.int32)

    def where(i: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        part = span[i] >> _FULL
        return part, np.minimum(code[i] // part, _U((1 << FULL) - 1)).astype(np.int32)

    def take(i: np.ndarray | slice, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        now = code[i] - part * start
        part = part * size
        short = part < _WORD_FULL
        shift, at = short * _WORD, read[i]
        code[i] = now << shift | tape.take(at, mode="clip") * short
        span[i] = part << shift
        read[i] = at + short

    with np.errstate(over="ignore", divide="ignore"):
        for t in range(steps):
            i = slice(0, n if t < m else n - 1)
            look = model.look(last1[i], last2[i])
            part, v = where(i)
            x = model.find(look, v)
            start, size = model.span(look, x)
            take(i, part, start.astype(_U), size.astype(_U))
            if model.tail and len(j := np.flatnonzero(x == last)):
                part, v = where(j)
                y = np.clip(np.searchsorted(model.rest, v, "right") - 1, 0, len(model.rest) - 2)
                take(j, part, model.rest[y].view(_U), (model.rest[y + 1] - model.rest[y]).view(_U))
                x[j] = y + last
            grid[t, i] = x
            last2[i] = last1[i]
            last1[i] = x
    texts = [x.tobytes() for x in names.astype("<u4")]
    for a, b in zip(left.tolist(), right.tolist()):
        texts.append(texts[a] + texts[b])
    texts = [texts[k] for k in order.tolist()]
    x = np.ascontiguousarray(grid.T).ravel()[:symbols]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) >> 2
    stops, flat = np.cumsum(size[x]), np.frombuffer(b"".join(texts), "<u4")
    if stops[-1] != total:
        raise ValueError(f"a block of {first} to {first + n - 1} is damaged: there are {stops[-1]} ids, not {total}")
    ids = flat[np.repeat((np.cumsum(size) - size)[x] - (stops - size[x]), size[x]) + np.arange(total)]
    stops = np.append(stops[block - 1 :: block][: n - 1], total).tolist()
    for k, (a, b) in enumerate(zip([0, *stops], stops)):
        if zlib.crc32(ids[a:b]) != sums[k]:
            raise ValueError(f"block {first + k} does not match its checksum")
    return ids, end, n


def encode(ids: np.ndarray, block: int | None = None) -> bytes:
    """ids: unsigned 32-bit numbers. Their coded blocks, in groups."""
    block = block or BLOCK
    parts = [_encode_group(ids[at : at + block * GROUP], max(1, block // PER_BLOCK)) for at in range(0, len(ids), block * GROUP)]
    return MAGIC + struct.pack("<Q", len(ids)) + b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The ids back. Raises ValueError on a foreign, short or damaged file, naming the first bad block."""
    if data[:4] != MAGIC or len(data) < 12:
        raise ValueError("no coded ids")
    total = struct.unpack_from("<Q", data, 4)[0]
    rest, out, found, first = memoryview(data)[12:], [], 0, 0
    while found < total:
        ids, used, blocks = _decode_group(rest, first)
        out.append(ids)
        found, first = found + len(ids), first + blocks
        rest = rest[used:]
    if found != total or len(rest):
        raise ValueError("the groups do not make up the file")
    return np.concatenate(out) if out else np.zeros(0, "<u4")
