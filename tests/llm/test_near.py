"""Near-dedup and line dedup against brute force."""

import re

import numpy as np
import pytest

from loomquery.llm import linededup, simhash

DOCS = "doc_id long, text string"


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def zipf(rng, n):
    return [f"w{x}" for x in rng.zipf(1.3, n) % 50_000]


def kept(spark, rows):
    return {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}


def test_every_kind_of_near_copy_goes(spark):
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for n in range(25):
        text = zipf(rng, 300)
        spots = set(rng.choice(2000, 40, replace=False).tolist())
        long = zipf(rng, 2000)
        kinds = [
            (text, text + [f"new{n}x{i}" for i in range(60)]), (zipf(rng, 300), None), (zipf(rng, 300), 0.86), ((short := zipf(rng, 13)), short[:-1] + ["last"]), ((short := zipf(rng, 20)), [*short, "more"]),
            (long, [f"odd{n}x{i}" if i in spots else w for i, w in enumerate(long)]),
        ]
        for a, b in kinds:
            b = a[:270] + [f"end{n}x{i}" for i in range(30)] if b is None else a[: int(b * len(a))] if isinstance(b, float) else b
            rows += [(2 * len(pairs), " ".join(a)), (2 * len(pairs) + 1, " ".join(b))]
            pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    stay = kept(spark, rows)
    assert sum(j >= 0.8 for j in pairs) > 100
    assert stay == {i for i, _ in rows if i % 2 == 0} | {2 * i + 1 for i, j in enumerate(pairs) if j < 0.8}


def test_no_pair_below_the_threshold_is_linked(spark):
    rng = np.random.default_rng(12)
    rows, similarity = [], []
    for n in range(200):  # edits reuse the text's own words
        text = zipf(rng, 400)
        other = list(text)
        for i in rng.choice(400, int(rng.integers(3, 20)), replace=False):
            other[i] = text[int(rng.integers(0, 400))]
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(other))]
        similarity.append(jaccard(rows[-2][1], rows[-1][1]))
    stay = kept(spark, rows)
    assert sum(0.6 <= j < 0.8 for j in similarity) > 50
    assert [2 * n + 1 in stay for n in range(200)] == [j < 0.8 for j in similarity]


def test_a_crowd_of_copies_of_copies(spark):
    rng = np.random.default_rng(13)
    text, rows = zipf(rng, 200), []
    for n in range(150):  # each a copy of the one before, so only neighbours are alike
        rows.append((n, " ".join(text)))
        text = list(text)
        for i in rng.choice(200, 3, replace=False):
            text[i] = f"c{n}x{i}"
    rows += [(1000 + n, " ".join(zipf(rng, 200))) for n in range(20)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    want = {rows[x][0] for x in set(up)}
    assert kept(spark, rows) == want
    assert {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS), block=40).collect()} == want
    crowd = [(n, " ".join(rows[0][1].split()[: 200 - n % 3] + [f"z{n}"])) for n in range(120)]  # one band for all
    assert kept(spark, crowd) == {0}


def test_a_crowd_just_below_and_above_the_threshold(spark):
    rng = np.random.default_rng(16)
    text, rows = zipf(rng, 150), []
    for n in range(300):  # all of one text, with 2 to 5 words changed: alike or not, pair by pair
        words = list(text)
        for i in rng.choice(150, int(rng.integers(2, 6)), replace=False):
            words[i] = f"d{n}x{i}"
        rows.append((n, " ".join(words)))
    up = list(range(300))
    for i in range(300):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert 1 < len(set(up)) < 300
    for block in (2048, 70, 20):
        assert {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS), block=block).collect()} == set(up)


def test_forests_of_sets_equal_brute_force():
    rng = np.random.default_rng(17)
    for n, common in ((40, 30), (150, 60), (150, 3)):
        sets = [np.unique(np.concatenate([np.arange(common), rng.integers(100, 140 if common > 3 else 10_000, rng.integers(1, 14))])).astype(np.uint64) for _ in range(n)]
        up = list(range(n))
        for i in range(n):
            for j in range(i):
                if simhash.similar(sets[i], sets[j]):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        root, member = simhash.similar_forest(sets)
        found = list(range(n))
        for r, m in zip(root.tolist(), member.tolist()):
            found[m] = r
        assert found == up


def test_null_and_repeated_ids_are_rows_like_any_other(spark):
    rng = np.random.default_rng(14)
    text = lambda: " ".join(zipf(rng, 60))
    own = [text() for _ in range(9)]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (None, own[2]), (7, own[3]), (7, own[4]), (7, own[4]), (1, own[5]), (7, own[5]), (None, own[5]), (2, own[6]), (2, own[6] + " more")]
    got = sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert len(got) == 7 and {t for _, t in got} - {own[6] + " more"} <= set(own[:7])
    assert {(i, t) for i, t in got if t in own[:6]} == {(None, own[0]), (None, own[1]), (None, own[2]), (7, own[3]), (7, own[4]), (1, own[5])}


def plain_line_dedup(docs, p):
    """(lines that stay) of each (doc_id, text), with nothing but loops. doc_ids are given; rows that repeat both are one document."""
    import xxhash

    as_long = lambda h: h - (1 << 64) if h >> 63 else h
    text_hash = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)

    def rolled(hashes, i):
        h = xxhash.xxh64_intdigest(p.seed.to_bytes(4, "little", signed=True), 42)
        for k in range(p.window):
            h = xxhash.xxh64_intdigest((hashes[i - k] if i >= k else 0).to_bytes(8, "little"), h)
        return as_long(h) % p.divisor

    words = lambda x: len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w])
    order, chunks, pairs = {}, {}, {}
    for doc_id, text in set(docs):
        key = as_long(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)))
        doc = order[doc_id, text] = (doc_id, key)
        lines = text.split("\n")
        long = [p.long_lines and words(x) >= p.long_words for x in lines]
        hashes, first = [text_hash(x) for x in lines], 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or long[i] or long[i + 1] or rolled(hashes, i) == 0:
                chunk = "\n".join(lines[first : i + 1])
                if long[i] or i > first and len(chunk) >= i - first + 1:
                    chunks.setdefault(chunk, []).append((doc, first, i - first + 1))
                first = i + 1
        for i in range(len(lines) - 1):
            pairs.setdefault(lines[i] + "\n" + lines[i + 1], []).append((doc, i))
    gone = {d: set() for d in order.values()}
    for found in chunks.values():
        keeper = min(found)[:2]
        for doc, first, n in found:
            if len(found) > 1 and (doc, first) != keeper:
                gone[doc] |= set(range(first, first + n))
    later, stay, at = {d: set() for d in order.values()}, {d: set() for d in order.values()}, {}
    for found in pairs.values():
        if len(found) > 1:
            doc, i = min(found)
            stay[doc] |= {i, i + 1}
            for doc, i in sorted(found)[1:]:
                later[doc].add(i)
    out = {}
    for (doc_id, text), doc in order.items():
        lines = text.split("\n")
        run = []
        for i in [*sorted(later[doc]), None]:
            if run and (i is None or i != run[-1] + 1):
                if sum(words(lines[x]) for x in range(run[0], run[-1] + 2)) >= p.long_words:
                    gone[doc] |= set(range(run[0], run[-1] + 2)) - stay[doc]
                run = []
            if i is not None:
                run.append(i)
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone[doc])
    return out


@pytest.mark.parametrize("p", [linededup.LineParams(), linededup.LineParams(hash_bits=6), linededup.LineParams(window=1, divisor=2, long_words=20), linededup.LineParams(window=3, long_lines=False)])
def test_line_dedup_equals_brute_force(spark, p):
    rng = np.random.default_rng(31)
    line = lambda: " ".join(f"v{x}" for x in rng.integers(0, 10**6, int(rng.choice([0, 1, 5, 12, 30, 60]))))
    pool = [line() for _ in range(60)]
    passages = [[line() for _ in range(int(rng.integers(1, 9)))] for _ in range(15)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            kind = rng.random()
            lines += passages[int(rng.integers(15))] if kind < 0.4 else [pool[int(rng.integers(60))]] if kind < 0.6 else [line()]
        rows.append((int(rng.integers(0, 140)), "\n".join(lines)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, "\n\n\n"), (502, "")]
    want = plain_line_dedup(rows, p)
    got = linededup.line_dedup(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, was string"), p).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["was"]): r["text"] for r in got} == want
    assert sum(want[x] != x[1] for x in want) > 30


def test_lines_repeated_among_documents_without_an_id_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    for i in (None, 5):
        rows = [(i, f"{passage}\nown line {n}") for n in range(4)]
        got = [r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()]
        assert sum(passage in t for t in got) == 1 and all(any(f"own line {n}" in t for t in got) for n in range(4))


def test_short_passages_of_short_lines_go(spark):
    rng = np.random.default_rng(15)
    line = lambda: " ".join(f"l{x}" for x in rng.integers(0, 10**9, 15))
    rows, want = [], {}
    for n in (2, 3, 4, 6, 8, 12):
        for _ in range(8):  # a passage of n lines in two documents, at other places; 15 words a line
            passage, at = [line() for _ in range(n)], len(rows)
            for i in range(2):
                before, after = [line() for _ in range(int(rng.integers(1, 5)))], [line() for _ in range(int(rng.integers(1, 5)))]
                rows.append((at + i, "\n".join(before + passage + after)))
                want[at + i] = "\n".join(before + (passage if i == 0 or n < 4 else []) + after)
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    long = [i for i, t in rows if want[i] != t or i % 2 == 0]
    assert len(long) > 70 and all(got[i] == want[i] for i in long)
    assert all(x in got[i] for i, t in rows for x in want[i].split("\n") if len(t.split()) and want[i] != t)


def plain_fingerprint(text, shingle=3):
    """Bit by bit, from the definition."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(None, "A b C d"), (None, "a B c D"), (10**9, "É a\x85b ÀÉ x y"), (10**9, "other"), (10**9 + 1, "one two"), (10**9 + 2, None), (10**9 + 3, " \x0b ")]
    docs = docs.union(spark.createDataFrame(extra, DOCS))
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    ids = {}
    for r, p in zip(rows, prints):
        ids.setdefault(p, []).append(r["doc_id"])
    values = sorted(ids)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for v in values:
        least.setdefault(root(v), []).extend(i for i in ids[v] if i is not None)
    want = sorted(((r["doc_id"], f"{p:016x}", min(least[root(p)], default=None)) for r, p in zip(rows, prints)), key=str)
    assert sorted(map(tuple, simhash.classes(docs).collect()), key=str) == want
