"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns: each operator has a defined result."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import common, graph_ann, htmlcut, linededup, mixing, mtree, packing, quality, simhash, tokenfile, warc
from loomquery.llm.queries import word_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, bits string, key string, doc string"
LONG = "word " * 60_000


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 7, 7, 7.0, "x", "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (None, "x y", "s"), (3, "", ""), (4, LONG, "t"), (5, "a\nb\nc", None), (6, " \t\n", "t")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_mixing(spark, odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == 8 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows} == {1: 3, 2: 0, None: 2, 3: 0, 4: 60_000, 5: 3, 6: 0}
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "mix_epoch", "mix_shard", "mix_order"]
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert [tuple(r) for r in mixing.mix_plan(odd).orderBy("doc_id", "size").collect()] == [tuple(r) for r in mixing.mix_plan(odd).orderBy("doc_id", "size").collect()]


def test_targets_by_filling_up(spark):
    sizes = {"a": 1000, "b": 10, None: 500, "": 40, "é": 0, "z": 300}
    frame = spark.createDataFrame([(k or "", k is None, v) for k, v in sizes.items()], "src string, src_null boolean, size long")
    got = {(None if r["src_null"] else r["src"]): r["target"] for r in mixing.source_targets(frame).collect()}
    order = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [None]
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    want, full = {}, set()
    while True:  # the excess is shared again until no source is over its cap
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in order if s not in full]
        want = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{0 if i % 3 == 0 else i % 7}") for i in range(3000)]
    p = mixing.MixParams(block_words=500, shard_words=5000)
    made = mixing.mix_plan(docs(spark, rows), p).collect()
    by = {}
    for r in made:
        by.setdefault((r["source_size"], r["target"]), 0)
        by[r["source_size"], r["target"]] += r["taken"]
        assert len(r["shards"]) == r["copies"] <= 3
    assert all(abs(taken - target) < 60 for (_, target), taken in by.items())
    assert len({s for r in made for s in r["shards"]}) >= 8


def test_many_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(21)
    rows = [(i, "w " * int(rng.choice([1, 2, 5, 40, 300])), f"host{i % 200}" if i % 3 else "hot") for i in range(4000)]
    by = {}
    for r in mixing.mix_plan(docs(spark, rows), mixing.MixParams(block_words=2000, shard_words=50_000)).join(docs(spark, rows).select("doc_id", "source"), "doc_id").collect():
        taken, target, _ = by.get(r["source"], (0, 0, 0))
        by[r["source"]] = taken + r["taken"], r["target"], r["source_size"]
    off = [abs(taken - target) for taken, target, _ in by.values()]
    assert len(by) == 201 and max(off) <= 150 and np.mean(off) < 50  # no document has over 300 words


def test_split_keeps_every_quota(spark):
    quotas = spark.createDataFrame([(0, 37), (1, 0), (2, 200), (3, 1)], "src_no int, quota long")
    rows = mixing.split_quotas(quotas, 3, 42).collect()
    total = {}
    for r in rows:
        total[r["src_no"]] = total.get(r["src_no"], 0) + r["quota"]
    shards = {}
    for r in rows:
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["quota"]
    assert total == {0: 37, 1: 0, 2: 200, 3: 1} and len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1


def test_quality(spark, odd, none):
    rows = [(i, ("good text of plain words " if i % 4 else "BAD!! *** $$$ ") * (i % 5 + 1) + str(i), "s") for i in range(400)]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, None), (7, 1), (7, 1)], "doc_id long, quality int")
    got = quality.classified(frame, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and held
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in quality.classified(odd, labels).collect())
    assert quality.classified(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classified(odd, empty).collect()} == {0.5}
    kept = quality.good(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 300


def plain_features(raw):
    """All n-grams of a text, one after another."""
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    mix = lambda w: sum((c + 1) * pow(quality._PRIME, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64)
    place = lambda h, kind: (((h ^ h >> 29) * (0x9E3779B97F4A7C15 + 2 * kind)) % (1 << 64)) >> (64 - quality.BITS)
    h = [mix(w) for w in words]
    out = {place(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2], 0) for i in range(len(raw) - 2)} | {place(x, 1) for x in h}
    out |= {place((x * 0xC2B2AE3D27D4EB4F + y) % (1 << 64), 2) for x, y in zip(h, h[1:])}
    if any(len(set(h[i : i + quality.RUN])) == 1 for i in range(len(h) - quality.RUN + 1)):
        out.add(place(1, 3))
    return sorted(out)


@pytest.mark.parametrize("part", [1, 2, 3, 7, 64, 1 << 20])
def test_features_do_not_depend_on_the_parts(part):
    rng = np.random.default_rng(part)
    texts = [b"", b" ", b"a", b"ab", b"x" * 90, b"no no no no no no", b"so so so so so", b"  lead and trail \t\n ", b"same same same other same same same"]
    texts += [bytes(rng.choice(np.frombuffer(b"ab \n.", np.uint8), 300)) for _ in range(20)] + ["é日本 ß x".encode() * 9]
    for t in texts:
        assert quality.features(t, part).tolist() == plain_features(t)


def test_features_of_texts_over_a_mebibyte():
    rng = np.random.default_rng(8)
    spaced = bytes(rng.choice(np.frombuffer(b"abcdefg  \n", np.uint8), 1_300_000))
    for t in (spaced, spaced.replace(b" ", b"x").replace(b"\n", b"y"), b"run " * 400_000):
        whole = quality.features(t, 1 << 22)
        assert (quality.features(t) == whole).all() and (quality.features(t, 99_991) == whole).all()


def test_quality_learns_nothing_from_held_out_labels(spark):
    frame = docs(spark, [(i, f"word{i} text", "s") for i in range(100)])
    one = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    held = quality.held_out()
    other = one.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda labels: [r["score"] for r in quality.classified(frame, labels).orderBy("doc_id").collect()]
    assert score(one) == score(other)


def test_line_dedup(spark, odd, none):
    assert linededup.line_dedup(none).count() == 0 and linededup.line_report(none).count() == 0
    out = linededup.line_dedup(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in odd.collect())))


def test_line_dedup_finds_shifted_passages(spark):
    rng = np.random.default_rng(5)
    line = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(9))
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(int(rng.integers(0, 9)))] + passage + [line() for _ in range(3)]), "s") for i in range(12)]
    rows += [(100, " ".join(line() for _ in range(8)), "s")]
    rows += [(101, line() + "\n" + rows[-1][1], "s"), (102, line() + "\n" + line(), "s")]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1]  # the first keeps all
    for i, text, _ in rows[1:12]:
        left = [x for x in got[i].split("\n") if x in passage]
        assert len(left) <= 12 and all(x in got[i] for x in text.split("\n") if x not in passage)
    assert got[102] == rows[-1][1]
    assert got[101] == rows[-2][1].split("\n")[0]  # a long line goes, whatever stands before it


def brute_components(values, k):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (int(a) ^ int(values[j])).bit_count() <= k:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_trie_join_equals_brute_force(k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(250)], np.uint64))
    a, b = simhash.trie_join(values, None, k)
    up = list(range(len(values)))
    for x, y in zip(a, b):
        up[y] = x
    roots = []
    for i in range(len(values)):
        while up[i] != i:
            i = up[i]
        roots.append(i)
    assert roots == brute_components(values, k)


def test_links_with_split_groups(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 10, dtype=np.uint64)
    values = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(500)], np.uint64))
    frame = spark.createDataFrame([(int(v), int(v)) for v in values.view(np.int64)], "item long, bits long")
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    for rows in (1, 200_000):
        found = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, 2, group_rows=rows)).collect()}
        groups = {}
        for v, i in place.items():
            groups.setdefault(found.get(v, v), set()).add(i)
        want = {}
        for i, r in enumerate(brute_components(values, 2)):
            want.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash(spark, odd, none):
    assert simhash.classes(none).count() == 0 and simhash.one_of_each(none).count() == 0
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(odd).collect()), key=str)
    assert len(got) == 8
    zero = {d: c for d, f, c in got if f == "0" * 16}
    assert zero == {2: 2, 3: 2, 6: 2}
    import xxhash

    assert dict((d, f) for d, f, _ in got)[1] == f"{xxhash.xxh64_intdigest(b'a b c', 42):016x}"
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 4]


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    rows, n = [], 0
    for _ in range(60):
        text = words(200)
        rows.append((n, " ".join(text), "s"))
        changed = list(text)
        changed[50] = "other"
        rows.append((n + 1, " ".join(changed), "s"))
        rows.append((n + 2, " ".join(words(200)), "s"))
        n += 3
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert all(i in kept for i in range(n) if i % 3 != 1) and sum(i in kept for i in range(n) if i % 3 == 1) <= 2


def test_packing(spark, odd, none):
    path = word_tokenizer()
    assert packing.pack(none, path).count() == 0
    rows = packing.pack(odd, path).collect()
    whole = {}
    for r in rows:
        assert r["offset"] + r["length"] <= 4096
        whole.setdefault(r["doc_id"], 0)
        whole[r["doc_id"]] += r["length"]
    assert whole == {1: 8, 2: 1, None: 3, 3: 1, 4: 60_001, 5: 4, 6: 1}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length


def test_pieces_are_the_documents_ids(spark, odd):
    from tokenizers import Tokenizer

    path = word_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    seen = {}
    for r in packing.pack(odd, path).collect():
        whole = ids[r["doc_id"]]
        part = whole[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(whole) and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    copies = {d: sum(1 for r in odd.collect() if r["doc_id"] == d) for d in texts}
    for d, parts in seen.items():  # each id lies in one piece of each of its rows
        assert sorted(x for a, n in parts for x in range(a, a + n)) == sorted(list(range(len(ids[d]))) * copies[d])


def test_packing_pads_little(spark):
    rng = np.random.default_rng(12)
    rows = packing.pack(docs(spark, [(i, "word " * int(rng.integers(1, 3000)), "s") for i in range(1500)]), word_tokenizer()).collect()
    held = sum(r["length"] for r in rows)
    assert held / (4096 * len({r["sequence_id"] for r in rows})) > 0.99


def test_best_fit_decreasing_equals_a_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 101, 200).tolist(), reverse=True)
        windows, offsets, made = packing.best_fit(lengths, 100)
        room = []
        for n in lengths:
            fit = [i for i, r in enumerate(room) if r >= n]
            i = min(fit, key=lambda i: room[i]) if fit else len(room)
            if not fit:
                room.append(100)
            room[i] -= n
        assert made == len(room)
        used = [0] * made
        for w, o, n in zip(windows, offsets, lengths):
            assert o == used[w]
            used[w] += n
        assert sorted(100 - u for u in used) == sorted(room)


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = word_tokenizer()
    assert tokenfile.round_trip(none, path).count() == 0
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(odd.where("doc_id is not null"), path).collect())
    tok, at = Tokenizer.from_file(path), 0
    texts = {1: "a b c", 2: "", 3: "", 4: LONG, 5: "a\nb\nc", 6: " \t\n"}
    for start, doc_id, n, crc in got:
        ids = np.array([*tok.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert [g[1] for g in got] == [1, 1, 2, 3, 4, 5, 6]
    none_first = sorted((r["start"], r["doc_id"]) for r in tokenfile.round_trip(odd, path).collect())
    assert none_first[0] == (0, None) and none_first[1][1] == 1
    tokenfile.write_ids(odd, str(tmp_path / "ids"), path)
    assert sorted(len(r["ids"]) for r in tokenfile.read_ids(spark, str(tmp_path / "ids"), body=True).collect()) == [1, 1, 1, 3, 4, 4, 4, 60_001]


VECTORS = "vec_id long, embedding array<float>, label int, v int, dim int, rank int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(40)]  # one common vector
    rows += [(700, None), (750, [0.0] * 8), (800, [float("nan")] + [1.0] * 7), (850, [float("inf")] * 8), (900, [None] + [1.0] * 7), (950, []), (1000, [1.0, 2.0]), (1001, [2.0, 4.0])]
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, "x") for i, v in rows], VECTORS), rows


def brute(rows, every, k, score, ok):
    held = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and ok(v)]
    out = {}
    for q, a in held:
        if q % every == 0:
            out[q] = sorted(((-score(a, b), i) for i, b in held if i != q))[:k]
    return out


def test_graph_search(spark, vectors):
    frame, rows = vectors
    got = {}
    for r in graph_ann.nearest(frame, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, 50, 5, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)), any)
    hits = sum(len({i for _, i in w} & {i for i, _ in got[q]}) for q, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert [i for i, _ in got[0]] == [600, 601, 602, 603, 604] and got[0][0][1] == pytest.approx(1.0, abs=1e-12)
    assert [i for i, _ in got[650 - 50]] == [0, 601, 602, 603, 604]
    assert got[1000] == [(1001, pytest.approx(1.0))] and not {700, 750, 800, 850, 900, 950} & set(got)
    assert graph_ann.nearest(frame.limit(0)).count() == 0


def test_metric_tree(spark, vectors):
    frame, rows = vectors
    whole = [(i, None if v is None or any(x is None or not np.isfinite(x) for x in v) else np.floor(64 * np.array(v, float))) for i, v in rows]
    want = brute(whole, 20, 20, lambda a, b: int(a @ b), lambda v: True)
    got = {}
    for r in mtree.top_k(frame, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert {q: w for q, w in got.items() if q != 1000 and q != 950 and q != 900} == want
    assert mtree.top_k(frame.limit(0)).count() == 0


def test_metric_tree_spares_distances():
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.integers(-2, 3, (400, 8)) + c for c in rng.integers(-500, 500, (12, 8))]).astype(np.int64)
    tree = mtree.Tree({"z": z, "most": np.array((z**2).sum(axis=1).max()), **mtree.build_tree(mtree.lift(z))})
    rows, scores = tree.best(z[:1], 10)[0]
    full = z @ z[0]
    order = np.lexsort((np.arange(len(full)), -full))[:10]
    assert (rows == order).all() and (scores == full[order]).all() and tree.computed < len(z) // 2


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("<article><p>A &amp; B&nbsp;c<p>D</article>", "A & B c\nD"),
        ("<p>a plain text that has enough words to stand alone as one.</p><footer>&copy; me</footer>", "a plain text that has enough words to stand alone as one."),
        ("<article><p>One.</p><script>'</p>'</script><style>x</style><p>T<b>w</b>o.</p><div class='comments'><p>Nice words, said a reader of this page.</p></div></article><aside><p>More to read here, today.</p></aside>", "One.\nTwo."),
        ("<main><p>kept, with <a href='y'>links</a> in it.</p><form><p>Your name and your mail, please.</p></form></main>", "kept, with links in it."),
    ],
)
def test_main_text(page, text):
    assert htmlcut.main_text(page) == text


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        excess = rng.integers(-9, 10, n).tolist()
        edges = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.integers(0, 7, 12))]
        cost = lambda side: sum(max(0, -x) if s else max(0, x) for x, s in zip(excess, side)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        assert cost(htmlcut.min_cut(excess, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi é.</article>", "x"), (1, "u", "<article><p>Hi é.</article>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = sorted(map(str, (tuple(r)[:4] for r in htmlcut.extracted(pages).collect())))
    assert got == sorted(map(str, [(1, "u", "Hi é.", 5), (1, "u", "Hi é.", 5), (None, None, "", 0)]))
    assert htmlcut.main_text("<div><p>x<span" * 20_000) is not None


def test_warc(spark):
    rows = [(i, f"http://h/{i}" if i % 5 else None, f"<p>page {i}é</p>" * (i % 7) if i % 11 else None, "x") for i in range(700)] + [(None, None, None, "x"), (3, "http://h/3", "<p>page 3é</p>" * 3, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    got = warc.audited(pages, warc.damaged(pages)).collect()
    assert len(got) == 702
    for r in got:
        want = "ok" if r["page_id"] is None else "missing" if r["page_id"] % 311 == 7 else "changed" if r["page_id"] % 97 == 5 else "ok"
        assert r["status"] == want
    # Laid end to end, the records are a WARC file.
    text = warc.record(F.col("page_id"), F.col("url"), F.col("html"))
    raw = "".join(r[0] for r in pages.orderBy("page_id").select(text).collect()).encode()
    read = list(warc.parse(raw))
    assert len(read) == 702 and sum(n for _, n, _, _ in read) == len(raw) and read[4][3] == ("<p>page 3é</p>" * 3).encode()
    empty = pages.limit(0)
    assert warc.audited(empty, warc.damaged(empty)).count() == 0


def test_records_that_share_a_page_id(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (1, "u", "<p>c</p>"), (None, "u", "<p>d</p>"), (None, "v", "<p>e</p>"), (2, "u", "<p>f</p>"), (2, "u", "<p>f</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = pages.select("page_id", "html", F.sha2(warc.record(F.col("page_id"), F.col("url"), F.col("html")).cast("binary"), 256).alias("sha"))
    status = lambda replica: sorted((r["html"], r["status"]) for r in warc.audited(pages, replica.select("page_id", "sha")).join(whole.select("sha", "html").distinct(), "sha").collect())
    ok = [(h, "ok") for _, _, h in rows]
    assert status(whole) == sorted(ok)
    assert status(whole.where("html <> '<p>b</p>'")) == sorted([x for x in ok if "b" not in x[0]] + [("<p>b</p>", "missing")])
    changed = whole.withColumn("sha", F.when(F.col("html").isin("<p>b</p>", "<p>d</p>"), F.lit("0" * 64)).otherwise(F.col("sha")))
    assert status(changed) == sorted([x for x in ok if x[0] not in ("<p>b</p>", "<p>d</p>")] + [("<p>b</p>", "changed"), ("<p>d</p>", "changed")])


def test_audit_of_two_catalogs_finds_what_either_lacks(spark):
    at = [(f"{i % 3:x}", 100 * i, 90, f"{i:064x}") for i in range(300)]
    first = spark.createDataFrame(at, "archive string, at long, length long, sha string")
    other = [r for r in at if r[1] != 4200] + [("1", 50, 40, "f" * 64)]
    other = [(a, b, c, "e" * 64 if b == 900 else s) for a, b, c, s in other]
    second = spark.createDataFrame(other, "archive string, at long, length long, sha string")
    assert sorted(map(tuple, warc.audit(first, second).collect())) == [("0", 900, "changed"), ("0", 4200, "missing"), ("1", 50, "extra")]
    assert warc.audit(first, first).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    raw = [r[0].encode() for r in pages.select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("file", "at").collect()
    assert [(r["uri"], bytes(r["payload"])) for r in got] == 2 * [("http://a/", b"<p>x</p>"), (None, b"")]


def test_folders_are_shared(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_graph_recall_of_a_shard_of_full_size():
    """One shard as op6 builds it: 8,192 random vectors of 64 components, where nothing is easy to find."""
    rng = np.random.default_rng(40)
    x = rng.normal(size=(8192, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x.astype(np.float32)
    p = graph_ann.GraphParams()
    edges, entry = graph_ann.build_graph(x, p)
    q = x[::50]
    nodes, _, _ = graph_ann.beam_search(x, edges, entry, q, p.beam_search, p.wide)
    far = q @ x.T
    far[np.arange(len(q)), np.arange(0, 8192, 50)] = -2
    want = np.argsort(-far, axis=1)[:, :5]
    found = [set(n[n >= 0].tolist()) for n in nodes]
    recall = np.mean([len(set(w.tolist()) & f) / 5 for w, f in zip(want, found)])
    assert recall >= 0.95, recall
