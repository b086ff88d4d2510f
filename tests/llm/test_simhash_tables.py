"""The near-dedup stage's candidates: SimHash fingerprints and the trie join against plain versions."""

import numpy as np
import pandas as pd

from loomquery.llm import simhash


def test_all_pairs_of_the_trie_join():
    rng = np.random.default_rng(21)
    seeds = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = np.sort(np.array([s ^ np.uint64(sum(1 << int(b) for b in rng.choice(56, rng.integers(0, 12), replace=False))) for s in seeds for _ in range(15)], np.uint64))
    i, j = simhash.trie_join(values, None, 17, 8, pairs=True)
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if values[a] >> np.uint64(56) == values[b] >> np.uint64(56) and int(values[a] ^ values[b]).bit_count() <= 17}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 500 and len(i) == len(want)


def test_long_fingerprints_differ_by_the_angle_of_the_sets():
    rng = np.random.default_rng(22)
    for common, own in ((8, 1), (40, 5), (720, 90)):  # similarity 0.8
        apart = []
        for _ in range(40):
            x = rng.integers(0, 2**64, common + 2 * own, dtype=np.uint64)
            a, b = (simhash.long_fingerprint(np.sort(s)) for s in (x[: common + own], np.concatenate([x[:common], x[common + own :]])))
            apart.append(int(np.bitwise_count(a ^ b).sum()))
        assert abs(np.mean(apart) / simhash.POOL - simhash.APART) < 0.02 and max(apart) <= simhash.FAR


def test_candidates_of_a_bucket_are_all_pairs_of_its_trie_join():
    rng = np.random.default_rng(23)
    head, _, k = simhash.tables_for(1000)
    value = np.concatenate([rng.integers(0, 2**64, 400, dtype=np.uint64), np.uint64(7) << np.uint64(56) | np.arange(100, dtype=np.uint64)])  # a crowd
    item = rng.permutation(len(value))
    got = simhash._meet(pd.DataFrame({"bucket": 30, "item": item, "value": value.view(np.int64)}), head, k, 1)
    pairs, crowd = got[got["band"] < 0], got[got["band"] >= 0]
    near = {tuple(sorted((int(item[a]), int(item[b])))) for a in range(len(value)) for b in range(a) if value[a] >> np.uint64(64 - head) == value[b] >> np.uint64(64 - head) and int(value[a] ^ value[b]).bit_count() <= k}
    held = {b: set(g["a"]) for b, g in crowd.groupby("band")}
    assert set(item[400:]) <= next(iter(held.values()))
    found = set(zip(pairs["a"], pairs["b"]))
    assert found <= near and all(p in found or any(set(p) <= h for h in held.values()) for p in near)


def test_bands_of_a_crowd_grow_with_its_items_not_their_pairs():
    rng = np.random.default_rng(24)
    head, k = 8, 17
    for n in (8, 16, 32):  # ten groups of so many, each under a head of its own
        value = np.concatenate([np.uint64(g + 1) << np.uint64(56) | np.arange(n, dtype=np.uint64) for g in range(10)])
        item = rng.permutation(len(value))
        group = pd.DataFrame({"bucket": 30, "item": item, "value": value.view(np.int64)})
        got = simhash._meet(group, head, k, 1)
        assert len(got) == 10 * n and got["band"].nunique() == 10
        alone = simhash._meet(group.assign(label=value.view(np.int64) >> 56), head, k, 1)  # all of a band are one group already
        assert len(alone) == 0


def test_links_of_a_band_span_its_near_pairs_alone():
    rng = np.random.default_rng(25)
    seeds = rng.integers(0, 2**64, (6, simhash.POOL // 64), dtype=np.uint64)
    bits = [(s ^ rng.integers(0, 2, len(s)).astype(np.uint64)).tobytes() for s in seeds for _ in range(5)]
    size = [100, 100, 100, 100, 10] * 6  # the last of each is of another size
    got = simhash._close(pd.DataFrame({"item": range(30), "band": 7, "size": size, "bits": bits}))
    up = list(range(30))
    for a, b in zip(got["a"], got["b"]):
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert up == [i if size[i] == 10 else i - i % 5 for i in range(30)] and len(got) == 18
