"""The tokenizer's cache: fewer words, the same ids."""

import numpy as np

from loomquery.llm.queries import word_tokenizer
from loomquery.llm.tokens import WordEncoder


def test_a_small_cache_gives_the_same_ids_and_stays_small():
    rng = np.random.default_rng(31)
    texts = [" ".join(f"Wort{x}, käse{x % 7}." for x in rng.integers(0, 3000, 60)).encode() for _ in range(120)]
    small, whole = WordEncoder(word_tokenizer(), 200), WordEncoder(word_tokenizer())
    most = 0
    for at in range(0, 120, 10):
        for a, b in zip(small.batch(texts[at : at + 10]), whole.batch(texts[at : at + 10])):
            assert np.array_equal(a, b)
        most = max(most, len(small.known))
    assert most < 1200 < len(whole.known)
