"""Words of letters alone go to the tokenizer's model; their ids are those of the whole library."""

import random

from loomquery.llm.queries import word_tokenizer
from loomquery.llm.tokens import LATIN_1, WordEncoder


def test_words_of_letters_do_not_pass_through_the_whole_library():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(word_tokenizer()), random.Random(5)
    encoder = WordEncoder(word_tokenizer())
    given, through = [], encoder._encode
    encoder._encode = lambda words: given.extend(words) or through(words)
    words = ["".join(rng.choices("abcxyzABCXYZ" + LATIN_1, k=rng.randint(1, 9))) for _ in range(2000)] + [c * n for c in LATIN_1 for n in (1, 2)]
    texts = [" ".join(words), " ".join(w + rng.choice(".,!?;") for w in words), "Plain words, lower-cased."]
    assert [x.tolist() for x in encoder.batch([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(w) < 3 or not w.decode().isalpha() for w in given)
    mixed = ["".join(rng.choices("aZ" + LATIN_1 + "0'9.,!×÷İªµ́ā<|>", k=rng.randint(1, 9))) for _ in range(2000)]
    assert next(encoder.batch([" ".join(mixed).encode()])).tolist() == plain.encode(" ".join(mixed), add_special_tokens=False).ids
