"""Whole texts to token ids with the tokenizers library, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np

#: Words that a worker remembers, each of at most CACHED_BYTES; the cache is emptied when full.
CACHE_WORDS = 600_000
CACHED_BYTES = 48
#: ASCII characters that form no token with what stands before them in a word.
TAIL = b".,;:!?*#$%&"
#: Words of letters alone, ASCII or of Latin-1. Each is one piece to the tokenizer's model, in lower case, as no normalization but that reaches them.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LATIN_1 = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: Bytes of text whose words are looked up together, a word of the cache, and at most: words met again in a part are still near by then.
PART_BYTES, MOST_BYTES = 3.5, 250_000
#: Words encoded in one call of the library, which takes some 2 kB a word meanwhile.
CALL_WORDS = 2_000


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space and never joins what it separates.

    Between two runs of ASCII white space nothing of the tokenizer's normalization, splitting or merging
    reaches across, so a text's ids are its words' ids in order, and repeated words are encoded once.
    A text with only ASCII characters is lower-cased first (the tokenizer does so itself), unless it may
    hold a special token. Words of letters alone go to the tokenizer's model as they are (whole_words). exact() says whether the file is of this kind; others are encoded text by text.
    words bounds the cache (some 200 bytes a word): a smaller one takes more time, the ids are the same.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self.exact(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        self.words = words
        self.known: dict[bytes, bytes] = {}
        self.model, self.letters = self.tokenizer.model, LETTERS.fullmatch
        if not self.by_word or not self.whole_words(spec):
            self.letters = lambda word: None

    @staticmethod
    def exact(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        names = [s.get("type") for s in steps]
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        joined = any(" " in t["content"] for t in spec.get("added_tokens") or ())
        return drops and "Lowercase" in names and set(names) <= {"NFC", "Replace", "Lowercase"} and not joined

    def whole_words(self, spec: dict) -> bool:
        """True if the tokenizer takes a word of LETTERS for one piece, written byte by byte. Fills in how the bytes of LATIN_1 are written."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        runs = len(steps) == 2 and "|[\\p{L}]+|" in str((steps[0].get("pattern") or {}).get("Regex"))
        if not (runs and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and spec["model"]["type"] == "BPE"):
            return False
        from tokenizers.pre_tokenizers import ByteLevel

        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): plain.pre_tokenize_str(c)[0][0] for c in LATIN_1}
        return True

    def _word(self, word: bytes) -> bytes:
        """The ids of a word of LETTERS in lower case, without the library's way through normalization and splitting."""
        text = word.decode("ascii") if word.isascii() else word.decode().translate(self.written)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL_WORDS):
            part = [w.decode("utf-8", "replace") for w in words[at : at + CALL_WORDS]]
            out += [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Adds these words to the known ones. After an ASCII letter or digit, a run of TAIL characters at a word's end is a token run of its own (after one of LETTERS too), so "word," is "word" and ","."""
        known, letters = self.known, self.letters
        cut = {w: c for w in words if 0 < len(c := w.rstrip(TAIL)) < len(w) and (c[-1:].isalnum() or letters(c))}
        # Capitals in a text that has other characters too.
        low = {}
        for c in words.difference(cut).union(cut.values()):
            if c.isascii():
                if not c.islower() and b"<|" not in c:
                    low[c] = c.lower()
            elif letters(c) and (lower := c.decode().lower().encode()) != c:
                low[c] = lower
        plain = {low.get(c, c) for c in words.difference(cut).union(cut.values())}.union(w[len(c) :] for w, c in cut.items()).difference(known)
        others = []
        for c in plain:
            if letters(c):
                known[c] = self._word(c)
            else:
                others.append(c)
        known.update(zip(others, self._encode(others)))
        for w, c in low.items():
            known[w] = known[c]
        for w, c in cut.items():
            known[w] = known[c] + known[w[len(c) :]]

    def batch(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each UTF-8 text as unsigned 32-bit numbers; none for null."""
        if not self.by_word:
            for t in texts:
                yield np.frombuffer(self._encode([t or b""])[0], np.uint32)
            return
        known = self.known
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < min(PART_BYTES * self.words, MOST_BYTES):
                text = texts[at] or b""
                if text.isascii() and b"<|" not in text and not any(s in text for s in self.special):
                    text = text.lower()
                split.append(text.split())
                size += len(text)
                at += 1
            if len(known) > self.words:
                known.clear()
            new: set[bytes] = set()
            for words in split:
                new.update(filterfalse(known.__contains__, words))
            if new:
                self._learn(new)
            for words in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)
            for w in [w for w in new if len(w) > CACHED_BYTES]:
                del known[w]


@cache
def encoder(path: str, words: int = CACHE_WORDS) -> WordEncoder:
    """One a process: workers are used again, and so are their caches."""
    return WordEncoder(path, words)
