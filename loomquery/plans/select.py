"""Choosing the tables that a question is about, by words and, if given, by vectors."""

from __future__ import annotations

import re

from loomquery.sources.catalog import Catalog

STOP = set("a an the of in on for to and or by with from is are was were what which how many much show list give me all each per total number count average sum than more less have has do does did their its top most least".split())
#: Points: the whole name, its core word, a word of it, a column; confident from LEAST and MARGIN times the next.
EXACT, CORE, WORD, COLUMN, MOST_COLUMNS, LEAST, MARGIN = 30.0, 25.0, 12.0, 3.0, 12.0, 20.0, 1.5


def words(text: str) -> list[str]:
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return [w for w in re.findall(r"[a-z0-9]+", split.lower())]


def single(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith("es") and word[:-2].endswith(("s", "x", "ch", "sh")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def scores(question: str, catalog: Catalog) -> dict[str, float]:
    asked = [single(w) for w in words(question) if w not in STOP]
    joined = " ".join(single(w) for w in words(question))
    out = {}
    for t in catalog.items.values():
        name = [single(w) for w in words(t.name.replace("_", " "))]
        total = 0.0
        if " ".join(name) in joined.split("  ")[0] and set(name) <= set(asked):
            total += EXACT
        elif name and name[-1] in asked:
            total += CORE
        total += WORD * sum(w in asked for w in name)
        held = {single(w) for c in t.df.columns for w in words(c.replace("_", " ")) if len(w) > 2}
        total += min(MOST_COLUMNS, COLUMN * sum(w in held for w in set(asked)))
        out[t.name] = total
    return out


def select(question: str, catalog: Catalog, vector_hits: dict[str, float] | None = None, most: int = 5) -> tuple[list[str], bool]:
    """Tables by falling score, at most so many, and whether the first is certain. Vectors add to what words have found, or speak alone when strong."""
    total = scores(question, catalog)
    for t, v in (vector_hits or {}).items():
        if t in total and (total[t] > 0 or v * 100 >= 25):
            total[t] += min(10.0, 0.4 * v * 100)
    ranked = sorted((t for t in total if total[t] > 0), key=lambda t: (-total[t], t))[:most]
    sure = bool(ranked) and total[ranked[0]] >= LEAST and (len(ranked) == 1 or total[ranked[0]] >= MARGIN * total[ranked[1]])
    return ranked, sure
