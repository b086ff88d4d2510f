"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is read into blocks of text. A linear classifier gives each a cost for either label; these are its
capacities to the two terminals. Blocks that follow one another, and blocks that share a container, are tied by
smoothness edges, stronger the nearer they stand in the DOM. The minimum cut, found by maximum flow, parts the article
from the boilerplate: it settles blocks of which the classifier is not sure, like a one-word paragraph between two of prose,
or a sentence among links.

The classifier adds two things: what the block's text looks like, and where it stands. How much a text's looks count is
learned from the pages: blocks in article or main elements, and blocks in navigation, footers, forms and the like,
are examples of the two labels; a logistic fit of TEXT_PRIOR strength around fixed weights tells them apart by their texts
alone. What elements and class names count is fixed; a class name by itself never outweighs an article's
prose and neighbours unless it says plainly what the block is (STRONG).
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values, in logits of being article text. Of the text's looks these are where learning starts.
TEXT = {"base": -0.5, "words": 0.5, "links": -5.0, "sentence": 0.5, "p": 1.0, "heading": 0.7, "item": -0.7, "legal": -2.0}
PLACE = {"article": 4.0, "body": 2.0, "boiler": -10.0, "strong": -10.0, "weak": -2.0}
#: The most that a text's looks count, the strength of TEXT against examples, and the pages that examples are taken from, about.
TEXT_MOST, TEXT_PRIOR, SAMPLE_PAGES = 2.5, 50.0, 4000
NEAR, SIBLING, SCALE = 3.0, 0.8, 1000
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr output progress q ruby rb rp rt rtc s samp small span strike strong sub sup svg time tt u var wbr path g picture source".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER = set("nav footer aside form menu dialog head button select option fieldset datalist object audio video canvas svg math".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Parts of class names and ids. STRONG and COMMENTS say what a block is; WEAK ones may also name what an article is about.
STRONG = set("ad ads adv advert advertisement adverts advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notification notifications popup popover modal overlay nav navbar navigation menu menus submenu sidebar sidebars aside footer foot masthead topbar toolbar breadcrumb breadcrumbs crumbs share sharing related recommended recommendations newsletter subscribe subscription signup login searchbox widget widgets pagination pager tagcloud copyright skip hidden sr outbrain taboola paywall".split())
COMMENTS = set("comment comments commentlist commenting respond reply replies disqus".split())
WEAK = set("notice notices alert alerts social search tags legal disclaimer discussion reviews feedback".split())
# Parts of class names that say where or how a block stands, not what it is.
NEUTRAL = set("site page main top bottom left right block box bar container wrapper wrap inner outer list item items section area group row col column panel unit slot module component global local primary secondary js is has the".split())
BODY_HINTS = set("article content post entry story body text main maincontent articlebody".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption details".split())
PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDS = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
LEGAL = re.compile(r"^\W*©|^\W*copyright\b|\ball rights reserved\b", re.I)


class _Open:
    __slots__ = ("name", "boiler", "strong", "weak", "article", "body", "parent", "depth", "up")

    def __init__(self, name: str, up: "_Open | None") -> None:
        self.name, self.up, self.depth = name, up, up.depth + 1 if up else 0
        self.boiler, self.strong, self.weak, self.article, self.body = (up.boiler, up.strong, up.weak, up.article, up.body) if up else (0, 0, 0, 0, 0)


def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether the names in a class or id are strong signs of boilerplate, weak ones, or signs of an article's body. A name of which only a part is a sign ("social-policy") is a weak one."""
    strong = weak = body = False
    for name in value.split():
        parts = {w.rstrip("0123456789") for w in re.split(r"[^a-z0-9]+", CAMEL.sub(" ", name).lower())} - {""}
        signs = parts & (STRONG | COMMENTS)
        if signs and (parts - NEUTRAL <= STRONG | COMMENTS | WEAK or parts & COMMENTS):
            strong = True
        elif signs or parts & WEAK:
            weak = True
        elif parts & BODY_HINTS:
            body = True
    return strong, weak, body


def _judge(node: _Open, attrs: str) -> None:
    """Counts the element's own signs on top of its parent's."""
    name = node.name
    if name in ("html", "body"):
        return
    outer, strong, weak, body, comments, header = name in ("article", "main"), False, False, False, False, False
    if name in BOILER or name == "header" and not node.article:
        node.boiler += 1
    if attrs and attrs.strip(" /"):
        for key, a, b, c in ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                found = _named(value)
                strong, weak, body = strong or found[0], weak or found[1], body or found[2]
                words = set(re.split(r"[^a-z0-9]+", CAMEL.sub(" ", value).lower()))
                comments, header = comments or bool(words & COMMENTS), header or "header" in words
            elif key == "role":
                node.boiler += value.strip().lower() in ROLES
                node.article += value.strip().lower() in ("main", "article")
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
                node.boiler += 1
        if re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(ATTR, " ", attrs)):
            node.boiler += 1
        if comments or strong and not outer or header and not node.article and not outer:
            node.strong += 1
        elif weak and not outer:
            node.weak += 1
        elif body:
            node.body += 1
    if outer and not comments:
        node.article += 1


def blocks(page: str) -> list[tuple[str, float, _Open]]:
    """(text, share of linked characters, innermost open block element) of each block, in page order."""
    found: list[tuple[str, float, _Open]] = []
    node = _Open("", None)
    parts: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((text, min(1.0, linked / len(text)), node))
            parts.clear()
        linked = 0

    while at < n:
        m = MARK.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name == "br" or name in INLINE:
                if name == "br":
                    parts.append(" ")
                if name not in ("svg", "math"):
                    continue
            flush()
            up = node
            while up.up and up.name != name:
                up = up.up
            if up.up:  # it was open: all within it ends too
                node = up.up
                in_link = 0 if name not in INLINE else in_link
            continue
        if name in RAW and not (m[3] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            if name != "title":
                parts.append(" ")
            continue
        if name == "a":
            in_link += 1
        if name in VOID or name in INLINE:
            if name == "hr":
                flush()
            elif name in ("br", "img", "input", "wbr"):
                parts.append(" " if name != "wbr" else "")
            hidden = name not in VOID and m[3] and ("class" in m[3] or "style" in m[3] or "hidden" in m[3]) and name in ("span", "svg", "label")
            if not hidden:
                continue
            probe = _Open(name, node)
            _judge(probe, m[3])
            if (probe.boiler, probe.strong) == (node.boiler, node.strong):
                continue
            # An inline element that is an aside of its own: a block apart.
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            flush()
            node, back = probe, node
            parts.append(re.sub(r"<[^>]*>", "", page[at : end.start()]))
            flush()
            node, at = back, end.end()
            continue
        flush()
        if name in CLOSES_P and node.name == "p":
            node = node.up
        if name in PEERS:
            same, stop = PEERS[name]
            up = node
            while up.up and up.name not in stop and up.name not in same:
                up = up.up
            if up.name in same:
                node = up.up
        node = _Open(name, node)
        _judge(node, m[3] or "")
        in_link = 0 if name in CLOSES_P else in_link
    flush()
    return found


def _far(a: _Open, b: _Open) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def looks(text: str, links: float, node: _Open) -> tuple[float, ...]:
    """What TEXT weighs, in coarse steps, so that examples of a kind can be counted."""
    name = node.name
    return (
        1.0, round(4 * min(len(text.split()), 5000) ** 0.25) / 4, round(10 * links) / 10, float(bool(ENDS.search(text[-8:]))), float(name == "p"), float(name in HEADINGS),
        float(name in ("li", "td", "th", "dt")), float(len(text) < 300 and bool(LEGAL.search(text))),
    )


def example(node: _Open) -> int | None:
    """1 for a block that stands in an article without any sign against it, 0 for one in an element of boilerplate, else None."""
    if node.boiler and not node.article:
        return 0
    return 1 if node.article and not (node.boiler or node.strong or node.weak) else None


def learn(seen: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of looks: a logistic fit to counted examples, both labels weighed alike, held to TEXT by TEXT_PRIOR. Without examples of both: TEXT."""
    start = np.array(list(TEXT.values()))
    if len(set(label.tolist())) < 2:
        return start
    n = np.array([count[label == k].sum() for k in (0, 1)], float)
    weight, w = count * (n.sum() / (2 * n[label])), start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(seen @ w, -35, 35)))
        slope = seen.T @ (weight * (p - label)) + TEXT_PRIOR * (w - start)
        step = np.linalg.solve((seen.T * (weight * p * (1 - p))) @ seen + TEXT_PRIOR * np.eye(len(w)), slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(text: str, links: float, node: _Open, weights: np.ndarray | None = None) -> float:
    w = list(TEXT.values()) if weights is None else weights
    seen = looks(text, links, node)
    if node.article:
        seen = (*seen[:7], 0.0)  # an article may speak of rights
    total = max(-TEXT_MOST, min(TEXT_MOST, float(sum(a * b for a, b in zip(seen, w)))))
    total += PLACE["boiler"] * min(2, node.boiler) + PLACE["strong"] * min(2, node.strong) + PLACE["weak"] * min(2, node.weak)
    return total + PLACE["article"] * bool(node.article) + PLACE["body"] * (bool(node.body) and not (node.boiler or node.strong))


def min_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut. excess: capacity from the source less that to the sink; edges: (a, b, capacity both ways).

    A node whose excess outweighs all its edges takes its own side in any minimum cut; it is settled first and its
    edges become excess of its neighbours. What is left goes to a maximum flow by shortest augmenting levels.
    """
    n = len(excess)
    excess = list(excess)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    tied = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(excess[i]) >= tied[i]]
    while todo:
        i = todo.pop()
        if side[i] is not None:
            continue
        side[i] = excess[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                tied[j] -= c
                excess[j] += c if side[i] else -c
                del near[j][i]
                if abs(excess[j]) >= tied[j]:
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(s) for s in side]
    source, sink = n, n + 1
    flow: dict[int, dict[int, int]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if excess[i] > 0:
            flow[source][i], flow[i][source] = excess[i], 0
        elif excess[i] < 0:
            flow[i][sink], flow[sink][i] = -excess[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in flow[a].items():
                if c > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [i in level if side[i] is None else bool(side[i]) for i in range(n)]
        left = {a: iter(list(flow[a])) for a in level}
        path = [source]
        while path:  # a blocking flow, without recursion
            a = path[-1]
            if a == sink:
                least = min(flow[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    flow[x][y] -= least
                    flow[y][x] = flow[y].get(x, 0) + least
                cut = next(k for k, (x, y) in enumerate(zip(path, path[1:])) if flow[x][y] == 0)
                left_over = path[cut]
                path = path[: cut + 1]
                left[left_over] = iter(list(flow[left_over]))
                continue
            for b in left[a]:
                if flow[a][b] > 0 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                level[a] = -1
                path.pop()


def labelled(page: str | None, weights: np.ndarray | None = None, near: float = NEAR, sibling: float = SIBLING) -> tuple[list[str], list[bool], list[bool]]:
    """The blocks of a whole page, which of them the classifier alone would keep, and which the minimum cut keeps."""
    found = blocks(page or "")
    excess = [round(SCALE * logit(*b, weights)) for b in found]
    edges = [(i, i + 1, round(SCALE * near / max(1, _far(found[i][2], found[i + 1][2])))) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, _, node) in enumerate(found):
        container = id(node.up)
        if container in last and last[container] < i - 1:
            edges.append((last[container], i, round(SCALE * sibling)))
        last[container] = i
    return [b[0] for b in found], [x > 0 for x in excess], min_cut(excess, edges) if found else []


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """The article of a whole page: its blocks' texts joined by line feeds; empty for null, empty and all-boilerplate pages."""
    texts, _, keep = labelled(page, weights)
    return "\n".join(t for t, k in zip(texts, keep) if k)


def learned(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """The weights of looks, from about so many pages (those whose ids hash least); examples are counted by kind, so few rows are fitted at any size. Null and empty pages are no examples."""
    kinds = list(TEXT)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*looks(*b), label) for page in batch["html"] for b in blocks(page or "") if (label := example(b[2])) is not None]
            yield pd.DataFrame(rows, columns=[*kinds, "label"])

    share = min(1.0, sample_pages / max(1, pages.count()))
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("html")
    counted = some.mapInPandas(count, ", ".join(f"{k} double" for k in kinds) + ", label int").groupBy(*kinds, "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    fit = lambda rows: pd.DataFrame({"w": [learn(rows[kinds].to_numpy(float), rows["label"].to_numpy(), rows["n"].to_numpy())]})
    made = materialize(counted.groupBy().applyInPandas(lambda rows: fit(rows.sort_values([*kinds, "label"])), "w array<double>"), "html-weights").first()
    return np.array(made["w"] if made else list(TEXT.values()))


def extracted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Per row of pages: page_id, url, text (the main text of the whole html), n_chars, its code points, n_blocks, and n_changed, how many of them the cut labels otherwise than the classifier alone.

    Null html counts as empty; repeated rows are read each; extra columns are ignored. An empty table gives no rows.
    """
    weights = learned(pages, sample_pages)

    @F.pandas_udf("text string, n_blocks long, n_changed long")
    def read(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            texts, alone, keep = labelled(page, weights)
            rows.append(("\n".join(t for t, k in zip(texts, keep) if k), len(texts), sum(a != k for a, k in zip(alone, keep))))
        return pd.DataFrame(rows, columns=["text", "n_blocks", "n_changed"])

    held = pages.select("page_id", "url", read("html").alias("s"))
    return held.select("page_id", "url", "s.text", F.char_length("s.text").cast("long").alias("n_chars"), "s.n_blocks", "s.n_changed")
