"""Main text: whole pages with their articles, what the minimum cut decides, and what is learned."""

import numpy as np
import pytest

from loomquery.llm import htmlcut

LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul>"
PROSE = ["The river rose in the night, and by morning the lower town stood under water.", "Nobody was hurt, the mayor said, as most had left the day before.", "It is the third flood in four years; a fourth dam is to be built."]
P = "".join(f"<p>{x}</p>" for x in PROSE)
TEXT = "\n".join(PROSE)

PAGES = {
    "article element": (f"<body><nav>{LINKS}</nav><div class=ad>Buy the best boots in town, today only.</div><article><h1>Flood</h1>{P}</article><footer>&copy; The paper. All rights reserved.</footer></body>", "Flood\n" + TEXT),
    "no article element": (f"<div id='header'>The Paper</div><div class='menu'>{LINKS}</div><div class='post-content'>{P}</div><div id=footer>Printed by the press of the town.</div>", TEXT),
    "only paragraphs": (f"{LINKS}{P}<div class='copyright'>Copyright the press</div>", TEXT),
    "role and header": (f"<div role=banner>The Paper, a daily.</div><div role=main><header><h1>Flood</h1></header>{P}</div><div role=contentinfo>Write to us, we answer.</div>", "Flood\n" + TEXT),
    "social policy": (f"<article>{P}<div class='social-policy'><p>On social policy the council was split.</p></div></article>", TEXT + "\nOn social policy the council was split."),
    "reviews in an article": ("<article><section class='reviews'><p>The first film is a slow one, but worth the wait.</p></section></article>", "The first film is a slow one, but worth the wait."),
    "a notice that is quoted": (f"<article>{P}<blockquote class='notice'><p>All boats are to stay in the harbour.</p></blockquote></article>", TEXT + "\nAll boats are to stay in the harbour."),
    "adverts within": (f"<article><p>{PROSE[0]}</p><div class='ad'>Buy the best boots in town, today only.</div><p>{PROSE[1]}</p><div class='related-links'>{LINKS}</div><p>{PROSE[2]}</p></article>", TEXT),
    "comments": (f"<article>{P}<section id='comments'><article class='comment'><p>I was there, it was as you say.</p></article></section></article>", TEXT),
    "comments beside": (f"<main>{P}</main><div class='comment-list'><p>I was there, it was as you say, and more.</p></div>", TEXT),
    "forms and notices": (f"<div class='cookie-notice'>We use cookies, as all do. Is that fine?</div><main>{P}<form><label>Your mail, so that we may write.</label><input></form></main><aside><p>Also read: the dam that never was.</p></aside>", TEXT),
    "hidden": (f"<article>{P}<p style='display:none'>You should not see this, ever.</p><p hidden>Nor this one, we think.</p></article>", TEXT),
    "lists and tables": (f"<article>{P}<ul><li>Boats: 14</li><li>Houses: 220</li></ul><table><tr><td>Dam</td><td>4th</td></tr></table></article>", TEXT + "\nBoats: 14\nHouses: 220\nDam\n4th"),
    "inline markup": ("<article><p>A <b>b</b>o<i>l</i>d <a href=x>step</a>,<br>they&nbsp;said &amp; did &#233;.</p></article>", "A bold step, they said & did é."),
    "unclosed": ("<article><h1>A<p>One.<p>Two<br><p>Three.</article><footer>x", "A\nOne.\nTwo\nThree."),
    "scripts": ("<article><script>if (a</p>b) '<p>no</p>'</script><p>One.</p><style>p{}</style><noscript><p>Turn it on.</p></noscript></article>", "One."),
}


@pytest.mark.parametrize("name", PAGES)
def test_articles_of_whole_pages(name):
    page, text = PAGES[name]
    assert htmlcut.main_text(page) == text


def test_the_cut_decides_what_the_classifier_alone_does_not():
    a, b = PROSE[:2]
    cases = [
        (f"<p>{a}</p><div>Why</div><p>{b}</p>", [True, True, True]),  # one word between two paragraphs
        ("<div><a href=x>One link</a></div><div>Read it now.</div><div><a href=x>Other links</a></div>", [False, False, False]),  # a sentence among links
        (f"<div><div>{a}</div><div>{b}</div><div>More</div><div>{a}</div></div>", [True, True, True, True]),
    ]
    for page, want in cases:
        _, alone, keep = htmlcut.labelled(page)
        assert keep == want and alone != want
        _, alone, keep = htmlcut.labelled(page, near=0, sibling=0)
        assert keep == alone != want


def test_what_texts_look_like_is_learned():
    pages = [f"<nav>{LINKS}</nav><article><h2>Flood</h2>" + "".join(f"<div>{x}</div>" for x in PROSE) + "</article><footer>Imprint of the press</footer>"] * 400
    counted = {}
    for page in pages:
        for block in htmlcut.blocks(page):
            if (label := htmlcut.example(block[2])) is not None:
                key = (*htmlcut.looks(*block), label)
                counted[key] = counted.get(key, 0) + 1
    keys = np.array(list(counted))
    w = htmlcut.learn(keys[:, :-1], keys[:, -1].astype(int), np.array(list(counted.values()), float))
    assert w[2] < htmlcut.TEXT["links"] + 1 and w[3] > htmlcut.TEXT["sentence"]
    right = sum(((key[:-1] @ w > 0) == key[-1]) * n for key, n in zip(keys, counted.values()))
    assert right >= 0.95 * sum(counted.values())
    nothing = htmlcut.learn(np.zeros((0, 8)), np.zeros(0, int), np.zeros(0))
    assert nothing.tolist() == list(htmlcut.TEXT.values())


def test_pages_in_spark(spark):
    rows = [(i, f"http://h/{i}", page, 3) for i, (page, _) in enumerate(PAGES.values())] * 2 + [(None, None, None, 3)]
    got = htmlcut.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r["page_id"] is None else list(PAGES.values())[r["page_id"]][1]
        assert (r["text"], r["n_chars"]) == (want, len(want)) and r["n_changed"] <= r["n_blocks"]
    assert htmlcut.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
