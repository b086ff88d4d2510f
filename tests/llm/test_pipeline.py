"""The pipeline over a small fixture, stage by stage."""

from pathlib import Path

import corpus_pipeline
from loomquery.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = table(spark, DATA, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test")
        if name != "packing":
            assert docs.columns == first.columns
        if name in ("quality_classifier", "simhash_near_dedup"):
            assert docs.count() <= before and docs.select("doc_id").distinct().count() == docs.count()
        before = docs.count()
    rows = docs.collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert rows and all(n <= 4096 for n in used.values())
    assert corpus_pipeline.run(spark, DATA).columns == docs.columns


CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, item long, label int, score double, mix_order int"


def odd_rows():
    words = " ".join(f"w{i}" for i in range(90))
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(30)) for i in range(4))
    rows = [(1, words, "a"), (1, words, "a"), (2, None, None), (None, "plain words of a text without an id", "a"), (None, words + " more", "b"), (3, "", "b"), (4, "long " * 30_000, None), (5, f"one\n{passage}", "a"), (6, f"two\n{passage}\nend", ""), (7, " \t\n", "b")]
    return [(i, t, "en", s, len(t) if t is not None else None, 7, 7, "k", 7, 7, 7.0, 7) for i, t, s in rows]


def plain_run(spark, docs):
    """The stages one after another, each on what the one before it has written."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], DATA), "test"))
    return out


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), CLASH)
    stages = plain_run(spark, docs)
    for made in stages[:5]:
        assert made.columns[:4] == docs.columns[:4] and set(made.columns) >= set(docs.columns) - {"mix_order"}
    kept, cut, near, mixed, packed = (s.collect() for s in stages[1:])
    assert len(cut) == len(kept) <= len(odd_rows())
    texts = [r["text"] for r in near]
    assert len(near) < len(cut) and sum(t is not None and t.startswith("w0 w1") for t in texts) <= 1  # the copies of one text are one
    assert sum("p2x3" in (t or "") for t in (r["text"] for r in cut)) <= 1  # the passage stands once
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in near}
    pieces = {}
    for r in packed:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    assert sum(pieces.values()) >= len(mixed)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], CLASH)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        assert made.count() == 0
        docs = made if name != "packing" else docs


def test_a_run_leaves_only_what_its_result_reads(spark, tmp_path):
    from loomquery.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "llm"
    before = {p.name for p in folder.glob("tables/stage-*")} | {p.name for p in folder.glob("scratch-*")}
    made = corpus_pipeline.run(spark, DATA)
    left = {p.name for p in folder.glob("tables/stage-*")} | {p.name for p in folder.glob("scratch-*")}
    assert {x.split("-")[1] for x in left - before} == {"source_mixing"}
    assert made.count() > 0


def test_near_copies_of_the_given_documents(spark):
    """On the table itself, in two of its languages: no pair at 0.8 or more is left, and none of what goes was without one."""
    from loomquery.llm import simhash

    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang in ('de', 'es')").select("doc_id", "text")
    rows = {r["doc_id"]: frozenset(simhash.shingle_set(r["text"]).tolist()) for r in docs.collect()}
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    by = {}
    for i, s in rows.items():
        for x in s:
            by.setdefault(x, []).append(i)
    near = {}
    for i, s in rows.items():
        met = {}
        for x in s:
            for j in by[x]:
                met[j] = met.get(j, 0) + 1
        near[i] = {j for j, n in met.items() if j != i and 5 * n >= 4 * (len(s) + len(rows[j]) - n)}
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, others in near.items():
        for j in others:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    empty = sorted(i for i, s in rows.items() if not s)
    want = {root(i) for i, s in rows.items() if s} | set(empty[:1])
    assert kept == want and len(want) < len(rows)
