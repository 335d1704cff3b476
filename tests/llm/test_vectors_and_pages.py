"""Embedding near-duplicates, main-text extraction and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, html_main, simhash, toxicity, vectors

DATA = "/root/testdata/sf0.001"


def brute_links(x: np.ndarray, ids: list[int]) -> dict[int, tuple[int, int]]:
    n = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    for i in range(120):  # a crowded place, and chains
        x[i] = x[0] + 0.05 * rng.normal(size=16)
    for i in range(200, 260):
        x[i] = x[i - 1] + 0.25 * rng.normal(size=16)
    x[300:340] = x[299]
    ids = rng.permutation(5000)[:500].tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [1.0, None]), (9006, [1.0, 2.0]), (9007, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rep", "n", "vec", "links", "shard", "component")})
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    want = brute_links(x, ids)
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeated_and_missing_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 2), (1, 2), (2, 2)]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 32))
    x = np.concatenate([centres, np.repeat(centres[:40], 30, axis=0) + 0.1 * rng.normal(size=(1200, 32)), rng.normal(size=(1500, 32))])
    index = vectors.Index.build(np.arange(len(x)), np.ones(len(x), int), x, 0.95)
    a, b = vectors.Index.loads(index.dumps()).links(np.arange(len(x)), x, 0.95)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = (unit @ unit.T >= 0.95).sum() - len(x)
    assert len(a) >= 0.95 * exact and (np.einsum("ij,ij->i", unit[a], unit[index.ids[b]]) >= 0.95 - 1e-9).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (210, 211), (211, 210), (None, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {210: 210, 211: 210}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="ad">Buy now and save a lot.</div>
<{tag}><h1>Title {i} &amp; more</h1><p><b>First   words
of it.<br><p>Second {i} &lt;tag&gt; caf&eacute;.</p><p>{long}</p></{tag}>
<div id="comments"><p>Nice article, thanks a lot.</p></div><form><p>Your mail</p></form><footer>&copy; all rights. A b c.</footer></body></html>"""


def page(i: int, tag: str) -> tuple[str, str]:
    long = " ".join(f"word{i}{k}" for k in range(30)) + "."
    return PAGE.format(i=i, tag=tag, long=long), f"Title {i} & more\n\nFirst words of it.\n\nSecond {i} <tag> café.\n\n{long}"


def test_main_text_with_and_without_the_mark(spark):
    cases = [page(i, "article" if i % 3 else "div") for i in range(90)]
    rows = [(i, f"http://x/{i}", c[0]) for i, c in enumerate(cases)] + [(900, None, None), (901, "u", ""), (902, "u", "<p"), (None, "u", cases[1][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "model", "n_chars")})
    got = {r.page_id: r for r in html_main.extract(df).collect()}
    assert len(got) == len(rows) and all(got[i].text == c[1] for i, c in enumerate(cases))
    assert got[900].text == got[901].text == "" and got[None].text == cases[1][1]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_without_training_pages(spark):
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    one = spark.createDataFrame([(1, "u", "<body><nav>Menu</nav><p>Some words here.</p></body>")], "page_id long, url string, html string")
    assert "Menu" not in html_main.extract(one).first().text


def test_viterbi_is_the_best_path():
    rng = random.Random(0)
    for _ in range(50):
        model = html_main.Model({"a": rng.uniform(-2, 2), "b": rng.uniform(-2, 2)}, [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)], [rng.uniform(-1, 1), rng.uniform(-1, 1)])
        chain = [[rng.choice("ab")] for _ in range(6)]
        u = model.unary(chain)

        def score(path):
            return model.start[path[0]] + sum(x * y for x, y in zip(u, path)) + sum(model.steps[p][q] for p, q in zip(path, path[1:]))

        paths = [[m >> k & 1 for k in range(6)] for m in range(64)]
        assert score(model.decode(chain)) == pytest.approx(max(map(score, paths)))


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    clean = stage[names[0]](spark, docs, DATA)
    rejected = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == every - rejected
    alone = stage[names[1]](spark, docs, DATA)
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in alone.select("doc_id").collect()} == groups
    for f in (n for n in names[:-1]):
        assert stage[f](spark, docs, DATA).columns == docs.columns
    masked = {r.doc_id: r.text for r in stage[names[2]](spark, docs, DATA).collect()}
    assert set(masked) == every and not any("AKIA" in t for t in masked.values())


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_pages_with_tags_left_open_keep_their_text():
    said = lambda html: [b[0] for b in html_main.blocks(html)]
    assert said("<html><head><title>T</title><meta charset=utf-8><body><article><p>One two.</p></article></body>") == ["One two."]
    assert said("<head><title>T</title><style>p{}</style><p>No body tag.</p><div>More</div>") == ["No body tag.", "More"]
    assert said("<head><noscript><div>off</div></noscript></head><body><p>On</p>") == ["On"]
    assert said("<body><div><button>Menu<p>Kept text.</p>and this</div><p>After</p>") == ["Kept text.", "and this", "After"]
    assert said("<body><select><option>A<option>B<p>Kept.</p></body>") == ["Kept."]
    assert said("<body><button><div>Label</div></button><select><option>A</option></select><svg><text>x</text></svg><p>Text</p>") == ["Text"]
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert said(f"<article><p>Let {formula} hold.</p></article>") == ["Let x=1 hold."]


def test_audits_count_links_and_not_the_vector_itself():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    index = vectors.Index.build(np.arange(400), np.ones(400, int), x, 0.95)
    assert index.audited == (0, 0) and index.beam == vectors.BEAM  # nothing is near anything: nothing to find
    x[200:] = x[:200] + 0.05 * rng.normal(size=(200, 24))
    others = np.arange(1000, 1020), x[:20] + 0.03 * rng.normal(size=(20, 24))
    index = vectors.Index.build(np.arange(400), np.ones(400, int), x, 0.95, others)
    there, found = index.audited
    assert there >= 100 and found >= vectors.RECALL * there
    # A graph without links finds nothing but its way in: the audit widens the beam to a scan of the shard.
    cut = vectors.Index(index.ids, index.weights, index.raw, [np.full_like(index.layers[0], -1)], vectors.BEAM)
    cut.audit(0.95)
    assert cut.beam > vectors.BEAM and cut.audited[0] == cut.audited[1]


def test_recall_on_planted_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 48))
    x[1500:] = x[:1500] + 0.2 * rng.normal(size=(1500, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).collect()
    want = brute_links(x, list(range(3000)))
    links = sum(n for n, _ in want.values())
    assert links > 2500 and sum(r.n_links for r in got) >= 0.99 * links and len({r.recall for r in got}) == 1 and got[0].recall >= 0.99
    assert all(r.n_links <= want[r.vec_id][0] for r in got)


def test_a_full_beam_becomes_a_scan_where_that_is_less_work(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[:400] = x[0] + 0.05 * rng.normal(size=(400, 32))
    index = vectors.Index.build(np.arange(3000), np.ones(3000, int), x, 0.95)
    walked, walk = [], vectors.beam_search
    monkeypatch.setattr(vectors, "beam_search", lambda q, x, links, entries, beam: walked.append((len(q), beam)) or walk(q, x, links, entries, beam))
    a, b = index.links(np.arange(3000), x, 0.95)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(a) == (unit @ unit.T >= 0.95).sum() - 3000
    # A walk of 128 for each of the 400 costs many times what looking at 3,000 vectors does.
    assert index.beam == vectors.BEAM and max(beam for _, beam in walked) == vectors.BEAM and sum(n for n, _ in walked) == 3000


def test_two_shards_meet_once():
    for shards in range(1, 12):
        of = np.arange(shards)
        met = np.array([vectors.meets(of, s, shards) for s in range(shards)])  # by queried shard and own shard
        assert met.diagonal().all() and ((met ^ met.T) | np.eye(shards, dtype=bool)).all()
        assert met.sum(axis=0).max() - met.sum(axis=0).min() <= 1


def test_links_between_shards_count_for_both_ends(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1600, 24))
    x[800:] = x[:800] + 0.05 * rng.normal(size=(800, 24))
    x[1500:] = x[1499]  # a class of equal vectors: a link with it counts all of them
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == brute_links(x, list(range(1600)))


def test_shards_and_slots_have_tasks_of_their_own(spark):
    df = spark.range(4000).selectExpr("id as vec_id", "array(sin(id), cos(id), sin(id * id), cos(id * 7)) as embedding")
    dealt = []
    real = type(df).repartitionById
    try:
        type(df).repartitionById = lambda self, n, by: dealt.append(real(self, n, by)) or dealt[-1]
        vectors.near_vectors(df)
    finally:
        type(df).repartitionById = real
    for part, by, n in zip(dealt, ("slot", "shard"), (4, vectors.SHARDS)):
        rows = part.select(by, F.spark_partition_id().alias("task")).distinct().collect()
        assert len(rows) == len({r.task for r in rows}) == len({r[by] for r in rows}) == n


def plain_crf(pages, epochs):
    """The same gradient steps, with every path of every page counted out."""
    import itertools
    import math

    w, t, start = {}, [[0.5, -0.5], [-0.5, 0.5]], [0.0, 0.0]
    order = np.random.default_rng(0)
    for epoch in range(epochs):
        rate = html_main.RATE / (1 + epoch)
        for at in order.permutation(len(pages)).tolist():
            page, labels = pages[at]
            n = len(page)
            u = [sum(w.get(f, html_main.PRIOR.get(f, 0.0)) for f in fs) for fs in page]
            paths = list(itertools.product((0, 1), repeat=n))
            score = lambda p: start[p[0]] + sum(x * y for x, y in zip(u, p)) + sum(t[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            weight = [math.exp(score(p)) for p in paths]
            z = sum(weight)
            one = [sum(m for p, m in zip(paths, weight) if p[i]) / z for i in range(n)]
            both = [[[sum(m for p, m in zip(paths, weight) if p[i - 1] == a and p[i] == b) / z for b in (0, 1)] for a in (0, 1)] for i in range(1, n)]
            for i in range(n):
                g = labels[i] - one[i]
                if abs(g) > 1e-4:
                    for f in page[i]:
                        old, prior = w.get(f, html_main.PRIOR.get(f, 0.0)), html_main.PRIOR.get(f, 0.0)
                        w[f] = old + rate * (g - html_main.DECAY * (old - prior))
            for a in (0, 1):
                for b in (0, 1):
                    seen = sum(labels[i - 1] == a and labels[i] == b for i in range(1, n)) - sum(m[a][b] for m in both)
                    t[a][b] += rate * (seen / max(1, n) - html_main.DECAY * t[a][b])
            for y in (0, 1):
                start[y] += rate * ((labels[0] == y) - (one[0] if y else 1 - one[0]))
    return w, t, start


def test_the_crf_fit_equals_the_plain_one(monkeypatch):
    monkeypatch.setattr(html_main, "EPOCHS", 3)
    rng = random.Random(2)
    names = ["tag:p", "out", "in:nav", "links:all", "a", "b"]
    pages = [([rng.sample(names, rng.randint(1, 3)) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]) for n in (1, 2, 3, 5, 6, 4, 1, 2) for _ in range(3)]
    model, (w, t, start) = html_main.fit(pages), plain_crf(pages, 3)
    assert model.weights == pytest.approx(w, abs=1e-9) and model.start == pytest.approx(start, abs=1e-9)
    assert [*model.steps[0], *model.steps[1]] == pytest.approx([*t[0], *t[1]], abs=1e-9)


def awkward_docs(spark, rows):
    clashing = {c: F.lit("x") for c in ("row", "part", "key", "shard", "kept", "size", "rank", "seats")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clashing)


def test_pipeline_stages_on_awkward_rows(spark):
    rows = [(i, f"document {i} has some words of its own like word{i} and more{i}", "en", "ab"[i % 2], 10) for i in range(20)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), (None, "words of a row without an id", "en", "b", 3), (32, "x " * 5000, "en", "a", 10000)]
    rows += [(40, rows[3][1], "en", "a", 10), (3, rows[3][1], "en", "a", 10), (41, "the password = abcdefghijkl9 is here", "en", None, 5)]
    docs = awkward_docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert got
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        none = stage(spark, docs.limit(0), DATA)
        assert none.collect() == []
        docs = spark.createDataFrame(got, out.schema)
    ids = {r.doc_id for r in got}
    # 40 is a copy of 3, and 31, empty, of 30; 41 alone is its source, with fewer words than a block of the mix.
    assert 40 not in ids and ids >= {3, 30, 32, None} and 31 not in ids
