"""Classifiers on held-out rows, page extraction, mixing, vectors, components and the pipeline."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import embedding_dedup, html_text, linear, mixing, quality_classifier, quality_rules
from slotwise.llm.components import components

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
@pytest.mark.parametrize("kind", ["rules", "classifier"])
def test_held_out_accuracy(spark, kind):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    if kind == "rules":
        got = quality_rules.scored(docs, quality_rules.fit(docs, seen)).where("not base_failed")
    else:
        got = quality_classifier.scored(docs, quality_classifier.fit(docs, seen)).selectExpr("row.doc_id", "is_kept as kept")
    clean = "quality = 1 and toxic = 0"
    held = got.join(unseen, "doc_id").selectExpr("kept", "quality = 0 as poor", f"{clean} as good", "quality = 1 and toxic = 1 as toxic").collect()
    assert np.mean([r.kept for r in held if r.good]) > 0.98 and np.mean([r.kept for r in held if r.poor]) < 0.2
    if kind == "classifier":
        assert np.mean([r.kept for r in held if r.toxic]) < 0.8


@tables
def test_grades_are_ordered(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    rows = quality_classifier.scored(docs, model).select("row.doc_id", "expected_grade", "p_acceptable", "p_clean").join(labels, "doc_id").collect()
    mean = lambda q, t: np.mean([r.expected_grade for r in rows if (r.quality, r.toxic) == (q, t)])
    assert mean(0, 0) < mean(1, 1) < mean(1, 0)
    assert all(0 <= r.p_clean <= r.p_acceptable <= 1 and r.expected_grade == pytest.approx(r.p_clean + r.p_acceptable) for r in rows)


@pytest.mark.parametrize("kind", [quality_rules, quality_classifier])
def test_odd_rows_are_scored(spark, kind):
    text = " ".join(f"word{i % 97} Other, {i}" for i in range(30_000))
    schema = "doc_id bigint, text string, kept boolean, probability string, row string"
    docs = spark.createDataFrame([(1, text, True, "x", "y"), (1, text, True, "x", "y"), (None, "plain words", None, None, None), (2, None, None, None, None), (3, "", None, None, None)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.where("false")):
        out = kind.scored(docs, kind.fit(docs, given))
        assert out.count() == 5 and kind.scored(docs.where("false"), kind.fit(docs, given)).count() == 0
        verdict = "is_kept" if kind is quality_classifier else "kept"
        assert sum(r[verdict] for r in out.collect()) <= 3


def test_counted_signals(spark):
    text = "a b c d e f g h i\n" * 2 + "x #*$ y\n\n\nx #*$ y\n é <z>"
    docs = spark.createDataFrame([(1, text), (2, None), (None, "w " * 30), (3, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.scored(docs, quality_rules.fit(docs, none)).collect()}
    r = got[1]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (26, 32, 8, 2, 18)
    assert r.base_failed and not r.kept and got[2].base_failed and got[3].n_words == 0
    assert got[None].n_repeat_words == 30
    assert linear.sampled_labels(none, none["quality"]).count() == 0


def test_pages(spark):
    long = "Words of the article that go on for quite a while. " * 5
    page = f"""<html><head><title>t</title><script>var x = "</p>";</script></head><body><nav><a href=/>Home</a></nav><header>Site</header>
    <div class="cookie-notice">We use cookies, long text long text long text long text</div><div id="main"><article><h1>A &amp; B</h1><p>{long}<p>Second <b>bo</b>ld
    &eacute;\t x<br>y</p><ul><li>one<li>two</ul><div class="ad">buy</div></article><aside>side</aside></div><section id="comments"><p>{long}{long}</p></section><form><p>f</p></form><footer>foot</footer>"""
    first = " ".join(long.split())
    assert html_text.main_text(page) == f"A & B {first} Second bold é x y one two"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain a < b", "<!-- c --><p>x")] == ["", "", "", "plain a < b", "x"]
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (None, None, "<p>é")], "page_id bigint, url string, html string")
    assert sorted(r.n_chars for r in html_text.extracted(pages).collect()) == [0, 1, len(html_text.main_text(page))]


def test_broken_quotes_and_deep_pages(spark):
    assert html_text.main_text(f'<p title="5" wide">{"FIRST words here " * 20}</p>') == ("FIRST words here " * 20).strip()
    assert html_text.main_text(f"<div data-id='sidebar' title='a class=nav b'><p>{TEXT}</p></div>") == TEXT.strip()
    began = time.time()
    for deep in ("<div>" * 20_000 + TEXT + "</p>" * 20_000, "<div>" * 20_000 + TEXT + "</div>" * 20_000, "<b><div class='comment'>x</div>" * 5_000 + TEXT):
        assert TEXT.strip() in html_text.main_text(deep)
    assert time.time() - began < 20
    pages = spark.createDataFrame([(1, "u", f"<p>{TEXT * 2000}", 5), (1, "u", f"<p>{TEXT * 2000}", 5)], "page_id bigint, url string, html string, text int")
    assert [r.n_chars for r in html_text.extracted(pages).collect()] == [len((TEXT * 2000).strip())] * 2
    assert html_text.extracted(pages.where("false")).count() == 0


TEXT = "A sentence of the article that is long enough to be read, with a comma. " * 8


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "page with-header", "elementor-widget-container", "post-has-comments", "hasSidebar", "layout-sidebar-right", "sidebar-none", "post comments-open", "widget so-panel widget_sow-editor"])
@pytest.mark.parametrize("inner", ["div", "article", "main"])
def test_names_on_the_article_or_around_it(name, inner):
    menu = "<div class='site-header'><h1>Site</h1></div><div class='main-nav'><a href=/>Home</a></div>"
    around = f"<body>{menu}<div class='{name}'><{inner}><p>{TEXT}</p></{inner}></div><div class='cookie-banner'>We use cookies.</div></body>"
    assert html_text.main_text(around) == TEXT.strip()
    assert html_text.main_text(f"<body>{menu}<{inner} class='{name}'><p>{TEXT}</p></{inner}></body>") == TEXT.strip()


def test_noise_beside_a_short_article_stays_out():
    long = f"<p>{TEXT}</p>" * 5
    for name in ("comments", "comment-list", "post-comments", "sidebar", "related-posts", "left-sidebar", "footer-widgets", "newsletter-signup"):
        page = f"<body><div><article><h1>Title</h1><p>{TEXT}</p></article></div><div class='{name}'>{long}</div></body>"
        assert html_text.main_text(page) == f"Title {TEXT.strip()}", name
    thread = f"<body><div><h1>Title</h1><p>{TEXT}</p></div><div id='comments'><article class='comment-body'>{long}</article></div></body>"
    assert html_text.main_text(thread) == f"Title {TEXT.strip()}"
    cards = f"<body><main><article><p>{TEXT}</p></article><article class='related'><p>Another one</p></article></main></body>"
    assert html_text.main_text(cards) == TEXT.strip()
    assert html_text.main_text(f"<body><div id='comments'><p>{TEXT}</p></div></body>") == TEXT.strip()


def test_flat_body_keeps_its_paragraphs():
    p = f"<p>{'word ' * 50}</p>"
    li = f"<li>{'item ' * 12}</li>" * 30
    row = f"<tr>{'<td>some cell text</td>' * 5}</tr>" * 60
    for block in (f"<ul>{li}</ul>", f"<table>{row}</table>", f"<div><ul>{li}</ul></div>"):
        text = html_text.main_text(f"<body><h1>Title</h1>{p * 3}{block}</body>")
        assert text.startswith("Title word") and text.count("word") == 150, block[:20]
        assert len(text) > 2000
    stray = html_text.main_text(f"<body><div>{p * 5}</div><p>Copyright</p></body>")
    assert "Copyright" not in stray and stray.count("word") == 250


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 4}" if i % 9 else None) for i in range(3000)] + [(1, None, "s1"), (1, "w w", "s1"), (1, "w w", "s1"), (None, "w", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.copies(docs).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = dict(zip([*sorted(s for s in sizes if s is not None), None], (1, 2, 3, 1, 2, 3), strict=False))
    capped = {}
    while True:
        level = (sum(sizes.values()) - sum(capped.values())) / sum(w for s, w in weights.items() if s not in capped)
        more = {s: 3 * sizes[s] for s in sizes if s not in capped and level * weights[s] >= 3 * sizes[s]}
        if not more:
            break
        capped |= more
    want = {s: capped.get(s, level * weights[s]) for s in sizes}
    for s, part in got.groupby("source", dropna=False):
        s = None if isinstance(s, float) else s
        assert part["target"].iloc[0] == pytest.approx(want[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs((part["copies"] * part["size"]).sum() - want[s]) <= 60
    again = mixing.copies(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "key"]
    assert got.sort_values(key)["copies"].tolist() == again.sort_values(key)["copies"].tolist()
    assert mixing.resampled(docs).count() == got["copies"].sum() + (got["size"] == 0).sum()
    assert mixing.copies(docs.where("false")).count() == 0


def test_mixing_of_uneven_sizes(spark):
    rng = np.random.default_rng(9)
    sizes = np.minimum(np.exp(rng.normal(5, 1.6, 1200)).astype(int) + 1, 20_000)
    rows = [(i, "w " * int(n), f"s{i % 5}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.copies(docs).toPandas()
    for _, part in got.groupby("source"):
        target = part["target"].iloc[0]
        assert abs((part["copies"] * part["size"]).sum() - target) < 0.002 * target
    fractions = mixing.rounded(spark.createDataFrame([(0, "a", i, 10 + i % 7, 0.3) for i in range(500)], "key int, source string, doc_id bigint, size bigint, p double"), 40, 5)
    taken = fractions.selectExpr("sum(p * size)", "count(*)", "sum(int(p in (0, 1)))").first()
    assert abs(taken[0] - 0.3 * sum(10 + i % 7 for i in range(500))) <= 16 and taken[1] == taken[2] == 500


@pytest.mark.parametrize(("block", "part"), [(4096, 1024), (7, 1024), (30, 4), (4096, 5)])
def test_vectors(spark, block, part):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    made = [(i, i % 2, (base[i % 12] * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.13).astype(np.float32).tolist()) for i in range(80)]
    made += [(100, 0, made[0][2]), (101, 0, made[0][2]), (102, 1, made[0][2]), (103, 0, None), (104, 0, [0.0] * 16), (105, 0, [float("nan")] * 16), (106, None, made[0][2]), (107, 0, []), (108, 0, [None] * 16), (109, 0, [1e38] * 16), (110, 0, [2e38] * 16)]
    frame = spark.createDataFrame(made, "vec_id bigint, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, block=block, part=part).collect()}
    live = [(i, lab, np.array(v, dtype=np.float32).astype(float)) for i, lab, v in made if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in made}, {i: 0 for i, *_ in made}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, x in live:
        for j, b, y in live:
            if i < j and a == b and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i), find(i) == i) for i in root}
    assert sum(links.values()) > 20
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.01, 1.0]), (1, 0, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("rep", F.lit("x")).withColumn("component", F.lit("y"))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 111


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    poor = {r.doc_id for r in labels.where("quality = 0").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = corpus_pipeline.staged(stages["quality_classifier"](spark, docs, DATA), "t1")
    assert first.columns == names and len(ids(first) & poor) <= 0.05 * len(poor) and len(ids(first) & good) >= 0.98 * len(good)
    second = corpus_pipeline.staged(stages["line_dedup"](spark, first, DATA), "t2")
    third = corpus_pipeline.staged(stages["ngram_jaccard"](spark, second, DATA), "t3")
    from test_texts import brute_components

    want = brute_components_fast([(r.doc_id, r.text) for r in second.collect()])
    assert ids(third) == want and third.columns == names
    fourth = corpus_pipeline.staged(stages["mixing"](spark, third, DATA), "t4")
    assert fourth.columns == names and ids(fourth) <= ids(third)
    packed = stages["best_fit_packing"](spark, fourth, DATA)
    assert packed.where("piece = 0").count() == fourth.count()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*pieces).collect()))
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(packed)
    assert brute_components([(1, "a b c d e f"), (2, "a b c d e f")], 5, 80)[2][1] == 1


def brute_components_fast(rows):
    """Smallest doc_ids of the groups at five words and 0.8, by an inverted index."""
    sets, index, root = {}, {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in index.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}
