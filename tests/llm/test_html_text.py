import numpy as np
import pytest
from helpers import SF

from corpusrisk.llm import html_text as ht

PAGES = "page_id long, url string, html string"


def texts(html):
    return [b.text for b in ht.blocks(html)]


def test_blocks_of_loose_markup():
    assert texts("<p>one <b>two</b>\n three<p>four<br>five</p>six") == ["one two three", "four five", "six"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts('<a href="x>y">t</a> &amp;amp; &lt;b&gt;&nbsp;&#x41; &am') == ["t &amp; <b> A &am"]
    assert texts("<script>var t='</p>';</script><style>p{}</style>x<!-- <p>no</p> -->y") == ["xy"]
    assert texts("a<script>never closed <p>b") == ["a"]
    assert texts("a <!-- never closed <p>b") == ["a"]
    assert texts("1 < 2 <p>x</p> <") == ["1 < 2", "x", "<"]
    assert texts("<title>no</title><body><select><option>no</select>yes<template><p>no</template>") == ["yes"]
    assert texts("") == [] and texts("<div></div>  \n") == []


def test_paths_end_with_their_elements():
    paths = [[e[0] for e in b.path] for b in ht.blocks("<article><p><b>x<p>y</article><footer>z")]
    assert paths[0][:2] == ["article", "p"] and "b" in paths[0]
    assert paths[1][0] == "article" and paths[2] == ["footer"]
    assert [e for b in ht.blocks('<div class="Post-Body ad1" id=main role="search">x') for e in b.path] == [("div", ".post", ".body", ".ad", ".main", "@search")]


def test_innermost_telling_element_decides():
    path = lambda *e: tuple(x if isinstance(x, tuple) else (x,) for x in e)
    assert ht.told(path("body", "article", "p")) == 1
    assert ht.told(path("body", "article", ("div", ".ad"), "p")) == 0
    assert ht.told(path("article", "header", "h1")) == 1
    assert ht.told(path("body", "header", "h1")) == 0
    assert ht.told(path("body", ("section", ".comments"), "article", "p")) == 1  # as told; context is the labeller's
    assert ht.told(path("body", "div", "p")) is None


def test_gradients_equal_finite_differences():
    rnd = np.random.default_rng(0)
    model = ht.Labeller.fresh(seed=3, width=6, cells=4, kind=np.float64)
    x, mask = ht.padded([rnd.standard_normal((n, 6)) for n in (5, 3, 1)])
    label, weight = (rnd.random(mask.shape) < 0.5).astype(float) * mask, rnd.random(mask.shape) * mask
    _, grad = model.gradients(x, mask, label, weight)
    for name, g in grad.items():
        w = model.w[name]
        for at in [tuple(rnd.integers(0, n) for n in w.shape) for _ in range(6)]:
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up = model.gradients(x, mask, label, weight)[0]
            w[at] = old - eps
            down = model.gradients(x, mask, label, weight)[0]
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), rel=1e-5, abs=1e-9)


def test_a_page_is_read_the_same_alone_and_among_others():
    rnd = np.random.default_rng(1)
    model = ht.Labeller.fresh(seed=5, width=7, cells=3, kind=np.float64)
    pages = [rnd.standard_normal((n, 7)) for n in (4, 0, 9, 1, 4)]
    together = model.probabilities(pages)
    for p, q in zip(pages, together):
        assert np.allclose(model.probabilities([p])[0], q)


@pytest.fixture(scope="module")
def model(spark):
    return ht.trained(ht.training_pages(spark.read.parquet(f"{SF}/pages.parquet"), limit=100))


def test_held_out_pages(spark, model):
    """The tables' pages hold one article element each; pages outside the sample give exactly its text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sampled = set(ht.training_pages(pages, limit=100))
    rows = [r for r in ht.main_text(pages, model).join(pages.select("page_id", "html"), "page_id").collect() if r["html"] not in sampled]
    assert len(rows) >= 100
    for r in rows:
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert r["text"] == "\n\n".join(texts(inner))


def test_layouts_that_no_sampled_page_has(model):
    story = [f"This is sentence number {i} of a longer story, and it goes on for a while." for i in range(6)]
    page = (
        "<html><head><title>T</title></head><body><div id='cookie-notice'>We use cookies. <button>OK</button></div>"
        "<div class='site-header'><a href='/'>Home</a></div><div class='post-content'><h1>A headline of the story</h1>"
        + "".join(f"<p>{s}</p>" for s in story)
        + "<ul><li>One point of the story.</li></ul></div><div class='sidebar'><h3>Related</h3><ul><li><a href=a>Other</a></li></ul></div>"
        "<div id='comments'><p>I do not agree with this at all.</p></div><form><label>Your name</label></form><footer>Imprint</footer></body></html>"
    )
    b = ht.blocks(page)
    assert ht.extracted_text(b, model.probabilities([ht.vectors(b)])[0]) == "\n\n".join(["A headline of the story", *story, "One point of the story."])


def test_awkward_pages(spark, model):
    long = "<article>" + "".join(f"<p>paragraph {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<nav><a href=x>menu</a></nav>"), (2, "v", long), (3, "w", "<p>" * 5000 + "deep"), (3, "w", "<p>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' AS text", "1 AS n")
    out = ht.main_text(df, model).collect()
    assert len(out) == 6 and sorted(r["text"] for r in out if r["page_id"] == 1) == ["", ""]
    assert next(r["text"] for r in out if r["page_id"] is None) == ""
    assert next(r["text"] for r in out if r["page_id"] == 2).count("\n\n") == 19_999
    assert len({r["text"] for r in out if r["page_id"] == 3}) == 1


def test_empty_table_and_no_telling_block(spark):
    assert ht.main_text(spark.createDataFrame([], PAGES)).collect() == []
    assert len(ht.main_text(spark.createDataFrame([(1, "u", "<div>x</div>")], PAGES)).collect()) == 1
