import itertools
import time

import numpy as np
import pytest

from lodestrata.llm import html_crf, labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this site work.</p><button>OK</button></div>
<!-- ad 1 --><div class="ad">Buy this now at a good price.</div><article><h1>A title here</h1><p>First <b>wo</b>rd of a longer paragraph &amp; more&nbsp;text, which goes on for a while.
And  on.<br>After the break it ends.</p><div class="ad">Another thing to buy.</div><p>Second paragraph of the article, with some more text in it.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside><section id="comments"><div class="comment"><p>I like this a lot, said a reader.</p></div></section>
<form action="/s"><label>Search</label><input><button>Go</button></form><footer>&copy; Somebody</footer></body></html>"""
TEXT = "A title here First word of a longer paragraph & more text, which goes on for a while. And on. After the break it ends. Second paragraph of the article, with some more text in it."


def test_page():
    assert html_crf.extract_texts([PAGE], html_crf.default_model()) == [TEXT]


def around(inner):
    return PAGE.replace("goes on for a while.", inner + "goes on for a while."), TEXT


@pytest.mark.parametrize("tag", ["math", "object", "noscript"])
def test_shown_elements_are_labelled(tag):
    page, want = around(f"<{tag}>seen</{tag}> ")
    assert html_crf.extract_texts([page], html_crf.default_model()) == [want.replace("goes on for", "seen goes on for")]


def test_formulas():
    page, want = around("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>\\x</annotation></semantics></math> ")
    assert html_crf.extract_texts([page], html_crf.default_model()) == [want.replace("goes on for", "x=1 goes on for")]


@pytest.mark.parametrize("tag", ["math", "object", "noscript", "svg", "template"])
def test_an_unclosed_element_takes_nothing_with_it(tag):
    page, _ = around(f"<{tag}>")
    got = html_crf.Tree(page)
    assert any("Second paragraph of the article" in t for _, t, *_ in got.texts)
    assert "".join(t for _, t, *_ in html_crf.Tree(around("<script>var x")[0]).texts).endswith("which ")


UNITS = ['<p a="x ', '<p a="x >', "<p a=\"'>", "<aaaa", "<template>", "<head>", "<!-", "<li><ul><span>", "</x>", "<p ", "&#"]


@pytest.mark.parametrize("page", [*[u * (1_000_000 // len(u)) for u in UNITS], "<div>" * 100_000 + "</x>" * 120_000, "<li><ul>" + "<span>" * 80_000 + "<li>" * 100_000, '<p a=">b' * 120_000 + '"'])
def test_a_million_letters_of_broken_markup_take_linear_time(page):
    began = time.perf_counter()
    html_crf.Tree(page)
    assert time.perf_counter() - began < 5


def test_quotes_count_behind_an_equals_sign():
    text = lambda page: "".join(t for _, t, *_ in html_crf.Tree(page).texts)
    assert text("<p title=it's>one</p> don't <b>two</b>") == "one don't two"
    assert text('<p title="a > b">one</p>') == "one" and text("<p title='a > b' x>one</p>") == "one" and text('<p a="x>one</p>two') == "onetwo"
    assert text("one <b>two</b> <i unfinished") == "one two " and text("1 < 2 <3 </> x") == "1 < 2 <3  x"


@pytest.mark.parametrize(("family", "least"), [("semantic", 0.97), ("named", 0.97), ("bare", 0.75), ("mixed", 0.97)])
def test_a_family_of_templates_held_out(family, least):
    """Learned from the other families of templates alone."""
    model = html_crf.fit(labelled_pages.pages(250, families=tuple(f for f in labelled_pages.FAMILIES if f != family)), steps=120)
    trees = [html_crf.Tree(m) for m in labelled_pages.pages(60, seed=7, families=(family,))]
    right = total = 0
    for tree, p in zip(trees, model.marginals(trees), strict=True):
        for node, text, _, _ in tree.texts:
            if text.strip():
                total += len(text)
                right += len(text) * (labelled_pages.is_content(text) == (p[node] >= 0.5))
    assert right / total > least


def test_a_page_of_bare_containers():
    story = "Some long article text, with commas and stops. " * 12
    page = f"<html><body><div><div>Home | About | Contact</div><div><p>{story}</p><p>{story}</p></div><div>Copyright 2020</div></div></body></html>"
    got = html_crf.extract_texts([page], html_crf.default_model())[0]
    assert "Copyright" not in got and got.count("Some long") == 24
    # the same words in an article that is marked as one are its own
    assert html_crf.extract_texts([PAGE.replace("</article>", "<p>All rights reserved.</p></article>")], html_crf.default_model()) == [TEXT + " All rights reserved."]


def test_svg_text_is_read():
    texts = [t for _, t, *_ in html_crf.Tree(around("<svg><title>icon</title><desc>what</desc><text>label</text></svg>")[0]).texts]
    assert "label" in texts and not {"icon", "what"} & set(texts)


def test_messages_are_exact():
    """Marginals by enumeration over a small tree."""
    r = np.random.default_rng(0)
    parent, depth, kind = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2]), np.array([0, 1, 2, 3, 0, 1])
    unary, edge = r.normal(size=6), r.normal(size=(4, 2, 2))
    p, pair = html_crf.messages(unary, edge, parent, depth, kind)
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        weight[y] = np.exp(sum(unary[k] * y[k] for k in range(6)) + sum(edge[kind[k], y[parent[k]], y[k]] for k in range(1, 6)))
    z = sum(weight.values())
    assert p == pytest.approx([sum(w for y, w in weight.items() if y[k]) / z for k in range(6)])
    for k in range(1, 6):
        for a, b in itertools.product((0, 1), repeat=2):
            assert pair[k, a, b] == pytest.approx(sum(w for y, w in weight.items() if y[parent[k]] == a and y[k] == b) / z)


def test_held_out_pages():
    model = html_crf.default_model()
    trees = [html_crf.Tree(m) for m in labelled_pages.pages(120, seed=99, families=("semantic", "named", "mixed"))]
    right = total = 0
    for tree, p in zip(trees, model.marginals(trees), strict=True):
        for node, text, _, _ in tree.texts:
            if text.strip():
                total += 1
                right += labelled_pages.is_content(text) == (p[node] >= 0.5)
    assert right / total > 0.99


@pytest.mark.parametrize("broken", ["<", "<p", "<article><p>x", "</p></div>", "<a href=\"x>y", "<!-- open", "<script>never closed", "text only", "<p><p><p>", "<table><td>a<td>b", "&#xZZ; &unknown; &amp", "<article><p>a < b and c > d</p></article>"])
def test_broken_markup_is_read(broken):
    assert isinstance(html_crf.extract_texts([broken], html_crf.default_model())[0], str)


def test_table_and_cases(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9), (3, "w", "<html><body><nav><a href=x>only menu</a></nav></body></html>", 9)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == sorted([(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (0, "", 0), (3, "", 0)])
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_driver_pages_by_plain_reading(spark):
    """On the tables' own template the article element is the article."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = html_crf.extract_texts([r["html"] for r in rows], html_crf.default_model())
    for r, text in zip(rows, got, strict=True):
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))
        assert text == " ".join(html.unescape(inner).split())


def test_very_long_page():
    body = "<p>" + "word " * 200 + "</p>"
    page = "<html><body><nav><a href=x>menu</a></nav><article>" + body * 500 + "</article></body></html>"
    assert len(html_crf.extract_texts([page], html_crf.default_model())[0].split()) == 100_000
