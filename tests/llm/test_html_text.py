"""Main text of pages: reading of markup, the labeller's learning, whole pages."""

import html
import re

import numpy as np
import pytest

from flakelens.llm import html_text as ht
from flakelens.llm import queries

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in ht.blocks_of(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<html><body></body>") == []
    assert texts("<p>a <b>b</b>c<br>d\n e</p>f") == ["a bc", "d e", "f"]
    assert texts("<title>t</title><script>'</p>' <p>x</script><style>p{}</style>y<!-- <p>z</p> -->w") == ["yw"]
    assert texts("&lt;p&gt; &amp;amp; &eacute;&nbsp;&#x41;<p title='a>b'>c") == ["<p> &amp; é A", "c"]
    assert texts("1 < 2 <p>a<p>b</p></div>c<script>never closed <p>") == ["1 < 2", "a", "b", "c"]
    assert texts("<p>a<!-- open <p>b") == ["a"] and texts("a<p class='open") == ["a"]
    assert texts("<td>a<td>b<li>c<li>d") == ["a", "b", "c", "d"]
    assert texts("<P CLASS=X>A</P><SCRIPT>s</SCRIPT>B") == ["A", "B"]


def test_elements_without_end_tag():
    rest = "<body><article><p>a<p>b</article>"
    assert texts("<html><head><title>x</title>" + rest) == ["a", "b"]
    assert texts("<head><meta charset=utf-8><title>x</title><script>'</head>'</script><link rel=x><p>a") == ["a"]
    assert texts("<head><title>x</title>plain text") == ["plain text"]
    assert texts("<head><title>x<style>p{}</style></head>" + rest) == ["a", "b"]
    assert "<head" not in ht.blocks_of("<head><title>x</title><p>a")[0].path
    for tag in "iframe object canvas svg math video audio noscript template".split():
        assert texts(f"<{tag} class=x>" + rest) == ["a", "b"]
        assert texts(f"<{tag}>" + rest + f"<{tag}>gone</{tag}><p>c") == ["a", "b", "c"]
        assert texts(f"<p>a<{tag}>gone<!-- </{tag}> --><{tag}>gone</{tag}>gone</{tag}><p>b") == ["a", "b"]
        assert texts(f"<{tag}-x>a</{tag}-x>") == ["a"]
    assert texts("<title>x" * 20_000 + "<svg>" * 20_000 + "<p>a") == ["a"]
    assert texts("<svg>" * 20_000 + "</svg><p>a") == ["a"]


def test_paths():
    page = "<article class='post-body'><p>a<p>b</article><nav id=top><a href=x>c</a></nav>d"
    a, b, c, d = ht.blocks_of(page)
    assert {"<article", "post-body", "post", "body", "<p"} <= set(a.path) and a.path == b.path
    assert "<nav" in c.path and c.linked == 1.0 and "<article" not in c.path and d.path == ("leaf:",)


def test_gradient():
    """Back-propagation through both directions against finite differences."""
    rnd = np.random.default_rng(4)
    pages = [[ht.Block("a b c.", ("x",)), ht.Block("d", ("y", "z"))], [ht.Block("e f", ("x",), 1.0)]]
    model = ht.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["W"] += rnd.standard_normal(model.p["W"].shape) * 0.3
    read = ht.inputs(pages)
    y = np.array([[1.0, 0.0], [1.0, 0.0]])

    def loss():
        z, _ = model.forward(*read)
        return ((np.log1p(np.exp(z)) - y * z) * read[-1]).sum() / read[-1].sum()

    steps = model.step(*read, y)
    for name, grad in steps.items():
        flat = np.abs(grad).ravel().argsort()[-5:]
        for i in flat:
            value = model.p[name].ravel()[i]
            out = []
            for by in (1e-3, -1e-3):
                model.p[name].ravel()[i] = value + by
                out.append(loss())
            model.p[name].ravel()[i] = value
            assert abs((out[0] - out[1]) / 2e-3 - grad.ravel()[i]) < 2e-3


@pytest.fixture(scope="module")
def labeller(spark):
    return ht.train(spark.read.parquet(f"{SF}/pages.parquet"))


def main(labeller, page):
    blocks = ht.blocks_of(page)
    return " ".join(b.text for b, m in zip(blocks, labeller.labels([blocks])[0], strict=True) if m)


PROSE = ["The first paragraph has a number of words and ends here.", "Another paragraph follows, with more words than the one before it, and goes on for a while until it is done."]
P = "".join(f"<p>{p}</p>" for p in PROSE)
AROUND = [
    "<header class='site-header'><h2>Site name</h2></header>", "<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>",
    "<div class='cookie-notice'>We use cookies on this site. Accept them all now.</div>", "<div class=ad>Buy one and get another.</div>",
    "<aside class=sidebar><h3>More</h3><p>Some other story that is told at some length elsewhere.</p></aside>",
    "<form class=search><label>Search</label><button>Go</button></form>",
    "<section class=comments><h3>Comments</h3><p>I read all of it and I liked the second paragraph best of all.</p></section>",
    "<footer>&copy; somebody, all rights reserved.</footer>",
]


@pytest.mark.parametrize("opened, closed", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id='main-content'>", "</div>"),
    ("<div class='wrapper'><article class=post>", "</article></div>"), ("<div class='entry-content'>", "</div>"),
])
def test_layouts(labeller, opened, closed):
    want = " ".join(["A title", *PROSE])
    core = f"{opened}<h1>A title</h1>{P}{closed}"
    assert main(labeller, f"<html><body>{''.join(AROUND[:4])}{core}{''.join(AROUND[4:])}</body></html>") == want
    assert main(labeller, f"<html><body>{AROUND[1]}{core}{AROUND[-1]}") == want
    if "article" in opened:
        inner = core.replace("</article>", f"{AROUND[4]}{AROUND[6]}</article>").replace("</h1>", f"</h1>{AROUND[3]}")
        assert main(labeller, f"<html><body>{AROUND[0]}{inner}{AROUND[-1]}") == want


def test_given_pages(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op6_html_text(spark, SF).collect()}
    assert len(got) == len(pages)
    wrong = 0
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        wrong += got[r.page_id].text != want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert wrong == 0


def test_awkward_rows(spark, labeller):
    rows = [(1, None, None), (1, "u", ""), (2, "u", "plain text"), (2, "u", "<" * 5000), (None, "u", "<p>" * 20_000 + "x"),
            (3, "u", "<article><h1>T</h1>" + P * 500), (3, "u", "<article><h1>T</h1>" + P * 500), (4, "u", "<a title='" * 2000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, text string, id string")
    got = ht.main_text(df, labeller=labeller).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    long = [r.text for r in got if r.page_id == 3]
    assert long == [" ".join(["T", *PROSE * 500])] * 2
    assert ht.main_text(df.filter("page_id = 9")).count() == 0
    assert ht.main_text(df.filter("page_id = 1")).count() == 2


def test_training_on_large_pages(spark):
    long = [f"Paragraph {i} goes on. {PROSE[i % 2]}" for i in range(1500)]
    page = f"<body>{''.join(AROUND)}<article><h1>A title</h1>{''.join(f'<p>{p}</p>' for p in long)}</article>{AROUND[-1]}"
    assert len(page) > 150_000
    blocks, labels = ht.sample_of(page)
    assert len(blocks) == len(labels) == ht.SAMPLE_BLOCKS and set(labels) == {0, 1}
    assert [len(b.text) for b in ht.sample_of("<p>" + "word " * 50_000)[0]] == [ht.BLOCK_CHARS]
    assert sum(len(b.text) for b in ht.sample_of(("<p>" + "word " * 1000) * 300)[0]) <= ht.SAMPLE_CHARS
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert ht.main_text(df).first().text == " ".join(["A title", *long])


def test_sample_of_few_usable_pages(spark, monkeypatch):
    """Copies and pages without text do not shrink the sample."""
    seen = []
    monkeypatch.setattr(ht, "examples", lambda pages: seen.extend(pages) or [])
    rows = [(f"<script>{i}</script>",) for i in range(400)] + [(f"<p>text {i % 5}",) for i in range(50)] + [(None,), ("",)]
    ht.train(spark.createDataFrame(rows, "html string"), sample_pages=4)
    assert len(seen) == 4 == len({blocks[0].text for blocks, _ in seen})


def test_no_page_to_train_on(spark):
    """Fixed texts teach the labeller where the table has none."""
    empty = spark.createDataFrame([(None,), ("<script>x</script>",)], "html string")
    page = f"<html><body>{AROUND[1]}<article><h1>A title</h1>{P}</article>{AROUND[-1]}"
    assert main(ht.train(empty), page) == " ".join(["A title", *PROSE])


def test_open_elements_and_many_paths_take_linear_time_and_bounded_memory():
    """Twenty thousand open elements; a hundred thousand blocks with a path each."""
    import time
    import tracemalloc

    model = ht.Labeller()
    deep = "".join(f'<div id="d{i}">t{i} ' for i in range(20_000)) + "</span>" * 20_000
    start = time.perf_counter()
    blocks = ht.blocks_of(deep)
    assert len(blocks) == 20_000 and len(blocks[99].path) == 1 + 1 + 100
    assert ht.weak_labels(blocks) is None and len(ht.sample_of(deep)[0]) == ht.SAMPLE_BLOCKS
    assert time.perf_counter() - start < 6  # under two seconds on an idle core
    wide = "".join(f'<div id="c{i}">t{i}</div>' for i in range(100_000))
    tracemalloc.start()
    pages = [ht.blocks_of(wide)]
    assert len(model.labels(pages)[0]) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_reading_by_elements_equals_reading_whole_paths(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()
    pages = [b for r in rows if (b := ht.blocks_of(r.html))] + [ht.blocks_of("x<p>a<div class='a b'><p>c")]
    model = ht.Labeller()
    model.p["W"] += np.random.default_rng(2).standard_normal(model.p["W"].shape).astype(np.float32) * 0.1
    z, _ = model.forward(*ht.inputs(pages))
    got = model.read(pages)
    for i, page in enumerate(pages):
        assert np.abs(got[i, : len(page)] - z[i, : len(page)]).max() < 1e-3
        given = [ht.Block(b.text, b.path, b.linked) for b in page]
        assert np.abs(model.read([given])[0] - got[i, : len(page)]).max() < 1e-3
        assert [b.sides() for b in page] == [b.sides() for b in given]
