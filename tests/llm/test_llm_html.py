import html
import itertools
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from echoless.llm import html_text
from echoless.llm.labelled_pages import LABELLED_PAGES

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def crf():
    examples = [(b, [x.keep for x in b]) for b in map(html_text.leaf_blocks, LABELLED_PAGES)]
    return html_text.train(examples * 3)


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<p>a <b>b<br>c<p>d&amp;e</b>") == ["a b c", "d&e"]
    assert texts('<script>var t="</p>";</script><p>x</p><!-- <p>no</p> --><style>p{}</style>y') == ["x", "y"]
    assert texts('<a title="1 > 0" href=x>in</a>side <ul><li>one<li>two</ul>') == ["inside", "one", "two"]
    assert texts("") == texts("<<<>>>"[:0]) == texts("<div><p></p></div>") == []
    assert texts("<p>cut off &am") == ["cut off &am"] and texts("<p>cut <b off") == ["cut"]
    assert texts("<title>no</title><textarea>no</textarea><p>a\n\t b\xa0c</p>") == ["a b c"]
    assert texts("<script>never closed <p>x") == []
    assert texts('<p class="a>b</p><p>c</p>') != []


def test_no_text_is_swallowed_by_empty_custom_or_foreign_elements():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts('<p>a <svg class="i"/>b <math/>c</p><p>d <svg/> e</p>') == ["a b c", "d e"]
    assert texts("<p>a<svg-icon></svg-icon> b</p><title-bar>c</title-bar><p>d</p><select-box>e</select-box><p>f") == ["a b", "c", "d", "e", "f"]
    assert texts("<p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> shows</p>") == ["as x=1 shows"]
    assert texts('<p>see <object data="f.swf"><param name="a" value="b">the film</object> here</p>') == ["see the film here"]
    assert texts("<p>a <svg><title/><desc>no</desc><style>p{}</style><path d='M0'/><text>one</text><text>two</text></svg> b</p>") == ["a one two b"]
    assert texts("<svg><title>no</title></svg><p>x</p><script>no</script ><p>y</p><style/>no</style><p>z") == ["x", "y", "z"]


def test_paths_end_where_elements_end():
    blocks = html_text.leaf_blocks('<div class="Side-Bar x1"><p>a<p><b>b</div><article id=main>c</article>')
    assert [[t for t, _ in b.path] for b in blocks] == [["div", "p"], ["div", "p", "b"], ["article"]]
    assert blocks[0].path[0][1] == ("side", "bar", "x") and blocks[2].path[0][1] == ("main",)


def test_viterbi_finds_the_best_labels_of_all(crf):
    for page in LABELLED_PAGES:
        blocks = html_text.leaf_blocks(page)[:11]
        scores = [crf.score(b) for b in blocks]

        def total(labels):
            pairs = sum(crf.pairs[2 * a + b] for a, b in zip(labels, labels[1:]))
            return pairs + sum(s for s, y in zip(scores, labels) if y) + crf.first * labels[0]

        best = max(itertools.product((False, True), repeat=len(blocks)), key=total)
        assert total(crf.decode(blocks)) == pytest.approx(total(best))


def test_gradient_is_that_of_the_likelihood(crf):
    import math

    scores, labels = [0.3, -1.2, 0.7, 2.0], [True, False, True, True]

    def likelihood(pairs, first, s):
        def total(y):
            return sum(pairs[2 * a + b] for a, b in zip(y, y[1:])) + sum(v for v, t in zip(s, y) if t) + first * y[0]

        return total(labels) - math.log(sum(math.exp(total(y)) for y in itertools.product((0, 1), repeat=4)))

    at, pairs, first = html_text._gradient(crf, scores, labels)
    now, e = likelihood(crf.pairs, crf.first, scores), 1e-6
    for i in range(4):
        assert (likelihood(crf.pairs, crf.first, [v + e * (k == i) for k, v in enumerate(scores)]) - now) / e == pytest.approx(at[i], abs=1e-4)
        assert (likelihood([v + e * (k == i) for k, v in enumerate(crf.pairs)], crf.first, scores) - now) / e == pytest.approx(pairs[i], abs=1e-4)
    assert (likelihood(crf.pairs, crf.first + e, scores) - now) / e == pytest.approx(first, abs=1e-4)


def test_left_out_layouts(crf):
    """Each page labelled by hand, decoded by a field that has not seen it."""
    right = total = 0
    for i, page in enumerate(LABELLED_PAGES):
        others = [(b, [x.keep for x in b]) for k, p in enumerate(LABELLED_PAGES) if k != i for b in [html_text.leaf_blocks(p)]]
        blocks = html_text.leaf_blocks(page)
        said = html_text.train(others * 3).decode(blocks)
        right += sum(a == b.keep for a, b in zip(said, blocks))
        total += len(blocks)
    assert right / total >= 0.75  # five pages to learn from


def test_everyday_words_do_not_end_an_article(crf):
    for page, text in (
        ("<article><h1>Copyright reform</h1><p>The privacy law and the terms of the copyright bill changed.</p><p>Reply to critics: we subscribe to no party.</p></article>",
         "Copyright reform\n\nThe privacy law and the terms of the copyright bill changed.\n\nReply to critics: we subscribe to no party."),
        ("<header><a>Home</a></header><article><h1>Bees in town</h1><p>They live on roofs.</p></article>", "Bees in town\n\nThey live on roofs."),
        ("<nav><a>Home</a></nav><main><h1>Bees in town</h1><p>They live on roofs.</p></main>", "Bees in town\n\nThey live on roofs."),
        ("<article><h1>Bees in town</h1><p>They live on roofs.</p></article><div class=responses><p>I saw them too, on our own house.</p></div>", "Bees in town\n\nThey live on roofs."),
    ):
        assert html_text.main_text(page, crf) == text


def test_deep_and_unclosed_elements_cost_no_more_than_others(crf):
    for page in ("<div>" * 100_000 + "x", "<div>x" * 20_000, "<b>" * 20_000 + "<div>a</div></i>" * 20_000, "<i><div>" * 20_000 + "</i>y" * 20_000, "<p><b>" * 20_000):
        begin = time.process_time()
        html_text.main_text(page, crf)
        assert time.process_time() - begin < 5
    tracemalloc.start()
    html_text.main_text("<div>" * 100_000 + "x", crf)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_the_way_to_a_deep_block_shows_both_ends():
    (block,) = html_text.leaf_blocks("<article>" + "<div>" * 200 + "<p>x")
    assert len(block.path) == 2 * html_text.SHOWN and block.path[0][0] == "article" and block.path[-1][0] == "p"


def test_articles_of_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert found[r.page_id].text == text and found[r.page_id].n_chars == len(text) and found[r.page_id].url == r.url


def test_nulls_empty_repeated_long_and_no_rows(spark):
    long = "<article>" + "<p>one two three four five six seven eight, nine ten.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", long), (3, "w", "<nav>a</nav>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({n: F.lit(1) for n in ("text", "n_chars", "blocks")})
    found = html_text.extract(df).collect()
    assert sorted((r.page_id is None, r.page_id, r.n_chars > 0) for r in found) == sorted((r[0] is None, r[0], r[0] == 2) for r in rows)
    assert [r.text.count("\n\n") for r in found if r.page_id == 2] == [19_999]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0
