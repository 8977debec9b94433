import itertools

import numpy as np
import pytest

from pixelgrove.llm.html_text import blocks, extract, fit, labelled_pages, labels, main_text, viterbi

SCHEMA = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return fit(labelled_pages(250))


def page(body, end="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t=\"</p><article>no\";</script></head><body><nav><ul><li><a href='/a'>Menu</a></li><li><a href='/b'>More</a></li></ul></nav>{body}<footer>&copy; site &middot; Footer text.</footer>{end}"


ARTICLE = "<article><h1>The  title &amp; more</h1><p>First\n paragraph&nbsp;here &lt;b&gt;.</p><p><b>Second one.<br><p>Third&#33; <a href='x'>link</a> end.</article>"
WANT = "The title & more\nFirst paragraph here <b>.\nSecond one.\nThird! link end."


def test_articles_without_their_surroundings(model):
    around = [
        "<div class=\"ad\">Buy this now.</div>", "<!-- <p>hidden</p> --><aside class='sidebar'><h3>Related</h3><ul><li><a href='/c'>Other</a></li></ul></aside>",
        "<form id='search'><label>Find</label><input><button>Go</button></form>", "<div class='cookie-notice'>We use cookies here.</div>", "<header class='site-header'><p>The Site</p></header>",
    ]
    for k in range(len(around) + 1):
        for some in itertools.combinations(around, k):
            assert main_text(page("".join(some) + ARTICLE), model) == WANT
    assert main_text(page(ARTICLE + "<section class='comments'><h3>Comments</h3><div class='comment'><p>I like it a lot.</p></div></section>"), model) == WANT


def test_broken_pages(model):
    assert main_text(page("<article><p>Only text to the end", ""), model).startswith("Only text to the end")
    assert main_text(None, model) == main_text("", model) == main_text("<p", model) == ""
    assert main_text(page(""), model) == ""
    assert main_text(page("<article><p>a<script>x < y && '</p>'</script>b</p></article>"), model) == "ab"
    assert main_text(page("<article><p>cut &am</p><p>&quot;q&quot; &unknown; &amp</p></article>"), model) == "cut &am\n\"q\" &unknown; &"


def test_quotes_count_only_where_a_value_begins(model):
    texts = ["First text of the article here.", "Second text, it's longer than that.", "Third and last text of it."]
    want = "The title\n" + "\n".join(texts)
    for tag in ("<p class=foo'>", '<p title=5" class=x>', "<p don't>", "<p a\"b'c>", "<p =\">", "<p title='a > \"b' id=x>", "<p a = 'x'b=\"y\">", "<p data-x=\"it's\">"):
        assert main_text(page("<article><h1>The title</h1>" + "".join(f"{tag}{t}</p>" for t in texts) + "</article>"), model) == want
    # a tag that begins in a text ends at its next >, whatever quotes it holds
    assert main_text(page(f"<article><h1>The title</h1><p>First a<b then it's</p><p>{texts[1]}</p><p>{texts[2]}</p></article>"), model).endswith("\n".join(texts[1:]))
    assert [b.text for b in blocks("<p>a<!-->b<!---->c<!-- > -- >d--!>e")] == ["abce"]


def test_pages_written_by_hand(model):
    from hand_pages import PAGES

    missing = more = total = 0
    for html, text in PAGES:
        found, want = main_text(html, model).split("\n"), text.split("\n")
        missing, more, total = missing + len(set(want) - set(found)), more + len(set(found) - set(want)), total + len(want)
    assert missing == 0 and more <= 0.1 * total


def test_held_out_made_pages(model):
    right = [labels(found, model) == y for found, y in labelled_pages(100, seed=99)]
    assert np.mean(right) > 0.95


def test_viterbi_like_enumeration():
    r = np.random.default_rng(2)
    for n in (1, 2, 5):
        emit, trans = r.normal(size=n), r.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=n), key=lambda s: sum(e * x for e, x in zip(emit, s, strict=True)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
        assert viterbi(emit, trans) == list(best)


def test_rows_nulls_and_empty_table(spark, model):
    long = page("<article>" + "<p>Long paragraph of words.</p>" * 20_000 + "</article>")
    rows = [(1, "u", page(ARTICLE), "x"), (None, None, page(ARTICLE), None), (2, "v", None, "x"), (3, "w", "", "x"), (3, "w", "", "x"), (4, "z", long, "x")]
    out = extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted([(r.page_id, r.text) for r in out], key=str)[:5] == sorted([(1, WANT), (None, WANT), (2, ""), (3, ""), (3, ""), (4, "\n".join(["Long paragraph of words."] * 20_000))], key=str)[:5]
    assert extract(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_blocks_know_their_ancestors():
    found = blocks("<div class='Side-Bar ad'><ul><li>a<li>b</ul></div><p>c<div>d</div>e")
    assert [b.text for b in found] == ["a", "b", "c", "d", "e"]
    assert found[1].path == ("div", "ul", "li") and {"side", "advert"} <= set(found[0].signs)
