import numpy as np
import pytest

from tidepanel.llm import boosting, html_text
from tidepanel.llm.dom import parse

LONG = "A sentence with enough words in it to look like the running text of an article, and one more. "


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def page(*around, body="<h1>Title here</h1><p>First  line\n of <b>text</b>.</p><p>Second &amp; last &eacute;&#8212;.</p>"):
    before, after = around
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>{before}<article>{body}</article>{after}</body></html>"


WANT = "Title here\nFirst line of text.\nSecond & last é—."


@pytest.mark.parametrize(
    "before, after",
    [
        ("", ""),
        ("<nav><ul><li><a href='/a'>Home</a></li><li><a href=/b>News</a></li></ul></nav>", f"<footer>&copy; {LONG}</footer>"),
        (f"<header><p>{LONG}</p></header>", f"<aside><h3>More</h3><p>{LONG}</p></aside>"),
        (f'<div class="cookie-notice">{LONG}</div>', f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{LONG * 3}</p></div></section>'),
        (f'<div class="ad">{LONG}</div>', f'<div id="sidebar"><p>{LONG}</p></div><form action=/s><label>{LONG}</label><input></form>'),
        ("<script>var t = '<p>' + \"</p>\";</script><!-- <p>no</p> -->", f'<div class="footer">{LONG}</div>'),
    ],
)
def test_article_stays_and_the_rest_goes(model, before, after):
    assert model.texts([page(before, after)]) == [WANT]


def test_parts_within_the_article_go(model):
    inside = f"<h1>Title here</h1><p>{LONG}</p><div class='ad'>Buy this now</div><p>{LONG}</p><aside class='related'><a href=/x>Read more here</a></aside><p>End.</p>"
    assert model.texts([page("", "", body=inside)])[0].split("\n") == ["Title here", LONG.strip(), LONG.strip(), "End."]


def test_markup_that_is_never_closed(model):
    messy = "<h1>Title here</h1><p><b>First line<br><p>Second line<li>third<p>fourth"
    text = model.texts([f"<html><body><nav><a href=/>Home</a></nav><article>{messy}"])[0]
    assert text.split("\n")[:3] == ["Title here", "First line", "Second line"]


def test_awkward_pages(model):
    deep = "<div>" * 5000 + "<p>deep text" + "</div>" * 5000
    pages = [None, "", "   ", "<!---->", "<!-- never closed", "<p", "plain words only", deep, "<article><p>" + "word " * 50000, "</p></p></div>"]
    texts = model.texts(pages)
    assert texts[:6] == [""] * 6
    assert len(texts) == len(pages) and texts[8] == ("word " * 50000).strip()
    assert model.texts([]) == []


def test_decoding_never_contradicts_and_is_best():
    random = np.random.default_rng(1)
    found = html_text.units(parse("<div><p>a<p>b</div><div><div><p>c</p>d</div></div>"))
    number = {id(u): i for i, u in enumerate(found)}
    for _ in range(50):
        p = random.uniform(0.05, 0.95, len(found))
        chosen = html_text.decode(found, p)
        assert all(u.parent is None or not c or chosen[number[id(u.parent)]] for u, c in zip(found, chosen))
        best = -np.inf
        for bits in range(1 << (len(found) - 1)):
            pick = np.array([True, *[bool(bits >> k & 1) for k in range(len(found) - 1)]])
            if all(u.parent is None or not c or pick[number[id(u.parent)]] for u, c in zip(found, pick)):
                best = max(best, np.where(pick, np.log(p), np.log1p(-p)).sum())
        assert np.isclose(np.where(chosen, np.log(p), np.log1p(-p)).sum(), best)


def test_held_out_generated_pages(model):
    maker = html_text._Maker(1234)
    right = total = 0
    for _ in range(150):
        found = html_text.units(maker.page())
        chosen = html_text.decode(found, model.trees.probability(html_text.table_of(found, model.odds)))
        leaves = [(u.kept, c) for u, c in zip(found, chosen) if u.texts]
        right, total = right + sum(a == b for a, b in leaves), total + len(leaves)
    assert right / total > 0.95


def test_trees_learn_a_rule():
    random = np.random.default_rng(2)
    x = random.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    made = boosting.fit(x[:1500], y[:1500], np.ones(1500), columns=1.0)
    assert ((made.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_rows(spark, model):
    rows = [(1, "u", page("", ""), "t", 1), (1, "u", page("", ""), "t", 1), (None, None, None, None, None), (3, "v", "", "t", 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in html_text.extracted(frame, model).collect())
    assert got == [("1", "u", WANT, len(WANT)), ("1", "u", WANT, len(WANT)), ("3", "v", "", 0), ("None", "", "", 0)]
    assert html_text.extracted(frame.limit(0), model).count() == 0


def test_a_long_attribute_with_brackets_stays_in_its_tag():
    from tidepanel.llm import dom

    for quote in "\"'":
        value = "<p>no</p>" * 20_000
        root = parse(f"<div data-props={quote}{value}{quote} id=a title=it's><p>yes</p></div>")
        (div,) = root.parts
        assert div.attrs["data-props"] == value and [x.tag for x in div.parts] == ["p"] and div.parts[0].parts == ["yes"]
    never = "<a x='\">" * 60_000  # every value is open to the next tag's quote, the last one for ever
    assert parse(never + "end").parts
    ends = dom._TagEnds("<a x='" + "<b y=\">" * 50_000)
    assert ends.after(2) == 13


def visible(page):
    """All text of a page's tree, in order."""
    from tidepanel.llm.dom import parse

    def walk(node):
        for part in node.parts:
            if isinstance(part, str):
                yield part
            else:
                yield from walk(part)

    return "|".join(t.strip() for t in walk(parse(page)) if t.strip())


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>İ</p><STYLE>x{}</STYLE><p>rest</p>", "İ|rest"),
        ("<p>a</p><svg width=1 /><p>rest</p>", "a|rest"),
        ('<p>a</p><svg viewBox="0 0"/><p>rest</p>', "a|rest"),
        ("<p>a</p><svg width=1/><path/></svg><p>rest</p>", "a|rest"),
        ("<p>a</p><svg><text>in</text></svg><p>rest</p>", "a|rest"),
        ("<p>a</p><!--><p>rest</p>", "a|rest"),
        ("<p>a</p><!---><p>rest</p>", "a|rest"),
        ("<p>a</p><!-- x --!><p>rest</p>", "a|rest"),
        ("<p>a</p><!-- x -> y > z --><p>rest</p>", "a|rest"),
        ("<p>a</p><!----><p>rest</p>", "a|rest"),
        ("<script>s = '</scripts>'; t = '</script-x>'</script><p>rest</p>", "rest"),
        ("<script>s</SCRIPT ><p>rest</p>", "rest"),
        ("<script>never closed </scripts", ""),
    ],
)
def test_nothing_after_odd_markup_is_lost(page, want):
    assert visible(page) == want


def test_long_attribute_values_count_whole():
    from tidepanel.llm.html_text import tokens

    assert "comments" in tokens({"class": "x1 " * 400 + "comments"})
