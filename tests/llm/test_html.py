import html
import re
import tracemalloc

import pytest

from pointlake.llm.html import deduce_templates, extract_main_text, html_query, main_text, occurrence_classes, scan
from tests.llm.conftest import SF

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><header>Site</header>'
    '<nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div>{body}<aside>Side</aside><form>Go<input></form>'
    '<div id="comments"><article class="comment"><p>Reader</article></div><footer>&copy; me</footer></body></html>'
)
ARTICLE = "<article><header><h1>A &amp; B</h1></header><p>One<br>two <b>three\n\t four<p>five<ul><li>a<li>b</ul><!-- no --><div class='ad'>buy</div></article>"
TEXT = "A & B\nOne two three four\nfive\na\nb"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_given_pages_against_a_plain_reading(spark):
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = _article(r["html"])
        assert found[r["page_id"]] == (text, len(text))


def test_parts_of_a_page(spark):
    rows = [(i, f"https://H.example:80/{i}", PAGE.format(body=ARTICLE)) for i in range(4)]
    rows += [(10, None, None), (11, "nonsense", ""), (12, "http://o.example/", "just text &lt;here"), (0, rows[0][1], rows[0][2])]
    got = extract_main_text(_pages(spark, rows).selectExpr("*", "'clash' AS host")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(
        [(i, TEXT) for i in (0, 0, 1, 2, 3)] + [(10, ""), (11, ""), (12, "just text <here")]
    )


def test_template_text_is_left_out_where_there_is_no_article(spark):
    body = "<div class='content with-sidebar'><p>Own text {i}</div><div class='x'>On every page</div>"
    rows = [(i, "http://h.example/", PAGE.format(body=body.format(i=i))) for i in range(8)]
    got = extract_main_text(_pages(spark, rows)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Own text {i}" for i in range(8)}
    # Two pages may have a text in common.
    few = extract_main_text(_pages(spark, rows[:2])).collect()
    assert {r["text"] for r in few} == {f"Own text {i}\nOn every page" for i in range(2)}


def test_template_has_the_article_slot(spark):
    rows = [(i, "http://h.example/", PAGE.format(body=ARTICLE)) for i in range(3)]
    (template,) = deduce_templates(occurrence_classes(_pages(spark, rows))).collect()
    assert template["host"] == "h.example" and template["articles"] == [">html>body.no.sidebar>article"] or template[
        "articles"
    ] == [">html>body>article"]


@pytest.mark.parametrize("cut", range(0, len(PAGE.format(body=ARTICLE)), 7))
def test_a_page_may_end_anywhere(cut):
    page = PAGE.format(body=ARTICLE)[:cut]
    tokens, _ = scan(page)
    assert all(n >= 0 for n in tokens.values())
    assert set(main_text(page, set(), set()).rstrip("<").split()) <= set(TEXT.split()) | {"A", "&", "&a", "&am"}


def test_empty_table(spark):
    assert extract_main_text(_pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def test_a_very_long_page():
    assert main_text("<article><p>" + "word " * 400_000, set(), set()).count("word") == 400_000


@pytest.mark.parametrize("deep", [10, 60, 63, 64, 65, 66, 100, 2000])
def test_deep_nesting_changes_nothing(deep):
    """Frames, headers and articles are seen however many elements stand around or inside them."""
    open_, close = "<div>" * deep, "</div>" * deep
    page = (
        f"{open_}<nav>Menu</nav><header>Site</header><article><header><h1>A</h1></header>{open_}<p>One<div class='advert'>{open_}buy{close}</div>"
        f"<p>two{close}</article><footer>{open_}End{close}</footer>{close}"
    )
    assert main_text(page, set(), set()) == "A\nOne\ntwo"
    plain = f"{open_}<div class='masthead'>{open_}Site{close}</div><p>One<p>two{close}"
    assert main_text(plain, set(), set()) == "One\ntwo"


def test_memory_of_deep_pages_is_linear():
    tracemalloc.start()
    peaks = []
    for deep in (5_000, 20_000):
        tracemalloc.reset_peak()
        tokens, pieces = scan("<div>" * deep + "text")
        assert sum(tokens.values()) == 2 * deep and pieces[-1].text() == "text"
        peaks.append(tracemalloc.get_traced_memory()[1])
        del tokens, pieces
    tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 60e6


def test_quotes_only_count_after_an_equals_sign():
    page = "<article><p class=don't>One<p title=\"a > b\" it's>two<p title = 'c > d'>three<p \"odd>four</article>"
    assert main_text(page, set(), set()) == "One\ntwo\nthree\nfour"
