import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import emit as M
from folio.operators import graph as G
from folio.operators import reading_order as L
from folio.operators import recover as V
from folio.sources import structured as S
from folio.sources.html import extract

LD = {
    "@type": "Organization", "name": " Acme\u200b  Works ", "secret": "no", "foundingDate": 1999, "keywords": ["a", "b", True],
    "address": {"addressLocality": "Oslo", "x": 1}, "offers": [{"@type": "Offer", "price": 9.5}, {"@type": "Offer", "price": 9.5}],
    "mainEntity": [{"@type": "Question", "name": "Why so?", "acceptedAnswer": [{"text": ""}, {"text": "It is   agreed."}]}, {"@type": "Question", "name": "Empty?"}],
}
STATE = {"a": ["The whole story of this place", "/route/x", "the whole  STORY of this place", "short", "https://x.example/long path here"], "l": ["Ethereum", "https://e.example/a", "??", "https://e.example/b"]}
PAGE = f"""<html><head><title>The Title of it all</title><script type="application/ld+json">{json.dumps(LD)}</script><script type="application/ld+json">{{broken</script></head>
<body><nav><a href="/a">A link of the menu</a></nav><main><h1>First *head*</h1><p>A paragraph with a_word and _edge.</p><ul><li>one</li><li>two</li></ul><blockquote>said</blockquote>
<img src="i.png" alt="a view of hills"><img src="i.png" alt="again"><img src="d.png" alt=""><details><summary>More</summary>folded words</details>
<div aria-hidden="true">Hidden sentence number one is here. A sentence that nobody has seen so far.</div></main>
<script type="application/json" id="__NEXT_DATA__">{json.dumps(STATE)}</script></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, "https://s.example/p/", PAGE), (2, "https://s.example/q", ""), (3, None, None)]
    return extract(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_facts_take_whitelisted_fields_once(found):
    got = [tuple(r) for r in S.facts(found).select("page_id", "type", "field", "value").orderBy("ord").collect()]
    assert got == [(1, "Offer", "price", "9.5"), (1, "Organization", "addressLocality", "Oslo"), (1, "Organization", "foundingDate", "1999"), (1, "Organization", "keywords", "a, b, true"), (1, "Organization", "name", "Acme Works")]


def test_questions_need_an_answer(found):
    assert [tuple(r) for r in S.faq(found).select("question", "answer").collect()] == [("Why so?", "It is agreed.")]


def test_numbers_as_text():
    assert [S.leaf(x) for x in (1.0, 0.00001, 2.50, False, None, {"a": 1}, [" x ", "", 3])] == ["1", "0.00001", "2.5", "false", "", "", "x, 3"]


def test_payloads_give_prose_and_links_once(found):
    assert [r.text for r in S.payload_texts(found).collect()] == ["The whole story of this place"]
    got = sorted((r.label, r.href) for r in V.payload_links(found, G.links(found)).collect())
    assert got == [("Ethereum", "https://e.example/a"), ("short", "https://x.example/long path here")]
    assert [r.text for r in V.payload_blocks(found, G.blocks(found)).collect()] == ["The whole story of this place"]
    said = G.blocks(found).select("page_id", F.lit("The whole story of THIS place").alias("text"))
    assert V.payload_blocks(found, said).count() == 0


def test_media_resolve_once_and_skip_decoration(found):
    assert [(r.src, r.alt, r.source, r.meaningful) for r in V.media(found).collect()] == [("https://s.example/p/i.png", "a view of hills", "alt", True)]


def test_gaps_point_at_hidden_text(spark, found):
    (gap,) = V.page_gaps(found).collect()
    assert (gap.label, gap.reason, len(gap.latent_ids)) == ("More", V.FOLDED, 1)
    controls = spark.createDataFrame([(1, "More", "tab", False), (1, "Other", "tab", None), (1, "Shown", "tab", True)], "page_id long, label string, kind string, open boolean")
    got = {r.label: (r.reason, len(r.latent_ids)) for r in V.gaps(controls, V.latent(found)).collect()}
    assert got == {"More": (V.FOLDED, 1), "Other": (V.FOLDED_ABSENT, 0)}


def test_served_text_needs_three_proofs(spark):
    line = "This is sentence number {} of the page"
    served = [(1, i, line.format(i), "opacity-zero") for i in range(4)] + [(1, 9, line.format(3), "aria-hidden"), (2, 0, line.format(0), "aria-hidden"), (1, 10, line.format(8), "display-none")]
    served = spark.createDataFrame(served, "page_id long, seq int, text string, reason string")
    seen = spark.createDataFrame([(p, line.format(i) + ".") for p in (1, 2) for i in range(3)], "page_id long, text string")
    assert [tuple(r) for r in V.adopted(served, seen).collect()] == [(1, 3, line.format(3), "opacity-zero", 3)]


def test_rendering(found):
    (page,) = M.rendered(G.blocks(found)).collect()
    assert page.markdown.startswith("# First \\*head\\*\n\nA paragraph with a_word and \\_edge.\n\n- one\n- two\n\n> said\n\n"), page.markdown
    assert "<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n" in page.html and page.plain.startswith("First *head*\n")


def test_markdown_escapes_line_starts_only(spark):
    cases = {"# a # b": "\\# a # b", "1. x 2. y": "1\\. x 2. y", "12. x": "12. x", "  - a-b": "  \\- a-b", "a|b[c]`d`": "a\\|b\\[c\\]\\`d\\`", "é_é _x a__b": "é_é \\_x a\\_\\_b", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.markdown_escape("t").alias("m")).collect()
    assert {r.t: r.m for r in got} == cases


def page(boxes, width=1000.0):
    x, y, w, h = (np.array(v, float) for v in zip(*boxes))
    n = len(boxes)
    return L.Page(x, y, w, h, np.full(n, 16.0), np.zeros(n), np.zeros(n), width)


def test_columns_are_read_down_and_rows_across():
    head = [(0, 0, 900, 40)]
    two = [(c, y, 400, 50) for y in (100, 160, 220) for c in (0, 500)]
    assert page(head + two).order()[0] == [0, 1, 3, 5, 2, 4, 6]
    # a gutter of 400 beside gaps between rows of 80, then of 580
    assert page([(0, 0, 100, 20), (500, 0, 100, 20), (0, 100, 100, 20), (500, 100, 100, 20)]).order()[0] == [0, 2, 1, 3]
    assert page([(0, 0, 100, 20), (500, 0, 100, 20), (0, 600, 100, 20), (500, 600, 100, 20)]).order()[0] == [0, 1, 2, 3]


def test_bands_split_at_the_widest_gaps_only():
    parts, gap = L.bands(np.array([0.0, 10, 30, 100]), np.array([5.0, 25, 40, 110]), 1)
    assert [p.tolist() for p in parts] == [[0, 1, 2], [3]] and gap == 60
    assert L.bands(np.array([0.0, 3]), np.array([5.0, 8]), 0.5)[1] == 0


def test_pages_that_never_scroll_follow_checkpoints():
    p = page([(0, 10, 10, 10)] * 8)
    p.checkpoint = np.array([7.0, 6, 5, 4, 3, 2, 1, 0])
    assert p.order()[:3] == ([7, 6, 5, 4, 3, 2, 1, 0], 0.55, "checkpoint")


def test_served_fragments_keep_document_order(found):
    got = L.reading_order(L.laid_out(G.fragments(found))).orderBy("page_id", "ord").collect()
    assert [r.seq for r in got] == sorted(r.seq for r in got) and {r.basis for r in got} == {"geometry"}


def test_canvas_ladder(spark):
    rows = [(1, "/a", "fall back", "lab", 0.5, False, "ocr", None, None), (1, "/b", "", "label", 0.5, False, None, None, None), (1, "/c", None, None, 0.5, False, "ocr text", None, True),
            (1, "/d", None, None, 0.5, False, "ocr text", None, True), (1, "/e", None, None, 0.5, False, "ocr text", None, False), (1, "/f", None, None, 0.1, False, "ocr text", None, True), (1, "/g", None, None, 0.9, False, "", "vision text", None)]
    rows = spark.createDataFrame(rows, "page_id long, path string, fallback string, label string, viewport_share double, uniform boolean, ocr string, vision string, confirmed boolean")
    scenes = spark.createDataFrame([(1, "the scene")], "page_id long, text string")
    assets = spark.createDataFrame([(1, "u", "asset text")], "page_id long, url string, text string")
    got = [(r.path, r.source, round(r.score, 3)) for r in V.canvases(rows, scenes, assets).orderBy("path").collect()]
    assert got == [("/a", "fallback", 0.98), ("/b", "fallback", 0.9), ("/c", "scene", 0.8), ("/d", "scene", 0.75), ("/e", "ocr", 0.3), ("/f", None, 0.0), ("/g", "vision", 0.28)]
