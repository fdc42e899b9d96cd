import os

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import urls as U
from folio.operators import graph as G
from folio.queries import ORACLES, QUERIES
from folio.sources.html import Extractor, hiding, strip_comments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows_of(names, rows):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    said = duck.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([x[0] for x in said.description], said.fetchall())


#: The driver's pages hold no structured data, payloads, images or hidden text; fixtures test these.
NOTHING = {"page_facts", "page_faq", "page_gaps", "page_latent", "page_media", "page_payload_blocks", "page_payload_links", "page_served_text"}
#: One row a page, or an order of its rows from the first on.
A_PAGE = {"page_artifact", "page_content_hash", "page_manifest", "page_rendered", "page_signals", "page_summaries", "decision_factors"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    pages = {r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()}
    if name in NOTHING:
        assert rows == []
    elif name in A_PAGE:
        assert sorted(r.page_id for r in rows) == sorted(pages)
    elif name == "adjacent_echo":
        assert len(rows) == 200 and all(r.kept > 0 for r in rows)
    else:
        assert {r.page_id for r in rows} == pages


def test_clean(spark):
    df = spark.createDataFrame([("a​b  c‮\n d ",), ("",)], "t string").select(*T.clean_report("t"))
    assert [tuple(r) for r in df.collect()] == [("ab c d", 2, True, True), ("", 0, False, False)]


def test_tokens(spark):
    cases = {"": 0, "a": 1, "hello world": 3, "漢字": 2, "abc漢": 2}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.tokens("t").alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_urls(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(U.canonical_url(F.lit("HTTP://Ex.com?b=2&utm_source=q&a=1#f"))) == "http://ex.com/?a=1&b=2"
    assert one(U.absolute(F.lit("../x"), F.lit("http://e.com/a/b"))) == "http://e.com/x"
    assert one(U.absolute(F.lit("http://e.com/a/./b/../../c/."), F.lit(""))) == "http://e.com/c/" and one(U.absolute(F.lit("..?q=../x"), F.lit("http://e.com/a/b/c"))) == "http://e.com/a/?q=../x"
    assert one(U.absolute(F.lit("mailto:a..b@c"), F.lit("http://e.com/"))) == "mailto:a..b@c" and one(U.absolute(F.lit(""), F.lit("http://e.com/"))) == ""
    assert one(U.media_filename(F.lit("m_001"), F.lit("http://e.com/a.PNG?x"))) == "m_001.png"


def test_html_reconstructs_open_formatting():
    e = Extractor("<p><b>a<br><p>c</p>")
    assert [(f["tag"], f["text"]) for f in e.out["fragments"]] == [("b", "a"), ("b", "c")]
    assert e.signals["paragraphs"] == 0


def test_html_quarantines_hidden_text():
    e = Extractor('<style>.x{display:none}</style><p>seen</p><div class=x>one</div><p hidden>two</p><details><summary>s</summary>three</details>')
    assert [f["text"] for f in e.out["fragments"]] == ["seen"]
    assert [(x["text"], x["reason"]) for x in e.out["latent"]] == [("one", "display-none"), ("two", "hidden-attribute"), ("s three", "closed-details")]


def test_css():
    assert hiding("opacity: 0") == "opacity-zero" and hiding("color:red;background:red") == "same-colour" and hiding("color:red") == ""
    assert strip_comments("a/*x*/b/*c") == "ab"


def test_echoes(spark):
    cases = {"ABCABC": "ABC", "ABAC": "ABAC", "AA": "A", "AAA": "AA", "AAAA": "AA", "AAAAA": "AAA", "ABABAB": "ABAB", "ABABA": "ABA"}
    rows = [(p, i, k) for p, keys in enumerate(cases) for i, k in enumerate(keys)]
    out = G.echoes(spark.createDataFrame(rows, "page_id long, ord long, key string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.page_id, r.ord)):
        got[r.page_id] = got.get(r.page_id, "") + r.key
    assert [got[p] for p in range(len(cases))] == list(cases.values())


def test_latent_text_is_in_no_block(spark):
    pages = spark.createDataFrame([(1, "http://e.com/", "<h1>Title</h1><p>A visible paragraph.</p><p style='display:none'>secret words</p>")], "page_id long, url string, html string")
    from folio.sources.html import extract

    found = extract(pages)
    assert [r.text for r in G.blocks(found).orderBy("ord").collect()] == ["Title", "A visible paragraph."]
    assert found.first().latent[0].text == "secret words"


def test_stream_equals_batch(spark, tmp_path):
    from folio.streaming import capture

    rows = [(1, "a", k, float(k % 3)) for k in range(9)] + [(2, "b", 1, 0.5)]
    schema = "page long, path string, cp long, opacity double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    q = capture.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["page", "path"], ["cp"], "opacity", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    batch = capture.merged(spark.createDataFrame(rows, schema), ["page", "path"], ["cp"], "opacity")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


PAGE = """<html><head><title>The shop</title><meta name=description content="What we sell."></head><body>
<header><a href="/home">Home page of the shop</a><span>Open from nine to five</span></header>
<nav><a href="/a">First</a> <a href="/b">Second</a></nav>
<main><h1>Apples</h1><p>A paragraph about apples that is long enough to be read as prose.</p><h3>Prices</h3><p>Short one.</p><p><a href="/opt"><code>--cookie-jar</code></a></p>
<form action="/search" method="post"><input name="q" required><input type="submit"></form><button disabled>Buy it</button>
<details><summary>More</summary>Hidden words.</details></main>
<footer>Rua da Cozinha 4, Lisboa</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    from folio.sources.html import extract
    from folio.sources.store import written

    return written(extract(spark.createDataFrame([(1, "http://e.com/x/", PAGE)], "page_id long, url string, html string")), "page")


def test_chrome_comes_after_content(spark, page):
    rows = G.blocks(page).orderBy("ord").collect()
    assert [(r.region, r.type, r.level, r.text) for r in rows] == [
        ("main", "heading", 1, "Apples"), ("main", "paragraph", None, "A paragraph about apples that is long enough to be read as prose."), ("main", "heading", 2, "Prices"), ("main", "paragraph", None, "Short one."), ("main", "code", None, "--cookie-jar"), ("main", "paragraph", None, "Buy it"),
        ("footer", "paragraph", None, "Rua da Cozinha 4, Lisboa"), ("header", "paragraph", None, "Open from nine to five"),
    ]
    assert [r.block_id for r in rows] == [f"b_{k:03d}" for k in range(8)]
    from folio.operators import emit

    assert [r.text for r in emit.furniture(G.blocks(page)).orderBy("ord").collect()] == ["Rua da Cozinha 4, Lisboa", "Open from nine to five"]


def test_artifact_has_all_sections(spark, page):
    from folio.operators import emit, recover

    out = emit.artifact(None, page).first()
    md = out.markdown
    assert md.startswith("---\nurl: \"http://e.com/x/\"\ntitle: The shop\n") and "outcome: ok\n" in md and "latent_blocks: 1  # hidden content, not included below\n" in md
    order = ["# Apples\n", "## Prices\n", "## What a visitor can do here\n\n### Form: —\n\n- Submits `POST` to `http://e.com/search`\n- Fields:\n  - `q` (text, required) — q\n", "### Buttons\n\n- Buy it (disabled)\n", "## Site navigation\n\n- [Home page of the shop](http://e.com/home)\n- [First](http://e.com/a)\n- [Second](http://e.com/b)\n", "## Header and footer\n\n- Rua da Cozinha 4, Lisboa\n- Open from nine to five\n", "## Content not shown on this page\n\n- **More** (details) — "]
    places = [md.find(x) for x in order]
    assert -1 not in places and places == sorted(places) and "Hidden words" not in md
    hidden = emit.latent_markdown(recover.latent(page)).first().md
    assert "## Behind: More\n\n- `[h_001]` More Hidden words. <!--" in hidden


def test_page_titles_equal_their_sql_on_odd_markup(spark, tmp_path):
    import duckdb

    odd = ["<title>cut &amp;&amp</title>", "<title>&amp;lt; &lt &copy; &#39;&quot;&gt;</title>", "<TITLE>\n a\u00a0\u3000b\x0b </TITLE><title>c</title>", "<title lang=en>d</title>", "<!--<title>e</title>-->", "<title>open", "<title></title>", "<title><b>f</b></title>", "<svg><title>g</title></svg>", "", None]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").withColumn("url", F.lit("http://e.com/")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["page_titles"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLES["page_titles"]).fetchall()) and got[0][1] == "cut &&amp" and got[-1][1] is None


def test_titles_and_summaries(spark):
    from folio.sources.html import extract

    pages = [(1, "u", "<title>T</title><meta name=description content=D><p>x y</p>"), (2, "u", "<meta property='og:title' content=O><p>" + "long words of a page " * 20 + "</p>"), (3, "u", "<h2>Head</h2><p>short text</p>"), (4, "u", "")]
    found = extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    out = {r.page_id: (r.title, r.summary) for r in G.titles(found, G.blocks(found)).collect()}
    assert out[1][0] == "T" and out[2][0] == "O" and out[2][1] == ("long words of a page " * 20)[:400].strip() + "…" and out[3] == ("Head", "Head") and out[4] == ("", "")


def test_folded_prose():
    prose = "Words of a specification that is folded away until somebody asks for it, with all that a reader would want to know about it."
    cases = {
        f"<details>{prose}</details>": (1, len(prose)), f"<details open>{prose}</details>": (0, 0), f"<nav aria-hidden=true>{prose}</nav>": (0, 0), f"<div aria-hidden=true><a>{prose}</a></div>": (0, 0), "<details>short</details>": (0, 0),
        f"<div id=p>{prose}</div><button aria-expanded=false aria-controls=p>Specs</button>": (1, len(prose)), f"<div id=p>{prose}</div><button aria-expanded=false aria-controls=p>Accept cookies</button>": (0, 0),
        f"<details>{prose}<details>{prose}</details></details>": (1, 2 * len(prose) + 1),
    }
    for html, want in cases.items():
        s = Extractor(html).signals
        assert (s["folded_controls"], s["folded_chars"]) == want, html


def test_question_sets(spark, tmp_path):
    import json

    from folio.plans import benchmark as B

    (tmp_path / "set.json").write_text(json.dumps({"url": "u", "name": "n", "questions": [{"ask": "a?", "facts": ["x"]}, {"id": "own", "ask": "b?"}]}, indent=1))
    rows = B.question_set(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.ask, r.facts) for r in rows] == [("own", "b?", None), ("q01", "a?", ["x"])]
    assert B.tasks(B.question_set(spark, str(tmp_path))).count() == 4


def test_script_literals_and_corpus(spark):
    from folio.plans import benchmark as B

    script = "var a='Words of a title'; // 'not this one here'\n/* \"nor this one\" */ b(`two\nlines of it`, \"x\", 'abc_def_ghi_jkl', 'unfinished words\n)"
    rows = spark.createDataFrame([(1, 1, "script", script), (1, 0, "text", "plain")], "page_id long, seq int, kind string, body string")
    r = B.corpus(rows, 40).first()
    assert (r.text, r.saturated, r.n_text, r.n_script) == ("plain\nWords of a title\ntwo\nlines of it\nunfinished words"[:40], True, 1, 3)


def test_raw_context(spark):
    from folio.plans import benchmark as B

    r = spark.createDataFrame([("é" * 100,), ("ab",)], "h string").select(*B.raw_context(F.col("h"), 10)).collect()
    assert r[0].truncated and r[0].text.startswith("é" * 14 + "\n\n[") and not r[1].truncated and r[1].text == "ab"


def test_confirmed_by_anchor(spark):
    from folio.operators import retrieve as R

    wanted = {"the old miller counted": True, "old miller": False, "longwordhere": True, "wordhere": False, "ngwordhere is": True, "no such words at all": False, "“quoted—words” are here": True}
    corpus = spark.createDataFrame([("and the OLD miller counted sacks",), ("a verylongwordhere is in it",), ('say "quoted-words" are here now',), (None,)], "b string")
    out = R.confirmed(spark.createDataFrame([(k,) for k in wanted], "t string"), corpus, "t", "b").collect()
    assert {r.t: r.confirmed for r in out} == wanted
