"""HTML extraction: small hand-written golden pages."""

from weft.functions import markup
from weft.functions.text import decode_entities
from weft.operators import html as H

SMALL = """<html><head><title>Harbour log</title></head><body><h1>Arrivals</h1><p>Two ships came in.</p>
<ol><li>Alma</li><li>Bree</li><li>Cora</li></ol><a href="https://log.example/alma">Alma's page</a></body></html>"""

GOLDEN = """<!DOCTYPE html><html><head><title>T1
x</title><title>T2</title></head><body>
<h2>Second</h2><h1>First</h1><h3></h3>
<p>a</p><p>b</p>
<p>x&nbsp;y\t z

w</p>
<script>var t="</p>";</script><style>p{}</style>
<ul><li>one<ul><li>inner</li></ul></li><li>two</ul>
<ol><li>o1<li>o2</ol>
<dl><dt>term<dd>def<div><dt>skip</dt></div></dl>
<ul></ul>
<table><tr><th>H1</th><th>H2</th></tr><tr><td>a</td><td>b<table><tr><td>n1</td></tr></table></td></tr><tr></tr></table>
<a href="x.pdf?a=1">pdf</a><a href=""><img src=x></a><a href="/a?f=x.pdf">q</a><a href="a">rel</a>
<p><b>unclosed<br><p>next
</body></html>"""


def _doc(spark, html):
    pages = spark.createDataFrame([(1, "https://x.com/Docs/", html)], "page_id long, url string, html string")
    return H.documents(pages).collect()[0]


def test_small_page(spark):
    d = _doc(spark, SMALL)
    assert d.title == "Harbour log"
    assert [h["content"] for h in d.headings] == ["Arrivals"] and [p["content"] for p in d.paragraphs] == ["Two ships came in."]
    assert d.lists[0]["items"] == ["Alma", "Bree", "Cora"] and [a["href"] for a in d.links] == ["https://log.example/alma"]


ODD = """<body><ul><li><svg><path d="M0"/></svg>One</li><li>Two</li><li>Three</li></ul><ul><li><div>A</li><li>B</li></ul><ul><div><li>x</li><li>y</li></div></ul>
<h1><div>A</div><div>B</div></h1><h2><p>x</p>tail</h2><a title="x href=evil y">no</a><a class="x"href="/n">n</a><a href="/p?a=1&copy=2&reg=3&amp;z=1">q</a>
<p>&#146;&#150;&#x000000041;&copy=2 &#99999999999;</p></body>"""


def test_odd_markup(spark):
    d = _doc(spark, ODD)
    assert [x["items"] for x in d.lists] == [["One", "Two", "Three"], ["A", "B"], []]
    assert [h["content"] for h in d.headings] == ["AB", "xtail"]
    assert [(a["href"], a["text"]) for a in d.links] == [("/n", "n"), ("/p?a=1&copy=2&reg=3&z=1", "q")]
    assert d.paragraphs[-1]["content"] == "\u2019\u2013A\u00a9=2 \ufffd"


def test_many_attributes_take_one_pass(spark):
    d = _doc(spark, "<body><a " + "x y " * 5000 + ">no</a><a " + "b='c' " * 5000 + "href=z>yes</a>")
    assert [(a["href"], a["text"]) for a in d.links] == [("z", "yes")]


# (page, tokens as (kind, tag, text), raw text, paragraphs)
RAW_STATES = [
    ("<p>a</p><script>x = '<p>no</p>'", [("open", "p", None), ("text", None, "a"), ("close", "p", None), ("script", None, None)], "a", ["a"]),
    ("<p>a</p><script>1</script ><p>b", None, "ab", ["a", "b"]),
    ("<p>a<!-- <p>no", [("open", "p", None), ("text", None, "a"), ("comment", None, None)], "a", ["a"]),
    ("<p>a<!--> b<!--x--!> c<!---> d", None, "a b c d", ["a b c d"]),
    ("<body><textarea><p>x &amp; y</p></textarea>z", [("open", "body", None), ("textarea", "textarea", "<p>x & y</p>"), ("text", None, "z")], "<p>x & y</p>z", []),
    ("<body><textarea>open <p>end", None, "open <p>end", []),
    ("<title>A &lt;b&gt; <p></title><p>t", [("title", None, None), ("open", "p", None), ("text", None, "t")], "t", ["t"]),
    ("<body><p>k<iframe><p>in &amp; out</p></iframe>m", [("open", "body", None), ("open", "p", None), ("text", None, "k"), ("raw", "iframe", "<p>in &amp; out</p>"), ("text", None, "m")],
     "k<p>in &amp; out</p>m", ["k<p>in &amp; out</p>m"]),
    ("<p>a<xmp><p>x</xmp>b", None, "a<p>xb", ["a"]),
    ("<noembed><a href=x>no</a></noembed><noframes><p>n</p></noframes>", [("raw", "noembed", "<a href=x>no</a>"), ("raw", "noframes", "<p>n</p>")], "<a href=x>no</a><p>n</p>", []),
    ("<p>a<plaintext><p>b</plaintext>", [("open", "p", None), ("text", None, "a"), ("raw", "plaintext", "<p>b</plaintext>")], "a<p>b</plaintext>", ["a"]),
    ("<style>p{}</styles><p>x</p></style><p>y", None, "y", ["y"]),
    ("<p>a</ p><p>b<p title='>'>c<p class=\"x", None, "abc", ["a", "b", "c"]),
    ("<p title=a\"b>q</p><p =x>r</p>1 < 2", None, "qr1 < 2", ["q", "r"]),
    ("<scripty><p>s</scripty>", None, "s", ["s"]),
    ("<SCRIPT SRC='a>b'>x</Script><P>t</P>", None, "t", ["t"]),
    ("", [], "", []),
]


def test_raw_text_states(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, *_) in enumerate(RAW_STATES)], "page_id long, html string")
    docs, seen = {r.page_id: r for r in H.documents(pages).collect()}, {}
    for r in sorted(H.html_tokens(pages).collect(), key=lambda r: (r.page_id, r.pos)):
        seen.setdefault(r.page_id, []).append((r.kind, r.tag, r.text))
    titles = {r.page_id: r.title for r in H.titles(pages).collect()}
    for i, (html, tokens, raw, paragraphs) in enumerate(RAW_STATES):
        assert (docs[i].raw_text, [p["content"] for p in docs[i].paragraphs]) == (raw, paragraphs), html
        got = seen.get(i, [])
        assert tokens is None or got == tokens, (html, got)
        assert len(got) == sum(1 for _ in markup._TOKEN.finditer(html))  # Spark's tokens are those that the fold sees
        assert titles[i] == docs[i].title
    assert docs[6].title == "A <b> <p>"


def test_references_decode_alike(spark):
    texts = ["&amp;&lt;x&gt; &copy;&copy &copyz &reg=1 &notit; &#65;&#x41;&#X41 &#0;&#128;&#159;&#xD800;&#x110000;&#99999999999; & &; &unknown; &hellip;", "none", "&", "&#;", "&#x;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for attribute in (False, True):
        got = [r[0] for r in df.select(decode_entities(df.t, attribute)).collect()]
        assert got == [markup.decoded(t, attribute) for t in texts]


def test_no_shuffle_and_only_the_work_asked_for(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (H.documents(pages), H.html_tokens(pages), H.raw_text(pages), H.lists(pages), H.anchors(pages), H.html_elements(pages), H.titles(pages)):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)
    assert not any("EvalPython" in plan(df) for df in (H.titles(pages), H.html_tokens(pages)))
    assert plan(H.documents(pages)).count("EvalPython") == 1 and plan(H.raw_text(pages)).count("EvalPython") == 1


def test_null_pages_and_named_extractors(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(1, SMALL), (2, None), (3, "<p>x")], "page_id long, html string")
    words = lambda t: t.filter("kind = 'text'").groupBy("page_id").agg(F.sum(F.size(F.split("text", " "))).alias("words"))
    links = lambda t: t.filter("tag = 'a' and kind = 'open'").groupBy("page_id").agg(F.count("*").alias("n"), F.min("tok").alias("first"))
    got = {r.page_id: r for r in H.documents(pages, extractors={"words": words, "links_seen": links}).collect()}
    assert got[1].words.words == 11 and got[1].links_seen.n == 1 and got[1].links_seen.first.startswith("<a href")
    assert got[3].words.words == 1 and got[3].links_seen is None and got[2].words is None
    assert got[2].raw_text == "" and got[2].title is None


def test_very_large_page(spark):
    html = "<body>" + "<ul><li>a" * 2000 + "<p>b</p>" * 20000 + "<table>" + "<tr><td>x</td><td>y</td></tr>" * 5000
    d = _doc(spark, html)
    assert len(d.lists) == 2000 and len(d.paragraphs) == 20000 and len(d.tables[0]["rows"]) == 5000


def test_golden_page(spark):
    d = _doc(spark, GOLDEN)
    assert d.title == "T1\nx"
    assert [(h["level"], h["content"]) for h in d.headings] == [(1, "First"), (2, "Second"), (3, "")]
    assert [p["content"] for p in d.paragraphs] == ["a", "b", "x y z w", "unclosed", "next"]
    assert d.raw_text.split("\n")[:3] == ["SecondFirst", "ab", "x y z"]
    lists = [(x["list_type"], x["items"]) for x in d.lists]
    assert lists == [("unordered", ["oneinner", "two"]), ("unordered", ["inner"]), ("ordered", ["o1", "o2"]),
                     ("definition", ["term", "def"]), ("unordered", [])]
    assert [(t["headers"], t["rows"]) for t in d.tables] == [(["H1", "H2"], [["a", "bn1", "n1"], ["n1"]]), ([], [["n1"]])]
    assert [(a["href"], a["text"]) for a in d.links] == [("x.pdf?a=1", "pdf"), ("/a?f=x.pdf", "q"), ("a", "rel")]


def test_a_fold_holds_one_page(monkeypatch):
    """A folded page is many times its text: the fold of an Arrow batch holds one at a time, and gives what single pages give."""
    import pyarrow as pa
    from weft.operators import html as H

    alive, most, folds = [0], [0], []

    class Counted(H.markup.Page):
        def __init__(self, html):
            alive[0] += 1
            most[0] = max(most[0], alive[0])
            super().__init__(html)

        def __del__(self):
            alive[0] -= 1

    monkeypatch.setattr(H.F, "arrow_udf", lambda fold, schema: folds.append(fold) or (lambda c: c))
    monkeypatch.setattr(H.F, "col", lambda c: c)
    monkeypatch.setattr(H.markup, "Page", Counted)
    H.page_elements("html")
    pages = ["<title>t</title><h2>b</h2><p>x<ul><li>i</ul>" + f"<a href='/{i}'>l</a>" * (i % 400) for i in range(60)] + [None, ""]
    monkeypatch.setattr(H, "_BUILT", 50, raising=False)
    got = folds[0](pa.array(pages, pa.string())).to_pylist()
    assert most[0] <= 2, most
    assert got == [folds[0](pa.array([p], pa.string())).to_pylist()[0] for p in pages]
    assert got[-2] is None and [len(g["links"]) for g in got[:60]] == [i % 400 for i in range(60)]
