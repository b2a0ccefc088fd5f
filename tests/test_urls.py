"""URL validity and canonical form: literals from the reference tests plus the quirk list."""

from weft.functions import urls as U

CASES = [
    # (url, base, valid, canonical)
    ("https://example.com", None, True, "https://example.com"),
    ("http://sub.example.com/path", None, True, "http://sub.example.com/path"),
    ("not-a-url", None, False, None),
    ("", None, False, None),
    ("HTTPS://Example.com/Path/", None, True, "https://example.com/path"),
    ("http://www.example.com", None, True, "http://example.com"),
    ("/path", "https://example.com", False, "https://example.com/path"),
    ("mailto:a@b.c", None, True, "mailto:a@b.c"),
    ("http://x.com/a#", None, True, "http://x.com/a#"),
    ("http://x.com/a#x", None, True, "http://x.com/a#x"),
    ("http://x.com/a?", None, True, "http://x.com/a?"),
    ("http://x.com/?b=2&a=1", None, True, "http://x.com?a=1&b=2"),
    ("?a", "http://x.com/p", False, "http://x.com/p?a="),
    ("http://x.com/?a=%zz", None, True, "http://x.com?a=%25zz"),
    ("http://x.com//x//y//", None, True, "http://x.com/x/y"),
    ("https://a.com:443/x", None, True, "https://a.com/x"),
    ("http://www.www.a.com/", None, True, "http://www.a.com"),
    ("http://user:pw@a.com/", None, True, "http://a.com"),
    ("http://a.com/É", None, True, "http://a.com/%c3%89"),
    ("a", "https://x.com/Docs/", False, "https://x.com/docs/a"),
    ("a", "https://x.com/docs", False, "https://x.com/a"),
    ("../b/./c", "http://h.com/a/x/y", False, "http://h.com/a/b/c"),
    ("http://exa mple.com", None, False, None),
    ("http://a.com:99999/", None, False, None),
    # escapes decode one by one
    ("http://x.com/?a=%C3%BC%zz", None, True, "http://x.com?a=%C3%BC%25zz"),
    ("http://x.com/?b=1%&a=%2", None, True, "http://x.com?a=%252&b=1%25"),
    ("http://x.com/?a=%FF+b", None, True, "http://x.com?a=%EF%BF%BD+b"),
    # a special scheme before a relative reference of the same scheme
    ("https:foo", "https://a.com/d/x", True, "https://a.com/d/foo"),
    ("https:/foo", "https://a.com/d/x", True, "https://a.com/foo"),
    ("https://foo", "https://a.com/d/x", True, "https://foo"),
    ("http:foo", "https://a.com/d/x", True, "http://foo"),
    ("https:", "https://a.com/d/x", False, "https://a.com/d/x"),
    ("https:?q=1", "https://a.com/d/x", False, "https://a.com/d/x?q=1"),
    # hosts
    ("https://münchen.de/", None, True, "https://xn--mnchen-3ya.de"),
    ("https://MÜNCHEN.de/", None, True, "https://xn--mnchen-3ya.de"),
    ("https://例え.テスト/a", None, True, "https://xn--r8jz45g.xn--zckzah/a"),
    ("https://faß.de/", None, True, "https://xn--fa-hia.de"),
    ("https://bücher。ｅｘａｍｐｌｅ/", None, True, "https://xn--bcher-kva.example"),
    ("https://☃.net/", None, True, "https://xn--n3h.net"),
    ("https://a%2ecom/", None, True, "https://a.com"),
    ("https://m%C3%BCnchen.de/", None, True, "https://xn--mnchen-3ya.de"),
    ("https://a%zz.com/", None, False, None),
    ("https://a%2fb.com/", None, False, None),
    ("https://a%ff.com/", None, False, None),
    ("http://0x7f.1/", None, True, "http://127.0.0.1"),
    ("http://127.1/", None, True, "http://127.0.0.1"),
    ("http://2130706433/", None, True, "http://127.0.0.1"),
    ("http://0300.0250.1/", None, True, "http://192.168.0.1"),
    ("http://1.2.3.4./", None, True, "http://1.2.3.4"),
    ("http://256.1.1.1/", None, False, None),
    ("http://1.2.3.4.5/", None, False, None),
    ("http://09.1/", None, False, None),
    ("http://4294967296/", None, False, None),
    ("http://a.0x/", None, False, None),
    ("http://1.2.3.com/", None, True, "http://1.2.3.com"),
    ("http://[::1]:80/x", None, True, "http://[::1]/x"),
    ("http://a..b/", None, True, "http://a..b"),
    ("//b.com/x", "https://a.com/", False, "https://b.com/x"),
    ("#f", "mailto:a@b.c", False, "mailto:a@b.c#f"),
    ("x", "mailto:a@b.c", False, None),
    (None, "https://a.com/", False, None),
    ("http://a.com/" + "x/" * 3000 + "..", None, True, "http://a.com/" + "x/" * 2998 + "x"),
]


def test_canonical_and_validity(spark):
    df = spark.createDataFrame([(u, b) for u, b, _, _ in CASES], "url string, base string")
    df = U.with_validity(df, "url", "valid")
    df = U.with_canonical(df, "url", "base", "canon")
    known = U.with_known_canonical(df.select("url", "base"), "url", "base", "canon")
    assert sorted(r.canon for r in known.collect()) == sorted(c for _, _, _, c in CASES if c is not None)
    got = {(r.url, r.base): (r.valid, r.canon) for r in df.collect()}
    for u, b, valid, canon in CASES:
        assert got[(u, b)] == (valid, canon), (u, b, got[(u, b)])


def test_canonical_is_idempotent_except_stacked_www(spark):
    df = spark.createDataFrame([("http://x.com/?b=2&a=1#f",), ("https://A.com/Für/",), ("http://www.www.a.com/x",)], "url string")
    once = U.with_canonical(df, "url", None, "c1")
    twice = U.with_canonical(once, "c1", None, "c2")
    rows = twice.collect()
    assert rows[0].c1 == rows[0].c2 and rows[1].c1 == rows[1].c2
    assert rows[2].c1 == "http://www.a.com/x" and rows[2].c2 == "http://a.com/x"


def test_punycode_against_the_codec(spark):
    labels = ["ü", "bücher", "ελληνικά", "中国", "日本語ドメイン", "a中b国c", "😀x", "ñandú-café", "ل" * 20, "zzü" * 15]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    assert [r[0] for r in df.select(U.punycode(df.x)).collect()] == [x.encode("punycode").decode() for x in labels]


def test_one_plan_copy(spark):
    df = spark.createDataFrame([("a", "b")], "u string, b string")
    plan = U.with_canonical(df, "u", "b", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000, len(plan)


def test_ansi_mode_gives_the_same(spark):
    """Spark 4's own default: no cast may fail on a URL without a port, whose port is '' ."""
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _, _) in enumerate(CASES)], "i int, u string, b string")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        got = {r.i: r for r in U.with_validity(U.with_canonical(df, "u", "b", "c"), "u", "v").collect()}
        ports = [r.p for r in spark.createDataFrame([("http://a.com:/",), ("http://a.com:080/",), ("http://a.com:x/",), ("http://a.com:12345678901234567890/",)], "u string")
                 .select(U.canonical_url("u").alias("p")).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    assert [(got[i].v, got[i].c) for i in range(len(CASES))] == [(v, c) for _, _, v, c in CASES]
    assert ports == ["http://a.com", "http://a.com", None, None]
