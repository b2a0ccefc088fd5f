"""HTML pages to structured documents, page by page where the pages are: no shuffle.

* ``html_tokens`` and ``titles`` are Spark expressions: one regular expression
  cuts a page into its array of tokens.
* Elements need running state over a page's tokens (nesting, implied ends),
  which no built-in function keeps in linear time. One Arrow function folds
  each page once (``weft.functions.markup``) and returns all kinds asked for
  as one struct column; the page's other columns do not go through Python.

Known deviations from a full HTML5 tree builder (documented in the README):
misnested formatting elements are not re-opened (adoption agency), table
foster-parenting is not done, and escaped script data ends at its first end tag.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import markup
from weft.functions.text import decode_entities
from weft.functions.urls import let

_RAW = "|".join((*markup.DECODED_ELEMENTS, *markup.RAW_ELEMENTS, "plaintext"))


def _token_array(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(markup.TOKEN_RE), F.lit(0))


def html_tokens(pages: DataFrame) -> DataFrame:
    """H1: one row per token: ``page_id, pos, kind, tag, tok, text``.

    ``kind`` is one of comment (also declarations and tags cut off by the page's end), script, style, title, textarea, raw
    (iframe, xmp, noembed, noframes, plaintext), open, close, text. ``tag`` is set for open, close, textarea and raw; ``text``
    for text, textarea (both decoded) and raw.
    """
    t = pages.select("page_id", _token_array(F.col("html")).alias("toks")).select("page_id", F.size("toks").alias("n"), F.posexplode("toks").alias("pos", "tok"))
    raw = F.lower(F.regexp_extract("tok", rf"(?i)^<({_RAW})(?=[ \t\n\f\r/>])", 1))
    name = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][^ \t\n\f\r/>]*)", 1))
    whole = (F.col("pos") < F.col("n") - 1) | F.col("tok").rlike(markup.TAG_RE)  # only the last token can be cut off
    kind = (
        F.when(~F.col("tok").startswith("<") | (F.col("tok") == "<"), F.lit("text"))
        .when((name == "") | ~whole, F.lit("comment"))
        .when(raw.isin("script", "style", "title", "textarea"), raw)
        .when(raw != "", F.lit("raw"))
        .when(F.col("tok").startswith("</"), F.lit("close"))
        .otherwise(F.lit("open"))
    )
    t = t.withColumns({"kind": kind, "_name": name})
    inner = F.regexp_replace(F.regexp_replace("tok", markup.TAG_RE, ""), rf"(?is)</(?!plaintext)(?:{_RAW})(?=[ \t\n\f\r/>])[^>]*>?$", "")
    text = F.when(F.col("kind") == "text", F.col("tok")).when(F.col("kind").isin("textarea", "raw"), inner)
    t = t.withColumn("_text", text)  # one decoder for both kinds of text
    text = F.when(F.col("kind").isin("text", "textarea"), decode_entities(F.col("_text"))).otherwise(F.col("_text"))
    return t.select("page_id", "pos", "kind", F.when(F.col("kind").isin("open", "close", "textarea", "raw"), F.col("_name")).alias("tag"), "tok", text.alias("text"))


# -- elements ------------------------------------------------------------------------------------

# kind of element: (field of the struct, its method, (field, type)...); every one begins with ``pos``
_FIELDS = {
    "heading": ("headings", "heading_rows", ("level", pa.int32()), ("content", pa.string())),
    "paragraph": ("paragraphs", "paragraph_rows", ("content", pa.string())),
    "list": ("lists", "list_rows", ("list_type", pa.string()), ("content", pa.string()), ("items", pa.list_(pa.string()))),
    "table": ("tables", "table_rows", ("content", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))),
    "anchor": ("links", "anchor_rows", ("content", pa.string()), ("href", pa.string())),
}
_SQL = {pa.int32(): "int", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.list_(pa.list_(pa.string())): "array<array<string>>"}
KINDS = ("title", "raw_text", *_FIELDS)
_BUILT = 4096  # elements kept as Python objects before they become Arrow


def page_elements(html: str | Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The elements of a page as one struct: ``title``, ``raw_text`` and an array for each other kind (``headings``,
    ``paragraphs``, ``lists``, ``tables``, ``links``), whose structs begin with ``pos``, the place of the element's token.

    Only the kinds asked for are built. A NULL page gives NULL.
    """
    plain = [k for k in ("title", "raw_text") if k in kinds]
    nested = {k: f for k, f in _FIELDS.items() if k in kinds}

    def fold(column: pa.Array) -> pa.Array:
        missing, texts, flat, ends, built = [], {k: [] for k in plain}, {k: [] for k in nested}, {k: [0] for k in nested}, {k: [] for k in nested}

        def build(k: str) -> None:
            _, _, *fields = nested[k]
            columns = list(zip(*flat[k])) if flat[k] else [()] * (len(fields) + 1)
            built[k].append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *(t for _, t in fields)])], ["pos", *(n for n, _ in fields)]))
            flat[k].clear()

        for value in column:  # one page at a time: a page folded is many times its text
            html = value.as_py()
            page = None if html is None else markup.Page(html)
            missing.append(page is None)
            for k in plain:
                texts[k].append(None if page is None else page.title or None if k == "title" else page.raw_text())
            for k, (_, method, *_) in nested.items():
                rows = [] if page is None else getattr(page, method)()
                flat[k].extend(rows)
                ends[k].append(ends[k][-1] + len(rows))
                if len(flat[k]) >= _BUILT:
                    build(k)
        arrays, names = [pa.array(texts[k], pa.string()) for k in plain], list(plain)
        for k, (name, *_) in nested.items():
            build(k)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.concat_arrays(built[k])))
            names.append(name)
        return pa.StructArray.from_arrays(arrays, names, mask=pa.array(missing, pa.bool_()))

    structs = [f"{name}: array<struct<pos: int, {', '.join(f'{n}: {_SQL[t]}' for n, t in fields)}>>" for name, _, *fields in nested.values()]
    schema = f"struct<{', '.join([f'{k}: string' for k in plain] + structs)}>"
    return F.arrow_udf(fold, schema)(F.col(html) if isinstance(html, str) else html)


def html_elements(pages: DataFrame, kinds: tuple[str, ...] = KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per extracted element of the given kinds of every page.

    Columns: ``page_id``, the page's columns named by ``keep``, and ``kind, pos, level, content, href, list_type, items,
    headers, rows``. kinds: ``title`` (first title, raw), ``raw_text`` (H3), ``heading``, ``paragraph``, ``list``, ``table``,
    ``anchor``. ``pos`` orders elements of one kind in document order (headings are ordered by level first).
    """
    types = {"content": "string", **{n: _SQL[t] for _, _, *fields in _FIELDS.values() for n, t in fields}}
    order = ("level", "content", "href", "list_type", "items", "headers", "rows")

    def row(kind: str, pos: Column, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), *(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in order))

    def rows_of(kind: str, names: list[str]) -> Callable[[Column], Column]:
        return lambda x: row(kind, x["pos"], **{n: x[n] for n in names})

    e = pages.select("page_id", *keep, page_elements("html", kinds).alias("d"))
    built = [F.array(row(k, F.lit(0), content=F.col(f"d.{k}"))) for k in ("title", "raw_text") if k in kinds]
    for k, (name, _, *fields) in _FIELDS.items():
        if k in kinds:
            built.append(F.transform(f"d.{name}", rows_of(k, [n for n, _ in fields])))
    return e.select("page_id", *keep, F.explode(F.concat(*built) if len(built) > 1 else built[0]).alias("e")).select("page_id", *keep, "e.*")


def raw_text(pages: DataFrame) -> DataFrame:
    """H3: ``page_id, raw_text``."""
    return pages.select("page_id", page_elements("html", ("raw_text",))["raw_text"].alias("raw_text"))


def titles(pages: DataFrame) -> DataFrame:
    """H4: ``page_id, title`` (first title, not cleaned, NULL if empty or absent)."""
    def inner(token: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(token, markup.TAG_RE, ""), r"(?is)</title(?=[ \t\n\f\r/>])[^>]*>?$", "")
        return F.when(token.rlike(markup.TAG_RE), text)

    token = F.get(F.filter(_token_array(F.col("html")), lambda x: x.rlike(r"(?i)^<title[ \t\n\f\r/>]")), F.lit(0))
    return pages.select("page_id", let(let(let(token, inner), lambda t: decode_entities(t)), lambda t: F.nullif(t, F.lit(""))).alias("title"))


def _rows(pages: DataFrame, kind: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    name = _FIELDS[kind][0]
    one = pages.select("page_id", *keep, F.explode(page_elements("html", (kind,))[name]).alias("e"))
    return one.select("page_id", *keep, *(f"e.{c}" for c in columns))


def headings(pages: DataFrame) -> DataFrame:
    """H5: ``page_id, pos, level, content``; document order is (level, pos)."""
    return _rows(pages, "heading", "pos", "level", "content")


def paragraphs(pages: DataFrame) -> DataFrame:
    """H6: ``page_id, pos, content`` (non-empty, cleaned)."""
    return _rows(pages, "paragraph", "pos", "content")


def lists(pages: DataFrame) -> DataFrame:
    """H7: ``page_id, pos, list_type, items, content``."""
    return _rows(pages, "list", "pos", "list_type", "items", "content")


def tables(pages: DataFrame) -> DataFrame:
    """H8: ``page_id, pos, headers, rows``."""
    return _rows(pages, "table", "pos", "headers", "rows")


def anchors(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """H9: ``page_id, pos, href, text`` (href raw, text cleaned, both non-empty, not deduplicated)."""
    return _rows(pages, "anchor", "pos", "href", "content", keep=keep).withColumnRenamed("content", "text")


# fields of each nested element as stored, ``type`` first
_STORED = {"headings": ("heading", "level", "content"), "paragraphs": ("paragraph", "content"), "lists": ("list", "list_type", "content", "items"),
           "tables": ("table", "content", "headers", "rows"), "links": ("link", "content", "href", "text")}


def documents(pages: DataFrame, valid_link: Callable[[Column], Column] | None = None, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """One nested row per page (``page_id, title, raw_text, headings, paragraphs, lists, tables, links``), with the
    page's columns named by ``keep`` and ``extraction_success`` (false for a page without a body: NULL instead of HTML).

    ``valid_link(href) -> boolean`` drops links where it is not true (L2's rule); it may use the page's kept columns.

    ``extractors`` (X1) are custom extractors by name: each is a function from the token rows of ``html_tokens`` to rows of
    ``page_id`` and its own columns, at most one for each page; they become a struct column of that name (NULL where it gives
    no row).
    """
    e = pages.select("page_id", *keep, page_elements("html").alias("d"))

    def nested(name: str) -> Column:
        kind, *fields = _STORED[name]
        source = F.col(f"d.{name}")
        if name == "links" and valid_link is not None:
            source = F.filter(source, lambda x: F.coalesce(valid_link(x["href"]), F.lit(False)))
        value = lambda x, f: x["content" if f == "text" else f].alias(f)
        return F.transform(source, lambda x: F.struct(F.lit(kind).alias("type"), *(value(x, f) for f in fields))).alias(name)

    out = e.select("page_id", *keep, F.col("d.title"), F.coalesce("d.raw_text", F.lit("")).alias("raw_text"), *map(nested, _STORED),
                   F.col("d").isNotNull().alias("extraction_success"))
    tokens = html_tokens(pages) if extractors else None
    for name, extract in (extractors or {}).items():
        own = extract(tokens)
        rest = [c for c in own.columns if c != "page_id"]
        out = out.join(own.select("page_id", F.struct(*rest).alias(name)), "page_id", "left")
    return out
