"""Text helpers: whitespace cleaning and HTML character references."""

from __future__ import annotations

import json
from html.entities import html5 as _html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.markup import C1 as _C1

# The JavaScript \s class (ASCII whitespace, NBSP, Ogham space,
# U+2000-U+200A, line/paragraph separators, narrow NBSP, math space,
# ideographic space, BOM).
JS_SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clean_text(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim (JS ``\\s`` semantics)."""
    return F.regexp_replace(F.regexp_replace(c, JS_SPACE + "+", " "), "^ | $", "")


# HTML5 named character references, taken from Python's standard library table
# (html.entities.html5): names with their terminating ';', plus the legacy
# names that are also recognised without it.
_NAMED = {k: v for k, v in _html5.items() if k.endswith(";")}
_LEGACY = {k: v for k, v in _html5.items() if not k.endswith(";")}
_NAMED_JSON = json.dumps(_NAMED)
_LEGACY_JSON = json.dumps(_LEGACY)
# The most frequent references, decoded without a map lookup.
COMMON_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                   ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7")]

# A reference (with a following '=', which matters in attributes), a bare '&', or a run of other characters.
_RUNS = r"&(?:#[xX][0-9a-fA-F]++;?|#[0-9]++;?|[A-Za-z][A-Za-z0-9]*+[;=]?)|&|[^&]+"


def _hex2(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def _code_point_char(cp: Column) -> Column:
    """UTF-8 character for a code point (U+FFFD for 0, surrogates and out-of-range values)."""
    cp = F.when((cp >= 128) & (cp < 160), F.ascii(F.substring(F.lit(_C1), cp.cast("int") - 127, 1))).otherwise(cp)
    bad = (cp <= 0) | (cp > 0x10FFFF) | ((cp >= 0xD800) & (cp <= 0xDFFF))
    c = F.when(bad, F.lit(0xFFFD)).otherwise(cp)
    b6 = lambda shift: _hex2(F.shiftright(c, shift).bitwiseAND(0x3F).bitwiseOR(0x80))
    utf8 = (
        F.when(c < 0x80, _hex2(c))
        .when(c < 0x800, F.concat(_hex2(F.shiftright(c, 6).bitwiseOR(0xC0)), b6(0)))
        .when(c < 0x10000, F.concat(_hex2(F.shiftright(c, 12).bitwiseOR(0xE0)), b6(6), b6(0)))
        .otherwise(F.concat(_hex2(F.shiftright(c, 18).bitwiseOR(0xF0)), b6(12), b6(6), b6(0)))
    )
    return F.decode(F.unhex(utf8), "UTF-8")


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Decode HTML character references natively (numeric, and every HTML5 name).

    Strings without '&' pass through untouched; others are split into runs
    and each reference run is replaced. Unknown names stay as written, and in an
    attribute so do names without ';' before '=' (a letter or digit after a name
    makes it another name).
    """
    # One JSON literal per table: the optimizer folds it into a single map constant,
    # instead of thousands of literal nodes in every plan that decodes text.
    named = F.from_json(F.lit(_NAMED_JSON), "map<string,string>")
    legacy = F.from_json(F.lit(_LEGACY_JSON), "map<string,string>")

    def one(r: Column) -> Column:
        digits = F.regexp_extract(r, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        big = F.length(digits) > 7
        value = F.when(r.rlike("^&#[xX]"), F.conv(F.left(digits, F.lit(7)), 16, 10)).otherwise(digits).try_cast("long")
        num = F.when(digits == "", F.lit(0)).when(big, F.lit(0x110000)).otherwise(value)
        body = F.regexp_extract(r, "^&([^;=]*)", 1)
        rest = F.when(r.endswith("="), F.lit("=")).otherwise(F.lit(""))
        name_val = F.when(r.endswith(";"), F.element_at(named, F.concat(body, F.lit(";")))).otherwise(
            F.concat(F.element_at(legacy, body), rest))
        if attribute:
            name_val = F.when(~r.endswith("="), name_val)
        common = F.lit(None).cast("string")
        for ent, ch in COMMON_ENTITIES:
            common = F.when(r == ent, F.lit(ch)).otherwise(common)
        return (
            F.when(~r.startswith("&") | (r == "&"), r)
            .when(common.isNotNull(), common)
            .when(r.startswith("&#"), _code_point_char(num))
            .otherwise(F.coalesce(name_val, r))
        )

    runs = F.regexp_extract_all(c, F.lit(_RUNS), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(runs, one), "")).otherwise(c)
