"""URL parsing, resolution and canonicalisation as native Spark expressions.

Everything here builds ``Column`` expressions (regexes, string and higher-order
array functions), so it runs inside the JVM; no Python runs per row.

The parse follows the WHATWG URL standard closely enough for crawl data:
scheme, authority (userinfo, host, port), path with dot segments resolved and
percent-encoding applied, query and fragment; hosts of special schemes are
percent-decoded, mapped and Punycode-encoded, and IPv4 numbers in any form are
normalised. A URL is one struct-valued expression (``parsed``): each stage is
bound to a name (``let``) and referenced by it, so no stage's expression is
copied into the next, and a URL can be parsed inside any other expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemes with an authority and their default ports (WHATWG "special" schemes).
SPECIAL_SCHEMES = ["http", "https", "ws", "wss", "ftp", "file"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Characters that stay literal in each URL component. Anything
# else (controls, space, the listed delimiters, non-ASCII) is percent-encoded.
PATH_SAFE = r"!$-;=@-_a-z|~%"          # path set: encodes space " # < > ? ` { } and non-ASCII
QUERY_SAFE = r"!$-&(-;=?-~%"           # special-query set: encodes space " # < > ' and non-ASCII
FRAGMENT_SAFE = r"!#-;=?-_a-~%"         # fragment set: encodes space " < > ` and non-ASCII

# Hosts may not contain these (WHATWG forbidden domain code points, plus '%' and the sign of broken UTF-8).
FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f\x{FFFD}]"

# What host names are mapped by beside lower case: other full stops, and full-width ASCII.
_HOST_FROM = "\u3002\uff0e\uff61" + "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F) if c != 0x2E)
_HOST_TO = "..." + "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x2E)

SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(**columns: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in columns.items()))


def clean_input(c: Column) -> Column:
    """Trim leading/trailing C0 controls and spaces, drop tab and newline (URL parser preprocessing)."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def pct_encode(c: Column, safe: str) -> Column:
    """Percent-encode every character outside ``safe`` (UTF-8, upper-case hex)."""
    runs = F.regexp_extract_all(c, F.lit(f"[^{safe}]+|[{safe}]+"), F.lit(0))
    enc = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[^{safe}]"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))).otherwise(r),
    )
    # Fast path: nothing to encode (the common case) skips the array work entirely.
    return F.when(c.isNull() | ~c.rlike(f"[^{safe}]"), c).otherwise(F.array_join(enc, ""))


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path (``%2e`` counts as a dot)."""
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    n = F.size(segs)
    tagged = F.transform(segs, lambda s, i: F.struct(F.lower(s).alias("l"), s.alias("s"), (i == n - 1).alias("last")))

    def step(acc, t):
        single = t["l"].isin(".", "%2e")
        double = t["l"].isin("..", ".%2e", "%2e.", "%2e%2e")
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return (
            F.when(single & t["last"], F.array_append(acc, F.lit("")))
            .when(single, acc)
            .when(double & t["last"], F.array_append(popped, F.lit("")))
            .when(double, popped)
            .otherwise(F.array_append(acc, t["s"]))
        )

    out = F.aggregate(tagged, F.array().cast("array<string>"), step)
    # Fast path: no '.' or '..' segment (any case of %2e) means nothing to resolve.
    has_dots = path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)")
    return F.when(has_dots, F.concat(F.lit("/"), F.array_join(out, "/"))).otherwise(path)


def _split_tail(s: Column):
    """(part before ?/#, query or NULL, fragment or NULL) of a string."""
    pre = F.regexp_extract(s, r"^[^?#]*", 0)
    has_q = F.regexp_extract(s, r"^[^#]*", 0).contains("?")
    query = F.when(has_q, F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1))
    frag = F.when(s.contains("#"), F.regexp_extract(s, r"(?s)^[^#]*#(.*)$", 1))
    return pre, query, frag


# ---- hosts ---------------------------------------------------------------------------------------

_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Parameters of Punycode (RFC 3492): base, smallest and largest threshold, skew, damping, first bias, first code point.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def punycode(label: Column) -> Column:
    """RFC 3492 encoding of one label, without its prefix.

    The characters beyond ASCII are taken by (code point, place); each one's distance from the one before, in steps over all
    places and code points, is written as a number of variable length.
    """
    def encode(chars: Column) -> Column:
        beyond = F.array_sort(F.filter(chars, lambda x: x["c"] >= _FIRST))
        basic = F.array_join(F.transform(F.filter(chars, lambda x: x["c"] < _FIRST), lambda x: x["s"]), "")
        start = _fields(n=F.lit(_FIRST).cast("bigint"), i=F.lit(0).cast("bigint"), bias=F.lit(_BIAS).cast("bigint"),
                        h=F.length(basic).cast("bigint"), out=F.lit(""), first=F.lit(True))

        def digits(delta: Column, bias: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                t = F.greatest(F.lit(_TMIN).cast("bigint"), F.least(F.lit(_TMAX).cast("bigint"), k * _BASE - bias))
                last = acc["q"] < t
                digit = F.when(last, acc["q"]).otherwise(t + F.pmod(acc["q"] - t, F.lit(_BASE) - t))
                return F.when(acc["done"], acc).otherwise(_fields(q=F.when(last, F.lit(0).cast("bigint")).otherwise(_div(acc["q"] - t, F.lit(_BASE) - t)),
                                                                  out=F.concat(acc["out"], F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))), done=last))

            return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint")), _fields(q=delta, out=F.lit(""), done=F.lit(False)), step, lambda acc: acc["out"])

        def adapted(delta: Column, first: Column, points: Column) -> Column:
            most = (_BASE - _TMIN) * _TMAX // 2
            d = F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2))
            return F.aggregate(F.sequence(F.lit(1), F.lit(12)), _fields(d=d + _div(d, points), k=F.lit(0).cast("bigint")),
                               lambda acc, _: F.when(acc["d"] > most, _fields(d=_div(acc["d"], _BASE - _TMIN), k=acc["k"] + _BASE)).otherwise(acc),
                               lambda acc: acc["k"] + _div(acc["d"] * (_BASE - _TMIN + 1), acc["d"] + _SKEW))

        def step(acc: Column, e: Column) -> Column:
            place = F.size(F.filter(chars, lambda x: (x["at"] < e["at"]) & (x["c"] <= e["c"]))).cast("bigint")
            return let(_fields(place=place, delta=(e["c"] - acc["n"]) * (acc["h"] + 1) + place - acc["i"]), lambda v: _fields(
                n=e["c"], i=v["place"] + 1, bias=adapted(v["delta"], acc["first"], acc["h"] + 1), h=acc["h"] + 1,
                out=F.concat(acc["out"], digits(v["delta"], acc["bias"])), first=F.lit(False)))

        return F.concat(basic, F.when(basic != "", F.lit("-")).otherwise(F.lit("")), F.aggregate(beyond, start, step, lambda acc: acc["out"]))

    chars = F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda s, i: _fields(c=F.ascii(s).cast("bigint"), at=i, s=s))
    return let(chars, encode)


def _ipv4(host: Column) -> Column:
    """A host whose last label is a number, as dotted decimals; NULL if it is no IPv4 address."""
    def number(x: Column) -> Column:
        hexadecimal, octal = F.lower(x).startswith("0x"), x.startswith("0") & (F.length(x) > 1)
        digits = F.regexp_replace(F.when(hexadecimal, F.substring(x, 3, 1 << 30)).otherwise(x), "^0+", "")
        value = (F.when(hexadecimal, F.when(digits.rlike("^[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), digits), 16, 10)))
                 .when(octal, F.when(digits.rlike("^[0-7]{0,11}$"), F.conv(F.concat(F.lit("0"), digits), 8, 10)))
                 .when(x.rlike("^[0-9]+$") & (F.length(digits) <= 10), F.concat(F.lit("0"), digits)))
        return value.cast("bigint")

    def address(n: Column) -> Column:
        size, last = F.size(n), F.element_at(n, -1)
        fits = (size <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), lambda x: x < 256)
        room = F.element_at(F.array(*(F.lit(1 << 8 * (5 - i)).cast("bigint") for i in range(1, 5))), F.least(size, F.lit(4)))
        whole = F.aggregate(F.transform(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), lambda x, i: F.call_function("shiftleft", x, 8 * (3 - i))), last, lambda acc, x: acc + x)
        return F.when(fits & (last < room), let(whole, lambda w: F.concat_ws(".", *(F.call_function("shiftright", w, F.lit(8 * i)).bitwiseAND(255).cast("string") for i in (3, 2, 1, 0)))))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), address)


def host_name(raw: Column, special: Column) -> Column:
    """The host as the URL standard writes it, NULL if it is none: percent-decoded, lower-cased, labels beyond ASCII as
    Punycode, IPv4 numbers as dotted decimals (special schemes); lower-cased only (others); IPv6 in brackets as it is."""
    decoded = F.when(raw.contains("%"), F.when(~raw.rlike("%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))).otherwise(raw)
    mapped = F.lower(F.when(decoded.rlike(r"[^\x00-\x7f]"), F.translate(decoded, _HOST_FROM, _HOST_TO)).otherwise(decoded))

    def ascii_labels(m: Column) -> Column:
        label = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
        broken = m.contains("\ufffd")
        return F.when(m.rlike(r"[^\x00-\x7f]") & ~broken, F.array_join(F.transform(F.split(m, r"\."), label), ".")).otherwise(m)

    def checked(a: Column) -> Column:
        return F.when(~a.rlike(FORBIDDEN_HOST), F.when(a.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"), _ipv4(a)).otherwise(a))

    domain = let(mapped, lambda m: let(ascii_labels(m), checked))
    plain = F.lower(raw)
    opaque = F.when(~plain.rlike(FORBIDDEN_HOST), plain)
    simple = raw.rlike(r"^[A-Za-z0-9.\-_]*[A-Za-z\-_]$")  # nothing to decode, map or compute: the common case
    return F.when(raw.startswith("["), F.when(plain.rlike(r"^\[[0-9a-f:.]+\]$"), plain)).when(simple & ~plain.rlike(r"(^|\.)0x[0-9a-f]*$"), plain).when(special, domain).otherwise(opaque)


# ---- parsing -------------------------------------------------------------------------------------

def parsed(url: Column, base: Column | None = None) -> Column:
    """A URL as one struct, resolved against ``base`` (another such struct):

    ``ok`` (it parses), ``scheme``, ``special``, ``user``, ``host``, ``port`` (normalised, default dropped, '' if none),
    ``hasauth``, ``opaque``, ``path``, ``query`` (NULL if none), ``frag`` (NULL if none).
    """
    def of_base(field: str, otherwise) -> Column:
        return F.lit(otherwise) if base is None else base[field]

    def scheme(s: Column) -> Column:
        own = F.lower(F.regexp_extract(s, SCHEME_RE, 1))
        return let(_fields(s=s, own=own, special=own.isin(*SPECIAL_SCHEMES)), rest)

    def rest(v: Column) -> Column:
        s, own = v["s"], v["own"]
        after = F.substring(s, F.length(own) + 2, 1 << 30)
        # "https:foo" on an https base is relative
        same = v["special"] & F.coalesce(of_base("ok", False) & (of_base("scheme", None) == own), F.lit(False)) & ~after.startswith("//")
        absolute = (own != "") & ~same
        text = F.when(own != "", after).otherwise(s)
        name = F.when(absolute, own).otherwise(of_base("scheme", None).cast("string"))
        special = F.coalesce(name.isin(*SPECIAL_SCHEMES), F.lit(False))
        pre, query, frag = _split_tail(text)
        return let(_fields(s=s, absolute=absolute, scheme=name, special=special, pre=pre, query=query, frag=frag), authority)

    def authority(v: Column) -> Column:
        special, absolute = v["special"], v["absolute"]
        return let(F.when(special, F.regexp_replace(v["pre"], r"\\", "/")).otherwise(v["pre"]), lambda pre: let(
            # absolute: special schemes have an authority after any slashes, others only after '//'; relative: '//' begins one
            _fields(pre=pre, new=F.when(absolute & special, F.lit(True)).otherwise(pre.startswith("//")),
                    stripped=F.when(special, F.regexp_replace(pre, r"^/*", "")).otherwise(F.regexp_replace(pre, r"^//", ""))),
            lambda w: let(_fields(pre=w["pre"], new=w["new"], auth=F.regexp_extract(w["stripped"], r"^[^/]*", 0), stripped=w["stripped"]), lambda x: host(v, x))))

    def host(v: Column, x: Column) -> Column:
        hostport = F.regexp_replace(x["auth"], r"^.*@", "")
        raw = let(hostport, lambda h: _fields(h=h, raw=F.when(h.startswith("["), F.regexp_extract(h, r"^\[[^\]]*\]", 0)).otherwise(F.regexp_extract(h, r"^[^:]*", 0))))
        return let(raw, lambda h: let(_fields(user=F.regexp_extract(x["auth"], r"^(.*)@", 1), host=host_name(h["raw"], v["special"]), tail=F.substring(h["h"], F.length(h["raw"]) + 1, 1 << 30)),
                                      lambda y: port(v, x, y)))

    def port(v: Column, x: Column, y: Column) -> Column:
        digits = F.regexp_replace(y["tail"], r"^:0*(?=.)|^:", "")
        default = F.lit(None).cast("string")
        for name, usual in DEFAULT_PORTS.items():
            default = F.when(v["scheme"] == name, F.lit(usual)).otherwise(default)
        fits = y["tail"].rlike(r"^(:[0-9]*)?$") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("long"), F.lit(0)) <= 65535)
        named = y["host"].isNotNull() & F.when(v["special"] & (v["scheme"] != "file"), y["host"] != "").otherwise(F.lit(True))
        return let(_fields(ok=F.coalesce(fits, F.lit(False)) & named, port=F.when((digits == "") | F.coalesce(digits == default, F.lit(False)), F.lit("")).otherwise(digits)),
                   lambda z: whole(v, x, y, z))

    def whole(v: Column, x: Column, y: Column, z: Column) -> Column:
        absolute, new, pre = v["absolute"], x["new"], x["pre"]
        after = F.substring(x["stripped"], F.length(x["auth"]) + 1, 1 << 30)
        opaque = F.when(absolute, ~v["special"] & ~pre.startswith("/")).otherwise(of_base("opaque", False))
        if base is None:
            path, query = F.when(new, after).otherwise(pre), v["query"]
            relative_ok = F.lit(False)
        else:
            merged = F.concat(F.regexp_replace(base["path"], r"[^/]*$", ""), pre)
            relative = F.when(new, after).when(pre.startswith("/"), pre).when(pre == "", base["path"]).otherwise(merged)
            path = F.when(absolute, F.when(new, after).otherwise(pre)).otherwise(relative)
            # an empty relative reference keeps the base's query, and so does '#f'
            query = F.when(absolute | new | (pre != "") | v["query"].isNotNull(), v["query"]).otherwise(base["query"])
            only_fragment = (pre == "") & v["query"].isNull() & v["frag"].isNotNull()
            relative_ok = base["ok"] & ((~base["opaque"] & (z["ok"] | ~new)) | only_fragment)
        hier = F.when(v["special"] & (path == ""), F.lit("/")).when(~path.startswith("/") & (path != ""), F.concat(F.lit("/"), path)).otherwise(path)
        ok = F.when(absolute, z["ok"] | ~new).otherwise(relative_ok) & v["s"].isNotNull()
        taken = lambda field, mine, none: F.when(new, mine).otherwise(of_base(field, none))
        return let(_fields(opaque=opaque, path=path, hier=hier, query=query), lambda w: _fields(
            ok=F.coalesce(ok, F.lit(False)), scheme=v["scheme"], special=v["special"], user=taken("user", y["user"], ""), host=taken("host", y["host"], ""),
            port=taken("port", z["port"], ""), hasauth=F.when(absolute, new).otherwise(new | of_base("hasauth", False)), opaque=w["opaque"],
            path=F.when(w["opaque"], w["path"]).otherwise(let(F.when(w["hier"] == "", w["hier"]).otherwise(remove_dot_segments(w["hier"])), lambda p: pct_encode(p, PATH_SAFE))),
            query=F.when(w["query"].isNotNull(), pct_encode(w["query"], QUERY_SAFE)),
            frag=F.when(v["frag"].isNotNull(), pct_encode(v["frag"], FRAGMENT_SAFE))))

    return let(clean_input(url), scheme)


def _tail(u: Column) -> Column:
    return F.concat(F.when(u["query"].isNotNull(), F.concat(F.lit("?"), u["query"])).otherwise(F.lit("")),
                    F.when(u["frag"].isNotNull(), F.concat(F.lit("#"), u["frag"])).otherwise(F.lit("")))


def _host_port(u: Column) -> Column:
    return F.concat(u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(F.lit("")))


def serialized(u: Column) -> Column:
    """WHATWG serialisation of a parsed URL (NULL if it did not parse)."""
    user = F.when(u["user"] != "", F.concat(F.regexp_replace(u["user"], ":$", ""), F.lit("@"))).otherwise(F.lit(""))
    authority = F.when(u["hasauth"], F.concat(F.lit("//"), user, _host_port(u))).otherwise(F.lit(""))
    return F.when(u["ok"], F.concat(u["scheme"], F.lit(":"), authority, u["path"], _tail(u)))


def _form_decode(x: Column) -> Column:
    """Decoded escape by escape: a '%' before anything but two hexadecimal digits stands for itself."""
    return F.try_url_decode(F.when(x.contains("%"), F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")).otherwise(x))


def sorted_query(q: Column) -> Column:
    """URLSearchParams round trip of a query: pairs decoded, sorted by "key,value", form-encoded.

    Empty pieces are dropped; a key without '=' gets '='. Returns NULL when
    nothing is left (the '?' disappears).
    """
    pieces = F.filter(F.split(q, "&"), lambda x: x != "")
    pairs = F.transform(
        pieces,
        lambda x: F.struct(
            _form_decode(F.regexp_extract(x, r"^[^=]*", 0)).alias("k"),
            _form_decode(F.regexp_replace(x, r"^[^=]*=?", "")).alias("v"),
        ),
    )
    keyed = F.transform(pairs, lambda kv: F.struct(F.concat(kv["k"], F.lit(","), kv["v"]).alias("s"), kv["k"].alias("k"), kv["v"].alias("v")))
    ordered = F.array_sort(keyed)
    text = F.array_join(F.transform(ordered, lambda kv: F.concat(F.url_encode(kv["k"]), F.lit("="), F.url_encode(kv["v"]))), "&")
    return F.when(F.size(pieces) > 0, text)


def canonical(u: Column) -> Column:
    """Canonical form of a parsed URL (NULL if it did not parse).

    Rules: host lower-cased with one leading ``www.`` removed; default port
    dropped; non-empty query re-serialised with pairs sorted; path
    percent-encoded *then* lower-cased, ``//+`` collapsed, one trailing ``/``
    dropped; fragment kept; for the root path the result is
    ``scheme://host[:port]`` + query + fragment (userinfo dropped).
    Opaque URLs (``mailto:``) keep their path.
    """
    lowered = F.regexp_replace(F.lower(u["path"]), "/{2,}", "/")
    trimmed = F.when(lowered != "/", F.regexp_replace(lowered, "/$", "")).otherwise(lowered)

    def whole(path: Column) -> Column:
        w = _fields(ok=u["ok"], scheme=u["scheme"], user=u["user"], host=F.when(u["opaque"], u["host"]).otherwise(F.regexp_replace(u["host"], r"^www\.", "")),
                    port=u["port"], hasauth=u["hasauth"], path=path, frag=u["frag"],
                    query=F.when(u["query"].isNotNull() & (u["query"] != ""), sorted_query(u["query"])).otherwise(u["query"]))
        return let(w, lambda v: F.when(u["ok"] & ~u["opaque"] & (path == "/") & u["hasauth"], F.concat(v["scheme"], F.lit("://"), _host_port(v), _tail(v))).otherwise(serialized(v)))

    return let(F.when(u["opaque"], u["path"]).otherwise(trimmed), whole)


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed_against(url: str | Column, base: str | Column | None, then: Callable[[Column], Column]) -> Column:
    """``then(parsed URL)`` for a URL resolved against the text of a base URL, if any."""
    if base is None:
        return let(parsed(_column(url)), then)
    return let(parsed(_column(base)), lambda b: let(parsed(_column(url), b), then))


def canonical_url(url: str | Column, base: str | Column | None = None) -> Column:
    return parsed_against(url, base, canonical)


# ---- as columns of a table -----------------------------------------------------------------------

_FORMS: dict[str, Callable[[Column], Column]] = {
    "parts": lambda u: u,
    "canonical": canonical,
    "resolved": serialized,
    "valid": lambda u: u["ok"] & F.coalesce(u["scheme"] != "", F.lit(False)),
}
_built: dict[tuple, Column] = {}


def _form(form: str, df: DataFrame, url: str | Column, base: str | Column | None, parsed_base: bool = False) -> tuple[DataFrame, Column]:
    """``df`` with the URL and the base under fixed names, and the expression over those names.

    Building an expression of this size takes seconds of calls into the JVM, so each is built once and shared by all tables.
    """
    key = (form, base is not None, parsed_base, id(SparkContext._jvm))
    if key not in _built:
        if parsed_base:
            _built[key] = let(parsed(F.col("_weft_url"), F.col("_weft_base")), _FORMS[form])
        else:
            _built[key] = parsed_against("_weft_url", None if base is None else "_weft_base", _FORMS[form])
    named = {"_weft_url": _column(url)} if base is None else {"_weft_url": _column(url), "_weft_base": _column(base)}
    return df.withColumns(named), _built[key]


def with_once(df: DataFrame, value: Column, out: str, known: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``out`` = ``value``, computed once for each row; with ``known`` only rows where that is true of it.

    The optimizer copies an expression into every filter on it, also into those that it infers from joins; what a generator puts
    out it only refers to.
    """
    one = F.array(value)
    return df.select("*", F.explode(one if known is None else F.filter(one, known)).alias(out))


def _with_form(form: str, df: DataFrame, url: str | Column, base: str | Column | None, out: str, known: Callable[[Column], Column] | None = None,
               parsed_base: bool = False) -> DataFrame:
    named, value = _form(form, df, url, base, parsed_base)
    return with_once(named, value, out, known).drop("_weft_url", "_weft_base")


def with_url_parts(df: DataFrame, url: str | Column, base: str | Column | None = None, prefix: str = "_u") -> DataFrame:
    """Add ``prefix``: the struct of ``parsed`` (resolved against ``base``)."""
    return _with_form("parts", df, url, base, prefix)


def with_canonical(df: DataFrame, url: str | Column, base: str | Column | None = None, out: str = "url_canon") -> DataFrame:
    """Add ``out``: canonical form of ``url`` (resolved against ``base``), NULL if it does not parse."""
    return _with_form("canonical", df, url, base, out)


def with_known_canonical(df: DataFrame, url: str | Column, base: str | Column | None = None, out: str = "url_canon", parsed_base: bool = False) -> DataFrame:
    """As ``with_canonical``, without the rows that do not parse; with ``parsed_base`` the base is the struct of ``with_url_parts``."""
    return _with_form("canonical", df, url, base, out, lambda x: x.isNotNull(), parsed_base)


def with_known_parts(df: DataFrame, url: str | Column, base: str | Column | None = None, prefix: str = "_u") -> DataFrame:
    """As ``with_url_parts``, without the rows that do not parse."""
    return _with_form("parts", df, url, base, prefix, lambda x: x["ok"])


def with_resolved(df: DataFrame, url: str | Column, base: str | Column | None = None, out: str = "url_abs") -> DataFrame:
    """Add ``out``: ``url`` resolved against ``base`` and serialised (WHATWG href), NULL if invalid."""
    return _with_form("resolved", df, url, base, out)


def with_validity(df: DataFrame, url: str | Column, out: str = "is_valid") -> DataFrame:
    """Add ``out``: True iff ``url`` parses as an absolute URL on its own."""
    return _with_form("valid", df, url, None, out)


# ---- cheap column functions on URLs that are already absolute and canonical ----------------------

def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME_RE, 1))


def url_host(u: Column) -> Column:
    """Lower-cased host of an absolute URL with an authority ('' if none)."""
    return F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))


def url_path(u: Column) -> Column:
    """Path of an absolute URL with an authority ('/' if empty)."""
    p = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def effective_domain(host: Column) -> Column:
    """Host lower-cased, trimmed, one leading ``www.`` removed."""
    return F.regexp_replace(F.trim(F.lower(host)), r"^www\.", "")
