"""DuckDB SQL oracles for the registered queries.

Each entry is an independent formulation of the same result over the driver
tables (``pages orders lineitem events customer ...`` views). The derived crawl
tables are CTEs with the same definitions as ``weft.sources.tables``; URL and
HTML work is written for the forms that occur in the driver data (S* in the
survey): absolute http(s) page URLs, root-relative hrefs, the tags present.
Column names match the Spark queries.
"""

from __future__ import annotations

FX = {
    "fx_crawl_jobs": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'crawled' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
        3 AS max_depth FROM orders""",
    "fx_queue": """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
            CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS job_id,
        l_orderkey AS crawl_id,
        CASE l_linestatus || l_returnflag WHEN 'FA' THEN 'completed' WHEN 'FN' THEN 'completed' WHEN 'FR' THEN 'failed'
            WHEN 'OA' THEN 'active' WHEN 'ON' THEN 'waiting' WHEN 'OR' THEN 'delayed' END AS state,
        l_linenumber AS priority, l_shipdate AS event_ts FROM lineitem""",
    "fx_job_events": """SELECT event_id, user_id AS crawl_id, CAST(user_id AS VARCHAR) || ':' || props AS job_id,
        CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed'
            WHEN user_id % 3 = 0 THEN CASE event_type WHEN 'signup' THEN 'failed' ELSE 'completed' END
            WHEN event_type = 'view' THEN 'waiting' WHEN event_type = 'click' THEN 'active' WHEN event_type = 'signup' THEN 'delayed' END AS state,
        ts, event_id % 4 = 0 AS quota FROM events""",
    "fx_latest": """SELECT crawl_id, job_id, arg_max(state, (ts, event_id)) AS state, min(ts) AS added_at, max(ts) AS last_ts,
            arg_max(quota, (ts, event_id)) AS quota
        FROM fx_job_events GROUP BY crawl_id, job_id""",
    "fx_final": """SELECT crawl_id,
            CASE WHEN arg_max(state, (last_ts, job_id)) FILTER (WHERE state IN ('completed','failed')) = 'completed'
                 THEN 'crawled' ELSE 'failed' END AS status,
            max(last_ts) FILTER (WHERE state IN ('completed','failed')) AS completed_at
        FROM fx_latest GROUP BY crawl_id
        HAVING count(*) FILTER (WHERE state IN ('waiting','active','delayed')) = 0
           AND count(*) FILTER (WHERE state IN ('completed','failed')) > 0""",
    "fx_responses": """SELECT page_id, url, CASE page_id % 10 WHEN 3 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS status,
        CASE WHEN page_id % 10 = 9 THEN '' ELSE html END AS html FROM pages""",
    "fx_edges": """SELECT e.src, e.dst, e.pos, s.url AS src_url, d.url AS dst_url FROM (
            SELECT page_id AS src, (page_id * 2 + 1) % (SELECT count(*) FROM pages) AS dst, 0 AS pos FROM pages
            UNION ALL SELECT page_id, (page_id * 3 + 2) % (SELECT count(*) FROM pages), 1 FROM pages) e
        JOIN pages s ON s.page_id = e.src JOIN pages d ON d.page_id = e.dst""",
    "fx_requests": """SELECT url, CAST(CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 4 END AS INTEGER) AS max_depth,
            page_id % 7 AS user_id FROM pages
        UNION ALL SELECT * FROM (VALUES ('not-a-url', 2, 1), ('', 2, 1), ('mailto:a@b.c', NULL, 2)) t(url, max_depth, user_id)""",
    "fx_rules": """SELECT * FROM (VALUES
            ('c_net', ['example.net'], true, false, ['/fr']),
            ('c_one', ['ththre.example.com'], false, false, ['/admin', '/private', '/wp-admin', '/login', '/logout']),
            ('c_free', []::VARCHAR[], true, false, ['/fr']),
            ('c_nopath', ['example.com'], true, true, ['/admin', '/private', '/wp-admin', '/login', '/logout']))
        t(crawl_id, allowed_domains, allow_subdomains, ignore_paths, excluded_paths)""",
    "fx_crawl_urls": """SELECT (['c_net', 'c_one', 'c_free', 'c_nopath'])[page_id % 4 + 1] AS crawl_id, page_id, url FROM pages""",
    "fx_rule_requests": """SELECT page_id AS crawl_id,
            CASE WHEN page_id % 3 > 0 THEN [regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^$', '')] ELSE [] END AS allowed_domains,
            CASE WHEN page_id % 2 = 0 THEN page_id % 4 = 0 ELSE true END AS allow_subdomains,
            CASE WHEN page_id % 5 = 0 THEN page_id % 10 = 0 ELSE false END AS ignore_paths,
            CASE WHEN page_id % 7 = 0 THEN ['/fr'] ELSE ['/admin', '/private', '/wp-admin', '/login', '/logout'] END AS excluded_paths FROM pages""",
    "fx_quota": "SELECT c_custkey AS user_id, c_custkey % 3 + 1 AS quota FROM customer WHERE c_custkey % 10 <> 0",
    "fx_page_events": """SELECT o_custkey AS user_id, 'https://example.com/o/' || CAST(o_orderkey AS VARCHAR) AS url,
        o_orderdate AS ts FROM orders UNION ALL
        SELECT o_custkey, 'https://example.com/o/' || CAST(o_orderkey AS VARCHAR), o_orderdate FROM orders WHERE o_orderkey % 4 = 0""",
}

# ---- URL pieces in SQL (absolute http(s) URLs of the driver data) ----------------------------------
SAFE = "!$-;=@-_a-z|~%"


def _enc_path(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[^{SAFE}]+|[{SAFE}]+'), "
            f"lambda r: CASE WHEN regexp_matches(r, '^[^{SAFE}]') THEN url_encode(r) ELSE r END), '')")


def _form_enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def _form_dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _sorted_query(q: str) -> str:
    kx = _form_dec("regexp_extract(x, '^[^=]*', 0)")
    vx = _form_dec("regexp_replace(x, '^[^=]*=?', '')")
    pairs = (f"list_transform(list_filter(string_split({q}, '&'), lambda x: x <> ''), "
             f"lambda x: {{'k': {kx}, 'v': {vx}}})")
    srt = f"list_sort(list_transform({pairs}, lambda p: {{'s': p.k || ',' || p.v, 'k': p.k, 'v': p.v}}))"
    joined = f"array_to_string(list_transform({srt}, lambda p: {_form_enc('p.k')} || '=' || {_form_enc('p.v')}), '&')"
    return f"CASE WHEN len(list_filter(string_split({q}, '&'), lambda x: x <> '')) > 0 THEN {joined} END"


def canon_cte(src: str, key: str, url: str, base: str | None = None, name: str = "canon") -> str:
    """CTE ``name(key, url_canon)`` canonicalising ``url`` (resolved against ``base``) for the data's URL forms."""
    if base is None:
        absu = url
    else:
        absu = (f"CASE WHEN regexp_matches({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {url} "
                f"WHEN {url} LIKE '//%' THEN regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || {url} "
                f"WHEN {url} LIKE '/%' THEN regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || {url} "
                f"ELSE regexp_extract({base}, '^([^?#]*/)', 1) || {url} END")
    return f"""{name}_a AS (SELECT {key}, {absu} AS u FROM {src}),
{name}_p AS (SELECT {key}, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme,
        regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host,
        regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path0,
        CASE WHEN regexp_extract(u, '^[^#]*', 0) LIKE '%?%' THEN regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) END AS q0,
        CASE WHEN u LIKE '%#%' THEN regexp_extract(u, '^[^#]*#(.*)$', 1) END AS frag
    FROM {name}_a WHERE regexp_matches(u, '^https?://[^/?#]+')),
{name}_q AS (SELECT *, regexp_replace(lower({_enc_path("CASE WHEN path0 = '' THEN '/' ELSE path0 END")}), '/{{2,}}', '/', 'g') AS p1,
        CASE WHEN q0 IS NOT NULL AND q0 <> '' THEN {_sorted_query('q0')} ELSE q0 END AS q FROM {name}_p),
{name}_r AS (SELECT *, CASE WHEN p1 <> '/' AND p1 LIKE '%/' THEN left(p1, length(p1) - 1) ELSE p1 END AS path FROM {name}_q),
{name} AS (SELECT {key}, scheme || '://' || host || CASE WHEN path = '/' THEN '' ELSE path END
        || coalesce('?' || q, '') || coalesce('#' || frag, '') AS url_canon FROM {name}_r)"""


# ---- HTML pieces in SQL --------------------------------------------------------------------------
TOKEN_RE2 = ("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<title\\b.*?</title\\s*>"
             "|<[!?][^>]*>|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<")
SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
BLOCK_OPEN = ("'address','article','aside','blockquote','center','details','dialog','dir','div','dl','fieldset',"
              "'figcaption','figure','footer','form','h1','h2','h3','h4','h5','h6','header','hgroup','hr','main',"
              "'menu','nav','ol','p','pre','section','summary','table','ul','li','dd','dt','listing','plaintext','xmp','search'")
BLOCK_CLOSE = BLOCK_OPEN + ",'body','html','td','th','tr','caption','tbody','thead','tfoot'"


def _decode(x: str) -> str:
    out = x
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", "' || chr(160) || '"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}', ' ', 'g'), '^ | $', '', 'g')"


TOKENS = f"""tok0 AS (SELECT page_id, regexp_extract_all(html, '{TOKEN_RE2.replace("'", "''")}') AS toks FROM pages),
tok1 AS (SELECT page_id, CAST(i AS INTEGER) AS pos, toks[i + 1] AS tok FROM tok0, range(len(toks)) r(i)),
tokens AS (SELECT page_id, pos, tok,
        CASE WHEN tok LIKE '<!%' OR tok LIKE '<?%' THEN 'comment'
             WHEN regexp_matches(tok, '(?is)^<script\\b.*</script\\s*>$') THEN 'script'
             WHEN regexp_matches(tok, '(?is)^<style\\b.*</style\\s*>$') THEN 'style'
             WHEN regexp_matches(tok, '(?is)^<title\\b.*</title\\s*>$') THEN 'title'
             WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close'
             WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind,
        lower(regexp_extract(tok, '^</?([A-Za-z][^\\s/>]*)', 1)) AS tag0
    FROM tok1),
tk AS (SELECT page_id, pos, tok, kind, CASE WHEN kind IN ('open', 'close') THEN tag0 END AS tag,
        CASE WHEN kind = 'text' THEN {_decode('tok')} END AS text FROM tokens)"""


# Elements whose content is not markup, and everything that the end of the page may leave open.
_INNER = ("textarea", "iframe", "xmp", "noembed", "noframes")
RAW_TOKEN_RE2 = ("(?is)<!--(?:-?>|.*?(?:--!?>|\\z))|" + "|".join(f"<{n}(?:[\\s/][^>]*)?>.*?(?:</{n}\\s*>|\\z)" for n in ("script", "style", "title", *_INNER))
                 + "|<[!?][^>]*>|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<")


def raw_state_tokens(table: str) -> str:
    """``TOKENS`` of the pages of ``table``, with the content of raw elements as text (``tag`` names the element)."""
    inner = f"regexp_replace(regexp_replace(tok, '(?is)^<[^>]*>', ''), '(?is)</({'|'.join(_INNER)})\\s*>$', '')"
    t = TOKENS.replace(TOKEN_RE2.replace("'", "''"), RAW_TOKEN_RE2.replace("'", "''")).replace("FROM pages)", f"FROM {table})", 1)
    t = t.replace("'(?is)^<script\\b.*</script\\s*>$'", "'(?is)^<script[\\s>].*$'").replace(
        "WHEN regexp_matches(tok, '^</[A-Za-z]')", f"WHEN regexp_matches(tok, '(?is)^<({'|'.join(_INNER)})[\\s>]') THEN 'inner' WHEN regexp_matches(tok, '^</[A-Za-z]')")
    return t.replace("tk AS (SELECT page_id, pos, tok, kind, CASE WHEN kind IN ('open', 'close') THEN tag0 END AS tag,",
                     f"""tk AS (SELECT page_id, pos, tok, CASE kind WHEN 'inner' THEN 'text' ELSE kind END AS kind, CASE WHEN kind IN ('open', 'close', 'inner') THEN tag0 END AS tag,
        CASE WHEN kind = 'inner' AND tag0 = 'textarea' THEN {_decode(inner)} WHEN kind = 'inner' THEN {inner} ELSE""").replace(
        "CASE WHEN kind = 'text' THEN " + _decode("tok") + " END AS text FROM tokens)", "CASE WHEN kind = 'text' THEN " + _decode("tok") + " END END AS text FROM tokens)")


def element_text_cte(name: str, open_cond: str, closer: str) -> str:
    """CTE ``name(page_id, pos, tag, tok, content_raw)``: element opened by ``open_cond``, ended by the next ``closer`` token."""
    return f"""{name}_e AS (SELECT page_id, pos, tag, tok, open_flag, nxt FROM (
        SELECT page_id, pos, tag, tok, ({open_cond}) AS open_flag,
            min(CASE WHEN {closer} THEN pos END) OVER (PARTITION BY page_id ORDER BY pos
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM tk) WHERE open_flag),
{name} AS (SELECT e.page_id, e.pos, e.tag, e.tok,
        coalesce(string_agg(t.text, '' ORDER BY t.pos), '') AS content_raw
    FROM {name}_e e LEFT JOIN tk t ON t.page_id = e.page_id AND t.kind = 'text' AND t.pos > e.pos
        AND (e.nxt IS NULL OR t.pos < e.nxt)
    GROUP BY e.page_id, e.pos, e.tag, e.tok)"""


HREF_RE_SQL = r"""'(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)'"""
UNQUOTE_SQL = r"""'^["'']|["'']$'"""


def href_expr(tok: str) -> str:
    return _decode(f"regexp_replace(regexp_extract({tok}, {HREF_RE_SQL}, 1), {UNQUOTE_SQL}, '', 'g')")


def wq(names: list[str], extra: list[str], body: str) -> str:
    parts = [f"{n} AS ({FX[n]})" for n in names] + extra
    return "WITH " + ",\n".join(parts) + "\n" + body
