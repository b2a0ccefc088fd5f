"""robots.txt rules per origin.

Each robots file is parsed once per origin (lines exploded, groups found with a
running count over user-agent lines), and URLs meet only the rules whose
literal head begins their path, by an equi-join on (origin, head). Equal paths
of an origin are matched once; a hot origin spreads over its paths.

Choices (the reference leaves them to a library): RFC 9309 longest match,
Allow wins ties, ``*`` and ``$`` wildcards, the path includes the query;
no robots row (fetch failed) means allowed; no ``*`` group means allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.urls import with_once, with_url_parts


def _as_path(c):
    """A rule or URL path in one spelling: non-ASCII and blanks percent-encoded, all escapes in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"%[0-9A-Fa-f]{2}|[\x21-\x24\x26-\x7E]+|%|[^\x21-\x7E]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x21-\x24\x26-\x7E]"), r).when(r.startswith("%"), F.lower(r)).otherwise(
        F.lower(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))), "")


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row for each rule of the ``*`` group: ``origin, len, allow, anchored, parts ARRAY<STRING>, head``.

    A leading byte order mark and any whitespace around fields are dropped. ``parts``
    is the rule split at its wildcards, ``head`` the first of them.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "^\ufeff", "")
    lines = robots.select("origin", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("ln", "line"))
    lines = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"^\s+|\s+$", ""))
    key = F.lower(F.regexp_extract("line", r"^([^:]*?)\s*:", 1))
    val = F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1)
    lines = lines.withColumns({"key": key, "val": val}).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("ln")
    is_ua = F.col("key") == "user-agent"
    prev_ua = F.coalesce(F.lag(is_ua).over(w), F.lit(False))
    lines = lines.withColumn("_start", (is_ua & ~prev_ua).cast("int"))
    lines = lines.withColumn("grp", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    star = lines.filter(is_ua).groupBy("origin", "grp").agg(F.bool_or(F.col("val") == "*").alias("star"))
    rules = lines.filter(~is_ua & (F.col("val") != "")).join(star.filter("star"), ["origin", "grp"], "left_semi")
    anchored = F.col("val").endswith("$")
    core = _as_path(F.when(anchored, F.expr("substring(val, 1, length(val) - 1)")).otherwise(F.col("val")))
    return rules.select("origin", F.length(core).alias("len"), (F.col("key") == "allow").alias("allow"), anchored.alias("anchored"),
                        F.split(core, r"\*+", -1).alias("parts")).withColumn("head", F.col("parts")[0]).distinct()


def _matches(target, r):
    """Whether a rule matches: its first part starts the target, the others follow in order (each at its first place,
    so a rule takes one pass and never backtracks), and with '$' the last part ends the target."""
    parts = r["parts"]
    n = F.size(parts)
    last = F.element_at(parts, -1)
    inner = F.when(r["anchored"] & (n > 1), F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))).otherwise(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))))
    end = F.aggregate(inner, F.when(F.startswith(target, parts[0]), F.length(parts[0])).otherwise(F.lit(-1)),
                      lambda at, p: F.when(at < 0, at).otherwise(
                          F.when(F.call_function("locate", p, target, at + 1) > 0, F.call_function("locate", p, target, at + 1) - 1 + F.length(p)).otherwise(F.lit(-1))))
    closed = F.when(n == 1, target == parts[0]).otherwise((F.length(target) - F.length(last) >= end) & F.endswith(target, last))
    return (end >= 0) & (~r["anchored"] | closed)


def robots_allowed(urls: DataFrame, robots: DataFrame, url: str = "url", out: str = "robots_allowed") -> DataFrame:
    """Add ``out``: whether the origin's robots.txt allows ``url`` (canonical, as requests are made) for any user agent.

    A rule can only match a path that begins with its head. Each different path of an origin gives its beginnings of the lengths
    that the origin's heads have, and those are looked up among the heads: an equi-join on (origin, head). Only the rules found
    there are matched further, so an origin with many rules costs its matches, not rules times URLs.
    """
    u = with_url_parts(urls, url, None, "_o")
    origin = F.concat("_o.scheme", F.lit("://"), "_o.host", F.when(F.col("_o.port") != "", F.concat(F.lit(":"), "_o.port")).otherwise(F.lit("")))
    target = F.concat("_o.path", F.when(F.col("_o.query").isNotNull(), F.concat(F.lit("?"), "_o.query")).otherwise(F.lit("")))
    p = with_once(u, F.struct(F.when(F.col("_o.ok"), origin).alias("origin"), _as_path(target).alias("target")), "_at").withColumns({"_origin": F.col("_at.origin"), "_target": F.col("_at.target")}).drop("_o", "_at")
    rules = robots_rules(robots)
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("head")).alias("lengths"))
    asked = p.filter("_origin is not null").select(F.col("_origin").alias("origin"), F.col("_target").alias("target")).distinct().join(lengths, "origin")
    heads = asked.select("origin", "target", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))).alias("n")).select(
        "origin", "target", F.substring(F.col("target"), F.lit(1), F.col("n")).alias("head"))
    hits = heads.join(rules, ["origin", "head"]).filter(_matches(F.col("target"), {c: F.col(c) for c in ("parts", "anchored")}))
    # the longest rule decides, and of equally long ones an Allow
    best = hits.groupBy("origin", "target").agg(F.max(F.struct("len", "allow")).alias("best")).select(
        F.col("origin").alias("_origin"), F.col("target").alias("_target"), F.col("best.allow").alias("_allow"))
    return p.join(best, ["_origin", "_target"], "left").withColumn(out, F.coalesce("_allow", F.lit(True))).select(*urls.columns, out)
