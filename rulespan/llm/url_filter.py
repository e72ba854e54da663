"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits its host (and subdomains) and path. Pages are
also tied to the urls they name as themselves: <link rel=canonical>, and redirects by
<meta http-equiv=refresh>. Connected components over those edges are equivalence classes;
where some member's rule blocks and none's allows, members without a rule of their own are
blocked too. An explicit allow wins: it holds for its page whatever the class, and keeps the
class's other members from inheriting a block.

Urls are nodes by scheme-less host and path, without a fragment; the query stays, as
it may name another page. Links lose their character references and are resolved against
their page's url. A redirect's target is judged by the rules though it may be no page.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule,
has no edges and is allowed; rows are judged one by one (repeated rows and null ids kept);
null html has no edges; other columns are ignored; an empty table gives none. Edges grow
with the pages and stay distributed; the rules are a parameter, applied as one expression.
"""

from __future__ import annotations

import html as references
import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import components

#: (verdict, host, path prefix); the longest host, then the longest path, wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Up to the first ://, not given back when what follows fails.
FIRST = "(?s)^(?>.*?://)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, rf"{FIRST}([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, rf"{FIRST}[^/?#]*(/[^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node(url: Column) -> Column:
    """What names the page: host, and all after it but the fragment."""
    return F.concat(host(url), F.regexp_extract(url, rf"{FIRST}[^/?#]*([^#]*)", 1))


def targets(html: Column) -> Column:
    """What a page names as itself, as written: canonical links and refresh redirects."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.concat(canonical, refresh), lambda u: u != "")


def resolved(url: str, target: str) -> str | None:
    """The absolute url that a page at `url` means by an attribute's value; None if it is none."""
    target = references.unescape(target).strip()
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", target):
        try:  # nodes have no scheme, so any that joins will do
            target = urljoin("http://" + url.split("://", 1)[1], target)
        except ValueError:  # brackets that are no address
            return None
    return target if "://" in target else None


def judge(pages: DataFrame, ws: Workspace, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row a page."""
    url = F.col("url")
    named = ws.write(
        pages.select("page_id", "url", F.coalesce(targets(F.col("html")), F.array().cast("array<string>")).alias("to")), "named"
    )  # html is read once
    own = named.select("page_id", "url", host(url).alias("host"), path(url).alias("path"), F.when(url.contains("://"), F.xxhash64(node(url))).alias("at"))
    own = own.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    edges = named.where(url.contains("://")).select(url, F.explode("to").alias("written"))
    edges = edges.select(url, F.udf(resolved, "string")("url", "written").alias("target")).where("target is not null")
    ends = ws.write(edges.select(F.xxhash64(node(url)).alias("a"), F.xxhash64(node(F.col("target"))).alias("b"), F.col("url").alias("from"), "target").where("a <> b"), "edges")
    plain = own.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("own"), "at")
    if ends.isEmpty():
        return plain.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    roots = components(ends.select("a", "b"), ws)
    # Verdicts of every url that an edge touches; a class is summed up by two flags, combined map-side.
    urls = ends.select(F.col("a").alias("node"), F.col("from").alias("u")).union(ends.select("b", "target")).distinct()
    urls = urls.withColumn("v", matched(host(F.col("u")), path(F.col("u")), rules)["verdict"])
    classes = urls.join(roots, "node").groupBy("root").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocks"), F.max(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allows"))
    blocked = roots.join(classes.where("blocks and not allows"), "root").select(F.col("node").alias("at"), F.lit("block").alias("inherited"))
    joined = plain.join(blocked, "at", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE u AS (SELECT page_id, url, html, coalesce(contains(url, '://'), false) AS ok, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT *, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
r(verdict, h, px) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, url, arg_max(h || px, length(h || px)) AS rule, arg_max(verdict, length(h || px)) AS own
      FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, px) GROUP BY page_id, url),
t AS (SELECT DISTINCT url, r, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE ok),
e AS (SELECT url, r, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                       WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM t),
x AS (SELECT r AS a, substr(target, strpos(target, '://') + 3) AS b FROM e WHERE contains(target, '://')),
k AS (SELECT a AS r FROM x UNION SELECT b FROM x),
kk AS (SELECT r, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path, lower(regexp_extract(r, '^[^/?#]*')) || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS node FROM k),
s AS (SELECT i.node AS a, j.node AS b FROM x JOIN kk i ON i.r = x.a JOIN kk j ON j.r = x.b UNION SELECT j.node, i.node FROM x JOIN kk i ON i.r = x.a JOIN kk j ON j.r = x.b),
reach(a, b) AS (SELECT a, a FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
v AS (SELECT kk.r, any_value(node) AS a, arg_max(verdict, length(h || px)) AS own FROM kk, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, px) GROUP BY kk.r),
c AS (SELECT root FROM v JOIN root USING (a) GROUP BY root HAVING bool_or(own = 'block') AND NOT bool_or(own = 'allow')),
bl AS (SELECT a FROM root WHERE root IN (SELECT root FROM c))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.own, CASE WHEN bl.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url LEFT JOIN bl ON ok AND bl.a = p.host || p.tail
"""
