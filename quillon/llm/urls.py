"""URL filters with redirect equivalence.

Rules are pairs of a host and a path that allow or block; a rule fits its host and all
subdomains of it where the url's path starts with the rule's, and the longest rule
wins.  Urls that no rule fits are judged by their aliases: canonical links and
refreshes in the html, and given redirects, join urls that are one page; distributed
connected components carry block decisions over all of them.  An explicit allow stands
against what aliases carry.

A url is known by its key: scheme, ``www.`` and ``m.``, fragment, closing slash and
tracking parameters left out.  Urls of one key need no link.  Only links between
different keys enter the components, so their work follows the links, not the pages.

Null urls, and those without ``://``: empty host and path, no key, no rule, allowed.
Null or empty html has no links, very long html is read whole; the first canonical link
and the first refresh count.  Repeated rows and ids, and null ids: every row is judged
and returned.  Ties of rules (equal length): the longer host, then allow.  Rules with
a null in them are none.  No rows: no rows.  Other columns of any input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint
from quillon.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that say where a visitor came from, not what the page is.
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"
CANONICAL = r"(?is)<link\s[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then names it: generated code stays small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    return _let(url, lambda u: F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))))


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """The same for urls that name one page by convention; null for what is no url."""

    def of(rest: Column) -> Column:
        bare = F.regexp_replace(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^(www|m)\.", "")
        query = F.concat(F.lit("&"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1))
        query = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, "&" + TRACKING, ""), "^&", ""), r"(?s)^(.+)$", "?$1")
        return F.concat(bare, F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", ""), query)

    return _let(_rest(url), of)


def absolute(link: Column, base: Column) -> Column:
    """link as found in the page base; null for none."""
    scheme = F.substring_index(base, "://", 1)

    def of(x: Column) -> Column:
        return (
            F.when(F.coalesce(x, F.lit("")) == "", F.lit(None))
            .when(x.contains("://"), x)
            .when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
            .when(x.startswith("/"), F.concat(scheme, F.lit("://"), host(base), x))
            .otherwise(F.concat(scheme, F.lit("://"), host(base), F.regexp_replace(F.regexp_replace(path(base), "[^/]*$", ""), "^$", "/"), x))
        )

    return _let(F.replace(link, F.lit("&amp;"), F.lit("&")), of)


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, by (what decided: rule, alias or nothing) of each row of pages (page_id, url, html).

    rules: host, path, allow boolean; redirects: source, target (urls).
    """
    link = absolute(F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1), F.col("url"))
    sent = absolute(F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1), F.col("url"))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), key(F.col("url")).alias("key"), key(link).alias("canonical"), key(sent).alias("sent"))
    # the html is read once; what is left of a page is its url
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    found = _longest(rows.select("row", "host", "path"), rules)
    rows = checkpoint(rows.join(found, "row", "left").drop("row"))
    blocked = rows.filter(~F.col("allow") & F.col("key").isNotNull()).select("key").distinct()
    links = rows.select(F.col("key").alias("a"), F.explode(F.array("canonical", "sent")).alias("b"))
    if redirects is not None:
        links = links.union(redirects.select(key(F.col("source")), key(F.col("target"))))
    links = checkpoint(links.filter("a is not null and b is not null and a <> b").distinct())
    nodes = checkpoint(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("key"), F.monotonically_increasing_id().alias("id")))
    ends = links.join(nodes.withColumnsRenamed({"key": "a", "id": "x"}), "a").join(nodes.withColumnsRenamed({"key": "b", "id": "y"}), "b")
    group = nodes.join(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "id").select("key", "component")
    bad = group.join(blocked, "key").select("component").distinct()
    reached = blocked.union(group.join(bad, "component").select("key")).distinct().withColumn("reached", F.lit(True))
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("reached"), "alias").otherwise("nothing")
    bars = F.when(F.col("rule").isNotNull(), ~F.col("allow")).otherwise(F.coalesce("reached", F.lit(False)))
    return rows.join(reached, "key", "left").select("page_id", "host", "path", "rule", F.when(bars, "block").otherwise("allow").alias("verdict"), by.alias("by"))


def _longest(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row, rule, allow of the urls (row, host, path) that a rule fits.

    A url meets the rules' hosts by each suffix of its host, then the rules by its
    path's prefixes of the lengths that the host's rules have: equal keys only, whatever
    the number of rules.
    """
    rules = rules.filter("host is not null and path is not null and allow is not null").select(_lower(F.col("host")).alias("on"), F.col("path").alias("prefix"), "allow")
    rules = rules.groupBy("on", "prefix").agg(F.bool_or("allow").alias("allow"))
    lengths = rules.groupBy("on").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = urls.withColumn("on", F.explode(suffixes)).join(lengths, "on")
    near = near.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n")))
    hit = near.join(rules, ["on", "prefix"])
    rank = F.struct((F.length("on") + F.length("prefix")).alias("size"), F.length("on").alias("host"), "allow", F.concat("on", "prefix").alias("rule"))
    return hit.groupBy("row").agg(F.max(rank).alias("best")).select("row", "best.rule", "best.allow")


# The rules of the registered query.
RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]

SQL = r"""
WITH RECURSIVE
u AS (SELECT row_number() OVER () AS r, page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
t AS (SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
      replace(regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS l1,
      replace(regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS l2,
      regexp_extract(url, '^(.*?)://', 1) AS scheme FROM u),
s AS (SELECT r, rest, url, unnest([1, 2]) AS which, unnest([l1, l2]) AS l, scheme, scheme || '://' || regexp_extract(rest, '^([^/?#]*)', 1) AS site, regexp_replace(path, '[^/]*$', '') AS folder FROM t),
a AS (SELECT r, url AS x FROM t UNION ALL
      SELECT r + 1000000000 * which, CASE WHEN coalesce(l, '') = '' THEN NULL WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN scheme || ':' || l WHEN starts_with(l, '/') THEN site || l ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || l END FROM s),
b AS (SELECT r, CASE WHEN instr(x, '://') > 0 THEN substr(x, instr(x, '://') + 3) END AS rest FROM a),
k AS (SELECT r, regexp_replace(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '') || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '')
      || CASE WHEN q = '' THEN '' ELSE '?' || q END AS key FROM (SELECT r, rest, regexp_replace(regexp_replace('&' || regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS q FROM b)),
rules(h, p, allow) AS (VALUES ('org', '/', true), ('example.org', '/es/', false), ('example.org', '/en/1', false), ('com', '/fr/', true), ('com', '/de/', false)),
j AS (SELECT t.r, t.page_id, t.host, t.path, max({'n': length(h || p), 'h': length(h), 'allow': allow, 'rule': h || p}) AS best
      FROM t LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
v AS (SELECT j.r, page_id, host, path, best.rule AS rule, best.allow AS allow, key FROM j JOIN k USING (r)),
e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM k x JOIN k y ON y.r IN (x.r + 1000000000, x.r + 2000000000) WHERE x.r < 1000000000 AND x.key <> y.key),
reached(key) AS (SELECT DISTINCT key FROM v WHERE NOT allow AND key IS NOT NULL UNION SELECT f.b FROM reached JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) f ON f.a = reached.key)
SELECT page_id, host, path, rule, CASE WHEN CASE WHEN rule IS NOT NULL THEN NOT allow ELSE v.key IN (SELECT key FROM reached WHERE key IS NOT NULL) AND v.key IS NOT NULL END THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN v.key IN (SELECT key FROM reached WHERE key IS NOT NULL) THEN 'alias' ELSE 'nothing' END AS "by"
FROM v
"""
