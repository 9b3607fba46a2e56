"""URL filters with redirect equivalence, in DataFrame functions only.

Pages whose html declares a canonical link or a refresh redirect are joined with the target by an
edge. Block decisions go from a page under a block rule to all aliases of its component; an explicit
allow anywhere in the component comes before that, and a page's own rule before both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

# The rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def _with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """df with <prefix>host, <prefix>path and <prefix>node, which names a page: host, path and query.

    Scheme and fragment name the same page; a url that is null or without :// has no node.
    """
    u = F.col(url)
    df = df.withColumns({prefix + "host": host_of(u), prefix + "path": path_of(u), prefix + "query": F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1)})
    node = F.when(F.instr(u, "://") > 0, F.concat(*(F.col(prefix + x) for x in ("host", "path", "query"))))
    return df.withColumn(prefix + "node", node).drop(prefix + "query")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page and of its canonical link or refresh target."""
    html = F.col("html")
    tagged = pages.select("url", "html").filter(html.rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull())
    tags = tagged.select("url", F.explode(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    value = r"""(?i)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attr(name: str) -> Column:
        return F.concat(*(F.regexp_extract("tag", value % name, i) for i in (1, 2, 3)))

    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(attr("http-equiv")) == "refresh")
    target = F.when(canonical, F.trim(attr("href"))).when(refresh, F.trim(F.regexp_extract(attr("content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)))
    # Stored between the steps: else each expression is copied into every use of it.
    links = _with_parts(stored(tags.select("url", target.alias("href")), "links").filter("href != '' and href not like '#%'"), "url", "from_")
    href, site = F.col("href"), F.concat(F.lit("http://"), F.col("from_host"))
    folder = F.regexp_replace("from_path", r"[^/]*$", "")
    absolute = (
        F.when(F.instr(href, "://") > 0, href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )
    targets = stored(links.select("from_node", absolute.alias("target")), "targets")
    return _with_parts(targets, "target", "to_").select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits host and path; of equals, allow comes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are held in a plan")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; redirects(a, b) may add pairs of urls.

    A null url or one without :// has empty host and path and no aliases. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    name, verdict = rule_columns(rules)
    own = _with_parts(pages.select("page_id", "url"), "url", "").withColumns({"rule": name, "own": verdict})
    edges = alias_edges(pages)
    if redirects is not None:
        pairs = _with_parts(_with_parts(redirects.select("a", "b"), "a", "from_"), "b", "to_")
        edges = edges.union(pairs.select("from_node", "to_node"))
    members = connected_components(edges)
    # A target that is no page of the table is judged by its own address too.
    address = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    judged = members.select("node", "component", address.alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")).withColumn("own", verdict)
    groups = judged.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    inherited = F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block")
    aliases = members.join(groups, "component").select("node", inherited.alias("inherited"))
    return own.join(aliases, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) ELSE '' END AS query, html
  FROM pages),
tags AS (SELECT url, host, path, query, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
links AS (
  SELECT host || path || query AS a, trim(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''>]*)', 1) END) AS href, host, path
  FROM tags),
targets AS (SELECT a, CASE
    WHEN strpos(href, '://') > 0 THEN href WHEN href LIKE '//%' THEN 'http:' || href
    WHEN href LIKE '/%' THEN 'http://' || host || href
    ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS t
  FROM links WHERE href IS NOT NULL AND href != '' AND href NOT LIKE '#%'),
edges AS (SELECT a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(t, '(?s)^[^?#]*(\?[^#]*)', 1) AS b FROM targets),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
addresses AS (
  SELECT DISTINCT host, path FROM p
  UNION SELECT regexp_extract(b, '(?s)^([^/?#]*)', 1), regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) FROM reach),
ruled AS (
  SELECT host, path, arg_max(rhost || rpath, 2 * length(rhost || rpath) + (verdict = 'allow')::INT) AS rule, arg_max(verdict, 2 * length(rhost || rpath) + (verdict = 'allow')::INT) AS own
  FROM addresses JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path),
inherited AS (
  SELECT r.a AS node, bool_or(u.own = 'allow') AS allowed, bool_or(u.own = 'block') AS blocked
  FROM reach r JOIN ruled u ON u.host = regexp_extract(r.b, '(?s)^([^/?#]*)', 1) AND u.path = regexp_extract(r.b, '(?s)^[^/?#]*([^?#]*)', 1)
  GROUP BY r.a)
SELECT page_id, p.host, p.path, rule, coalesce(own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN ruled u ON p.host = u.host AND p.path = u.path
LEFT JOIN inherited i ON strpos(p.url, '://') > 0 AND i.node = p.host || p.path || p.query
"""
