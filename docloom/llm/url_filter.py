"""Operator 6, URL filters: rules, and block decisions carried over redirect equivalence.

A rule has a host and a path; it fits its host and all subdomains if the url's path starts
with the rule's, and the longest rule that fits wins (of equal ones an allow). Urls that
redirect to each other, that name each other as canonical, or that differ only in fragment
and tracking parameters are aliases: connected components over these edges. A url without a
rule takes its component's verdict: allow if some alias is explicitly allowed, else block if
some alias is blocked, else allow.

Rules are joined by host suffix to distinct (host, path) pairs, so neither a common url nor a
common host is repeated through the join; components run as written tables.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and no
alias; null HTML has no edges; repeated rows are judged alike; an empty table gives an empty
result; of further columns only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import components, written

#: The rules of the query (fixed values): host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Query parameters that do not change what a url shows (fixed values).
TRACKING = re.compile(r"(?:^|&)(?:utm_[A-Za-z_]+|ref|fbclid|gclid)=[^&]*")
LINKS = re.compile(r"<(?:link|meta)\b[^>]*>", re.I)
ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
REFRESH = re.compile(r"url\s*=\s*'?([^'\s]*)", re.I)
#: Rules are broadcast up to so many.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: str) -> str:
    """A url without its fragment and tracking parameters."""
    base, mark, query = url.partition("#")[0].partition("?")
    query = TRACKING.sub("", query) if mark else ""
    query = query.removeprefix("&")
    return f"{base}?{query}" if query else base


def aliases_of(url: str | None, html: str | None) -> list[str]:
    """What a page names as its own address or sends its readers to."""
    if not url or "://" not in url:
        return []
    out = [plain(url)]
    for tag in LINKS.findall(html or ""):
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(tag)}
        target = ""
        if tag[1] in "lL":
            if "canonical" in a.get("rel", "").lower().split():
                target = a.get("href", "")
        elif a.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.search(a.get("content", ""))):
            target = m[1]
        if target and not target.startswith("#"):
            try:
                target = urljoin(url, unescape(target))
            except ValueError:  # not an address
                continue
            if "://" in target:
                out.append(target)
    return [x for x in dict.fromkeys(out) if x != url]


def edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): canonical links, refreshes, tracking variants, and a table of redirects (two columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, x) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()) for x in aliases_of(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in (list(zip(*found)) or [[]] * 2)], names=["a", "b"])

    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string").alias("html")
    out = pages.select("url", html).mapInArrow(run, "a string, b string")
    if redirects is not None:
        a, b = redirects.columns
        out = out.unionByName(redirects.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b"))
    return out.distinct()


def rules_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled) of every distinct host and path of ``urls``."""
    named = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    if rules.count() <= BROADCAST_RULES:
        named = F.broadcast(named)
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = pairs.select("host", "path", F.explode(tails).alias("_h")).join(named, "_h").where(F.col("path").startswith(F.col("_p")))
    text = F.concat("_h", "_p")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length(text).alias("n"), (F.col("_v") == "allow").alias("a"), text.alias("rule"), F.col("_v").alias("v"))).alias("m"))
    return best.select("host", "path", F.col("m.rule").alias("rule"), F.col("m.v").alias("ruled"))


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, root): root is the least alias's url, null without aliases."""
    url = F.col("url")
    roots = components(edges(pages, redirects)).select(F.col("node").alias("url"), "root")
    roots = written(roots.withColumns({"host": host_of(url), "path": path_of(url)}), "aliases")
    own = written(pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")), "pages")
    ruled = written(with_rules(own.select("host", "path").unionByName(roots.select("host", "path")), rules), "ruled")
    said = (
        roots.join(ruled, ["host", "path"])
        .groupBy("root")
        .agg(F.min("ruled").alias("said"))  # an allow sorts before a block
    )
    aliases = written(roots.select("url", "root").join(said, "root", "left"), "aliases")
    return (
        own.join(ruled, ["host", "path"], "left")
        .join(aliases, "url", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", "said", F.lit("allow")).alias("verdict"), "root")
    )


#: The same over ``pages`` in DuckDB.
ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '^([^#]*)', 1) AS bare
  FROM pages),
q AS (
  SELECT url, regexp_extract(bare, '^([^?]*)', 1) AS base,
         regexp_replace(regexp_replace(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '(^|&)(utm_[A-Za-z_]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM p WHERE contains(url, '://')),
e AS (
  SELECT DISTINCT url AS a, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS b FROM q),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a),
roots AS (SELECT node, min(other) AS root FROM r GROUP BY node),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT url, max(struct_pack(n := length(rh || rp), a := v = 'allow', rule := rh || rp, v := v)) AS m
  FROM (SELECT DISTINCT url, host, path FROM (
          SELECT url, host, path FROM p
          UNION ALL
          SELECT node, translate(regexp_extract(node, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract(node, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) FROM roots))
  JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY url),
said AS (SELECT root, min(m.v) AS said FROM roots JOIN best ON node = url GROUP BY root)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, said.said, 'allow') AS verdict, roots.root AS root
FROM p LEFT JOIN best USING (url) LEFT JOIN roots ON p.url = roots.node LEFT JOIN said ON said.root = roots.root
"""
