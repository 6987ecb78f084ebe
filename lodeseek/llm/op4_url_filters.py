"""URL rules, and redirect equivalence for URLs without a rule.

A rule fits its host and that host's subdomains if the URL's path starts with the rule's path;
the longest rule wins, of equally long ones an allowing one. Pages whose URL has no rule take
the decision of their aliases: URLs tied together by canonical links and meta-refresh redirects
in the pages, transitively, by distributed connected components. An alias that a rule allows
allows the whole class; else an alias that a rule blocks blocks it; else it is allowed.
A node of the alias graph is a URL without scheme, fragment and last slash, its host in lower
case. Targets are read from the page's tree, so entities are decoded, any token of rel counts,
and base, dot segments and queries alone are resolved. The rest is DataFrame functions; no
class is gathered in one place. The SQL reads targets by expressions and doesn't know these forms.

Edge cases: a null URL, or one without "://", has empty host and path, no rule and no alias;
null html has no links; repeated pages each give a row; an empty table gives no row; relative
targets are resolved against the page's URL or its base href; those that can't be are left out;
of equally long rules an allowing one wins; other columns are left out, whatever their names; a key named
like a result column is returned as `key`.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import tree
from .common import connected_components, cut
from .tokens import text_batches

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
RESULT = ("host", "path", "rule", "verdict", "by_alias")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages without either word, or an entity that could hide it, have no target.
_MAYBE = re.compile("canonical|refresh|&", re.I)
#: The same within a link or meta tag, or a value there that holds the end of a tag: other pages go to no worker.
_TAG = r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh|&|=\s*\"[^\">]*>|=\s*'[^'>]*>)"
#: The target of a refresh: after the delay, with or without "url=" and quotes.
_REFRESH = re.compile(r"""^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^"'].*))""", re.I | re.S)
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<n, allow, rule, verdict> of the winning rule, else null. Every rule is tried on every row: keep lists short."""
    fits = []
    for action, h, p in rules:
        hit = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(hit, F.struct(F.lit(len(h + p)).alias("n"), F.lit(action == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))))
    return F.array_max(F.array(*fits))


def key_of(url: Column) -> Column:
    """The node of a URL; null where it has no "://"."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query))


def absolute(base: str, target: str) -> str:
    """target (entities decoded) on base; as browsers do, tabs and line ends inside and spaces around go."""
    try:
        return urljoin(base, re.sub("[\t\r\n]", "", target.strip(" \t\r\n\f")))
    except ValueError:
        return ""


def targets_of(url: str | None, html: str | None) -> list[str]:
    """Targets of a page's canonical links and meta refreshes as absolute URLs, on its first base href."""
    if not url or "://" not in url or not html or not _MAYBE.search(html):
        return []
    base, found = None, []
    for n in tree(html).walk():
        if n.tag == "base" and base is None and "href" in n.attrs:
            base = n.attrs["href"]
        elif n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split():
            found.append(n.attrs.get("href", ""))
        elif n.tag == "meta" and n.attrs.get("http-equiv", "").strip().lower() == "refresh":
            got = _REFRESH.search(n.attrs.get("content", ""))
            found.append((got[1] or got[2] or got[3] or "") if got else "")
    at = absolute(url, base) if base else ""
    at = at if "://" in at else url
    return [x for x in (absolute(at, t) for t in found if t.strip()) if "://" in x]


def with_targets(rows: DataFrame) -> DataFrame:
    """rows (id, u, html) with `to` for html. Pages are read one by one; no page's tree outlives it."""

    def run(batches):
        for b in batches:
            to = [targets_of(u.as_py(), h.as_py()) for u, h in zip(b.column("u"), b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array(to, pa.list_(pa.string()))], names=["id", "u", "to"])

    return text_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, u string, to array<string>")


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule (host and path of the winning one, else null), verdict, and by_alias: whether an alias decided."""
    rows = with_targets(pages.select(F.col(key).alias("id"), F.col(url).alias("u"), F.when(F.col(html).rlike(_TAG), F.col(html)).alias("html")))
    rows = rows.withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u")), "node": key_of(F.col("u"))})
    rows = cut(rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)))
    seen = rows.filter("node IS NOT NULL").select("node", F.explode("to").alias("target"))
    seen = cut(seen.select("node", "target", key_of(F.col("target")).alias("to")).filter("to IS NOT NULL").distinct())
    comp = cut(connected_components(seen.select(F.col("node").alias("a"), F.col("to").alias("b"))))
    told = rows.select("node", F.col("r.allow").alias("allow"))
    told = told.unionByName(seen.select(F.col("to").alias("node"), rule_of(host_of(F.col("target")), path_of(F.col("target")), rules)["allow"].alias("allow")))
    told = told.filter("node IS NOT NULL AND allow IS NOT NULL").groupBy("node").agg(F.max("allow").alias("allow"))
    named = told.join(comp, "node", "left").select(F.coalesce("component", "node").alias("component"), "allow")
    decided = named.groupBy("component").agg(F.max("allow").alias("class_allow"))
    members = comp.join(decided, "component").select("node", "class_allow")
    single = told.join(comp, "node", "left_anti").select("node", F.col("allow").alias("class_allow"))
    known = cut(members.unionByName(single))
    ruled = rows.filter("r IS NOT NULL").select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.lit(False).alias("by_alias"))
    free = rows.filter("r IS NULL").select("id", "host", "path", "node").join(known, "node", "left")
    free = free.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(~F.col("class_allow"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), F.col("class_allow").isNotNull().alias("by_alias"))
    return ruled.unionByName(free).withColumnRenamed("id", "key" if key in RESULT else key)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


_H = rf"translate(coalesce(regexp_extract({{0}}, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}')"
_P = "coalesce(regexp_extract({0}, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '')"
_K = f"CASE WHEN contains({{0}}, '://') THEN {_H} || regexp_replace({_P}, '/$', '') || regexp_extract({{0}}, '^[^?#]*(\\?[^#]*)', 1, 's') END"
_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
SQL = f"""
WITH RECURSIVE rules(action, rh, rp) AS (VALUES {_RULES}),
p AS (SELECT row_number() OVER () AS k, page_id, url, coalesce(html, '') AS html, {_H.format('url')} AS host, {_P.format('url')} AS path, {_K.format('url')} AS node FROM pages),
tag AS (SELECT node, url, path, unnest(regexp_extract_all(html, '<(?:link|meta)\\b[^>]*>', 0, 'is')) AS x FROM p WHERE node IS NOT NULL),
aim AS (SELECT node, url, path, regexp_extract(x, '\\bhref\\s*=\\s*["'']?\\s*([^"''>\\s]+)', 1, 'is') AS t FROM tag WHERE regexp_matches(x, '\\brel\\s*=\\s*["'']?\\s*canonical\\b', 'is')
  UNION ALL SELECT node, url, path, regexp_extract(x, '\\burl\\s*=\\s*''?([^"''>\\s]+)', 1, 'is') FROM tag WHERE regexp_matches(x, '\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b', 'is')),
far AS (SELECT node, CASE WHEN contains(t, '://') THEN t
  WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || t
  WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || t
  ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS target FROM aim WHERE t <> ''),
e AS (SELECT DISTINCT node, target, {_K.format('target')} AS dest FROM far),
both_ways AS (SELECT node AS a, dest AS b FROM e WHERE dest IS NOT NULL UNION SELECT dest, node FROM e WHERE dest IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
urls AS (SELECT node, host, path FROM p WHERE node IS NOT NULL UNION SELECT dest, {_H.format('target')}, {_P.format('target')} FROM e WHERE dest IS NOT NULL),
told AS (SELECT node, arg_max(action, length(rh || rp) * 2 + (action = 'allow')::INT) AS action FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node, host, path),
heard AS (SELECT node, action FROM told UNION SELECT r.a, action FROM reach r JOIN told ON r.b = told.node),
known AS (SELECT node, bool_or(action = 'allow') AS ok FROM heard GROUP BY node),
own AS (SELECT k, arg_max(rh || rp, length(rh || rp) * 2 + (action = 'allow')::INT) AS rule, arg_max(action, length(rh || rp) * 2 + (action = 'allow')::INT) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, CASE WHEN known.ok = false THEN 'block' ELSE 'allow' END) AS verdict,
  own.rule IS NULL AND known.ok IS NOT NULL AS by_alias
FROM p LEFT JOIN own ON p.k = own.k LEFT JOIN known ON p.node = known.node
"""
