"""URL filtering with redirect equivalence, in DataFrame functions only.

Rules block or allow a host with its subdomains under a path; the longest that
fits decides.  A URL no rule fits takes the decision of its aliases: URLs tied by
redirects and canonical links form components (alternating large-star and
small-star), and a component's block reaches all its members, unless one of them
is explicitly allowed.  An own rule is never overruled; without any, the verdict
is allow.

Edges come from the pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``)
and, if given, from a table of redirects.  Targets are resolved by RFC 3986.  A
node is a URL with scheme and host in lower case, no fragment and no dot segments
in its path.  Targets that are no pages count as members too.

A list of at most MOST_COMPILED rules is compiled into the plan.  A longer one, or
a table of any size, is joined by hash: a host's endings meet the hosts that have
rules, with the lengths that the paths of these have, and then the path's
beginnings of these lengths meet the rules.  Each distinct host and path is judged
once, rows are aggregated by it, and no rule is ever compared with all URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and has no aliases; null or empty html has no links; repeated pages are
judged alike; an empty table gives no rows; of equally long rules allow wins, then
the first in the alphabet; rules without a host or with another verdict than allow
and block are an error in a list, and fit nothing in a table.  The columns uf_host,
uf_path, uf_rule and uf_verdict replace those of these names; all other columns
stay, whatever they are called.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import Scratch, free_name, table
from .components import connected_components

Rule = tuple[str, str, str]
#: Longer lists of rules are joined as a table.
MOST_COMPILED = 200
_RULES = "verdict string, host string, path string"
_JUDGED = "struct<size:int,late:boolean,rule:string,verdict:string>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# Tags and their targets; the same patterns run in the SQL check.
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 2), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node of the alias graph; null where it has no ``://``."""
    scheme = F.translate(F.regexp_extract(url, PARTS, 1), _UPPER, _LOWER)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), _undotted(path_of(url)), F.regexp_extract(url, PARTS, 4)))


def _undotted(path: Column) -> Column:
    """A path that is empty or begins with a slash, without ``.`` and ``..`` segments."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path))
    # A dot segment at the end leaves its slash.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _mark(size: Column, verdict: Column, rule: Column) -> Column:
    """A rule that fits; of several the least decides."""
    return F.struct((-size).cast("int").alias("size"), (verdict != "allow").alias("late"), rule.alias("rule"), verdict.alias("verdict"))


def judged(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), _mark(F.lit(len(h + p)), F.lit(verdict), F.lit(h + p))) for verdict, h, p in rules]
    # array_min of one element is that element; nulls are skipped.
    return F.array_min(F.array(*fits)) if fits else F.lit(None).cast(_JUDGED)


class Rules:
    """A set of rules, as a list or a table (verdict, host, path)."""

    def __init__(self, spark: SparkSession, rules: list[Rule] | DataFrame, scratch: Scratch):
        self.compiled = None if isinstance(rules, DataFrame) else list(rules)
        self.scratch = scratch
        if self.compiled is not None:
            for verdict, host, _ in self.compiled:
                if verdict not in ("allow", "block") or not host:
                    raise ValueError(f"not a rule: {verdict} {host}")
            if len(self.compiled) <= MOST_COMPILED:
                return
            rules = spark.createDataFrame(self.compiled, _RULES)
            self.compiled = None
        usable = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict in ('allow', 'block') and host <> ''")
        mark = _mark(F.length("host") + F.length("path"), F.col("verdict"), F.concat("host", "path"))
        self.best = scratch.save(usable.groupBy("host", "path").agg(F.min(mark).alias("mark")), "rules")
        # One row for each host: the lengths of its paths, of which a URL has no more than its path has characters.
        self.lengths = scratch.save(self.best.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")), "rule-lengths")

    def judge(self, rows: DataFrame, host: str, path: str, into: str) -> DataFrame:
        """``rows`` with the column ``into``: struct(size, late, rule, verdict) of the rule that decides, else null."""
        if self.compiled is not None:
            return rows.withColumn(into, judged(F.col(host), F.col(path), self.compiled))
        pairs = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).where("h <> ''").distinct()
        labels = F.split("h", r"\.")
        endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        ending = pairs.select("h", "p", F.explode(endings).alias("host")).where("host <> ''")
        begin = ending.join(self.lengths, "host").select("h", "p", "host", F.explode(F.filter("lengths", lambda n: n <= F.length("p"))).alias("n"))
        met = begin.select("h", "p", "host", F.expr("substring(p, 1, n)").alias("path")).join(self.best, ["host", "path"])
        found = self.scratch.save(met.groupBy("h", "p").agg(F.min("mark").alias("mark")), "judged")
        h, p, mark = (free_name(n, rows.columns) for n in ("uf_h", "uf_p", "uf_mark"))
        found = found.select(F.col("h").alias(h), F.col("p").alias(p), F.col("mark").alias(mark))
        return rows.join(found, (F.col(host) == F.col(h)) & (F.col(path) == F.col(p)), "left").withColumn(into, F.col(mark)).drop(h, p, mark)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: nodes that a page ties by a canonical link or an immediate redirect."""
    html, url = F.col(html_col), F.col(url_col)
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    moves = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TO, 1))
    links = pages.where(F.contains(url, F.lit("://")) & html.isNotNull()).select(node_of(url).alias("a"), url.alias("from_url"), F.explode(F.concat(hrefs, moves)).alias("raw"))
    to = F.regexp_replace(F.replace(F.col("raw"), F.lit("&amp;"), F.lit("&")), r"(?s)#.*$", "")
    scheme = F.regexp_extract("from_url", PARTS, 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract("from_url", PARTS, 2))
    path = F.regexp_extract("from_url", PARTS, 3)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    whole = (
        F.when(to.rlike(SCHEME + "//"), to)
        .when(to.rlike(SCHEME), F.lit(None))  # mailto: and the like
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to == "", F.concat(site, path, F.regexp_extract("from_url", PARTS, 4)))
        .when(to.startswith("?"), F.concat(site, path, to))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return links.where("raw <> ''").select("a", node_of(whole).alias("b"))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with uf_host, uf_path, uf_rule and uf_verdict (columns of these names are replaced).

    ``rules`` is a list of (verdict, host, path), or a table of these columns.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    law = Rules(pages.sparkSession, rules, scratch)
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    members = scratch.save(connected_components(edges, scratch), "members")
    ruled = law.judge(members.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), "host", "path", "own").select("node", "component", F.col("own.verdict").alias("own"))
    groups = scratch.save(ruled.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")), "groups")
    url, added = F.col(url_col), ("uf_host", "uf_path", "uf_rule", "uf_verdict")
    kept = [c for c in pages.columns if c not in added]
    at, own, hit = (free_name(n, pages.columns) for n in ("uf_at", "uf_own", "uf_hit"))
    decided = scratch.save(members.join(groups, "component").where("blocked and not coalesce(allowed, false)").select(F.col("node").alias(hit)), "blocked")
    out = pages.select(*kept, host_of(url).alias("uf_host"), path_of(url).alias("uf_path"), node_of(url).alias(at))
    out = law.judge(out, "uf_host", "uf_path", own).join(decided, F.col(at) == F.col(hit), "left")
    verdict = F.coalesce(F.col(f"{own}.verdict"), F.when(F.col(hit).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*kept, "uf_host", "uf_path", F.col(f"{own}.rule").alias("uf_rule"), verdict.alias("uf_verdict"))


#: The rules of the registered query.
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return out.select("page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"), F.col("uf_verdict").alias("verdict"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_node(url: str) -> str:
    part = lambda k: f"regexp_extract({url}, {_quoted(PARTS)}, {k})"
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    return f"CASE WHEN contains({url}, '://') THEN {low(part(1))} || '://' || {low(part(2))} || {part(3)} || {part(4)} END"


def _sql_rule(host: str, path: str) -> str:
    fits = [f"CASE WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p}' END" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))]
    return f"coalesce({', '.join(fits)})"


def _sql_verdict(rule: str) -> str:
    return "CASE " + rule + " " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " END"


_U = "p.url"
OP9_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, {_quoted(PARTS)}, 2), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, {_quoted(PARTS)}, 3), '') AS path,
         {_sql_node('url')} AS node
  FROM pages),
raw AS (
  SELECT node, url, unnest(list_concat(
           list_transform(regexp_extract_all(html, {_quoted(CANONICAL)}, 0), lambda t: regexp_extract(t, {_quoted(HREF)}, 1)),
           list_transform(regexp_extract_all(html, {_quoted(REFRESH)}, 0), lambda t: regexp_extract(t, {_quoted(TO)}, 1)))) AS target
  FROM parts WHERE node IS NOT NULL AND html IS NOT NULL),
whole AS (
  SELECT node, replace(target, '&amp;', '&') AS t,
         regexp_extract(url, {_quoted(PARTS)}, 1) AS scheme,
         regexp_extract(url, {_quoted(PARTS)}, 1) || '://' || regexp_extract(url, {_quoted(PARTS)}, 2) AS site,
         regexp_replace(regexp_extract(url, {_quoted(PARTS)}, 3), '[^/]*$', '') AS folder
  FROM raw WHERE target <> ''),
resolved AS (
  SELECT node AS a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
         WHEN starts_with(t, '/') THEN site || t ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS target
  FROM whole),
one_way AS (SELECT a, {_sql_node('target')} AS b FROM resolved),
ties AS (SELECT a, b FROM one_way WHERE b IS NOT NULL UNION SELECT b, a FROM one_way WHERE b IS NOT NULL),
reach AS (SELECT a, a AS b FROM ties UNION SELECT r.a, t.b FROM reach r JOIN ties t ON r.b = t.a),
facts AS (
  SELECT b AS member, translate(regexp_extract(b, {_quoted(PARTS)}, 2), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(b, {_quoted(PARTS)}, 3) AS path, a FROM reach),
verdicts AS (SELECT a, {_sql_verdict(_sql_rule('host', 'path'))} AS v FROM facts),
groups AS (SELECT a, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS blocked FROM verdicts GROUP BY a),
ruled AS (SELECT *, {_sql_rule('host', 'path')} AS rule FROM parts)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce({_sql_verdict('r.rule')}, CASE WHEN g.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN groups g ON r.node = g.a
"""
