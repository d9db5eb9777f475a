"""URL rules with redirect equivalence: blocks reach the aliases of a blocked address.

Rules are (action, host, path): a rule fits its host and all subdomains when the address's
path starts with the rule's path, and the longest fitting rule decides. Addresses that
redirect to one another, or name a canonical address, are one page under several names;
these links are edges, and the connected components over them are found with joins and
aggregates. A page that no rule decides takes its component's decision: an explicit allow
in the component has precedence, then an explicit block; without either it is allowed.

Edges come from each page's canonical link and refresh redirect and from any further
(from, to) table. Only pages with an edge take part in the graph; all others are judged
row by row without a shuffle.

Defined results: null address, or one without ``://``, has empty host and path, no rule
and the verdict allow; relative targets that start with ``/`` are taken on the page's own
host, other relative ones are ignored; a tag ends at its first ``>`` and holds no ``<``; the longest rule is unique by its length, equal
lengths going to allow; repeated rows give the same row again; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, likely_among, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Within one tag, from its name on: the address of a canonical link and of a refresh.
CANONICAL = r"""(?is)^link\b(?=.*?\brel\s*=\s*["']?canonical\b).*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)^meta\b(?=.*?\bhttp-equiv\s*=\s*["']?refresh\b).*?\burl\s*=\s*["']?([^"'\s>]+)"""
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    # the last wrapped is tested first: shortest rules go in first
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def name_of(url: Column) -> Column:
    """The address as a node: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1), F.lit(""))
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query)


def _target(page: Column, tag: str, pattern: str) -> Column:
    """The first address that a tag of that name gives; tags are cut out first, so that a page is read once."""
    tags = F.filter(F.split(page, "<"), lambda t: F.rlike(t, F.lit(rf"(?i)^{tag}\b")) & F.contains(t, F.lit(">")))
    found = F.filter(F.transform(tags, lambda t: F.regexp_extract(F.substring_index(t, ">", 1), pattern, 1)), lambda x: x != "")
    return F.get(found, F.lit(0))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from, to) addresses by each page's canonical link and refresh redirect."""
    x, page = F.col(url), F.col(html)
    found = []
    for word, tag, pattern in (("canonical", "link", CANONICAL), ("refresh", "meta", REFRESH)):
        # the plain search spares the pattern nearly all pages
        target = F.when(F.contains(F.lower(page), F.lit(word)), _target(page, tag, pattern))
        target = F.regexp_replace(target, "&amp;", "&")
        scheme = F.regexp_extract(x, r"(?s)^(.*?://)", 1)
        target = (
            F.when(F.contains(target, F.lit("://")), target)
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(scheme, host_of(x), target))
        )
        found.append(target)
    rows = pages.where(F.contains(x, F.lit("://"))).select(x.alias("from"), F.explode(F.array(*found)).alias("to"))
    return rows.where(F.contains("to", F.lit("://")))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    redirects: DataFrame | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Per page: key, host, path, rule (null: none fits), verdict (allow or block)."""
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from", "to").where(F.contains("from", F.lit("://")) & F.contains("to", F.lit("://"))))
    ends = edges.select(name_of(F.col("from")).alias("f"), name_of(F.col("to")).alias("t"), F.col("from"), F.col("to")).where("f <> t")
    ends = materialize(ends)
    decided = None
    if not ends.isEmpty():
        # nodes by a number; two hashes of an address would have to clash for two to be taken as one
        names = ends.select(F.explode(F.array("f", "t")).alias("name")).distinct()
        names = materialize(names.withColumn("node", F.monotonically_increasing_id()))
        numbered = ends.join(names.toDF("f", "u"), "f").join(names.toDF("t", "v"), "t").select("u", "v")
        component = connected_components(numbered, "u", "v").join(names, "node").select("name", "component")
        component = materialize(component)
        # decisions of all members, whether a page of the table or only the end of an edge
        members = ends.select("f", "from").union(ends.select("t", "to")).toDF("name", "member").distinct()
        action = best_rule(host_of(F.col("member")), path_of(F.col("member")), rules)["action"]
        votes = members.join(component, "name").groupBy("component").agg(F.max(action == "allow").alias("allow"), F.max(action == "block").alias("block"))
        decided = component.join(votes, "component").select("name", F.when(F.col("block") & ~F.coalesce("allow", F.lit(False)), "block").otherwise("allow").alias("shared"))
    x = F.col(url)
    rows = pages.select(F.col(key).alias(key), x.alias("_url"), host_of(x).alias("host"), path_of(x).alias("path"))
    rows = rows.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = [F.col("_best.action")]
    if decided is not None:
        # only pages that the graph may know are shuffled
        decided = materialize(decided)
        rows = rows.withColumn("name", F.when(F.contains("_url", F.lit("://")), name_of(F.col("_url"))))
        known, others = likely_among(rows, "name", decided.select("name"))
        rows = known.join(decided, "name", "left").unionByName(others.withColumn("shared", F.lit(None).cast("string")))
        verdict.append(F.col("shared"))
    return rows.select(key, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(*verdict, F.lit("allow")).alias("verdict"))


def oracle(rules: Sequence[Rule], table: str = "pages", key: str = "page_id", url: str = "url") -> str:
    """SQL for pages without redirect or canonical links."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    fits = lambda h, p: f"((host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)}))"
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    rule = " ".join(f"WHEN {fits(h, p)} THEN {text(h + p)}" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN {text(a)}" for a, h, p in ranked)
    return f"""
WITH cut AS (SELECT {key}, CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END AS rest FROM {table}),
split AS (SELECT {key}, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT {key}, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM split"""
