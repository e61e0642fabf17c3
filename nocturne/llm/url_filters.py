"""URL filters: allow and block rules, and blocks that follow redirects and canonical links.

Urls that redirect to each other, or name one another as canonical, are one resource under several names.  The
links become edges, their connected components the resources, and a block of one name holds for all names that have no rule of their own;
an explicit allow of a name therefore comes before a block that another name brings.  DataFrame operations only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize, pick
from nocturne.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def name_of(url: Column) -> Column:
    """The url without scheme and fragment, host in lower case; null without a host."""
    host = host_of(url)
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in quotes or not; empty if the tag has none."""
    found = F.regexp_extract(tag, rf"(?is)[\s'\"]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.replace(F.trim(F.regexp_replace(found, "^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def _targets(html: Column) -> Column:
    """Urls that the page says it stands for or moves to, as written."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)[\s'\"]rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)[\s'\"]http-equiv\s*=\s*[\"']?refresh\b"))
    moved = F.transform(metas, lambda t: F.trim(F.translate(F.regexp_extract(_attribute(t, "content"), r"(?is)[;,]\s*url\s*=\s*(.*)$", 1), "'\"", "")))
    return F.concat(F.transform(links, lambda t: _attribute(t, "href")), moved)


def _resolved(target: Column, host: Column, path: Column) -> Column:
    """A link as written on a page, as an absolute url."""
    site = F.concat(F.lit("http://"), host)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", ""), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): names joined by a canonical link or a refresh in the html."""
    told = pages.select(name_of(F.col("url")).alias("a"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _targets(F.col("html")).alias("targets"))
    found = told.select("a", "host", "path", F.explode("targets").alias("target")).filter("target <> '' and a is not null")
    full = found.select("a", _resolved(F.col("target"), F.col("host"), F.col("path")).alias("full"))
    return full.select("a", name_of(F.col("full")).alias("b")).filter("a <> b")


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]], host: Column, path: Column) -> DataFrame:
    """Add ``rule`` (host and path of the longest rule that fits, else null) and ``ruling`` (allow or block). Ties go to allow, then to the rule's text."""
    best_rule, best_ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):  # later ones win
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best_rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(best_rule)
        best_ruling = F.when(fits, F.lit(action)).otherwise(best_ruling)
    return df.withColumn("rule", best_rule).withColumn("ruling", best_ruling)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, by_link) of every page.

    ``rules``: (allow or block, host, path), a policy the driver holds. A rule fits its host and all subdomains if the path starts with its own; the
    longest, host and path together, wins. Without a rule the verdict is block if a url of the same resource is blocked, else allow;
    ``by_link`` tells those. Resources: canonical links and refreshes in the html, and ``redirects`` (source, target: urls), followed any number of steps
    in both directions. Scheme and fragment of a url don't distinguish resources. A null url or one without ``://`` has empty host and path,
    no rule and no links, and is allowed; null html has no links; repeated pages are judged each; an empty table gives an empty table.
    """
    pages = pick(pages, "page_id", "url", "html")
    edges = link_edges(pages)
    if redirects is not None:
        moved = pick(redirects, "source", "target")
        edges = edges.union(moved.select(name_of(F.col("source")).alias("a"), name_of(F.col("target")).alias("b")).filter("a <> b"))
    linked = components(edges)
    url = F.concat(F.lit("x://"), F.col("id"))
    known = with_rule(linked, rules, host_of(url), path_of(url))
    blocked = materialize(known.filter("ruling = 'block'").select("component").distinct())
    aliases = materialize(linked.join(blocked, "component").select(F.col("id").alias("name"), F.lit(True).alias("linked")).distinct())
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), name_of(F.col("url")).alias("name"))
    ruled = with_rule(named, rules, F.col("host"), F.col("path")).join(aliases, "name", "left")
    by_link = F.col("ruling").isNull() & F.coalesce("linked", F.lit(False))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(by_link, "block").otherwise("allow")).alias("verdict"), by_link.alias("by_link"))
