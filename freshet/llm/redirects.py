"""URL rules carried over redirects and canonical links.

A page's html may name another address: ``<link rel="canonical" href=...>`` or a refresh with a
``url=``. These edges join addresses to groups (connected components); addresses that differ in
nothing but the fragment are one. A page that no rule fits gets ``block`` if a rule blocks an
address of its group and no rule allows one, else ``allow``. A page's own rule always comes first.

Everything is a DataFrame expression; rules are a parameter, compared as expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.common import keep
from freshet.llm.components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*(?:\"[^\"]*?\burl\s*=\s*'?([^\"']*)|'[^']*?\burl\s*=\s*\"?([^\"']*))"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, at: Column, where: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    return ((at == rule.host) | at.endswith(f".{rule.host}")) & where.startswith(rule.path)


def judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add rule and ruled (its verdict) for host and path; the longest rule that fits, else null.

    Of rules of one length an allowing one comes first.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        match = fits(r, F.col("host"), F.col("path"))
        rule = F.when(match, F.lit(r.name)).otherwise(rule)
        ruled = F.when(match, F.lit(r.verdict)).otherwise(ruled)
    return df.withColumns({"rule": rule, "ruled": ruled})


def address(url: Column) -> Column:
    """The url as a node: scheme and fragment dropped, host lower-cased, an empty path is ``/``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    where = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(url.contains("://"), F.concat(host(url), where, F.coalesce(rest, F.lit(""))))


def absolute(link: Column, url: Column) -> Column:
    """A link as found on the page of that url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host(url), link))
        .when(link == "", None)
        .otherwise(F.concat(scheme, F.lit("://"), host(url), F.when(folder == "", "/").otherwise(folder), link))
    )


def _found(pattern: str, groups: int) -> Column:
    html = F.coalesce(F.col("html"), F.lit(""))
    parts = [F.regexp_extract(html, pattern, g) for g in range(1, groups + 1)]
    return F.trim(F.regexp_replace(F.concat(*parts), "(?i)&amp;", "&"))


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses joined by a canonical link or a redirect."""
    known = pages.where(F.col("url").contains("://") & F.col("html").isNotNull())
    each = known.select("url", F.explode(F.array(_found(LINK, 3), _found(REFRESH, 2))).alias("link")).where("link != ''")
    return each.select(address(F.col("url")).alias("a"), address(absolute(F.col("link"), F.col("url"))).alias("b")).where("b is not null and a != b").distinct()


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of (page_id, url, html).

    Urls that are null or hold no ``://`` have an empty host and path, fit no rule, have no
    address and are allowed. Null html has no links. Repeated rows are judged each.
    """
    own = pages.select(F.col("page_id"), F.col("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = judged(own.withColumn("address", address(F.col("url"))), rules)
    linked, _ = keep(edges(pages.select("url", "html")), "redirects")
    # only addresses on an edge can get another verdict from their group
    groups = components(linked, "redirect-groups")
    nodes = groups.select(F.col("node"), F.col("component")).union(groups.select("component", "component")).distinct()
    asked = nodes.withColumns({"host": F.regexp_extract("node", "(?s)^([^/]*)", 1), "path": F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1)})
    asked = judged(asked, rules)
    said = asked.groupBy("component").agg(F.max((F.col("ruled") == "block").cast("int")).alias("blocked"), F.max((F.col("ruled") == "allow").cast("int")).alias("allowed"))
    said = said.where("blocked = 1 and coalesce(allowed, 0) = 0").select("component")
    blocked = nodes.join(said, "component", "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("passed"))
    out = own.join(blocked, "address", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "passed", F.lit("allow")).alias("verdict"))
