"""Verdicts on page urls, carried over to their aliases, with built-in functions only.

A rule names a host and the start of a path. Pages that redirect to each other or name
each other as canonical are aliases: links found in the html make a graph of urls, and a
block on one url of a connected component holds for all pages in it, except for those
that a rule allows by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.components import components
from corpusloom.llm.shared import shared_folder, stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
TAG = r"""(?is)<%s\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?is)[\s"'/]%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
REDIRECT = r"""(?is)\burl\s*=\s*["']?([^"']*)"""
AROUND = r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
# named and numeric forms; the ampersand comes last
ENTITIES = [('"', "quot|#34|#x22"), ("'", "apos|#39|#x27"), ("<", "lt|#60|#x3c"), (">", "gt|#62|#x3e"), ("&", "amp|#38|#x26")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def address(url: Column) -> Column:
    """The url without scheme and fragment, which don't tell pages apart; the path without
    dot segments, and / for none."""
    return F.when(host(url) != "", F.concat(host(url), _plain_path(path(url)), _query(url))).otherwise("")


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))


def _plain_path(path: Column) -> Column:
    """Every .. takes the segment before it away."""
    closed = F.regexp_replace(path, r"/(\.\.?)\z", "/$1/")
    kept = F.aggregate(
        F.slice(F.split(closed, "/"), 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def matching(rules: list[Rule], host: Column, path: Column, answer) -> Column:
    """answer(rule) of the longest rule that fits; of equally long ones an allow. Rules
    are part of the plan: a list of some hundred at most."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(answer(rule))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, ATTRIBUTE % name, i) for i in (1, 2, 3)])


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(TAG % name), F.lit(0))


def _decoded(text: Column) -> Column:
    for char, names in ENTITIES:
        text = F.regexp_replace(text, f"(?i)&(?:{names});", char)
    return F.regexp_replace(text, AROUND, "")


def resolved(target: Column, url: Column) -> Column:
    """The full url of a link target on a page: with a scheme of its own, or that of the page's
    scheme, host, folder or page. NULL for targets that name no page of a host."""
    site = F.concat(F.lit("http://"), host(url))
    folder = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), r"[^/]*\z", "")
    return (
        F.when(target == "", None)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .when(target.startswith("#"), F.concat(site, path(url), _query(url)))
        .otherwise(F.concat(site, folder, target))
    )


def links(pages: DataFrame) -> DataFrame:
    """from_url and to_url (as addresses) of all canonical links and refresh redirects in
    pages: every link tag with the word canonical in its rel, every refresh tag. Targets
    are decoded and resolved against the page's url; a base tag does not count."""
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    named = lambda tag: F.array_contains(F.split(F.regexp_replace(F.lower(_attribute(tag, "rel")), AROUND, ""), r"\s+"), "canonical")
    canonical = F.transform(F.filter(_tags(html, "link"), named), lambda tag: _attribute(tag, "href"))
    refresh = lambda tag: F.regexp_replace(F.lower(_attribute(tag, "http-equiv")), AROUND, "") == "refresh"
    content = lambda tag: F.regexp_extract(_attribute(tag, "content"), REDIRECT, 1)
    redirects = F.transform(F.filter(_tags(html, "meta"), refresh), content)
    found = pages.filter("url IS NOT NULL").select(url, F.explode(F.concat(canonical, redirects)).alias("target"))
    full = resolved(_decoded(F.col("target")), url)
    return found.select(address(url).alias("from_url"), address(full).alias("to_url")).filter("from_url != '' AND to_url != ''")


def judged(pages: DataFrame, rules: list[Rule], folder: str | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict.

    The verdict is that of the longest fitting rule. Without a rule a page is blocked if
    a url of its component is blocked by a rule, and else allowed. A null url, or one
    without ://, has an empty host and path, no rule and no aliases. Null html has no
    links. Rows with equal or null page_id are judged one by one. Other columns are
    ignored."""
    folder = folder or shared_folder(pages.sparkSession)
    rule = lambda h, p: matching(rules, h, p, lambda r: r.name)
    verdict = lambda h, p: matching(rules, h, p, lambda r: r.verdict)
    edges = stored(links(pages), folder, "links")
    member = components(edges, "from_url", "to_url", folder)
    # an address starts with the host
    inner = F.concat(F.lit("http://"), F.col("node"))
    blocked = member.filter(verdict(host(inner), path(inner)) == "block").select("component").distinct()
    aliases = member.join(blocked, "component").select(F.col("node").alias("address")).distinct()
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"))).withColumn("own", verdict(F.col("host"), F.col("path")))
    rows = rows.join(aliases.withColumn("alias", F.lit("block")), "address", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))
