"""URL rules that reach aliases: pages that redirect to one another or share a canonical link.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import components, let, materialize


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block. A rule fits its host and all subdomains where the path
    starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _node(url: Column) -> Column:
    """A URL without scheme and fragment, host in lower case; null without ``://``."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, path, query))


#: How markup writes signs that urls hold; the ampersand itself comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _unescaped(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments; those above the root are dropped."""
    one_less = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", one_less(acc)).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    joined = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(~path.contains("/."), path).otherwise(let(joined, lambda j: F.when(j == "", "/").otherwise(j)))


def _resolve(base: Column, target: Column) -> Column:
    """An absolute URL for ``target`` as found on the page ``base``; null for none, for fragments
    alone and for other schemes' addresses such as mail."""
    # Every part is computed once: it stands in several of the cases.
    return let(F.struct(base.alias("base"), F.trim(_unescaped(target)).alias("target")), lambda t: let(_link_parts(t["base"], t["target"]), _resolved))


def _link_parts(base: Column, target: Column) -> Column:
    host, path = url_parts(base)
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    own_path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return F.struct(base.alias("base"), target.alias("target"), scheme.alias("scheme"), host.alias("host"), path.alias("path"), own_path.alias("own"), rest.alias("rest"))


def _resolved(p: Column) -> Column:
    base, target, path, rest = p["base"], p["target"], p["path"], p["rest"]
    root = F.concat(p["scheme"], F.lit("://"), p["host"])
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/"))
    merged = F.when(target.startswith("/"), p["own"]).otherwise(F.concat(folder, p["own"]))
    return (
        F.when(target.isNull() | (target == ""), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(p["scheme"], F.lit(":"), target))
        .when(~base.contains("://"), F.lit(None).cast("string"))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:|^#"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, let(merged, _without_dots), rest))
    )


#: Tags that tie a page to another URL.
LINK_TAG = r"(?i)<link\s[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b[^>]*>"
META_TAG = r"(?i)<meta\s[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[^>]*>"
BASE_TAG = r"(?i)<base\s[^>]*\bhref[^>]*>"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?i)\burl\s*=\s*['\"]?([^'\"\s>]+)"


def page_edges(pages: DataFrame) -> DataFrame:
    """Canonical-link and refresh edges ``a``, ``b`` between URLs, read from all such tags of the
    pages' html. Relative links are resolved against the page, or its first base tag. Pages without
    url or html have none."""
    html, none = F.col("html"), F.array().cast("array<string>")
    href = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), href)
    metas = F.transform(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH, 1))
    # Most pages have neither tag; a plain search for the words is far cheaper.
    low = F.lower("html")
    targets = F.concat(F.when(low.contains("canonical"), links).otherwise(none), F.when(low.contains("refresh"), metas).otherwise(none))
    base = F.when(low.contains("<base"), F.nullif(href(F.regexp_extract(html, BASE_TAG, 0)), F.lit("")))
    found = pages.select("url", base.alias("base"), F.explode(targets).alias("to")).where("url is not null and to <> ''")
    found = found.withColumn("at", F.coalesce(_resolve(F.col("url"), F.col("base")), F.col("url")))
    return found.select(_node(F.col("url")).alias("a"), _node(_resolve(F.col("at"), F.col("to"))).alias("b"))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct ``text``, ``verdict``; null if none does."""
    chain = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def judge_pages(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Judge the ``url`` of every page.

    Returns a row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (the longest
    that fits, else null), ``verdict`` and ``component`` (the least URL of the page's aliases;
    null without aliases). A rule's verdict stands, so an explicit allow holds even where an
    alias is blocked. Without a rule a page is blocked if a rule blocks any of its aliases, and
    else allowed. Aliases are the connected components over the pages' canonical links and
    refreshes and over ``redirects`` (columns ``from_url``, ``to_url``), through any number of
    steps and through URLs that aren't pages. Null urls have empty parts and no aliases. Pages
    need ``page_id``, ``url`` and ``html``; other columns aren't read; no rows give no rows.

    Rules are part of the plan: a list in code, not a table.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(_node(F.col("from_url")), _node(F.col("to_url"))))
    groups = materialize(components(edges, "aliases"), "alias-groups")
    own_host, own_path = F.regexp_extract("node", r"^[^/?]*", 0), F.regexp_extract("node", r"^[^/?]*(/[^?]*)?", 1)
    blocked = groups.withColumn("rule", rule_of(own_host, own_path, rules)).groupBy("component").agg(F.max(F.coalesce(F.col("rule.verdict") == "block", F.lit(False))).alias("blocked"))
    groups = groups.join(blocked, "component")
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(groups, "node", "left")
    verdict = F.coalesce("own.verdict", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("own.text").alias("rule"), verdict.alias("verdict"), "component")
