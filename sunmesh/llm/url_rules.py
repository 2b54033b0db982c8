"""URL block and allow rules, carried over to aliases by redirect and canonical-link edges. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.components import connected_components
from sunmesh.sources.tables import materialise

# The rules of the contract, (host, path) and what they say.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """From ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def _address(url: Column) -> Column:
    """A page's node: host and the rest without fragment; the scheme doesn't tell pages apart."""
    tail = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(tail == "", "/").otherwise(tail)))


def _folded(path_: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(path_, "/")
    # A folder named by its dots ends in a slash.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    above = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    step = lambda done, part: F.when(part == ".", done).when(part == "..", above(done)).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(to: Column, url: Column) -> Column:
    """The address that a page at ``url`` names by ``to``; null if that is the page itself, or no address (``mailto:``)."""
    site = F.concat(F.regexp_extract(url, r"^([^:]*)://", 1), F.lit("://"), host(url))
    own = F.when(path(url) == "", "/").otherwise(path(url))
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    front, back = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), to)
        .when((to == "") | to.startswith("#") | F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:]*)://", 1), F.lit(":"), to))
        .when(to.startswith("?"), F.concat(site, own, to))
        .when(to.startswith("/"), F.concat(site, _folded(front), back))
        .otherwise(F.concat(site, _folded(F.concat(folder, front)), back))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``from_url, to_url``: what all canonical links and refreshes in the pages (``url, html``) name.

    Tags may have their attributes in any order, and ``canonical`` may be one
    of several words of ``rel``. Relative addresses are resolved against the
    page's first ``base`` address, else against its url.
    """
    rel = r"\srel\s*=\s*(?:[\"'](?:[^\"'>]*\s)?canonical(?=[\s\"'])|canonical(?=[\s/>]))"
    links = F.regexp_extract_all("html", F.lit(rf"(?is)(<link\b[^>]*{rel}[^>]*>)"), 1)
    metas = F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    base = F.regexp_extract("html", r"(?is)<base\b[^>]*\shref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    named = [F.col("url"), links.alias("links"), metas.alias("metas"), base.alias("base")]
    tagged = pages.filter("url is not null and html is not null").select(named).filter("size(links) > 0 or size(metas) > 0")
    # Few pages pass; they are stored, so that their addresses are worked out on them alone.
    tagged = materialise(tagged, "tags")
    moved = lambda tag: F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']?\s*\d+\s*[;,]\s*url\s*=\s*'?([^\"'\s>]+)", 1)
    href = lambda tag: F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    plain = lambda c: F.regexp_replace(c, "&amp;", "&")
    against = F.coalesce(resolved(plain("base"), F.col("url")), F.col("url"))
    named = tagged.select("url", against.alias("against"), F.explode(F.concat(F.transform("links", href), F.transform("metas", moved))).alias("to"))
    return named.select(F.col("url").alias("from_url"), resolved(plain("to"), F.col("against")).alias("to_url")).filter("to_url is not null")


def longest_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of ``text`` and ``says`` of the longest rule that fits; null if none does. A rule fits its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda d, p: ((host_ == d) | host_.endswith(f".{d}")) & path_.startswith(p)
    return F.coalesce(*(F.when(fits(d, p), F.struct(F.lit(d + p).alias("text"), F.lit(says).alias("says"))) for d, p, says in ordered))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdict of every page (``page_id, url, html``), one row per input row.

    A url that a rule fits has the rule's verdict. Any other one is judged by
    its aliases, the urls of its connected component over ``edges``
    (``from_url, to_url``; default: those found in the pages): an explicitly
    allowed alias allows it, else an explicitly blocked one blocks it, else it
    is allowed. Urls that only edges name count as aliases, too. Null urls and
    those without ``://`` have empty host and path, no rule and are allowed;
    repeated rows each get their row; no pages give no rows. Addresses are
    compared by 64-bit hashes.
    """
    edges = link_edges(pages) if edges is None else edges
    url = F.col("url")
    parts = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"), F.xxhash64(_address(url)).alias("node"), (F.instr(url, "://") > 0).alias("_is_url"))
    judged = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    # Stored, so that the addresses' expressions aren't folded into those that find the links.
    ends = materialise(edges.select("from_url", "to_url"), "links")
    ends = ends.filter((F.instr("from_url", "://") > 0) & (F.instr("to_url", "://") > 0))
    node = {c: F.xxhash64(_address(F.col(c))) for c in ("from_url", "to_url")}
    groups = connected_components(ends.select(node["from_url"].alias("a"), node["to_url"].alias("b")))
    named = ends.select(F.col("from_url").alias("url")).union(ends.select("to_url"))
    named = named.select(F.xxhash64(_address(url)).alias("node"), host(url).alias("host"), path(url).alias("path"))
    said = named.select("node", longest_rule(F.col("host"), F.col("path"), rules)["says"].alias("says"))
    # All urls of one node have the same host and path, hence the same verdict.
    spoken = said.filter("says is not null").join(groups, "node")
    decisions = spoken.groupBy("component").agg(F.max(F.col("says") == "allow").alias("allowed"))
    inherited = groups.join(decisions, "component").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("_inherited"))
    # One row per node on the right; a node with very many pages is split by adaptive execution.
    joined = judged.join(inherited, (judged["node"] == inherited["node"]) & judged["_is_url"], "left").drop(inherited["node"])
    return joined.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), F.coalesce("_rule.says", "_inherited", F.lit("allow")).alias("verdict"))
