"""Operator 4: URL rules and redirect equivalence, in native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import cut, named
from pointweave.llm.components import components

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules that one expression may hold; a longer list is a table and belongs in match_rules.
INLINE_RULES = 1000
#: Query parameters that name no other page.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that name another address of the page, and where in them it stands.
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*['"]?([^"'\s>;]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    rest = after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """The address without scheme, fragment, tracking parameters and last slash: pages that share it are one page."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    left = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), F.when(left != "", F.concat(F.lit("?"), left)).otherwise("")))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its . and .. segments resolved."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def target_of(url: Column, link: Column) -> Column:
    """An address in a page as an absolute one (RFC 3986, 5.2); null for what is not an address of a page: another
    scheme than http, an empty link, or a relative one in a page whose url has no ``://``."""
    origin = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^:/?#]+):", 1)
    own, path = path_of(url), F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.substring(link, F.length(path) + 1, F.length(link))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, "^(.*/)", 1))
    return (
        F.when(F.length(link) == 0, None)
        .when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(F.length(origin) == 0, None)
        .when(link.startswith("/"), F.concat(origin, without_dots(path), rest))
        .when(link.startswith("?"), F.concat(origin, own, link))
        .when(link.startswith("#"), F.concat(origin, own, query))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def links_of(html: Column, hint: str, tag: str, address: str) -> Column:
    """The addresses of all tags of a kind, &amp; read as &; texts without ``hint`` are not searched."""
    tags = F.when(F.lower(html).contains(hint), F.regexp_extract_all(html, F.lit(tag), F.lit(0)))
    found = F.transform(tags, lambda x: F.regexp_replace(F.regexp_extract(x, address, 1), "(?i)&amp;", "&"))
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def inline_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule (ties: the longer host, then text order), or null."""
    if len(rules) > INLINE_RULES:
        raise ValueError(f"{len(rules)} rules: pass them to match_rules as a table")
    best = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    out = F.lit(None)
    for verdict, h, p in reversed(best):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) with verdict and rule of the longest fitting rule, for rule tables of any size.

    Distinct (host, path) rows meet the rules on each suffix of the host and on the path up to each length that a
    rule has, so no row meets rules that do not fit it.
    """
    lengths = F.broadcast(rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths")))
    at = pages.select("host", "path").distinct().crossJoin(lengths)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    at = at.withColumn("r_host", F.explode(suffixes)).withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    at = at.select("host", "path", "r_host", F.expr("left(path, length)").alias("r_path"))
    hit = at.join(rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict"), ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = F.min(F.struct(-F.length(rule), -F.length("r_host"), rule.alias("rule"), F.col("verdict"))).alias("best")
    return hit.groupBy("host", "path").agg(best).select("host", "path", F.struct("best.verdict", "best.rule").alias("own"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (or null) and verdict.

    Pages with a rule get its verdict: an explicit allow holds whatever the aliases are. Pages without one take the
    verdict of their class, the component over shared page keys, canonical links, refresh redirects and the rows of
    ``redirects`` (source, target urls): allow if a rule allows a member, else block if a rule blocks one, else allow.
    A null url, or one without ``://``, has empty host and path, is alone in its class and allowed. Pages that repeat
    an id keep a row each; empty tables give empty results; other columns are not read. A result column that the id has
    the name of gets ``_result`` behind it.
    """
    url = F.col(url_col).cast("string")
    to_keys = F.expr("cast(array() as array<string>)")
    if html_col:
        html = F.col(html_col).cast("string")
        links = F.concat(links_of(html, "canonical", CANONICAL, HREF), links_of(html, "refresh", REFRESH, REFRESH_URL))
        to_keys = F.array_compact(F.transform(links, lambda x: page_key(target_of(url, x))))
    slim = pages.select(F.col(id_col).alias("pw_id"), host_of(url).alias("host"), path_of(url).alias("path"), page_key(url).alias("page_key"), to_keys.alias("to_keys"))
    if isinstance(rules, DataFrame):
        slim = cut(slim, "page-keys")
        slim = slim.join(match_rules(slim, rules), ["host", "path"], "left")
    else:
        slim = cut(slim.withColumn("own", inline_rule(F.col("host"), F.col("path"), rules)), "page-keys")
    edges = slim.where("page_key is not null").select(F.col("page_key").alias("a"), F.explode("to_keys").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(page_key(F.col("source")).alias("a"), page_key(F.col("target")).alias("b")))
    parts = components(edges.where("a <> b").distinct())
    keys = slim.where("page_key is not null").groupBy("page_key").agg(F.bool_or(F.col("own.verdict") == "allow").alias("allowed"), F.bool_or(F.col("own.verdict") == "block").alias("blocked"))
    keys = keys.join(parts.select(F.col("node").alias("page_key"), "component"), "page_key", "left").withColumn("component", F.coalesce("component", "page_key"))
    classes = keys.groupBy("component").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
    blocked = classes.where("blocked and not coalesce(allowed, false)").select("component")
    aliases = keys.join(blocked, "component", "left_semi").select(F.col("page_key"), F.lit(True).alias("by_alias"))
    alone = slim.where("page_key is null").withColumn("by_alias", F.lit(None).cast("boolean"))
    judged = slim.where("page_key is not null").join(aliases, "page_key", "left").select(*alone.columns).unionByName(alone)
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("by_alias"), "block").otherwise("allow"))
    names = named(id_col, ["host", "path", "rule", "verdict"])
    values = (F.col("host"), F.col("path"), F.col("own.rule"), verdict)
    return judged.select(F.col("pw_id").alias(id_col), *(v.alias(n) for v, n in zip(values, names, strict=True)))
