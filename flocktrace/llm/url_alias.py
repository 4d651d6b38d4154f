"""URL filters whose decisions hold for all addresses of a page.

Rules decide on urls by host and path.  Redirects and canonical links say that two addresses are one page; connected
components over these edges carry a block to every alias, unless the page has an address that a rule allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from .common import checked, staged

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lowered; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit(""))


def address(url: Column) -> Column:
    """The url as a node of the alias graph: lowered host, path and query, without scheme and fragment; null for urls without a host."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def _plain_path(path: Column) -> Column:
    """A path without . and .. segments; .. at the root stays there."""
    segments = F.split(path, "/")
    fold = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.lit(1), F.size(a) - 1))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.lit(0), F.size(segments) - 1)), F.array(F.lit("")), fold)
    # a path that ends in a dot segment is that of a folder
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.when(F.size(ended) == 1, F.lit("/")).otherwise(F.lit("")), F.array_join(ended, "/"))


def resolved(url: Column, target: Column) -> Column:
    """The target of a link on the page at url: itself where it names a scheme, else taken from the page's scheme, host and path.

    Targets that start with ?, and empty ones, keep the page's path; fragments go.
    """
    bare = F.regexp_extract(target, r"^[^#]*", 0)
    path, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"(\?.*)?$", 1)
    scheme = F.regexp_extract(url, r"^[^:/?#]*", 0)
    root, folder = F.concat(scheme, F.lit("://"), host_of(url)), F.regexp_extract(path_of(url), r"^(.*/)?", 1)
    from_root = F.concat(root, _plain_path(path), query)
    from_folder = F.concat(root, _plain_path(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), query)
    from_page = F.concat(root, path_of(url), query)
    named = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
    return named.when(bare.startswith("/"), from_root).when(path == "", from_page).otherwise(from_folder)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of the first canonical link and of the refresh, after any delay, that pages state; targets are resolved."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    canonical = F.regexp_extract(link, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    stated = pages.select(F.col(url_col).alias("url"), F.explode(F.array(canonical, refresh)).alias("target")).where("target <> ''")
    return stated.select("url", resolved(F.col("url"), F.col("target")).alias("target"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules (host, path, action; action allow or block): a rule fits its host and all subdomains where the url's path
    starts with the rule's; of several the longest (host and path together) decides, and of equally long ones allow.
    rule is host and path of that one.  Pages that no rule fits are blocked if an alias is blocked and none allowed, and
    allowed otherwise.  redirects (url, target) add to the edges that pages state in html.

    Null urls and urls without :// have an empty host and path, fit no rule and have no alias, so they are allowed; so
    are urls with :// that name no host, which keep their path.
    Repeated pages stay separate rows.  Empty tables give no rows.  Other columns are not read.
    """
    cols = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url")]
    seen = pages.select(*cols, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), address(F.col(url_col)).alias("node"))
    known = checked(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct())
    # the host and each of its parent domains
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    places = seen.where("host <> ''").select("host", "path").distinct()
    fits = places.select("host", "path", F.explode(domains).alias("rule_host")).join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), (F.col("action") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("decided"))
    # one row for each place, read from a table, so that Spark may split the rows of a hot one
    ruled = staged(seen.where("host <> ''").drop("url").join(checked(staged(best, "best")), ["host", "path"], "left"), "ruled")

    edges = redirects.select("url", "target") if redirects is not None else None
    if html_col is not None:
        stated = page_edges(pages, url_col, html_col)
        edges = stated if edges is None else edges.unionByName(stated)
    if edges is None:
        linked = pages.sparkSession.createDataFrame([], "node string, component string")
    else:
        linked = connected_components(edges.select(address(F.col("url")).alias("u"), address(F.col("target")).alias("v")))
    aliases = ruled.select("node", "decided").join(linked, "node").groupBy("component").agg(F.bool_or(F.coalesce(F.col("decided") == "allow", F.lit(False))).alias("any_allow"), F.bool_or(F.coalesce(F.col("decided") == "block", F.lit(False))).alias("any_block"))
    # addresses that are only linked to, and no page, can be decided by rules too
    nodes = linked.join(ruled.select("node").distinct(), "node", "left_anti").select("node", "component", F.split_part("node", F.lit("/"), F.lit(1)).alias("host"), F.regexp_extract("node", r"^[^/]*([^?]*)", 1).alias("path"))
    beyond = nodes.select("component", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."))).alias("rule_host"), "node")
    beyond = beyond.join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("component", "node").agg(F.max(rank).alias("best"))
    beyond = beyond.groupBy("component").agg(F.bool_or("best.allow").alias("any_allow"), F.bool_or(~F.col("best.allow")).alias("any_block"))
    states = aliases.unionByName(beyond).groupBy("component").agg(F.bool_or("any_allow").alias("any_allow"), F.bool_or("any_block").alias("any_block"))
    blocked = linked.join(states.where("any_block and not any_allow"), "component").select("node", F.lit("block").alias("inherited"))
    told = ruled.join(checked(staged(blocked, "blocked")), "node", "left").select("page_id", "host", "path", "rule", F.coalesce("decided", "inherited", F.lit("allow")).alias("verdict"))
    without = seen.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return told.unionByName(without)
