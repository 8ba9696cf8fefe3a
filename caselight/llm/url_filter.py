"""Block and allow decisions for urls, shared among urls that lead to one page.

A rule names a host and the beginning of a path; it fits the host and all its
subdomains, and the longest that fits decides. A url no rule fits takes the
decision of its equivalents: urls joined by redirects and canonical links,
directly or through others. One explicit allow among them outweighs any block.

Urls that differ in scheme, host case or fragment only are one address. With
``fold=True`` so are www and mobile hosts, tracking parameters and a closing
slash, which some sites use for different pages. Links are read off the pages
themselves - every refresh, and every link that has canonical among its relations
- but not out of comments, scripts, styles or templates; they are resolved
against the page's base or url. Components are found by joins and grouped minima.

Everything is a DataFrame expression. Rules are a table, joined by host and the
beginning of the path, so there may be any number; only the lengths their paths
have are told to every task, a few hundred numbers at most, as a path is a line.

Defined results: a NULL url, or one without ``://``, has an empty host and path,
fits no rule, has no equivalents and is allowed. Rows are judged one by one, so
repeated rows repeat. Of two rules that say the same of one host and path, an
allow counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.components import connected_components
from caselight.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Parameters that name where a reader came from, and host prefixes
# that name a form of the same site.
TRACKING = ("utm_[^=&]*", "ref", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid")
SITE_PREFIX = "^(www|m|mobile|amp)[.]"

# What a page's text is not read for links in, and tags that name an address.
_DEAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
_RELATION = r"""(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
_CANONICAL = rf"""(?i)<link\s(?:[^>]*\s)?rel\s*=\s*{_RELATION}[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?i)<base\s[^>]*>"""
_TO = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled): of each distinct (host, path) of ``urls`` that a
    rule fits, the longest such rule and its verdict."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    sizes = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    asked = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: n <= F.length("path"))
    each = asked.select("host", "path", F.explode(suffixes).alias("r_host"), heads.alias("heads"))
    each = each.select("host", "path", "r_host", F.explode("heads").alias("n"))
    each = each.withColumn("r_path", F.expr("substring(path, 1, n)"))
    told = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    found = each.join(told, ["r_host", "r_path"])
    # Of two as long, that of the longer host.
    size = F.length("r_host") + F.length("r_path")
    longest = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), F.struct(size, F.length("r_host")))
    best = found.groupBy("host", "path").agg(longest.alias("best"))
    return best.select("host", "path", "best.rule", F.col("best.verdict").alias("ruled"))


def address(url: Column, fold: bool = False) -> Column:
    """One spelling for all urls of an address; NULL if there is no host."""
    if not fold:
        rest = F.regexp_extract(after_scheme(url), "(?s)^[^/?#]*([^#]*)", 1)
        rest = F.when(rest == "", "/").otherwise(rest)
        return F.when(host_of(url) != "", F.concat(host_of(url), rest))
    host, path = F.regexp_replace(host_of(url), SITE_PREFIX, ""), F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*[?]([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit("^(" + "|".join(TRACKING) + ")=")))
    query = F.array_join(told, "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def named_in(tags: Column, value: str) -> Column:
    """What each of the tags names."""
    return F.transform(tags, lambda x: F.replace(F.regexp_extract(x, value, 1), F.lit("&amp;"), F.lit("&")))


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` steps taken."""
    steps = F.split(F.substring(path, 2, F.length(path)), "/")
    # A step up or none at the end leaves a folder.
    steps = F.when(F.rlike(path, F.lit("/[.][.]?$")), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    taken = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(x == ".", done)
        .otherwise(F.concat(done, F.array(x))),
    )
    return F.when(F.rlike(path, F.lit("/[.][.]?(/|$)")), F.concat(F.lit("/"), F.array_join(taken, "/"))).otherwise(path)


def resolved(to: Column, base: Column) -> Column:
    """The url that ``to`` names on a page at ``base``: a whole url, or one
    without scheme, host, folders or path. NULL if it is empty or of another kind."""
    scheme = F.concat(F.regexp_extract(base, "^([^:/?#]*):", 1), F.lit(":"))
    site = F.when(host_of(base) != "", F.concat(scheme, F.lit("//"), host_of(base)))
    path, rest = F.regexp_extract(to, "^[^?#]*", 0), F.regexp_extract(to, "(?s)[?#].*", 0)
    at = path_of(base)
    query = F.regexp_extract(after_scheme(base), "^[^?#]*([?][^#]*)", 1)
    folder = F.regexp_extract(at, "(?s)^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), to)
        .when((to == "") | F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
        .when(F.startswith(to, F.lit("/")), F.concat(site, without_dots(path), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(site, at, rest))
        .when(F.startswith(to, F.lit("#")), F.concat(site, at, query, rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    default: str = "allow",
    fold: bool = False,
) -> DataFrame:
    """Per page: its key, ``host``, ``path``, ``rule`` and ``verdict``. Rules
    are (host, path, ``allow`` or ``block``), as a list or a table of these
    columns."""
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    at = F.col("url")
    # Written, so that a page is cleaned once and plans stay short.
    shown = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.regexp_replace(F.col(html), _DEAD, " ").alias("html"))
    canonical, refresh, base = (F.regexp_extract_all("html", F.lit(x), F.lit(0)) for x in (_CANONICAL, _REFRESH, _BASE))
    tags = written(shown.select("key", "url", canonical.alias("canonical"), refresh.alias("refresh"), base.alias("base")), "page-tags")
    named = F.concat(named_in(F.col("canonical"), _HREF), named_in(F.col("refresh"), _TO))
    linked = tags.select("key", "url", named.alias("named"), F.get(named_in(F.col("base"), _HREF), F.lit(0)).alias("base"))
    linked = written(linked, "page-links")
    based = F.coalesce(resolved(F.col("base"), at), at)
    known = F.coalesce(at, F.lit(""))
    parsed = written(
        linked.select(
            "key",
            host_of(known).alias("host"),
            path_of(known).alias("path"),
            address(at, fold).alias("node"),
            F.array_compact(F.transform("named", lambda to: resolved(to, based))).alias("targets"),
        ),
        "parsed-urls",
    )
    links = parsed.select("node", F.explode("targets").alias("to")).select(
        "node", address(F.col("to"), fold).alias("target"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path")
    )
    links = written(links.where("node is not null and target is not null").distinct(), "links")
    asked = parsed.select("host", "path").unionByName(links.select("host", "path"))
    ruled = written(matched_rules(asked, rules), "ruled-urls")
    urls = parsed.select("node", "host", "path").unionByName(links.select(F.col("target").alias("node"), "host", "path"))
    told = urls.where("node is not null").distinct().join(ruled, ["host", "path"], "left")
    flags = [F.max((F.col("ruled") == v).cast("int")).alias(v) for v in ("allow", "block")]
    nodes = told.groupBy("node").agg(*flags)
    roots = connected_components(links.where("node <> target").select("node", "target"), "node", "target")
    joined = nodes.join(roots, "node", "left").select("node", "allow", "block", F.coalesce("root", "node").alias("root"))
    groups = joined.groupBy("root").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    decision = F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block")
    decided = joined.select("node", "root").join(groups.select("root", decision.alias("shared")), "root")
    out = parsed.join(ruled, ["host", "path"], "left")
    out = out.join(decided.where("shared is not null").select("node", "shared"), "node", "left")
    return out.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", "shared", F.lit(default)).alias("verdict")
    )
