"""URL rules with redirect equivalence.

A url's own rule decides first: of the rules that fit its host (or a parent domain) and begin its path, the longest; at equal length
allow goes before block. Urls without a rule take the decision of their aliases: canonical links, page-level redirects and given
redirects join urls into components (distributed connected components); a block in a component reaches every member that no rule
of its own allows. Everything else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, spool

#: Rule lists up to this length become one expression; longer ones are joined by host.
INLINE_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Urls with one key are one resource: scheme, fragment and tracking parameters do not count."""
    query = F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)(=|$)")), "&")
    return F.concat(url_host(url), url_path(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def own_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict (null: none fits) to rows that have host and path. rules: (allow or block, host/path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    split = [(v, t, t.partition("/")[0], "/" + t.partition("/")[2]) for v, t in ordered]
    if len(rules) <= INLINE_RULES:
        best: Column = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        for verdict, text, host, path in reversed(split):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            best = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(best)
        return pages.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict")).drop("best")
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, i, t, v) for i, (v, t, h, p) in enumerate(split)], "rule_host string, rule_path string, place int, rule string, rule_verdict string")
    # the decision depends on host and path alone, so each pair is judged once
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = places.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fit = parents.join(table, "rule_host").where("startswith(path, rule_path)").groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), "place").alias("best"))
    return pages.join(fit.select("host", "path", "best.rule", "best.rule_verdict"), ["host", "path"], "left")


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target): the canonical link and the refresh redirect in each page's html, resolved against the page's url."""
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    href = F.regexp_extract(canonical, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    moved = F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    found = pages.where("url is not null and html is not null").select("url", F.explode(F.array(F.when(F.col("html").rlike("(?i)canonical"), href), F.when(F.col("html").rlike("(?i)http-equiv"), moved))).alias("to"))
    found = found.where("to is not null and to <> ''").withColumn("to", F.regexp_replace("to", "&amp;", "&"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), url_host(F.col("url")))
    folder = F.regexp_replace(url_path(F.col("url")), "[^/]*$", "")
    full = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), F.col("to")))
    )
    return found.select("url", full.alias("target"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, propagated) for every page row.

    redirects: further (url, target) pairs. A null url, or one without ://, has an empty host and path, no rule and no alias.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    links = link_edges(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target").where("url is not null and target is not null"))
    links = spool(links, "url-links")
    judged = own_rule(pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules)
    if links.isEmpty():  # then urls of one key still share host and path, and so their rule
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(False).alias("propagated"))
    edges = links.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b")).where("a <> '' and b <> ''")
    comp = spool(connected_components(edges), "url-components")
    seen = pages.select("url").where("url is not null").unionByName(links.select(F.col("target").alias("url")))
    seen = own_rule(seen.select(url_key(F.col("url")).alias("node"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules).where("rule_verdict = 'block'").select("node").distinct()
    blocked = comp.join(seen, "node").select("component").distinct()
    hit = comp.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("hit"))
    out = judged.withColumn("node", url_key(F.col("url"))).join(hit, "node", "left")
    spread = F.col("rule_verdict").isNull() & F.col("hit").isNotNull()
    verdict = F.coalesce("rule_verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), spread.alias("propagated"))
