"""URL filters: host and path rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.graph import components

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """A url without scheme and fragment, host lower-cased: what redirects and canonical links join."""
    host, path = host_path(url)
    return F.concat(host, path, F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame([], "verdict string, host string, path string") if not rules else spark.sql(
        "SELECT * FROM VALUES " + ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in rules) + " AS t(verdict, host, path)"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of each distinct ``_host`` and its parent domains, longest first; hosts without any have no row."""
    labels = F.split("_host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_host = rules.select(
        F.col("host").alias("_parent"),
        F.struct(
            (-F.length("host") - F.length("path")).alias("order"),
            (-F.length("host")).alias("next"),
            F.concat("host", "path").alias("rule"),
            "path",
            "verdict",
        ).alias("_rule"),
    )
    return (
        hosts.select("_host").distinct().withColumn("_parent", F.explode(parents)).join(by_host, "_parent")
        .groupBy("_host").agg(F.sort_array(F.collect_set("_rule")).alias("_rules"))
    )


def _ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with ``_host`` and ``_path`` get the longest fitting rule as ``_hit (rule, verdict)`` or null."""
    fitting = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    return rows.join(_host_rules(rows, rules), "_host", "left").withColumn("_hit", F.get(fitting, F.lit(0))).drop("_rules")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``(from_url, to_url)`` of canonical links and refresh redirects in the pages' html."""
    found = F.concat(
        F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1)),
        F.transform(F.regexp_extract_all(F.col(html), F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_TO, 1)),
    )
    may = F.col(html).rlike("(?i)canonical|http-equiv")
    links = pages.where(may & F.col(url).contains("://")).select(F.col(url).alias("from_url"), F.explode(found).alias("to"))
    scheme = F.regexp_extract("from_url", "^(.*?)://", 1)
    site = F.regexp_extract("from_url", "^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("from_url", "^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    to = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), F.col("to")))
    )
    return links.where("to <> ''").select("from_url", to.alias("to_url"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, page: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    (host and path together, then host) decides. Pages without a rule are blocked if some url of
    their alias component has a block rule, and allowed otherwise: an explicit allow always wins
    for its own url, and never clears an alias. Components come from canonical links and refresh
    redirects in the html and from ``edges (from_url, to_url)``.

    A null url, or one without ``://``, has empty host and path, no rule and no alias. Null html
    has no links. Repeated pages are judged each; other columns are ignored; no rule allows all.
    """
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page).alias("_page"), F.col(url).alias("_url"), host.alias("_host"), path.alias("_path"))
    judged = _ruled(rows, rules).select(
        "_page", "_host", "_path", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("_own"),
        F.when(F.col("_url").contains("://"), url_node(F.col("_url"))).alias("_node"),
    )
    links = page_links(pages, url, html) if html in pages.columns else None
    if edges is not None:
        more = edges.select("from_url", "to_url").where("from_url like '%://%' and to_url like '%://%'")
        links = more if links is None else links.union(more)
    if links is not None:
        judged = judged.join(_blocked_nodes(links, rules), "_node", "left")
    else:
        judged = judged.withColumn("_alias", F.lit(None).cast("string"))
    return judged.select(
        F.col("_page").alias(page), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"),
    )


def _blocked_nodes(links: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_node, _alias)`` of every node whose component holds a url with a block rule."""
    ends = links.select(url_node(F.col("from_url")).alias("a"), url_node(F.col("to_url")).alias("b"))
    parts = components(ends)
    host, path = host_path(F.concat(F.lit("://"), F.col("node")))
    seen = _ruled(parts.withColumn("_host", host).withColumn("_path", path), rules)
    bad = seen.where("_hit.verdict = 'block'").select("component").distinct()
    return parts.join(bad, "component").select(F.col("node").alias("_node"), F.lit("block").alias("_alias"))
