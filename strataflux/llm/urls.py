"""URL filter with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest that
fits decides. Pages that no rule decides take part of their aliases' fate: a
page is an alias of the address in its canonical link and of the one its refresh
redirect leads to. Connected components over these edges are the aliases; an
address that no row of the table has counts too, if a rule decides it. A page
without a rule is blocked when its component holds a blocked address and no
explicitly allowed one; else it is allowed.

Addresses are compared without scheme and fragment, hosts in lower case. Rules
are a short fixed list and become column expressions; components run on the
addresses that have an edge only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common, graph

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

CANONICAL = r"(?i)<link\b([^<>]*\brel\s*=\s*(?:\"(?:[^\"<>]*\s)?|'(?:[^'<>]*\s)?)?canonical(?=[\s\"'/>])[^<>]*)>"  # any token of rel
REFRESH = r"(?i)<meta\b([^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*)>"
HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s<>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s<>]+)"


def lowered(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rest(url: Column) -> Column:
    """What stands behind the first `://`; empty for null or without it."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and address (host + path + query, an empty path as `/`; null without a host) of a url."""
    after = rest(url)
    host, path, query = (F.regexp_extract(after, p, 1) for p in (r"^([^/?#]*)", r"^[^/?#]*([^?#]*)", r"^[^?#]*(\?[^#]*)"))
    name = lowered(host)
    return name.alias("host"), path.alias("path"), F.when(name != "", F.concat(name, F.when(path == "", F.lit("/")).otherwise(path), query)).alias("address")


def fitting(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    chain = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        test = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def resolved(link: Column, host_: Column, path_: Column) -> Column:
    """`link` as an absolute url, seen from a page of that host and path. Dot segments stay as they are."""
    start = F.concat(F.lit("http://"), host_)
    folder = F.regexp_replace(F.when(path_ == "", F.lit("/")).otherwise(path_), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(start, link))
        .when(link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(start, folder, link))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses joined by a canonical link or a refresh redirect, from whole pages (url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    link = lambda tag, attribute: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), lambda t: F.regexp_extract(t, attribute, 1))
    has = F.lower(html).rlike("canonical|refresh")
    found = pages.where(has).select(*parts(F.col("url")), F.explode(F.array_union(link(CANONICAL, HREF), link(REFRESH, TARGET))).alias("link")).where("link <> ''")
    goal = found.select(F.col("address").alias("a"), resolved(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("host"), F.col("path")).alias("goal"))
    ends = common.stored(goal.select("a", parts(F.col("goal"))[2].alias("b")), "url-edges")  # few rows; parsed once
    return ends.where("a is not null and b is not null and a <> b").distinct()


def blocked_aliases(pages: DataFrame, rules=RULES) -> DataFrame:
    """Addresses (column address) that share a component with a blocked address and with no allowed one."""
    members = graph.components(edges(pages))
    placed = members.select("node", "label", *parts(F.concat(F.lit("http://"), F.col("node")))[:2])
    judged = common.stored(placed.select("node", "label", fitting(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")), "alias-members")
    bad = judged.groupBy("label").agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed")).where("blocked and not coalesce(allowed, false)")
    return judged.where("verdict is null").join(bad, "label", "left_semi").select(F.col("node").alias("address"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict. A null url has no host and is allowed."""
    rows = pages.select("page_id", *parts(F.col("url")))
    rows = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    aliases = blocked_aliases(pages.select("url", "html"), rules).withColumn("alias", F.lit("block"))
    joined = rows.join(aliases, "address", "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "alias", F.lit("allow")).alias("verdict"))


def op4_redirect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
