"""URL filter with redirect equivalence, in DataFrame operations only.

Rules decide urls directly. Redirects, canonical links and spellings of one address join urls to
components, and a component's decision reaches its aliases: allowed if a rule allows any of its urls,
else blocked if a rule blocks any, else allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import join_groups, packed, unpacked
from strandweave.llm.components import connected_components
from strandweave.session import save_scratch

ALLOW, BLOCK = "allow", "block"
#: Begins the nodes that stand for all spellings of an address.
SPELLED = "address:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OWN = ("host", "path", "rule", "verdict", "component")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(text: str, verdict: str) -> Rule:
    """A rule written like ``example.net/en/``."""
    host, slash, rest = text.partition("/")
    return Rule(host.translate(str.maketrans(UPPER, LOWER)), slash + rest, verdict)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def match_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; of equal ones an allowing rule."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one wrapped around is asked first.
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == ALLOW)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as a whole url."""
    scheme = F.regexp_extract(url, "^([^:/?#]*):", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


_VALUE = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref""" + _VALUE
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl""" + _VALUE


def spelling(url: Column) -> Column:
    """One text for the spellings of an address: without scheme, www., fragment, tracking and file ending."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    asked = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    asked = F.array_join(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)") & (p != "")), "&")
    return F.concat(F.lit(SPELLED), host, path, F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked)))


def _decoded(link: Column) -> Column:
    """A link with numeric character references, and the five named ones of XML, decoded once."""

    def piece(text: Column) -> Column:
        name = F.regexp_extract(text, r"^&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);", 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7))
        number = digits.cast("int")
        for entity, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            number = F.when(name == entity, F.lit(ord(char))).otherwise(number)
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(real, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(name == "", text).otherwise(F.concat(char, F.substring(text, F.length(name) + 3, F.length(text))))

    return F.when(link.contains("&"), F.array_join(F.transform(F.split(link, "(?=&)"), piece), "")).otherwise(link)


def alias_edges(pages: DataFrame, url_col: str, html_col: str | None, redirects: DataFrame | None) -> DataFrame:
    """``(a, b)``: urls joined by canonical link, refresh or given redirect, and each end with its spelling."""
    url = F.col(f"`{url_col}`")
    links = [spelling(url)]
    if html_col:
        for pattern in (CANONICAL, REFRESH):
            link = F.regexp_extract(F.col(f"`{html_col}`"), pattern, 1)
            links.append(F.when(link != "", _absolute(_decoded(link), url)))
    edges = pages.filter(url.isNotNull()).select(url.alias("a"), F.explode(F.array(*links)).alias("b"))
    if redirects is not None:
        moved = redirects.toDF("a", "b")
        edges = edges.unionByName(moved).unionByName(moved.select(F.col("a"), spelling(F.col("a")).alias("b")).filter(host_of(F.col("a")) != ""))
    ends = edges.filter(~F.col("b").startswith(SPELLED) & (host_of(F.col("b")) != ""))
    edges = edges.unionByName(ends.select(F.col("b").alias("a"), spelling(F.col("b")).alias("b")))
    return edges.filter("b IS NOT NULL AND a <> b").distinct()


def address_of(node: Column) -> Column:
    """A url's spelling, to which its edge leads; spellings themselves, and urls without a host, stay as they are."""
    return F.when(node.startswith(SPELLED) | (host_of(node) == ""), node).otherwise(spelling(node))


def judge(
    pages: DataFrame,
    rules: list[Rule],
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Every row (or its ``columns``) with ``host, path, rule, verdict, component``.

    A fitting rule decides (``rules`` is a list of the caller's, compiled into the query); else the
    component does. ``redirects`` are pairs of urls known to lead from one to the other. Urls that
    are null or without ``://`` have an empty host and path; null ones have no aliases. Repeated urls
    are decided alike. ``component`` names the component by its smallest member.
    """
    url = F.col(f"doc.`{url_col}`")
    edges = save_scratch(alias_edges(pages, url_col, html_col, redirects))
    narrow = pages.select(*columns, url_col) if columns and url_col not in columns else pages.select(*(columns or pages.columns))
    rows = save_scratch(packed(narrow).withColumn("node", F.coalesce(url, F.lit(""))))
    counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("asked", F.lit(True))
    # Where a given redirect starts is no address that rules are asked for, unless something else names it.
    ends = [edges.select(F.col(end).alias("node"), F.lit(0).cast("long").alias("n_rows"), F.lit(end == "b").alias("asked")) for end in "ab"]
    nodes = counted.unionByName(ends[0]).unionByName(ends[1]).groupBy("node").agg(F.sum("n_rows").alias("n_rows"), F.max("asked").alias("asked"))
    # A spelling that is no page's url is not an address that rules speak of.
    address = F.when(F.col("node").startswith(SPELLED) & (F.col("n_rows") == 0), F.lit("")).otherwise(F.col("node"))
    host, path = host_of(address), path_of(address)
    rule, decided = match_rule(rules, host, path)
    decided = F.when(F.col("asked"), decided)
    nodes = nodes.select(
        "node", "n_rows", host.alias("host"), path.alias("path"), rule.alias("rule"), decided.alias("decided"), address_of(F.col("node")).alias("address")
    )
    # Urls of one address are one node of the graph; what is left are its links to other addresses.
    links = edges.select(address_of(F.col("a")).alias("a"), address_of(F.col("b")).alias("b"))
    roots = connected_components(links).withColumnRenamed("node", "address")
    nodes = save_scratch(nodes.join(roots, "address", "left").withColumn("root", F.coalesce("root", "address")))
    components = save_scratch(
        nodes.groupBy("root").agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.min("node").alias("component"),
            F.max(F.coalesce(F.col("decided") == ALLOW, F.lit(False))).alias("allowed"),
            F.max(F.coalesce(F.col("decided") == BLOCK, F.lit(False))).alias("blocked"),
        )
    )
    passed_on = F.when(~F.col("allowed") & F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    judged = join_groups(nodes, components, "root", "n_nodes", nodes.count()).select(
        "node",
        "n_rows",
        "host",
        "path",
        "rule",
        F.coalesce("decided", passed_on).alias("verdict"),
        "component",
    )
    judged = save_scratch(judged.filter("n_rows > 0"))
    result = join_groups(rows, judged, "node", "n_rows", rows.count())
    return unpacked(result, *OWN)
