"""URL rules whose block decisions reach aliases: pages joined by redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, scratch, staged


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: What a browser does not read as markup.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ://, and for NULL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(rest, host).otherwise(""), F.when(rest, path).otherwise("")


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or NULL; of equal length, allow comes first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def node(url: Column) -> Column:
    """What stands for a URL in the graph: host, path and query, without scheme and fragment."""
    host, path = split_url(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, path, query))


def without_dots(path: Column) -> Column:
    """A path from the root without its . and .. parts."""
    parts = F.split(path, "/")
    up = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
    step = lambda held, x: F.when(x == "..", up(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    held = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    held = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(held, F.array(F.lit("")))).otherwise(held)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(held, "/"))).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """An absolute link; other forms take what they lack from the page's URL, paths from its directory.  Links of
    other schemes, such as mailto:, and those to a place in the page itself give NULL."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, without_dots(F.when(link.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by any canonical link or refresh in the html, outside comments and scripts.

    Links are few beside pages: each step of their resolution is written down, so that no step's expression, which names
    its input many times, is copied into the next one's.
    """
    clean = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    links = F.concat(*[F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), clean) for p in (CANONICAL, REFRESH)])
    has = F.col("html").rlike(r"(?i)canonical|refresh")
    read = pages.where(has).select("url", F.regexp_replace("html", UNREAD, " ").alias("html"))
    base = F.nullif(clean(F.regexp_extract("html", BASE, 1)), F.lit(""))
    each = staged(read.select("url", base.alias("href"), F.explode(links).alias("link")), "links")
    if each.isEmpty():
        return each.select(F.col("url").alias("a"), F.col("link").alias("b"))
    based = staged(each.where("link <> ''").select("url", F.coalesce(resolved(F.col("url"), F.col("href")), "url").alias("base"), "link"), "links")
    led = staged(based.select("url", resolved(F.col("base"), F.col("link")).alias("target")), "links")
    return staged(led.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")), "links").where("a <> b")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A page with a rule of its own has that rule's verdict.  Another page is blocked if a URL of its component of
    redirects and canonical links is blocked by a rule, unless a rule allows a URL of the component; else it is
    allowed.  Rules also judge URLs that only links name.  redirects may add (from_url, to_url) rows.
    NULL urls and urls without :// have empty host and path and no aliases; NULL html has no links; repeated rows
    and NULL ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"))
    with scratch(pages.sparkSession):
        return _filter_urls(slim, rules, redirects)


def _filter_urls(slim: DataFrame, rules: tuple[Rule, ...], redirects: DataFrame | None) -> DataFrame:
    edges = alias_edges(slim)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    parts = connected_components(edges, label="aliases")
    host = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
    _, own = matched(host, path, rules)
    parts = parts.withColumn("own", own)
    votes = parts.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allow"), F.bool_or(F.col("own") == "block").alias("block"))
    blocked = votes.where("block AND NOT coalesce(allow, false)").select("component")
    aliases = staged(parts.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("hit")), "blocked-aliases", keep=True)
    h, p = split_url(F.col("url"))
    text, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = slim.select("page_id", h.alias("host"), p.alias("path"), node(F.col("url")).alias("node"))
    judged = judged.select("*", text.alias("rule"), verdict.alias("own")).join(aliases, F.col("node") == F.col("alias"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
