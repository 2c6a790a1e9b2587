"""URL filters with redirect equivalence (numbered operator 9).

Explicit rules name a host, all of whose subdomains they cover, and the start of a path; the longest rule that fits decides.
Pages that no rule covers are judged by their aliases: urls are tied together by the canonical links and meta refreshes in
pages and by a table of redirects, if there is one.  Targets without a scheme or host are resolved against the page's url;
the path's `..` are not.  A url's name here is its host in small letters, port, path and query, without scheme and fragment.
Decisions spread over the connected components of these edges; a component with an explicit allow is allowed, else one with a
block is blocked, else the default holds.

Nulls: a null url, or one without `://`, has an empty host and path and no alias; no rule fits it and it gets the default.
Null html has no links.  Repeated rows get equal verdicts.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import bound
from veilmark.llm.components import components
from veilmark.llm.stages import cut


@dataclass(frozen=True)
class UrlRule:
    """`verdict` (allow or block) for `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> Column:
    """host, path and alias of a url; the alias is its name among its aliases, null where there is no host.

    Each part is worked out once, however often it is used, so plans stay small.
    """
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#]*?(\?[^#]*)", 1)
    split = lambda r: F.struct(lower_ascii(F.regexp_extract(r, r"^([^/?#]*)", 1)).alias("host"), F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    alias = lambda p: F.when(p["host"] != "", F.concat(p["host"], F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), query))
    named = lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path"), alias(p).alias("alias"))
    return bound(F.coalesce(rest, F.lit("")), lambda r: bound(split(r), named))


def resolved(target: Column, url: Column) -> Column:
    """An address in the page `url` as a whole address; null for other schemes, such as of mail, and for mere fragments."""
    scheme = F.concat(F.regexp_extract(url, r"^([^:/?#]+)://", 1), F.lit(":"))
    rest = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"^(.*/)", 1)

    def whole(p: Column) -> Column:
        home, x = F.concat(p["scheme"], F.lit("//"), p["rest"]), p["target"]
        return (
            F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x)
            .when((x == "") | x.startswith("#") | x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (p["rest"] == ""), F.lit(None).cast("string"))
            .when(x.startswith("//"), F.concat(p["scheme"], x))
            .when(x.startswith("/"), F.concat(home, x))
            .otherwise(F.concat(home, F.when(p["folder"] == "", F.lit("/")).otherwise(p["folder"]), x))
        )

    return bound(F.struct(scheme.alias("scheme"), rest.alias("rest"), folder.alias("folder"), target.alias("target")), whole)


def matched_rule(parts: Column, rules: list[UrlRule]) -> Column:
    """verdict and name of the longest rule that fits, of equally long ones the last; null if none does."""
    ordered = sorted(rules, key=lambda r: len(r.name))[::-1]
    if not ordered:
        return F.lit(None).cast("struct<verdict:string,host:string,path:string,name:string>")
    known = F.array(*[F.struct(*[F.lit(getattr(r, x)).alias(x) for x in ("verdict", "host", "path", "name")]) for r in ordered])
    fits = lambda r: ((parts["host"] == r["host"]) | parts["host"].endswith(F.concat(F.lit("."), r["host"]))) & parts["path"].startswith(r["path"])
    return F.get(F.filter(known, fits), F.lit(0))


def judged_url(url: Column, rules: list[UrlRule]) -> Column:
    """host, path, alias and, of the rule that fits, rule and ruled."""
    told = lambda p, r: F.struct(p["host"].alias("host"), p["path"].alias("path"), p["alias"].alias("alias"), r["name"].alias("rule"), r["verdict"].alias("ruled"))
    return bound(url_parts(url), lambda p: bound(matched_rule(p, rules), lambda r: told(p, r)))


# How canonical links and refreshes look; the target is the first group.
TAG = r"(?i)(<(?:link|meta)\b[^>]*>)"
TIES = r"(?i)\brel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)|\bhttp-equiv\s*=\s*[\"']?refresh\b"
TARGET = r"(?i)\b(?:href|url)\s*=\s*[\"']?\s*([^\"'\s>]+)"


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and meta refreshes, resolved."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.explode(F.filter(F.regexp_extract_all(html, F.lit(TAG), 1), lambda t: t.rlike(TIES)))
    tags = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", tag.alias("tag"))
    target = F.replace(F.regexp_extract("tag", TARGET, 1), F.lit("&amp;"), F.lit("&"))
    return tags.select("url", resolved(target, F.col("url")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Of `pages` (page_id, url, html): page_id, host, path, rule, verdict.  `redirects` has (url, target)."""
    rows = pages.select("page_id", judged_url(F.col("url"), rules).alias("u")).select("page_id", "u.host", "u.path", "u.alias", "u.rule", "u.ruled")
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    ties = cut(links.select(url_parts(F.col("url"))["alias"].alias("a"), judged_url(F.col("target"), rules).alias("t")).select("a", F.col("t.alias").alias("b"), "t.ruled"))
    member = components(ties.select("a", "b"))
    # what rules say of each alias, of the targets of links too
    said = rows.select("alias", "ruled").unionByName(ties.select(F.col("b").alias("alias"), "ruled")).where("alias is not null and ruled is not null").groupBy("alias").agg(F.min("ruled").alias("ruled"))  # 'allow' < 'block'
    placed = said.join(member, said["alias"] == member["node"], "left").select("alias", F.coalesce("component", "alias").alias("component"), "ruled")
    spread = placed.groupBy("component").agg(F.min("ruled").alias("inherited"))
    # only urls that an edge ties need the answer; they and no others are joined, by the page's own name
    open_ = rows.where("ruled is null and alias is not null").select("alias").distinct()
    told = open_.join(member.withColumnsRenamed({"node": "alias", "component": "member_of"}), "alias", "left").withColumn("component", F.coalesce("member_of", "alias"))
    told = told.join(spread, "component").select(F.col("alias").alias("of"), "inherited")
    asks = F.when(F.col("ruled").isNull(), F.coalesce("alias", F.concat(F.lit("#"), F.xxhash64("page_id", "host").cast("string"))))  # a null alias finds nothing and is dealt by its page
    judged = rows.withColumn("asks", asks).join(told, F.col("asks") == F.col("of"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit(default)).alias("verdict"))
