"""URL filters by redirect equivalence.

Rules name a host and the start of a path, and block or allow; the longest rule
that fits a url decides. Urls that redirect to each other, or name each other as
their canonical address, are aliases: connected components over those edges. The
spellings of one url (``alias_key``) are aliases without an edge. A
url without a rule is blocked if an alias is blocked by a rule, unless an alias
is allowed by one: an explicit allow comes first.

Rules, however many, meet hosts in a hash join on every suffix of a host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z
    lower-cased; empty for null and without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """One name for a url's spellings: without scheme, fragment and closing slashes. Null
    for a url without a host, which is no alias of anything."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    key = F.concat(host_of(url), F.rtrim(path_of(url), F.lit("/")), F.coalesce(query, F.lit("")))
    return F.when(host_of(url) != "", key)


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_HREF = r"""(?i)[\s"'/]href\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^"'\s>]+))"""
_CANONICAL = (r"""(?i)<link\b[^>]*[\s"'/]rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|"""
              r"""'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))[^>]*>""")
_REFRESH = r"""(?i)<meta\b[^>]*[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""


def _absolute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, base, target) as written in html to (source, target) urls; what is no address is dropped."""
    def written(text: str) -> str:
        return _ENTITY.sub(lambda m: entities.unescape(m.group()), text).strip()

    for batch in batches:
        source, target = [], []
        for u, base, t in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                t = urljoin(urljoin(u, written(base)), written(t)) if written(t) else ""
            except ValueError:
                continue
            if "://" in t:
                source.append(u)
                target.append(t)
        yield pa.record_batch([pa.array(source, pa.string()), pa.array(target, pa.string())], names=["source", "target"])


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls from all canonical links and refresh redirects in raw html.
    Targets are taken relative to the page (or its base address), entities decoded."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    href = lambda tag: F.concat(*[F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)])
    links = F.transform(F.regexp_extract_all(h, F.lit(_CANONICAL), F.lit(0)), href)
    metas = F.transform(F.regexp_extract_all(h, F.lit(_REFRESH), F.lit(0)),
                        lambda tag: F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    some = pages.where(u.isNotNull() & h.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    base = href(F.regexp_extract(h, r"(?i)<base\b[^>]*>", 0))
    return (some.select(u.alias("source"), base.alias("base"), F.explode(F.concat(links, metas)).alias("target"))
            .mapInArrow(_absolute, "source string, target string"))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` with the ``rule`` (host and path as one text)
    and its ``action`` (block, allow), or nulls. Of fitting rules the longest
    wins, then the one of the longer host, then allow before block."""
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(rules, "action string, rule_host string, rule_path string")
    places = urls.select("host", "path").distinct()
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    # no suffix of more labels than any rule's host has can meet a rule
    most = (rules.agg(F.max(dots(F.col("rule_host"))).alias("n")).first()["n"] or 0) + 1
    suffixes = F.expr(f"transform(sequence(1, least({most}, length(host) - length(replace(host, '.', '')) + 1)), i -> substring_index(host, '.', -i))")
    fits = (places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
            .where(F.col("path").startswith(F.col("rule_path"))))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "allow").alias("a"),
                    rule.alias("rule"), F.col("action").alias("action"))
    won = fits.groupBy("host", "path").agg(F.max(rank).alias("won"))
    return places.join(won, ["host", "path"], "left").select("host", "path", F.col("won.rule").alias("rule"), F.col("won.action").alias("action"))


def judge_urls(pages: DataFrame, rules, edges: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``edges``: (source, target) urls. Null and malformed urls have an empty host
    and path, fit no rule with a host, have no alias, and are allowed; a url with a
    path but no host (``file:///x``) has no alias either, and an edge to one says nothing. Hosts and
    paths of any length are judged whole. Repeated rows are judged each, other columns are left
    out, and an empty table gives an empty one.
    """
    u = F.col(f"`{url}`")
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    ends = edges.select(F.col("source").alias("url"), F.col("target").alias("other")).where("url is not null and other is not null")
    linked = ends.select(F.xxhash64(alias_key(F.col("url"))).alias("a"), F.xxhash64(alias_key(F.col("other"))).alias("b"),
                         alias_key(F.col("url")).alias("k"), alias_key(F.col("other")).alias("l")).where("k is not null and l is not null")
    member = connected_components(linked)
    nodes = (own.select("url").unionByName(ends.select("url")).unionByName(ends.select(F.col("other").alias("url")))
             .where(alias_key(F.col("url")).isNotNull()).distinct()
             .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     F.xxhash64(alias_key(F.col("url"))).alias("node")))
    ruled = with_rules(own.select("host", "path").unionByName(nodes.select("host", "path")), rules)
    group = F.coalesce("component", "node").alias("component")  # a node without an edge to another is its own
    by_group = (nodes.join(member, "node", "left").select("host", "path", group)
                .join(ruled.where("action is not null"), ["host", "path"])
                .groupBy("component").agg(F.bool_or(F.col("action") == "block").alias("blocks"),
                                          F.bool_or(F.col("action") == "allow").alias("allows"))
                .where("blocks and not allows").select("component", F.lit("block").alias("spread")))
    key = alias_key(F.col("url"))
    return (own.withColumn("node", F.when(key.isNotNull(), F.xxhash64(key))).join(ruled, ["host", "path"], "left")
            .join(member, "node", "left").select("page_id", "host", "path", "rule", "action", group)
            .join(by_group, "component", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict")))
