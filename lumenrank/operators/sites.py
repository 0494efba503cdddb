"""robots.txt rules, site maps, and finding a site's pages from them or from its links."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.shared import written
from .graph import components

MOST_URLS, MOST_CHILDREN, MOST_LENGTH = 50_000, 1_000, 2_048


def parse_robots(text: str) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """Groups in order: the agents named, and (allow, pattern) of their rules."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    naming = False
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff")):
        key, sep, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            naming = True
        elif key in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
    return groups


def product_token(agent: str) -> str:
    """What of a user agent's header groups are named by: "Bot/0.1 (+https://...)" is "bot"."""
    return re.split(r"[\s/]", agent.strip())[0].lower()


def rules_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """The rules of the groups that name the agent, even if there are none, else of those for all."""
    groups, token = parse_robots(text), product_token(agent)
    own = [rules for agents, rules in groups if token and token != "*" and token in agents]
    return [r for rules in own or [rules for agents, rules in groups if "*" in agents] for r in rules]


def pattern_matches(pattern: str, path: str) -> bool:
    """``*`` stands for anything, a last ``$`` for the end; else a prefix. Linear in the path."""
    anchored = pattern.endswith("$")
    first, *rest = (pattern[:-1] if anchored else pattern).split("*")
    if not path.startswith(first):
        return False
    at = len(first)
    for i, part in enumerate(rest):
        if anchored and i == len(rest) - 1:
            return len(path) - len(part) >= at and path.endswith(part)
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return not anchored or at == len(path)


RULE = "struct<allow:boolean,length:int,anchored:boolean,head:string,middle:array<string>,tail:string>"


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rules) from (host, status, text), a file a host: the rules for an agent, cut at their
    wildcards. Unreachable or 500 and above blocks everything, 400 to 499 nothing."""

    def compiled(allow: bool, pattern: str) -> dict:
        bare = pattern.removesuffix("$")
        head, *rest = bare.split("*")
        return {"allow": allow, "length": len(bare), "anchored": bare != pattern, "head": head, "middle": [x for x in rest[:-1] if x], "tail": rest[-1] if rest else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = pa.struct([("allow", pa.bool_()), ("length", pa.int32()), ("anchored", pa.bool_()), ("head", pa.string()), ("middle", pa.list_(pa.string())), ("tail", pa.string())])
        for b in batches:
            out = []
            for status, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = [(False, "/")] if status is None or status >= 500 else rules_for(text or "", agent) if status < 400 else []
                out.append([compiled(*r) for r in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(rule))], ["host", "rules"])

    return files.select("host", "status", "text").mapInArrow(run, f"host string, rules array<{RULE}>")


def _matches(rule: Column, path: Column) -> Column:
    """As ``pattern_matches``, by the rule's parts: each is looked for behind the one before."""
    locate = lambda part, at: F.call_function("locate", part, path, at + 1)

    def step(at: Column, part: Column) -> Column:
        found = locate(part, at)
        return F.when((at < 0) | (found == 0), -1).otherwise(found - 1 + F.length(part))

    end = F.aggregate(rule["middle"], F.length(rule["head"]), step)
    tail, plain = rule["tail"], F.when(rule["anchored"], path == rule["head"]).otherwise(True)
    behind = F.when(rule["anchored"], (F.length(path) - F.length(tail) >= end) & path.endswith(tail)).otherwise((tail == "") | (locate(tail, end) > 0))
    return path.startswith(rule["head"]) & F.when(tail.isNull(), plain).otherwise((end >= 0) & behind)


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages(id, host, path)``, path with its query, with ``allowed``: of the rules that match the
    longest decides (an end mark does not count), allowing wins ties; without a rule yes.

    Each page meets the one row of its host and goes through its rules in place, so nothing grows
    by pages times rules; a host of many pages can be split or the rules handed out, as their size
    allows.
    """
    met = pages.join(rules, "host", "left")
    path = F.coalesce("path", F.lit(""))
    won = F.array_max(F.transform(F.filter("rules", lambda r: _matches(r, path)), lambda r: F.struct(r["length"], r["allow"])))
    return met.withColumn("allowed", F.coalesce(won["allow"], F.lit(True))).drop("rules")


_LOC = re.compile(r"<(?:[\w-]+:)?(sitemap|url)\b[^>]*>(.*?)(?=<(?:[\w-]+:)?(?:sitemap|url)\b|</(?:[\w-]+:)?(?:urlset|sitemapindex)|\Z)", re.S | re.I)
_INNER = re.compile(r"<(?:(\w[\w-]*):)?loc\b[^>]*>\s*(?:<!\[CDATA\[(.*?)\]\]>|([^<]*))", re.S | re.I)


def parse_sitemap(text: str, most_urls: int | None = MOST_URLS, most_children: int | None = MOST_CHILDREN, most_length: int | None = MOST_LENGTH) -> tuple[str, list[str]]:
    """('urls' or 'sitemaps', addresses): tolerant of prefixes, CDATA, entities and bare &; a
    plain list of addresses counts too. Addresses of images and the like are left out. Each limit
    can be lifted (None)."""
    text = text.lstrip("﻿ \t\r\n")
    fits = lambda x: re.match(r"https?://", x, re.I) and (most_length is None or len(x) <= most_length)
    if not text.startswith("<"):
        found = [x.strip() for x in text.splitlines()]
        return "urls", [x for x in found if fits(x)][:most_urls]
    root = re.search(r"<(?:[\w-]+:)?(sitemapindex|urlset|sitemap|url)\b", text, re.I)
    kind = "sitemaps" if root and root[1].lower().startswith("sitemap") else "urls"
    most = most_children if kind == "sitemaps" else most_urls
    out = []
    for m in _LOC.finditer(text):
        for prefix, quoted, plain in _INNER.findall(m[2]):
            if prefix.lower() in ("image", "video", "news"):
                continue
            x = (quoted or _html.unescape(plain)).strip()
            if fits(x):
                out.append(x)
            break
        if most is not None and len(out) >= most:
            break
    return kind, out


def sitemap_urls(files: DataFrame, most_urls: int | None = MOST_URLS, most_children: int | None = MOST_CHILDREN, most_length: int | None = MOST_LENGTH) -> DataFrame:
    """(source, kind, ordinal, url) from (source, text); limits as in ``parse_sitemap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind, found = parse_sitemap(text or "", most_urls, most_children, most_length)
                rows += [(source, kind, i, u) for i, u in enumerate(found)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["source", "kind", "ordinal", "url"])

    return files.select("source", "text").mapInArrow(run, "source string, kind string, ordinal int, url string")


def sitemaps_of_robots(files: DataFrame, most: int | None = 20) -> DataFrame:
    """(host, ordinal, url) of the Sitemap: lines, distinct, at most ``most`` a host (None: all)."""
    line = F.explode(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("ordinal"), F.trim(F.substring_index(x, "#", 1)).alias("line"))))
    rows = files.select("host", line.alias("l")).select("host", "l.ordinal", F.regexp_extract("l.line", r"^(?i:sitemap)\s*:\s*(\S+)", 1).alias("url")).where("url <> ''")
    full = rows.withColumn("url", F.when(F.col("url").startswith("/"), F.concat(F.lit("https://"), "host", "url")).otherwise(F.col("url"))).where(F.col("url").rlike("^(?i:https?)://"))
    one = full.groupBy("host", "url").agg(F.min("ordinal").alias("ordinal"))
    if most is None:
        return one
    return one.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("ordinal"))).where(F.col("n") <= most).drop("n")


def distinct_pages(found: DataFrame, url: Column, ordinal: str) -> DataFrame:
    """One row a page by its key: the first address, depth and ordinal."""
    named = found.select(U.page_address(url).alias("p"), F.col(ordinal).alias("ordinal")).where("p is not null")
    return named.groupBy(F.col("p.key").alias("key")).agg(F.min_by("p", "ordinal").alias("p"), F.min("ordinal").alias("ordinal")).select("key", F.col("p.url").alias("url"), F.col("p.depth").alias("depth"), "ordinal")


def crawl_order(links: DataFrame, home: str, most_depth: int = 2, most_pages: int | None = None) -> DataFrame:
    """(key, level): pages reached from the home page over ``links(from_key, to_key)``, by the
    least number of links. Each level is written and read back, so that a plan holds one level
    only, and the search ends when a level finds nothing new."""
    found = links.sparkSession.createDataFrame([(home, 0)], "key string, level int")
    fresh = found
    for level in range(1, most_depth + 1):
        step = links.join(fresh.select(F.col("key").alias("from_key")), "from_key").select(F.col("to_key").alias("key")).distinct()
        fresh = written(step.join(found.select("key"), "key", "left_anti").withColumn("level", F.lit(level)), "crawl-level")
        if fresh.isEmpty():
            break
        found = written(found.unionByName(fresh), "crawl-found")
    return found.orderBy("level", "key").limit(most_pages) if most_pages else found


def merge_aliases(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host, key, url, ordinal, names): one row a page of ``found(host, ordinal, url)``, by the address found first. Addresses that
    ``pairs(url, other)``, redirects and canonical links, join in any number of steps name one page; names counts its addresses, those
    among them that were only pointed at included. Pairs go over hosts and cycles, and say nothing where either is no address worth reading."""
    key = lambda c: U.page_address(F.col(c))["key"]
    edges = pairs.select(key("url").alias("u"), key("other").alias("v")).where("u is not null and v is not null")
    names = components(edges)
    pages = found.select("host", "ordinal", U.page_address(F.col("url")).alias("p")).where("p is not null").select("host", "ordinal", "p.key", "p.url")
    named = pages.join(names.withColumnRenamed("node", "key"), "key", "left").withColumn("page", F.coalesce("label", "key"))
    one = named.groupBy("page").agg(F.min_by(F.struct("host", "key", "url", "ordinal"), F.struct("ordinal", "key", "url")).alias("o"), F.count_distinct("key").alias("own"), F.max("label").alias("label"))
    sizes = names.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return one.join(sizes, "label", "left").select("o.host", "o.key", "o.url", "o.ordinal", F.coalesce("n", "own").alias("names"))


def crawl(homes: DataFrame, links: DataFrame, most_depth: int = 2, fetches: int | None = 60, most_pages: int | None = None) -> DataFrame:
    """(host, key, url, level, found_at, place, truncated): the pages that each site's links lead to, all sites a level at a time.

    ``homes`` is (host, asked, url): the address asked for and the one that answered; ``links`` (from_key, ordinal, to_url) of the pages that
    can be read. Pages are read in the order they were found in, the home page first, down to the level above ``most_depth``, at most
    ``fetches`` a site and none once ``most_pages`` are found; what a page links to is found in the order of its links, on hosts of the site's
    domain, each address once. Place is the home page, then the shallower paths, then as found, cut at ``most_pages``; a site is truncated if
    pages were left unread or cut. None lifts a limit.
    """
    start = homes.select("host", U.registrable(F.col("url")).alias("site"), U.page_address(F.col("url")).alias("p"), U.page_address(F.col("asked"))["key"].alias("asked")).where("p is not null")
    one = start.groupBy("host").agg(F.min_by(F.struct("site", "p", "asked"), F.struct("p.url", "asked")).alias("h")).select("host", "h.*")
    home = written(one.select("host", "site", "asked", "p.key", "p.url", "p.depth"), "crawl-homes")
    found = home.select("host", "site", "key", "url", "depth", F.lit(0).alias("level"), F.lit(0).cast("long").alias("found_at"))
    known = home.select("host", "key").unionByName(home.where("asked is not null").select("host", F.col("asked").alias("key"))).distinct()
    state = home.select("host", F.lit(0).cast("long").alias("read"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("left"))
    address = links.select("from_key", "ordinal", U.page_address(F.col("to_url")).alias("p"), U.registrable(F.col("to_url")).alias("to_site")).where("p is not null").select("from_key", "ordinal", "to_site", F.col("p.key").alias("key"), "p.url", "p.depth")
    for level in range(most_depth):
        nth = F.row_number().over(Window.partitionBy("host").orderBy("found_at")) - 1
        ahead = found.where(F.col("level") == level).withColumn("nth", nth).select("host", "site", F.col("key").alias("from_key"), "nth").join(state, "host")
        if fetches is not None:
            ahead = ahead.withColumn("left", F.col("left") | (F.col("nth") >= fetches - F.col("read")))
        ahead = written(ahead, "crawl-ahead")
        asked = ahead if fetches is None else ahead.where(F.col("nth") < fetches - F.col("read"))
        met = asked.select("host", "site", "from_key", "nth").join(address, "from_key").where("site = to_site")
        fresh = met.groupBy("host", "key").agg(F.min(F.struct("nth", "ordinal", "url", "depth", "site")).alias("o")).join(known, ["host", "key"], "left_anti")
        fresh = written(fresh.select("host", "key", "o.*"), "crawl-fresh")
        # how many are known before each page is read; a site's pages to read are no more than its fetches
        brought = asked.join(fresh.groupBy("host", "nth").agg(F.count(F.lit(1)).alias("n")), ["host", "nth"], "left")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("size")
        go = F.lit(True) if most_pages is None or level == 0 else F.col("before") < most_pages
        turn = written(brought.withColumn("before", before).withColumn("go", go).select("host", "nth", "go", F.when(F.col("go"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n")), "crawl-turns")
        kept = fresh.join(turn.where("go").select("host", "nth"), ["host", "nth"], "left_semi").join(state.select("host", "size"), "host")
        order = F.row_number().over(Window.partitionBy("host").orderBy("nth", "ordinal", "key")) - 1 + F.col("size")
        found = written(found.unionByName(kept.select("host", "site", "key", "url", "depth", F.lit(level + 1).alias("level"), order.alias("found_at"))), "crawl-found")
        known = known.unionByName(kept.select("host", "key"))
        now = turn.groupBy("host").agg(F.count_if("go").alias("more_read"), F.sum("n").alias("more"), F.bool_or(~F.col("go")).alias("stopped"))
        over = ahead.groupBy("host").agg(F.bool_or("left").alias("over"))
        none = F.lit(0).cast("long")
        state = written(
            state.join(now, "host", "left").join(over, "host", "left").select("host", (F.col("read") + F.coalesce("more_read", none)).alias("read"), (F.col("size") + F.coalesce("more", none)).alias("size"), (F.col("left") | F.coalesce("stopped", F.lit(False)) | F.coalesce("over", F.lit(False))).alias("left")), "crawl-state"
        )
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("level") > 0, "depth", "found_at"))
    placed = found.join(state.select("host", "size", "left"), "host").withColumn("place", place)
    cut = F.lit(False) if most_pages is None else F.col("size") > most_pages
    out = placed.withColumn("truncated", F.col("left") | cut)
    return (out if most_pages is None else out.where(F.col("place") <= most_pages)).select("host", "key", "url", "level", "found_at", "place", "truncated")


def discover(home: DataFrame, mapped: DataFrame, crawled: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(host, key, url, via, place, truncated): a site's pages from the first site map that has any, by
    its rank, else from its links; the home page first, then by depth, then as found.

    ``home`` is (host, url), ``mapped`` (host, rank, ordinal, url), ``crawled`` (host, ordinal, url);
    ``most_pages`` cuts each site, and every row of a site that was cut says so.
    """
    address = lambda df: df.withColumn("p", U.page_address(F.col("url"))).where("p is not null").select(*[c for c in df.columns if c != "url"], "p.key", "p.url", "p.depth")
    maps = address(mapped)
    first = maps.groupBy("host").agg(F.min("rank").alias("rank"))
    chosen = maps.join(first, ["host", "rank"]).select("host", "ordinal", "key", "url", "depth", F.lit("sitemap").alias("via"))
    linked = address(crawled).join(first.select("host"), "host", "left_anti").select("host", "ordinal", "key", "url", "depth", F.lit("links").alias("via"))
    start = address(home).select("host", F.lit(-1).cast("long").alias("ordinal"), "key", "url", F.lit(-1).alias("depth"), F.lit("home").alias("via"))
    both = start.unionByName(chosen.withColumn("ordinal", F.col("ordinal").cast("long"))).unionByName(linked.withColumn("ordinal", F.col("ordinal").cast("long")))
    one = both.groupBy("host", "key").agg(F.min(F.struct("depth", "ordinal", "url", "via")).alias("o"))
    by_host = Window.partitionBy("host")
    placed = one.select("host", "key", "o.url", "o.via", F.row_number().over(by_host.orderBy("o.depth", "o.ordinal", "key")).alias("place"), F.count(F.lit(1)).over(by_host).alias("n"))
    if most_pages is None:
        return placed.withColumn("truncated", F.lit(False)).drop("n")
    return placed.where(F.col("place") <= most_pages).withColumn("truncated", F.col("n") > most_pages).drop("n")
