"""Stored web pages: links, sections, main text, probes and crawl policy. Fetching is a callable that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tesselith.functions import patterns as P
from tesselith.functions.text import blank, host, url_key

_SKIP = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form", "template"))
_BLOCK = frozenset(("p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote", "pre"))

_LINK = r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"


def anchors(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, href, anchor): every link of a page in order; native expressions."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(blank(F.col(html)), F.lit(_LINK), 1)).alias("pos", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "pos", F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), text.alias("anchor"))


def sectioned(pages: DataFrame, key: str = "url", html: str = "html", heading: str = "h3") -> DataFrame:
    """(key, pos, section, href, anchor): links with the heading above them; links before any heading have none."""
    parts = pages.select(key, F.posexplode(F.split(blank(F.col(html)), f"(?i)(?=<{heading}[ >])")).alias("part", "html"))
    head = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", f"(?is)^<{heading}[^>]*>(.*?)</{heading}>", 1), r"(?s)<[^>]*>", " ")), F.lit(""))
    links = parts.select(key, "part", head.alias("section"), F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("p", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return links.select(key, "part", F.col("p").alias("pos"), "section", F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), text.alias("anchor"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in _SKIP and self.hidden > 0
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@F.pandas_udf(StringType())
def main_text(html: pd.Series) -> pd.Series:
    """The text of a page without scripts, navigation and the like; blocks on lines of their own. Unclosed tags are borne."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        parser = _Text()
        parser.feed(h)
        parser.close()
        lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
        return "\n".join(line for line in lines if line)

    return html.map(one)


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """The address that a link leads to, without its fragment."""
    return pd.Series([None if b is None or h is None else urldefrag(urljoin(b, h))[0] for b, h in zip(base, href)])


def challenged(html: Column) -> Column:
    """Whether a page is a browser challenge instead of content."""
    return F.substring(blank(html), 1, 1500).contains("Just a moment")


def probe_score(html: Column) -> Column:
    """How much a page speaks of procedure: its cues of both domains; a challenge has none."""
    t = blank(html)
    cues = F.regexp_count(t, F.lit(f"(?i){P.CRIMINAL_CUES}")) + F.regexp_count(t, F.lit(f"(?i){P.CIVIL_CUES}"))
    return F.when(challenged(html), 0).otherwise(cues)


def best_probe(probes: DataFrame, by: str, order: str, score: str) -> DataFrame:
    """The best of the first three links of every group; of equal scores the earlier link."""
    return probes.where(F.col(order) < 3).groupBy(by).agg(F.min_by(F.struct(*probes.columns), F.struct(-F.col(score), F.col(order))).alias("r")).select("r.*")


def live(links: DataFrame, blocked: DataFrame, href: str = "href") -> DataFrame:
    """Links whose host is in no blocked set (host)."""
    return links.withColumn("host", host(F.col(href))).join(blocked.select("host").distinct(), "host", "left_anti")


def allowed(links: DataFrame, robots: DataFrame, agent: str, href: str = "href") -> DataFrame:
    """Links that the policy of their host (host, robots_txt) lets ``agent`` read; a host without policy allows all."""
    rows = links.withColumn("_host", host(F.col(href))).join(robots.select(F.col("host").alias("_host"), "robots_txt"), "_host", "left")

    @F.pandas_udf(BooleanType())
    def may(url: pd.Series, policy: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(u, p):
            if not p or not u:
                return True
            if p not in known:
                known[p] = RobotFileParser()
                known[p].parse(p.splitlines())
            return known[p].can_fetch(agent, u)

        return pd.Series([one(u, p) for u, p in zip(url, policy)], dtype=bool)

    return rows.where(may(F.col(href), F.col("robots_txt"))).drop("_host", "robots_txt")


def fetch_missing(urls: DataFrame, stored: DataFrame, fetch: Callable[[str], tuple[int, str]], pause: float = 0.5, skip: str | None = None) -> DataFrame:
    """(url, key, status, body) of addresses that ``stored`` (key) lacks, read by ``fetch``; a host's pages stay in one partition and wait for each other; addresses that match ``skip`` are left out."""
    urls = urls if skip is None else urls.where(~F.col("url").rlike(f"(?i){skip}"))
    todo = urls.select("url").distinct().withColumn("key", url_key(F.col("url"))).join(stored.select("key").distinct(), "key", "left_anti")
    todo = todo.repartition(host(F.col("url"))).sortWithinPartitions(host(F.col("url")), "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            got = []
            for u in pdf["url"]:
                try:
                    got.append(fetch(u))
                except Exception as e:  # noqa: BLE001  a page that fails must not fail the crawl
                    got.append((0, str(e)))
                time.sleep(pause)
            yield pd.DataFrame({"url": pdf["url"], "key": pdf["key"], "status": [g[0] for g in got], "body": [g[1] for g in got]})

    return todo.select("url", "key").mapInPandas(run, "url string, key string, status int, body string")
