"""Stored web pages: links of list pages, article pages, addresses still to fetch, posts. Nothing here goes to the network."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.plans.runtime import spread

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 tr section article header footer ul ol table blockquote".split())


class _Reader(HTMLParser):
    """Title, time, paragraphs, keywords and links of a page; unclosed tags do no harm."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title, self.time, self.keywords = "", "", []
        self.blocks: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._link: list[str] | None = None
        self._href = ""

    def _close_block(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append(text)
        self._text = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name == "keywords":
                self.keywords = [k.strip() for k in (a.get("content") or "").replace("，", ",").split(",") if k.strip()]
            elif name in ("article:published_time", "pubdate"):
                self.time = a.get("content") or ""
        if tag == "time" and a.get("datetime"):
            self.time = self.time or a["datetime"]
        if tag == "a" and a.get("href"):
            self._href, self._link = a["href"], []
        if tag in _BLOCKS or tag == "br":
            self._close_block()
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "a" and self._link is not None:
            self.links.append((self._href, " ".join("".join(self._link).split())))
            self._link = None
        if tag in _BLOCKS:
            self._close_block()
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if any(t in ("script", "style", "noscript") for t in self.stack):
            return
        if "title" in self.stack:
            self.title += data
            return
        self._text.append(data)
        if self._link is not None:
            self._link.append(data)


def read_page(html: str | None) -> dict:
    """Fields of one page; null gives empty fields."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    r._close_block()
    return {"title": " ".join(r.title.split()), "time": r.time, "keywords": r.keywords, "blocks": r.blocks, "links": [{"href": h, "text": t} for h, t in r.links]}


def parsed_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, time, keywords, blocks, links of stored pages; markup that isn't well-formed is read as browsers do."""
    kind = pages.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, title string, time string, keywords array<string>, blocks array<string>, links array<struct<href:string,text:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_page(h) for h in pdf[html]]
            yield pd.DataFrame({key: pdf[key], **{c: [r[c] for r in rows] for c in ("title", "time", "keywords", "blocks", "links")}})

    return spread(pages.select(key, html)).mapInPandas(run, schema)


def page_articles(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, id = MD5 of the content, title, time in one form, keywords, content with paragraphs joined by backslash and n; without content corrupt."""
    content = F.array_join("blocks", "\\n")
    good = F.size("blocks") > 0
    return parsed.select(key, F.when(good, F.md5(content)).alias("id"), "title", T.normal_time("time").alias("time"), "keywords", F.when(good, content).alias("content"), (~good).alias("corrupt"))


def links_of_day(parsed: DataFrame, day: str, key: str = "page_id") -> DataFrame:
    """key, href of links whose address or text holds the day ``yyyy-MM-dd``, with or without its year, once each, in page order.

    The day stands alone: figures before or after it make another number of it.
    """
    year, month, date = day.split("-")
    month_day = rf"(?<![0-9])(?:{year}[-/.]?)?{month}[-/.]?{date}(?![0-9])"
    l = parsed.select(key, F.posexplode("links").alias("pos", "l"))
    return l.where(F.concat_ws(" ", "l.href", "l.text").rlike(month_day)).groupBy(key, F.col("l.href").alias("href")).agg(F.min("pos").alias("pos"))


def search_results(results: DataFrame, themes: list[str], since: int = 2019) -> DataFrame:
    """theme, url once each of stored search results of the years wanted and known themes."""
    year = F.substring(T.normal_time("time"), 1, 4).try_cast("int")
    return results.where((year >= since) & F.col("theme").isin(*themes)).select("theme", "url").distinct()


def still_to_fetch(wanted: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Keys wanted and not done, once each."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key).distinct(), key, "left_anti")


def known_themes(rows: DataFrame, topics: list[str], without: list[str], theme: str = "theme") -> DataFrame:
    """Rows whose theme holds a known topic or is held by one; the ones left out and null themes have no row."""
    ok = F.exists(F.array(*map(F.lit, topics)), lambda t: t.contains(F.col(theme)) | F.col(theme).contains(t)) if topics else F.lit(False)
    return rows.where(ok & ~F.col(theme).isin(*without)) if without else rows.where(ok)


def keywords_or_theme(keywords: str = "keywords", theme: str = "theme"):
    """The keywords, or the theme as the only one where there are none."""
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, F.array(theme)).otherwise(F.col(keywords))


def title_list(lines: DataFrame) -> DataFrame:
    """title once each of lines (value), blanks at the ends removed, empty ones left out."""
    return lines.select(F.trim("value").alias("title")).where("title <> ''").distinct()


def keywords_of(articles: DataFrame) -> DataFrame:
    """keyword once each, blanks removed, empty ones left out."""
    k = articles.select(F.explode("keywords").alias("k")).select(F.trim("k").alias("keyword"))
    return k.where("keyword is not null and keyword <> ''").distinct()


def posts_of_users(posts: DataFrame, n: int) -> DataFrame:
    """The first n posts of each user by position (the crawl's own limit)."""
    w = Window.partitionBy("id").orderBy("pos")
    return posts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def post_pages(posts: DataFrame) -> DataFrame:
    """id, name, text: posts (folder ``name_id``, file, line number, value) joined without separators in a file and by ``<sep>`` between files."""
    part = F.split("folder", "_")
    lines = posts.groupBy("folder", "file").agg(F.array_sort(F.collect_list(F.struct("number", F.trim("value").alias("value")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["value"]), "")
    pages = lines.select("folder", "file", text.alias("post")).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("file", "post"))).alias("p"))
    return pages.select(F.try_element_at(part, F.lit(-1)).alias("id"), F.get(part, F.lit(0)).alias("name"), F.array_join(F.transform("p", lambda x: x["post"]), "<sep>").alias("text"))


def linked_pages(pages: DataFrame) -> DataFrame:
    """title, target: links of ambiguous pages one hop on, leaving out the page itself; pages (title, description, ambiguous, links)."""
    a = pages.where(F.col("ambiguous") | F.col("description").contains("消歧")).select(F.col("title").alias("from"), F.explode("links").alias("title"))
    return a.join(pages.select("title").distinct(), "title", "left_semi").where("`from` <> title").select("from", F.col("title").alias("target")).distinct()
