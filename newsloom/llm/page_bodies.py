"""The lines of a web page that belong to its article.

Method: site template removal. A page is a sequence of blocks (lines); each block, and each part of a block between separators,
is hashed after its figures and the site's own name are masked. The hashes are counted per host in Spark, once per page, and
blocks recurring over many pages of their host are deleted. Recurring beginnings (up to a colon) and endings (after a comma or
slash) are counted in the same way, for bylines, date lines and links to other articles whose rest varies.

What no count can tell is decided by place: blocks that recur rarely but never beside a paragraph are comments or messages;
a recurring heading that is followed by runs of lines without an end mark opens a list of other articles, and whether a host
has such lists before or after its articles is counted too.

Counts are aggregated in the workers, then per (host, hash), so a host with a third of all pages is no hot group. The templates go
to the workers if they are few (BROADCAST_TEMPLATES), else they are joined to the pages by host.

Defined results: null and empty pages have no lines; repeated rows count once; a page whose url and source are null belongs to
a host of its own. Line numbers count blank lines. Pages are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.runtime import cut, spread

#: A block is a template of its host if this share of the host's pages (and at least LEAST pages) has it.
SHARE, LEAST = 0.10, 5
#: A beginning or ending is one if it has this share over the hosts that have it, and was seen LEAST_SHARED times.
PART_SHARE, LEAST_SHARED = 0.04, 8
#: Beginnings and endings are looked at in lines up to this length.
PART_LENGTH = 160
#: A rarely recurring sentence is a comment or message if it stands beside a paragraph in less than this share of its places.
BESIDE = 0.35
#: Share over its hosts from which a sentence is looked at for that, or a line without end mark is a template.
RARE_SHARE, PLAIN_SHARE = 0.004, 0.05
#: A remark that is preceded by a sentence on less than this share of its pages stands in place of an article: a message that it is missing.
PRECEDED = 0.6
#: A template opens a list if so many lines that can be its entries follow it on average.
LIST_RUN = 2.4
BROADCAST_TEMPLATES = 300_000

# Words that open a byline, and words of advertisements and notices in short lines, in the languages of the pages.
_BYLINE = re.compile(
    r"^(?:(?:Words|Story|Text|Photos?|Report(?:ed|ing)?|Written|Edited)\s+by\s|By\s+[A-Z]|Von\s+[A-Z]|Por\s+[A-Z]|(?:Text|Foto|Redaktion)\s*:|"
    r"(?:文|圖|图|記者|记者|撰文|攝影|摄影|責任編輯|责任编辑|編輯|编辑|採訪|采访|取材|写真|撮影)\s*[：:・／/])|^(?:記者|记者)[^，。]{1,12}[／/]|,\s*(?:staff writer|correspondent|reporter)$|\s(?:報導|报导|報道|报道)$"
)
_ADVERT = re.compile(r"廣告|广告|広告|贊助|赞助|Advertisement$|^Sponsored|Skip ad|^Anzeige$|^Werbung$|下載 ?App|下载 ?App|^Get our app|往下閱讀|往下阅读|continues below|下に続きます|^Publicidad")
_DATED = re.compile(r"^[^\s\d]{0,14}\s?\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$")
_BULLET = re.compile(r"^(?:[•▸▪»›＞>※◆■●▶‧*]\s*|-\s+|[・·]\s*|\d{1,2}[.、)]\s+)(?=\S)")
_SEPARATORS = re.compile(r"\s*[\t|/·　]\s*|\s{2,}")
_FIGURES = re.compile(r"\d+")
_ENDS = "。！？!?.…।」』”）)\"»“’"
_STOPS_IN = re.compile(r"[。！？!?।]|(?<!Prof)(?<!approx)(?<=[a-zß-ÿ]{3})\.(?=\s+[\"“„«A-Z¿¡])|\.$")
_OPENING = re.compile(r"^([^：:》｜】／]{1,20}[：:》｜】／])")
_CLOSING = re.compile(r"([,，／][^,，／]{2,26})$")


def host_of(url: str | None, source: str | None, page: object) -> str:
    """Host of a page: that of its url, else its source, else its own."""
    m = re.match(r"^[a-z]+://([^/\s]+)", url) if url else None
    return m.group(1).lower() if m else source or f"page {page}"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _masked(line: str, site: str) -> str:
    return _FIGURES.sub("9", line.replace(site, "SITE") if site else line)


def _site(host: str) -> str:
    label = host.removeprefix("www.").split(".")[0]
    return label if len(label) > 3 else ""


def ended(line: str) -> bool:
    """Whether a line ends with a mark that ends sentences (or a quote or bracket that closes there)."""
    return line[-1] in _ENDS and not (line[-1] in ")）" and not _STOPS_IN.search(line[:-1][-2:]))


def _split(content: str) -> list[str]:
    return [x.strip().strip("​﻿") for x in content.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def recurring_blocks(pages: DataFrame) -> DataFrame:
    """key: the blocks that LEAST pages or more have, of whatever host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for host, content in zip(pdf["host"], pdf["content"]):
                site = _site(host)
                seen.update({_masked(x, site) for x in _split(content) if x})
            yield pd.DataFrame([(_hash(m), n) for m, n in seen.items()], columns=["key", "n"]).astype("int64")

    return pages.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("key")


def _keys_of(content: str, host: str) -> set[int]:
    site = _site(host)
    return {_hash(_masked(x, site)) for x in _split(content) if x}


def _with_keys(pages: DataFrame, keys: DataFrame, of, name: str) -> DataFrame:
    """``pages`` and, as array ``name``, those of ``keys`` (column key) that ``of`` finds on each page; for keys too many to be broadcast."""

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(at, key) for at, host, content in zip(pdf["at"], pdf["host"], pdf["content"]) for key in of(content, host)]
            yield pd.DataFrame(found, columns=["at", "key"]).astype("int64")

    placed = pages.withColumn("at", F.xxhash64("page_id", "content"))
    of_page = placed.select("at", "host", "content").mapInPandas(looked_up, "at long, key long").join(keys, "key").groupBy("at").agg(F.collect_set("key").alias(name))
    return placed.join(of_page, "at", "left").drop("at")


def block_counts(pages: DataFrame) -> DataFrame:
    """kind, host, key, n, beside, follow, before, ended: blocks (b), beginnings (p) and endings (s) of lines per host, one per page.

    beside: pages where it stands beside a sentence that fewer than LEAST pages have; follow: lines that can be entries of
    a list and follow it; before: pages where such a sentence precedes it.
    """
    recurring, sent = cut(recurring_blocks(pages)), None
    if recurring.count() <= BROADCAST_TEMPLATES:
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(r.key for r in recurring.collect()))  # at most BROADCAST_TEMPLATES
    else:
        pages = _with_keys(pages, recurring, _keys_of, "again")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[str, str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
            held = [sent.value] * len(pdf) if sent is not None else [frozenset(x) if x is not None else frozenset() for x in pdf["again"]]
            for host, content, again in zip(pdf["host"], pdf["content"], held):
                site = _site(host)
                lines = [(x, _masked(x, site)) for x in _split(content) if x]
                flags = [(ended(x), _hash(m) not in again, len(x) >= 25) for x, m in lines]
                sentence = [e and u and long for e, u, long in flags]
                plain = [not e for e, _, _ in flags]
                run_after, preceded = [0] * (len(lines) + 1), False
                for i in range(len(lines) - 1, -1, -1):
                    x = lines[i][0]
                    single = bool(_BULLET.match(x)) or (flags[i][1] and not _BYLINE.search(x) and (plain[i] or _shape(x) == "s"))
                    run_after[i] = run_after[i + 1] + 1 if single else 0
                done: set = set()
                for i, (x, m) in enumerate(lines):
                    keys = [("b", m)]
                    if len(x) <= PART_LENGTH:
                        p, s = _OPENING.match(m), _CLOSING.search(m)
                        if p and len(p.group()) < len(m):
                            keys.append(("p", p.group()))
                        if s and plain[i]:
                            keys.append(("s", s.group()))
                    for kind, text in keys:
                        if (kind, text) in done:
                            continue
                        done.add((kind, text))
                        f = found[kind, host, _hash(text)]
                        f[0] += 1
                        f[1] += (i > 0 and sentence[i - 1]) or (i + 1 < len(lines) and sentence[i + 1])
                        f[2] += run_after[i + 1]
                        f[3] += preceded
                        f[4] += flags[i][0]
                    preceded = preceded or sentence[i]
            rows = [(*k, *v) for k, v in found.items()]
            yield pd.DataFrame(rows, columns=["kind", "host", "key", "n", "beside", "follow", "before", "ended"])

    return (
        pages.mapInPandas(run, "kind string, host string, key long, n long, beside long, follow long, before long, ended long")
        .groupBy("kind", "host", "key")
        .agg(*[F.sum(c).alias(c) for c in ("n", "beside", "follow", "before", "ended")])
    )


def site_templates(pages: DataFrame) -> DataFrame:
    """host, kind (b, p, s; h for headings of lists, m for messages in place of an article, w for blocks known on any host), key, top.

    ``top`` (of kind h): the host has its lists before its articles.
    """
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = cut(block_counts(pages).join(sizes, "host"))
    pooled = (
        counts.groupBy("kind", "key")
        .agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "beside", "follow", "before", "ended", "pages")], F.count("*").alias("hosts"))
        .where(F.col("all_n") >= LEAST)
    )
    joined = counts.join(pooled, ["kind", "key"])
    share, everywhere = F.col("n") / F.col("pages"), F.col("all_n") / F.col("all_pages")
    often, is_ended = F.col("all_n") >= LEAST_SHARED, F.col("all_ended") > 0.5 * F.col("all_n")
    own = ((share >= SHARE) & (F.col("n") >= LEAST)) | ((everywhere >= SHARE) & often & (F.col("hosts") > 1))
    remark = is_ended & often & (everywhere >= RARE_SHARE) & (F.col("all_beside") < BESIDE * F.col("all_n"))
    block = (F.col("kind") == "b") & (own | remark | (~is_ended & often & (everywhere >= PLAIN_SHARE)))
    part = (F.col("kind") != "b") & often & (everywhere >= PART_SHARE)
    kept = cut(joined.where(block | part).select("host", "kind", "key", "n", "follow", "before", "all_n", "all_follow", "all_ended"))
    lists = kept.where((F.col("kind") == "b") & (F.col("all_ended") == 0) & (F.col("all_follow") >= LIST_RUN * F.col("all_n")))
    tops = lists.groupBy("host").agg((F.sum("before") < 0.5 * F.sum("n")).alias("top"))
    heads = lists.join(tops, "host").select("host", F.lit("h").alias("kind"), "key", "top")
    sparse = (F.col("kind") == "b") & remark & ~own & (F.col("all_before") < PRECEDED * F.col("all_n"))
    notes = joined.where(sparse).select("host", F.lit("m").alias("kind"), "key", F.lit(False).alias("top"))
    words = kept.where("kind = 'b' and all_ended = 0").select(F.lit("").alias("host"), F.lit("w").alias("kind"), "key", F.lit(False).alias("top")).distinct()
    return kept.select("host", "kind", "key", F.lit(False).alias("top")).unionByName(heads).unionByName(notes).unionByName(words)


class Templates:
    """What is known of one host."""

    def __init__(self) -> None:
        self.keys: dict[str, set[int]] = {"b": set(), "p": set(), "s": set(), "h": set(), "m": set()}
        self.top = False


def _is_furniture(line: str, masked: str, known: Templates, words: set[int]) -> bool:
    if _hash(masked) in known.keys["b"]:
        return True
    if _BYLINE.search(line) and len(line) < 80 and not ended(line):
        return True
    if _DATED.match(line) or (len(line) < 26 and not ended(line) and _ADVERT.search(line)):
        return True
    if len(line) <= PART_LENGTH:
        p = _OPENING.match(masked)
        if p and _hash(p.group()) in known.keys["p"]:
            return True
        s = _CLOSING.search(masked)
        if s and not ended(line) and _hash(s.group()) in known.keys["s"]:
            return True
    parts = [x for x in _SEPARATORS.split(masked) if x]
    if len(parts) > 1 and all(_hash(x) in words for x in parts):
        return True
    tokens = masked.split(" ")
    if 1 < len(tokens) <= 24 and not ended(line):
        reach = [True] + [False] * len(tokens)
        for j in range(1, len(tokens) + 1):
            for i in range(max(0, j - 6), j):
                if reach[i] and _hash(" ".join(tokens[i:j])) in words:
                    reach[j] = True
                    break
        return reach[-1]
    return False


def _word_keys(content: str, host: str) -> set[int]:
    """Hashes of all parts and token runs of a page's lines that ``_is_furniture`` looks up among the words."""
    site, keys = _site(host), set()
    for line in filter(None, _split(content)):
        masked = _masked(line, site)
        parts = [x for x in _SEPARATORS.split(masked) if x]
        if len(parts) > 1:
            keys.update(map(_hash, parts))
        tokens = masked.split(" ")
        if 1 < len(tokens) <= 24 and not ended(line):
            keys.update(_hash(" ".join(tokens[i:j])) for j in range(1, len(tokens) + 1) for i in range(max(0, j - 6), j))
    return keys


# Log-likelihoods of a line without end mark (n), of one sentence (s) and of a longer paragraph (p) in a list and in an article.
_IN_LIST = {"n": math.log(0.8), "s": math.log(0.19), "p": math.log(0.01)}
_IN_ARTICLE = {"n": math.log(0.1), "s": math.log(0.4), "p": math.log(0.5)}


def _shape(line: str) -> str:
    if not ended(line):
        return "n"
    inner = re.sub(r"「[^」]*」|『[^』]*』|„[^“]*“|«[^»]*»|“[^”]*”|（[^）]*）|\"[^\"]*\"|\([^)]*\)", "", line)
    return "p" if len(_STOPS_IN.findall(inner)) > 1 else "s"


def _after_list(lines: list[str]) -> int:
    """Where an article begins among lines that follow the heading of a list: the likeliest headline, or len(lines)."""
    first = max((i + 1 for i, x in enumerate(lines) if _BULLET.match(x)), default=0)
    shapes = [_shape(x) for x in lines]
    best, at = sum(_IN_LIST[s] for s in shapes[first:]) + math.log(0.15), len(lines)
    for k in range(first, len(lines)):
        if shapes[k] == "n":
            value = sum(_IN_LIST[s] for s in shapes[first:k]) + math.log(0.85) + sum(_IN_ARTICLE[s] for s in shapes[k + 1 :])
            if k == 0:
                value += math.log(0.05)  # a list is seldom empty
            if value > best:
                best, at = value, k
    return at


def article_lines(content: str, host: str, known: Templates, words: set[int]) -> list[int]:
    """Numbers of the lines of one page that belong to its article."""
    site = _site(host)
    lines = _split(content)
    masked = [_masked(x, site) for x in lines]
    numbers = [i for i, x in enumerate(lines) if x]
    furniture = {i: _is_furniture(lines[i], masked[i], known, words) for i in numbers}
    if known.keys["m"] and any(_hash(masked[i]) in known.keys["m"] for i in numbers):
        return []
    heads = {i for i in numbers if furniture[i] and _hash(masked[i]) in known.keys["h"]}
    kept: list[int] = []
    at = 0
    while at < len(numbers):
        i = numbers[at]
        if i in heads:
            stop = at + 1
            while stop < len(numbers) and not furniture[numbers[stop]]:
                stop += 1
            if not known.top:
                break
            if stop < len(numbers) and numbers[stop] in heads:
                at = stop
                continue
            run = numbers[at + 1 : stop]
            kept += run[_after_list([lines[j] for j in run]) :]
            at = stop
            continue
        if not furniture[i] and not _BULLET.match(lines[i]):
            kept.append(i)
        at += 1
    if not any(ended(lines[i]) for i in kept):
        return []
    return kept


def page_bodies(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, source, content) -> page_id, line_no of the lines of the article."""
    spark = rows.sparkSession

    def hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["host"] = [host_of(u, s, p) for p, u, s in zip(pdf["page_id"], pdf["url"], pdf["source"])]
            yield pdf[["page_id", "host", "content"]]

    kind = rows.schema["page_id"].dataType.simpleString()
    once = rows.where("content is not null and page_id is not null").select("page_id", "url", "source", "content")
    pages = cut(spread(once).mapInPandas(hosts, f"page_id {kind}, host string, content string").dropDuplicates(["page_id", "content"]))
    templates = cut(site_templates(pages))
    out = f"page_id {kind}, line_no int"

    def lines_of(page_ids, host_names, contents, lookup) -> pd.DataFrame:
        found = []
        for page, host, content in zip(page_ids, host_names, contents):
            known, words = lookup(host)
            found += [(page, i) for i in article_lines(content, host, known, words)]
        return pd.DataFrame(found, columns=["page_id", "line_no"])

    def known_of(entries) -> Templates:
        known = Templates()
        for kind, key, top in entries:
            if kind in known.keys:
                known.keys[kind].add(key)
                known.top = known.top or top
        return known

    if templates.count() <= BROADCAST_TEMPLATES:
        table: dict[str, list] = defaultdict(list)
        for r in templates.collect():  # at most BROADCAST_TEMPLATES
            table[r.host].append((r.kind, r.key, r.top))
        sent = spark.sparkContext.broadcast(dict(table))

        def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = {key for _, key, _ in sent.value.get("", ())}
            cache: dict[str, Templates] = {}

            def lookup(host):
                if host not in cache:
                    cache[host] = known_of(sent.value.get(host, ()))
                return cache[host], words

            for pdf in batches:
                yield lines_of(pdf["page_id"], pdf["host"], pdf["content"], lookup)

        return pages.mapInPandas(few, out).distinct()

    grouped = templates.where("host <> ''").groupBy("host").agg(F.collect_list(F.struct("kind", "key", "top")).alias("known"))

    pooled = templates.where("kind = 'w'").select("key").distinct()

    def many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for _, part in pdf.groupby("host", sort=False):
                entries = part["known"].iloc[0]
                known = known_of([(e["kind"], e["key"], e["top"]) for e in entries] if entries is not None else ())
                for page, host, content, words in zip(part["page_id"], part["host"], part["content"], part["words"]):
                    frames += [(page, i) for i in article_lines(content, host, known, set(words) if words is not None else set())]
            yield pd.DataFrame(frames, columns=["page_id", "line_no"])

    return _with_keys(pages, pooled, _word_keys, "words").join(grouped, "host", "left").mapInPandas(many, out).distinct()
