"""Scorers that stand where neural models would: their interface and deterministic built-in ones.

A scorer takes a DataFrame and gives it back with a column more; any object with ``run`` can take the place of a built-in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.ranking import dense_positions
from newsloom.plans.runtime import spread

#: Names of a gazetteer that are sent to the workers at once; a larger one is used block by block.
GAZETTEER_BLOCK = 500_000

# Parts of speech that carry content, and types of an older scheme with their new names.
CONTENT_TAGS = ("n", "nh", "ni", "nl", "ns", "nz", "j", "ws", "a", "z", "b", "v")
OLD_TYPES = {"人物": "PER", "地名": "LOC", "组织": "ORG"}


class Scorer(Protocol):
    """Adds a score, tags or a relation to rows."""

    def run(self, rows: DataFrame) -> DataFrame: ...


def sentences_of(title: Column | str, body: Column | str) -> Column:
    """The title and then the body's sentences, divided after end marks and at paragraph marks; blank ones are left out."""
    b = F.col(body) if isinstance(body, str) else body
    marked = F.regexp_replace(F.regexp_replace(b, r"\\n|\n", "\u241e"), r"([。！？!?]+[」』”’）)]*)", "$1\u241e")
    parts = F.filter(F.transform(F.split(marked, "\u241e"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    t = F.col(title) if isinstance(title, str) else title
    return F.concat(F.array(F.coalesce(t, F.lit(""))), F.coalesce(parts, F.array().cast("array<string>")))


words_of = T.words_of


def content_words(words: Column | str, stop_words: DataFrame | None = None, tags: tuple[str, ...] = CONTENT_TAGS) -> Column:
    """Words (array of word, pos) of the content tags, once each in order of first occurrence; of a repeated word the last tag counts."""
    w = F.col(words) if isinstance(words, str) else words
    names = F.array_distinct(F.transform(w, lambda x: x["word"]))
    last = lambda name: F.element_at(F.filter(w, lambda x: x["word"] == name), -1)["pos"]
    return F.filter(names, lambda n: last(n).isin(*tags) & (n != " "))


def without_stop_words(rows: DataFrame, key: str, words: str, stop_words: DataFrame) -> DataFrame:
    """key, words without those of ``stop_words`` (word), in their order; an anti-join, so the list may have any size."""
    exploded = rows.select(key, F.posexplode(words).alias("_pos", "word"))
    kept = exploded.join(stop_words.select("word").distinct(), "word", "left_anti")
    lists = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "word"))).alias("_l"))
    out = rows.select(key).distinct().join(lists, key, "left")
    return out.select(key, F.coalesce(F.transform("_l", lambda x: x["word"]), F.array().cast("array<string>")).alias(words))


class GazetteerTagger:
    """Finds names of a gazetteer (name, etype) in sentences: the leftmost, of those the longest, without overlaps."""

    def __init__(self, names: DataFrame, block: int = GAZETTEER_BLOCK):
        self.names = names.where("name is not null and length(name) > 1").groupBy("name").agg(F.min("etype").alias("etype"))
        self.block = block

    def run(self, rows: DataFrame) -> DataFrame:
        """``rows`` (aid, sidx, sentence) -> aid, sidx, start, end, form, type."""
        spark = rows.sparkSession
        parts = max(1, -(-self.names.count() // self.block))
        marked = self.names.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(parts)))
        texts = spread(rows.where("sentence is not null").select("aid", "sidx", "sentence").distinct())
        found = None
        for b in range(parts):
            table = {r.name: r.etype for r in marked.where(F.col("_b") == b).collect()}  # a block
            sent = spark.sparkContext.broadcast(table)

            def hits(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                import ahocorasick

                a = ahocorasick.Automaton()
                for name, kind in sent.value.items():
                    a.add_word(name, (len(name), kind))
                a.make_automaton()
                for pdf in batches:
                    out = []
                    for aid, sidx, s in zip(pdf["aid"], pdf["sidx"], pdf["sentence"]):
                        if len(sent.value):
                            out += [(aid, sidx, e + 1 - n, e + 1, s[e + 1 - n : e + 1], k) for e, (n, k) in a.iter(s)]
                    yield pd.DataFrame(out, columns=["aid", "sidx", "start", "end", "form", "type"])

            h = texts.mapInPandas(hits, "aid string, sidx int, start int, end int, form string, type string")
            found = h if found is None else found.unionByName(h)

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for aid, sidx, spans in zip(pdf["aid"], pdf["sidx"], pdf["spans"]):
                    at = 0
                    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                        if x["start"] >= at:
                            out.append((aid, sidx, x["start"], x["end"], x["form"], x["type"]))
                            at = x["end"]
                yield pd.DataFrame(out, columns=["aid", "sidx", "start", "end", "form", "type"])

        spans = found.groupBy("aid", "sidx").agg(F.collect_set(F.struct("start", "end", "form", "type")).alias("spans"))  # one sentence's hits
        return spans.mapInPandas(choose, "aid string, sidx int, start int, end int, form string, type string")


class OverlapScorer:
    """Scores a candidate by the cosine of the character sets of sentence and description."""

    def __init__(self, sentence: str = "token", description: str = "exrest"):
        self.sentence, self.description = sentence, description

    def run(self, rows: DataFrame) -> DataFrame:
        a, b = (F.array_distinct(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ""), lambda x: x != "")) for c in (self.sentence, self.description))
        score = F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))
        return rows.withColumn("score", F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(0.0))


class CentroidScorer:
    """Scores an event's sentences (event_id, pos, words) by the cosine with the event's centroid, plus a bonus for leading ones."""

    def __init__(self, lead: float = 0.1):
        self.lead = lead

    def run(self, rows: DataFrame) -> DataFrame:
        terms = rows.select("event_id", "pos", F.explode(F.array_distinct("words")).alias("term"))
        sentences = terms.select("event_id", "pos").distinct().groupBy("event_id").agg(F.count("*").alias("_n"))
        df = terms.groupBy("event_id", "term").agg(F.count("*").alias("_df")).join(sentences, "event_id")
        weights = df.select("event_id", "term", F.log(1 + F.col("_n") / F.col("_df")).alias("_w"), "_df")
        lengths = weights.groupBy("event_id").agg(F.sqrt(F.sum((F.col("_w") * F.col("_df")) * (F.col("_w") * F.col("_df")))).alias("_c"))
        each = terms.join(weights, ["event_id", "term"]).groupBy("event_id", "pos")
        dots = each.agg(F.sum(F.col("_w") * F.col("_w") * F.col("_df")).alias("_d"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_s")).join(lengths, "event_id")
        scores = dots.select("event_id", "pos", (F.col("_d") / (F.col("_s") * F.col("_c"))).alias("_v"))
        bonus = F.when(F.col("pos") == 0, self.lead).otherwise(0.0)
        return rows.join(scores, ["event_id", "pos"], "left").withColumn("score", F.coalesce("_v", F.lit(0.0)) + bonus).drop("_v")


def new_type(old: Column | str) -> Column:
    """Type of an older scheme in the new one; unknown ones give null."""
    table = F.create_map(*[F.lit(v) for kv in OLD_TYPES.items() for v in kv])
    return F.try_element_at(table, F.col(old) if isinstance(old, str) else old)


def cluster_candidates(postings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, clusters: the clusters that share a term with each document; postings (term, cluster)."""
    return terms.join(postings.distinct(), "term").groupBy(key).agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))


def arrival_order(rows: DataFrame, group: str, time: str) -> DataFrame:
    """group, first, ordinal: groups numbered from 0 by the time of their first row, of equals by name (one row for each group).

    Numbered by range partitions with offsets, so that no task sees all groups.
    """
    firsts = rows.where(F.col(group).isNotNull() & F.col(time).isNotNull()).groupBy(group).agg(F.min(time).alias("first"))
    return dense_positions(firsts, ["first", group], "ordinal", 0)


def event_document_text(documents: DataFrame) -> DataFrame:
    """event_id, value: an event document as the text of a file: identifier and content under their headings."""
    return documents.select("event_id", F.concat_ws("\n", F.lit("eventID"), "event_id", F.lit("content"), "content").alias("value"))
