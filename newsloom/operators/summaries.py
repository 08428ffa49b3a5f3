"""Event documents and extractive summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

LEAST_WORDS, MOST_WORDS, LEAST_SENTENCES, MOST_SENTENCES, PER_SUMMARY = 5, 200, 3, 100, 3


def event_documents(events: DataFrame, articles: DataFrame) -> DataFrame:
    """event_id, content: first paragraphs of an event's articles in the order of their identifiers, joined by line feeds.

    ``events`` (event_id, aid); articles (aid, content). Articles without such a paragraph are left out.
    """
    first = articles.select("aid", T.first_paragraph("content").alias("p")).where("p is not null").distinct()
    joined = events.join(first, "aid").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("aid", "p"))).alias("l"))
    return joined.select("event_id", F.array_join(F.transform("l", lambda x: x["p"]), "\n").alias("content"))


def usable_sentences(sentences: DataFrame) -> DataFrame:
    """event_id, pos, words: sentences of more than LEAST_WORDS words, cut at MOST_WORDS, the first MOST_SENTENCES of each event; events with
    fewer than LEAST_SENTENCES of them are left out (the limits are the summariser's input size)."""
    w = Window.partitionBy("event_id")
    long = sentences.where(F.size("words") > LEAST_WORDS).withColumn("words", F.slice("words", 1, MOST_WORDS))
    numbered = long.withColumn("_n", F.row_number().over(w.orderBy("pos"))).withColumn("_all", F.count("*").over(w))
    return numbered.where((F.col("_all") >= LEAST_SENTENCES) & (F.col("_n") <= MOST_SENTENCES)).drop("_n", "_all")


def segment_ids(tokens: DataFrame) -> DataFrame:
    """id, pos, segment: 0 and 1 in turn, changing after each separator."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.select("id", "pos", (F.coalesce(F.sum(F.col("is_sep").cast("int")).over(w), F.lit(0)) % 2).cast("int").alias("segment"))


def best_sentence(scored: DataFrame) -> DataFrame:
    """event_id, abstract: the best sentence by score, the first of equals (what the shipped rule always yields)."""
    return scored.groupBy("event_id").agg(F.max_by("sentence", F.struct("score", (-F.col("pos")).alias("p"))).alias("abstract"))


def _grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def choose(rows: list[tuple[int, str, list[str], float]], most: int = PER_SUMMARY) -> list[str]:
    """Sentences by score: the first, then those that share no 7-gram but a 2-gram with the chosen ones, up to ``most``.

    Sentences without a score come last, those without a place after the others of their score; without text they are left out.
    """
    rows = [r for r in rows if r[1] is not None]
    chosen: list[str] = []
    twos: set = set()
    sevens: set = set()
    for _, sentence, words, _ in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0.0), r[0] is None, r[0] or 0)):
        two, seven = _grams(words, 2), _grams(words, 7)
        if not chosen or (not (seven & sevens) and two & twos):
            chosen.append(sentence)
            twos |= two
            sevens |= seven
            if len(chosen) == most:
                break
    return chosen


def summaries(scored: DataFrame, most: int = PER_SUMMARY) -> DataFrame:
    """event_id, abstract: the chosen sentences in order of rank; ``scored`` (event_id, pos, sentence, words, score).

    One event's sentences, MOST_SENTENCES at most after ``usable_sentences``, are one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(e, "".join(choose([(r["pos"], r["sentence"], list(r["words"] if r["words"] is not None else ()), r["score"]) for r in rows], most))) for e, rows in zip(pdf["event_id"], pdf["rows"])]
            yield pd.DataFrame(out, columns=["event_id", "abstract"])

    kind = scored.schema["event_id"].dataType.simpleString()
    grouped = scored.groupBy("event_id").agg(F.collect_list(F.struct("pos", "sentence", "words", "score")).alias("rows"))
    return grouped.mapInPandas(run, f"event_id {kind}, abstract string")


def upsert_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows go in where the event is absent or its name is empty; others stay."""
    named = old.where("name is not null and length(name) > 0")
    fresh = new.join(named.select("eid"), "eid", "left_anti")
    return old.join(fresh.select("eid"), "eid", "left_anti").unionByName(fresh)
