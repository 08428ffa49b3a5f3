"""Whole chains as one lazy plan: from tag sequences to a knowledge graph, from articles to event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import graph, mentions as M, relations as R, summaries as S
from newsloom.operators.scoring import CentroidScorer, OverlapScorer, Scorer


def linked_mentions(sequences: DataFrame, aliases: DataFrame, scorer: Scorer | None = None, above: float = 0.0) -> DataFrame:
    """aid, sidx, eidx, form, type, start, end, wikiID: spans of the sequences that can be names, with the best candidate of their form.

    A single candidate is taken as it is; of several the best by ``scorer`` (token: the sentence, exrest: the description).
    """
    spans = M.name_like(M.spans(sequences))
    found = M.linked_by_alias(spans, aliases)
    sentences = sequences.select("aid", "sidx", F.col("sentence").alias("token")).groupBy("aid", "sidx").agg(F.min("token").alias("token"))
    scored = (scorer or OverlapScorer()).run(found.where("eid is not null").join(sentences, ["aid", "sidx"]))
    key = ["aid", "sidx", "eidx", "form"]
    best = scored.groupBy(*key).agg(F.max_by("eid", F.struct("score", (-F.col("seq")).alias("s"), "eid")).alias("wikiID"), F.max("score").alias("score"), F.count("*").alias("n"))
    kept = best.where((F.col("n") == 1) | (F.col("score") > above)).select(*key, "wikiID")
    return spans.join(kept, key, "left")


def knowledge_graph(sequences: DataFrame, aliases: DataFrame, relation: str = "with") -> DataFrame:
    """src, rel, dst: merged edges between the linked mentions of a sentence; the relation comes from a scorer or is ``relation``."""
    pairs = M.entity_pairs(linked_mentions(sequences, aliases)).where("eid1 <> eid2").withColumn("relation", F.lit(relation))
    edges = R.triples(pairs).select(F.col("eid1").alias("src"), F.col("relation").alias("rel"), F.col("eid2").alias("dst"))
    return graph.merge_edges(edges, edges.limit(0))


def event_summaries(events: DataFrame, sentences: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """eid, abstract, name: chosen sentences of each event; sentences (event_id, pos, sentence, words), events (event_id, name)."""
    scored = (scorer or CentroidScorer()).run(S.usable_sentences(sentences))
    chosen = S.summaries(scored)
    return chosen.join(events, "event_id", "left").select(F.col("event_id").alias("eid"), "abstract", "name")
