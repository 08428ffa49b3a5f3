"""Lexicon features of pages and the scoring of traits with supplied weights (for synthetic data only)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T


def lexicon_counts(pages: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """id, words, and a count for each category: entries with a star as patterns, others as literal parts. Han characters only."""
    han = T.han_only("text")
    counts = [
        sum([T.wildcard_occurrences(han, e) if "*" in e else T.occurrences(han, F.lit(e)) for e in entries], F.lit(0)).cast("int").alias(c)
        for c, entries in lexicon.items()
    ]
    return pages.select("id", F.length(han).alias("words"), *counts)


def trait_features(counts: DataFrame, means: dict[str, float]) -> DataFrame:
    """id, category, ratio, feature: category+ where the ratio of counts to words, rounded, is above the mean, else category-.

    Pages without words have no features. Rounding is that of binary arithmetic.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), F.lit(m).alias("mean")) for c, m in means.items()])).alias("x")
    ratio = T.round_places(F.col("x.n") / F.col("words"), 2)
    rows = counts.where("words > 0").select("id", "words", pairs)
    return rows.select("id", "x.category", ratio.alias("ratio"), F.concat(F.col("x.category"), F.when(ratio > F.col("x.mean"), "+").otherwise("-")).alias("feature"))


def weighted_mean(features: DataFrame, hidden: DataFrame) -> DataFrame:
    """id, dim, value: rows of a feature matrix (id, word, x) times hidden states (word, dim, h), over the sum of each row."""
    whole = features.groupBy("id").agg(F.sum("x").alias("_sum"))
    made = features.join(hidden, "word").groupBy("id", "dim").agg(F.sum(F.col("x") * F.col("h")).alias("_v"))
    return made.join(whole, "id").where("_sum <> 0").select("id", "dim", (F.col("_v") / F.col("_sum")).alias("value"))


def trait_scores(values: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """id, trait, score rounded to two places: a linear layer with given weights (trait, dim, w) and bias (trait, b)."""
    made = values.join(weights, "dim").groupBy("id", "trait").agg(F.sum(F.col("value") * F.col("w")).alias("_s"))
    return made.join(bias, "trait").select("id", "trait", T.round_places(F.col("_s") + F.col("b"), 2).alias("score"))


def attention_layer(h: np.ndarray, adjacency: np.ndarray, w: np.ndarray, a_src: np.ndarray, a_dst: np.ndarray, slope: float = 0.2) -> np.ndarray:
    """One multi-head graph attention layer over a small fixed graph, on the driver: heads x nodes x features."""
    out = []
    for k in range(w.shape[0]):
        z = h @ w[k]
        e = (z @ a_src[k])[:, None] + (z @ a_dst[k])[None, :]
        e = np.where(e > 0, e, slope * e)
        e = np.where(adjacency > 0, e, -np.inf)
        p = np.exp(e - e.max(axis=1, keepdims=True))
        out.append((p / p.sum(axis=1, keepdims=True)) @ z)
    return np.stack(out)
