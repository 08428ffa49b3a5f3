"""Term weights, sparse and dense similarities and the single-pass clustering of events."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.plans.runtime import shuffled


def document_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term once each (a word counts once per document, as the segmenter keeps a word once)."""
    return docs.select(key, F.explode(F.array_distinct(T.words_of(text))).alias("term"))


def document_frequency(terms: DataFrame, key: str) -> DataFrame:
    """term, df; rows of ``terms`` are distinct."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(terms: DataFrame, key: str, n_docs: int | None = None) -> DataFrame:
    """key, term, weight = log2(N / df); terms of every document vanish. One shuffle by term for counts, one for the join."""
    df = document_frequency(terms, key)
    n = terms.select(key).distinct().agg(F.count("*").alias("_n"))
    weighted = df.join(F.broadcast(n)).select("term", F.log2(F.col("_n") / F.col("df")).alias("weight")).where("weight > 0")  # n is one row
    return terms.join(shuffled(weighted), "term")


def unit(weights: DataFrame, key: str) -> DataFrame:
    """Weights of each document over their norm."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weights.join(norms, key).withColumn("weight", F.col("weight") / F.col("_norm")).drop("_norm")


def pivoted(weights: DataFrame, key: str, pivot: float = 10.0, slope: float = 0.1) -> DataFrame:
    """Weights over (1 - slope) * pivot + slope * norm; cosines are the same with and without."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weights.join(norms, key).withColumn("weight", F.col("weight") / ((1 - slope) * pivot + slope * F.col("_norm"))).drop("_norm")


def term_similarity(queries: DataFrame, rows: DataFrame, key: str, most_df: int | None = None) -> DataFrame:
    """query, key, cosine of unit vectors that share a term: an equi-join on the term, summed per pair.

    ``queries`` is a stated set of rows; partial sums are combined before the shuffle.
    """
    q = queries.select(F.col(key).alias("query"), "term", F.col("weight").alias("_w"))
    both = q.join(rows, "term").where(F.col("query") != F.col(key))
    return both.groupBy("query", key).agg(F.sum(F.col("_w") * F.col("weight")).alias("cosine"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays; of a null vector null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def mean_similarity_to_groups(vectors: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """key, group, mean cosine of each row to all members of its own group: dot with the sum of unit members over their number.

    Units are summed with partial sums before the shuffle, so a group of any size is no hot spot; the sums, one row for each group,
    come back by a join on it. Vectors of one length in a group are compared with each other; null vectors, vectors with nulls and
    null groups take no part.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    units = vectors.where(F.col(group).isNotNull() & (norm > 0)).select(key, group, F.size(vector).alias("_d"), F.transform(vector, lambda x: x.cast("double") / norm).alias("u"))
    parts = units.groupBy(group, "_d").agg(Summarizer.sum(array_to_vector("u")).alias("s"), F.count("*").alias("n"))
    whole = parts.select(group, "_d", vector_to_array("s").alias("s"), "n")
    dot = F.aggregate(F.zip_with("u", "s", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return units.join(whole, [group, "_d"]).select(key, group, (dot / F.col("n")).alias("similarity"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 2_000) -> DataFrame:
    """query, key, cosine, rank: the k nearest rows of each query vector, exactly, over all rows.

    Queries go to the workers in blocks of at most ``block``; each partition keeps its own k best of each query before the shuffle.
    Null vectors, and vectors with nulls, take no part; only vectors of one length are compared.
    """
    spark = vectors.sparkSession
    total = queries.count()
    parts = max(1, -(-total // block))
    out = None
    queries = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    vectors = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    marked = queries.select(key, vector, F.pmod(F.xxhash64(key), F.lit(parts)).alias("_b")).persist()
    for b in range(parts):
        rows = marked.where(F.col("_b") == b).orderBy(key).select(key, vector).toPandas()
        if not len(rows):
            continue
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size, part in rows.groupby(rows[vector].map(len)):
            q = np.array([np.asarray(v, np.float64) for v in part[vector]])
            by_size[int(size)] = (part[key].tolist(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))
        sent = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best: dict = defaultdict(list)
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                for size, part in pdf.groupby(pdf[vector].map(len)):
                    if size not in sent.value:
                        continue
                    ids, q = sent.value[size]
                    m = np.array([np.asarray(v, np.float64) for v in part[vector]])
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                    c, keys = q @ m.T, part[key].to_numpy()
                    for i, name in enumerate(ids):
                        order = np.lexsort((keys, -c[i]))[: k + 1]
                        best[name] += [(c[i, j], keys[j]) for j in order if keys[j] != name]
                        best[name] = sorted(best[name], key=lambda x: (-x[0], x[1]))[:k]
            yield pd.DataFrame([(name, y, float(x)) for name, found in best.items() for x, y in found], columns=["query", key, "cosine"])

        kind = vectors.schema[key].dataType.simpleString()
        found = vectors.select(key, vector).mapInPandas(run, f"query {kind}, {key} {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    from newsloom.operators.retrieval import top_by

    if out is None:
        kind = vectors.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"query {kind}, {key} {kind}, cosine double, rank int")
    return top_by(out, ["query"], [F.desc("cosine"), F.col(key)], k)


class SinglePass:
    """State of the single-pass clustering of sparse vectors.

    A document joins the cluster of the greatest mean cosine to all members (the dot product with the sum of the unit members
    over their number) among clusters that share a term with it, if that is at least theta; else it opens one. Of equals the
    lowest cluster. The first document opens cluster 0.
    """

    def __init__(self, theta: float):
        self.theta = theta
        self.sums: list[dict] = []
        self.sizes: list[int] = []
        self.postings: dict = defaultdict(set)

    def add(self, vector: dict) -> int:
        norm = sum(w * w for w in vector.values()) ** 0.5
        u = {t: w / norm for t, w in vector.items()} if norm else {}
        best, at = 0.0, -1
        for c in sorted(set().union(*(self.postings[t] for t in u if t in self.postings)) if u else ()):
            s = self.sums[c]
            value = sum(w * s.get(t, 0.0) for t, w in u.items()) / self.sizes[c]
            if value > best:
                best, at = value, c
        if at < 0 or best < self.theta:
            at = len(self.sums)
            self.sums.append({})
            self.sizes.append(0)
        s = self.sums[at]
        for t, w in u.items():
            s[t] = s.get(t, 0.0) + w
            self.postings[t].add(at)
        self.sizes[at] += 1
        return at


def single_pass(docs: DataFrame, key: str, order: str, theta: float = 0.1, block: str | None = None) -> DataFrame:
    """block, key, cluster: documents with ``terms`` (map term -> weight) clustered in the order of (order, key).

    The result depends on the order, so one block is one task: ``block`` names a column (a day, a theme) that divides the work and
    keeps each task bounded; without it the whole input is one block, which is exact and does not scale. A document without terms
    is a cluster of its own.
    """
    from newsloom.operators.vectors import SinglePass as State

    rows = docs.select(F.col(block).cast("string").alias("block") if block else F.lit("all").alias("block"), key, order, F.map_entries("terms").alias("terms"))
    kind = docs.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = State(theta)
        pdf = pdf.sort_values([order, key], kind="stable")
        clusters = [state.add({e["key"]: e["value"] for e in (t if t is not None else ())}) for t in pdf["terms"]]
        return pd.DataFrame({"block": pdf["block"], key: pdf[key], "cluster": clusters})

    return rows.groupBy("block").applyInPandas(run, f"block string, {key} {kind}, cluster int")


def cluster_events(clusters: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """event_id, articles: identifier of the date of the earliest member and the cluster's number, members in order of (time, key)."""
    m = clusters.join(shuffled(dates.select(key, "time")), key)
    members = F.array_sort(F.collect_list(F.struct("time", key)))
    g = m.groupBy("block", "cluster").agg(members.alias("m"))
    date = F.date_format(F.get("m", F.lit(0))["time"], "yyyy-MM-dd")
    return g.select(T.event_id(F.coalesce(date, F.lit("0000-00-00")), F.col("cluster")).alias("event_id"), "block", F.transform("m", lambda x: x[key].cast("string")).alias("articles"))


def event_lists(events: DataFrame) -> DataFrame:
    """event_id, aid: members joined with commas."""
    return events.select("event_id", F.array_join("articles", ",").alias("aid"))


def article_events(events: DataFrame) -> DataFrame:
    """aid, event_id: the inverse."""
    return events.select(F.explode("articles").alias("aid"), "event_id")
