"""Lookups by key, prefix, phrase, ranked match, time and property; a miss is an empty result, never null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T


def by_key(rows: DataFrame, key: str, value: str, first: bool = False) -> DataFrame:
    """Rows whose key equals the value; the filter reaches the scan."""
    found = rows.where(F.col(key) == value)
    return found.limit(1) if first else found


def by_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def by_properties(rows: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that have all the given values; a wanted null matches null."""
    tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()]
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def by_types(rows: DataFrame, column: str, types: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isin(*types))


def first_index_with(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """The row of the first table that has the key."""
    marked = [t.where(F.col(key) == value).withColumn("_at", F.lit(i)) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked).orderBy("_at").limit(1).drop("_at")


def with_fallback(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first table that has it; of equal keys in a table any one row."""
    marked = [t.withColumn("_at", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    columns = [c for c in rows.columns if c not in (key, "_at")]
    best = F.min(F.struct("_at", *columns)).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in columns])


def matching(rows: DataFrame, key: str, field: str, query: str, size: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that share a word with the query by their relevance (BM25), then by key: the first ``size`` (a top-k report).

    Numbers of rows, mean length and the rows that hold each word of the query come from one aggregate of a row; nothing else is
    shuffled, and each partition keeps its own best. Rows without text count as rows of no words; a query without words finds nothing.
    """
    asked = [r.w for r in rows.sparkSession.range(1).select(F.explode(F.array_sort(F.array_distinct(T.words_of(F.lit(query))))).alias("w")).collect()]  # the query's words
    if not asked:
        return rows.select(key, field, F.lit(0.0).alias("score")).limit(0)
    words = rows.withColumn("_w", F.coalesce(T.words_of(field), F.array().cast("array<string>")))
    times = lambda q: F.size(F.filter("_w", lambda x: x == F.lit(q)))
    counted = words.select(key, field, F.size("_w").alias("_l"), F.array(*map(times, asked)).alias("_tf"))
    whole = counted.agg(F.count("*").alias("_n"), F.avg("_l").alias("_mean"), F.array(*[F.count(F.when(F.col("_tf")[i] > 0, 1)) for i in range(len(asked))]).alias("_df"))
    idf = lambda df: F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
    weight = lambda tf, df: idf(df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_l") / F.col("_mean")))
    score = F.aggregate(F.zip_with("_tf", "_df", weight), F.lit(0.0), lambda s, x: s + x)
    found = counted.where(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(whole))  # one row
    return found.select(key, field, score.alias("score")).orderBy(F.desc("score"), key).limit(size)


def with_phrase(rows: DataFrame, field: str, phrase: str) -> DataFrame:
    """Rows whose field holds the phrase as it stands (text without word breaks)."""
    return rows.where(F.col(field).contains(phrase))


def time_prefix(year: int, month: int | None = None, day: int | None = None) -> str:
    """``YYYY[-MM[-DD]]``; a day without a month is ignored."""
    prefix = f"{year:04d}"
    if month is not None:
        prefix += f"-{month:02d}"
        if day is not None:
            prefix += f"-{day:02d}"
    return prefix


def by_time(rows: DataFrame, key: str, year: int, month: int | None = None, day: int | None = None, size: int | None = 10_000) -> DataFrame:
    """Rows whose identifier begins with the time, in order of the identifier; ``size`` is the report's page size."""
    found = by_prefix(rows, key, time_prefix(year, month, day)).orderBy(key)
    return found if size is None else found.limit(size)


def page_then_filter(rows: DataFrame, order: str, condition: Column, size: int = 10_000) -> DataFrame:
    """First a page of ``size`` rows, then the condition: rows beyond the page are not seen."""
    return rows.orderBy(order).limit(size).where(condition)


def edges_between(edges: DataFrame, nodes: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Edges from a node, or between two; with an unknown endpoint, or none given, nothing."""
    if src is None and dst is None:
        return edges.limit(0)
    found = edges
    for column, value in (("src", src), ("dst", dst)):
        if value is not None:
            there = nodes.where(F.col("eid") == value).select(F.col("eid").alias(column)).distinct()
            found = found.where(F.col(column) == value).join(there, column, "left_semi")
    return found.select("src", "rel", "dst")


def missing_in(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks (null keys are missing)."""
    return rows.join(there.select(key).distinct(), key, "left_anti")


def present_in(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return rows.join(there.select(key).distinct(), key, "left_semi")


def top_by(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
