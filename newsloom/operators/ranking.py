"""Ordered numbering without a single task, first-wins, sampling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_positions(rows: DataFrame, order: Sequence[str], name: str = "n", start: int = 1) -> DataFrame:
    """Numbers 1, 2, ... in total order, computed per range partition with offsets.

    The rows are range-partitioned and sorted once and checkpointed, so that the number of rows of each partition and the rows
    themselves agree even after a lost executor; the offsets are one row per partition.
    """
    from newsloom.plans.runtime import cut

    spark = rows.sparkSession
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ordered.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    del spark
    return numbered.withColumn(name, F.col("_before") + F.col("_local") + F.lit(start - 1)).drop("_part", "_before", "_local")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key the first row in ``order``; of equals the least row."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def hash_fifth(key: Column | str) -> Column:
    """Whether a key falls into the test fifth: by the first hex digits of its MD5, the same everywhere."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(5)) == 0


def positional_split(rows: DataFrame, group: Sequence[str], order: Sequence[str], share: float) -> DataFrame:
    """``part``: head for the first ``share`` of each group's rows in ``order``, else tail."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("part", F.when(n <= F.floor(F.count("*").over(w) * share), "head").otherwise("tail"))


def sample_rows(rows: DataFrame, n: int, keep: int, condition: Column, seed: int = 7, key: str | None = None) -> DataFrame:
    """Of ``n`` rows drawn by seed the first ``keep`` that meet the condition (a sampling operator; the draw is a top-k).

    Rows are drawn by the MD5 of the seed and ``key`` (the first column by default), so the draw is the same in any partitioning.
    """
    by = key or rows.columns[0]
    drawn = rows.withColumn("_r", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")))).orderBy("_r", by).limit(n)
    return drawn.where(condition).orderBy("_r", by).limit(keep).drop("_r")


def oversampled(rows: DataFrame, group: Sequence[str], order: str, tag: str) -> DataFrame:
    """The rows, and for each row of a group from its first wrong one (tag 0) on the group's first right one (tag 1) once more."""
    w = Window.partitionBy(*group)
    marked = rows.withColumns({"_wrong": F.max((F.col(tag) == 0).cast("int")).over(w.orderBy(order)), "_right": F.min(F.when(F.col(tag) == 1, F.col(order))).over(w)})
    again = marked.where("_wrong = 1 and _right is not null").select(*group, F.col("_right").alias(order), F.lit(1).alias(tag))
    return marked.select(*group, order, tag).unionByName(again)


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean over its population deviation; a deviation of nought gives nought."""
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = rows.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return both.withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])
