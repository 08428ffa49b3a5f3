"""Incremental forms: event counts with late data, clustering with kept state, resumable batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.vectors import SinglePass


def event_counts(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, n, total: counts and rounded sums by event time; ``late`` is the watermark of a stream.

    ``ts`` without zone is taken as UTC; rows without a time are left out.
    """
    rows = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n: runs of a user's events with no longer gap between them."""
    rows = events.where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def cluster_stream(docs: DataFrame, key: str, order: str, theta: float = 0.1, block: str = "block"):
    """Stream of (block, key, cluster): each block's documents join or open clusters of the state kept for the block.

    Weights are fixed when a document arrives. Rows of a micro-batch are taken in (order, key); batches follow one another.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        clusters = SinglePass(theta)
        if state.exists:
            sums, sizes = json.loads(state.get[0])
            clusters.sums, clusters.sizes = sums, sizes
            for c, s in enumerate(sums):
                for t in s:
                    clusters.postings[t].add(c)
        rows = pd.concat(list(batches)).sort_values([order, key], kind="stable")
        found = [clusters.add({e["key"]: e["value"] for e in t}) for t in rows["terms"]]
        state.update((json.dumps([clusters.sums, clusters.sizes]),))
        yield pd.DataFrame({block: keys[0], key: rows[key].to_numpy(), "cluster": found})

    flat = docs.select(F.col(block).cast("string").alias(block), key, order, F.map_entries("terms").alias("terms"))
    return flat.groupBy(block).applyInPandasWithState(run, f"{block} string, {key} {kind}, cluster int", "state string", "append", "NoTimeout")


def run_available(stream: DataFrame, each, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what has arrived and ends: ``each`` (rows, batch number) for every batch; ``checkpoint`` remembers where it ended."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not processed yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def after_checkpoint(rows: DataFrame, key: str, last: str | None) -> DataFrame:
    """Rows after the key at which the last run ended; with no checkpoint all."""
    return rows if last is None else rows.where(F.col(key) > last)


def two_phase_links(forms: DataFrame, aliases: DataFrame, resolve) -> tuple[DataFrame, DataFrame]:
    """(linked forms, grown alias table): forms are linked by the table, the distinct rest resolved once by ``resolve`` and added."""
    good = aliases.where("eid <> ''").select("form", "eid").distinct()
    known = forms.select("form").distinct().join(good, "form")
    fresh = resolve(forms.select("form").distinct().join(good.select("form"), "form", "left_anti"))
    return known.unionByName(fresh), good.unionByName(fresh).distinct()
