"""Sinks: text forms of annotated sentences, sharded files, checkpointed appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conll_lines(tokens: DataFrame) -> DataFrame:
    """aid, sidx, pos, line: ``word tag``, and an empty line after each sentence (pos one past its last)."""
    body = tokens.select("aid", "sidx", "pos", F.concat_ws(" ", "word", "tag").alias("line"))
    gaps = tokens.groupBy("aid", "sidx").agg((F.max("pos") + 1).alias("pos")).withColumn("line", F.lit(""))
    return body.unionByName(gaps)


def write_conll(tokens: DataFrame, path: str) -> None:
    """Text files in order; a sentence is never divided between files."""
    lines = conll_lines(tokens)
    lines.repartitionByRange("aid", "sidx").sortWithinPartitions("aid", "sidx", "pos").select("line").write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, path: str, size: int = 2_000, kind: str = "json") -> None:
    """Files of at most ``size`` records."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).format(kind).save(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table at ``path`` lacks; a table that isn't there yet is created."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(conf).exists(place):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def split_json(rows: DataFrame, path: str, key: str) -> None:
    """train and test folders of JSON lines, by the hash of the key."""
    from newsloom.operators.ranking import hash_fifth

    test = hash_fifth(F.col(key).cast("string"))
    rows.where(~test).write.mode("overwrite").json(f"{path}/train")
    rows.where(test).write.mode("overwrite").json(f"{path}/test")


class VersionedTable:
    """A keyed Parquet table on a shared folder with upserts: every change writes a new version and then names it the current one.

    A reader keeps the version it opened. The batch number of a stream is the version's name, so a repeated batch changes nothing.
    """

    def __init__(self, spark, path: str, key: str, order: str):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order

    def _fs(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        jvm, fs = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def versions(self) -> list[int]:
        """Numbers of the finished versions."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._there(f"{n}/_SUCCESS"))

    def read(self) -> DataFrame | None:
        """The current version; None before the first one."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def upsert(self, rows: DataFrame, version: int | None = None) -> None:
        """The latest row of each key of the current version and ``rows`` as a new version; a version that is there is left alone."""
        from newsloom.operators.graph import upsert_latest

        found = self.versions()
        number = version if version is not None else (found[-1] + 1 if found else 0)
        if number in found:
            return
        old = self.read()
        new = upsert_latest(old if old is not None else rows.limit(0), rows, self.key, self.order)
        new.write.mode("overwrite").parquet(f"{self.path}/v={number}")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``."""
        self.upsert(rows, batch_id)

    def clear(self, sure: bool = False) -> None:
        """An empty version; refuses without ``sure``."""
        if not sure:
            raise ValueError("clear() empties the table; call it with sure=True")
        now = self.read()
        if now is not None:
            now.limit(0).write.mode("overwrite").parquet(f"{self.path}/v={self.versions()[-1] + 1}")
