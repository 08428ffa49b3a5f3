"""Runtime helpers: reading tables, spreading small inputs, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the workers once per application, so that they need no path to it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    name = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a partition before Python work, without running anything.

    A small Parquet file arrives as one partition; a large table already has more partitions than cores and is returned
    untouched, so a scan isn't shuffled at scale. What comes out of a shuffle, whose partitions are known only when it has
    run, is dealt out evenly.
    """
    spark = df.sparkSession
    n = parallelism(spark)
    done = df._jdf.queryExecution()
    if "Exchange" in done.executedPlan().toString():
        return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df if done.toRdd().getNumPartitions() >= n else df.repartition(n)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and shuffles both sides.

    Sizes are estimated by the compressed files, and an explode, Python or a folding of texts counts for nothing; rows that are
    many times larger than that would else be collected by the driver for a broadcast.
    """
    return df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "newsloom-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
