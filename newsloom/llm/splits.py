"""Train, validation and test splits that keep related records together.

Method: connected components over records that share a form or a token (alternating large-star and small-star over
record-less edges: every distinct form and token is a vertex, so a form held by a third of all rows is one vertex and
its rows are never gathered), then a seeded hash of the component identifier falls into proportional ranges.

Defined results: null and all-blank values equal nothing; repeated rows get the same split; a record with neither form
nor token is a group of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.components import connected_components
from newsloom.plans.runtime import cut

NAMES = ("train", "validation", "test")
#: Seeds of the hash that are tried where none is given.
SEEDS = 24


def _plain(name: str):
    """Blanks at the ends removed, lower case; all-blank becomes null."""
    trimmed = F.regexp_replace(F.lower(name), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
    return F.when(trimmed != "", trimmed)


def record_groups(rows: DataFrame) -> DataFrame:
    """sample_id, group (long) and group_form (the least form of the group, null if it holds none) of every row."""
    plain = rows.select("sample_id", "tag", _plain("form").alias("f"), _plain("token").alias("t"))
    plain = plain.withColumns(
        {"fv": F.when(F.col("f").isNotNull(), F.xxhash64(F.lit("form"), "f")), "tv": F.when(F.col("t").isNotNull(), F.xxhash64(F.lit("token"), "t"))}
    ).withColumn("vertex", F.coalesce("fv", "tv", F.xxhash64(F.lit("row"), "sample_id")))
    edges = plain.select(F.col("vertex").alias("u"), F.coalesce("tv", "vertex").alias("v")).distinct()
    found = cut(connected_components(edges))
    named = plain.select("vertex", "f").distinct().join(found, F.col("vertex") == F.col("node"))
    forms = named.groupBy("component").agg(F.min("f").alias("group_form"))
    of = found.join(forms, "component")
    return plain.join(of, F.col("vertex") == F.col("node")).select("sample_id", "tag", F.col("component").alias("group"), "group_form")


def _split_of(seed, shares: tuple[float, float, float]):
    point = F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return F.when(point < shares[0], "train").when(point < shares[0] + shares[1], "validation").otherwise("test")


def chosen_seed(grouped: DataFrame, shares: tuple[float, float, float]) -> int:
    """The one of SEEDS seeds whose hash ranges hold shares of the rows, and of those with tag 1, next to ``shares``.

    One aggregate over group sizes gives the sums of all seeds; the least seed wins of equal ones.
    """
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"), F.count(F.when(F.col("tag") == 1, 1)).alias("ones"))
    tried = sizes.select("n", "ones", *[_split_of(k, shares).alias(f"s{k}") for k in range(SEEDS)])
    sums = [F.sum(F.when(F.col(f"s{k}") == name, F.col(c))).alias(f"{c}_{k}_{name}") for k in range(SEEDS) for name in NAMES for c in ("n", "ones")]
    r = tried.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), *sums).first()

    def off(k: int) -> float:
        return sum(abs((r[f"{c}_{k}_{name}"] or 0) / max(1, r[c] or 0) - share) for name, share in zip(NAMES, shares) for c in ("n", "ones"))

    return min(range(SEEDS), key=lambda k: (off(k), k))


def split_records(rows: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int | None = None) -> DataFrame:
    """sample_id, group_form, split: every group whole in train, validation or test.

    The hash of the group falls into the ranges of ``shares``, whatever the group's size. Without a ``seed`` the hash is seeded
    so that the sums come out next to ``shares`` (a group of a third of all rows then falls where there is room for it); with
    one a group's split never changes as the table grows.
    """
    grouped = cut(record_groups(rows))
    seed = chosen_seed(grouped, shares) if seed is None else seed
    return grouped.select("sample_id", "group_form", _split_of(seed, shares).alias("split"))


def split_report(rows: DataFrame) -> DataFrame:
    """Rows, groups, share of the rows and share of tag 1 of each split."""
    s = split_records(rows).select("sample_id", "group_form", "split").join(rows.select("sample_id", "tag"), "sample_id")
    whole = F.sum(F.count("*")).over(Window.partitionBy())
    return s.groupBy("split").agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / whole, 4).alias("share"),
        F.round(F.avg(F.coalesce("tag", F.lit(0)).cast("double")), 4).alias("tag_share"),
    )
