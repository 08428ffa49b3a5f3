"""The registry of the queries on training data and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import cuts, leaks, name_variants, near_duplicates, page_bodies, sentences, splits, textform, token_ids
from newsloom.plans.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.link_variants(table(spark, d, "mentions"), table(spark, d, "entities"), table(spark, d, "aliases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_bodies.page_bodies(table(spark, d, "crawled_pages"))


def _look_alike_values(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles").select(F.lit("content").alias("field"), F.col("id").alias("key"), F.col("content").alias("value"))
    entities = table(spark, d, "entities")
    names = [entities.select(F.lit(f).alias("field"), F.col("eid").alias("key"), F.col(f).alias("value")) for f in ("name", "name_cht")]
    return spread(articles).unionByName(names[0]).unionByName(names[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.look_alike_pairs(_look_alike_values(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return textform.look_alike_classes(_look_alike_values(spark, d))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select(F.col("id").alias("key"), F.col("content").alias("value"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.grouped_pairs(_contents(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.text_groups(_contents(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles").select(F.lit("content").alias("field"), F.col("id").alias("rec_key"), F.col("content").alias("text"), F.lit(False).alias("whole"))
    stored = table(spark, d, "tag_sequences").select(
        F.lit("sentence").alias("field"), F.concat("aid", F.lit("/"), F.col("sidx").cast("string")).alias("rec_key"), F.col("sentence").alias("text"), (F.col("sidx") == 0).alias("whole")
    )
    rows = spread(articles).unionByName(spread(stored))
    return sentences.sentence_units(rows, sentences.corpus_evidence(rows))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.record_groups(table(spark, d, "el_training")).select("sample_id", "group_form")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, "el_training"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(table(spark, d, "el_training"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cut_documents(table(spark, d, "documents"), lang="lang")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cuts_by_source(table(spark, d, "documents"), lang="lang")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_BLANK = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"

SQL = {
    "p6_found": rf"""with recursive p as (select sample_id, nullif(regexp_replace(lower(form), '{_BLANK}', '', 'g'), '') as f, nullif(regexp_replace(lower(token), '{_BLANK}', '', 'g'), '') as t from el_training),
        e as (select distinct f, t from p where f is not null and t is not null), n as (select distinct a.f, b.f as g from e a join e b using (t)),
        r as (select f, f as g from (select distinct f from p where f is not null) union select r.f, n.g from r join n on r.g = n.f),
        m as (select f, min(g) as g from r group by f), k as (select t, min(g) as g from e join m using (f) group by t)
        select sample_id, coalesce(m.g, k.g) as group_form from p left join m using (f) left join k on p.t = k.t""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the one query that has any; the others are tested against brute force, exact round trips or held-out links."""
    return dict(SQL)
