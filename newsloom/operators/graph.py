"""Nodes and edges: upserts, merges, minted identifiers, entity types and documents.

Null keys never meet anything: rows with a null key are left out of merges, as the docstrings say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

NODE_TYPES = ("PER", "ORG", "LOC", "REG", "OTH")
# Classes of the knowledge base for persons, regions and places, and the class of ambiguous names.
PERSON_CLASSES = ("Q5", "Q4164871")
REGION_CLASSES = ("Q6256", "Q3624078")
AMBIGUOUS_CLASS = "Q4167410"
PLACE_CLASSES = ("Q5284036", "Q82794", "Q515", "Q486972", "Q23442", "Q1496967", "Q5107", "Q2418896", "Q705296", "Q3622002", "Q35657")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one latest in ``order``; of equal ones the greatest row. Null keys are left out."""
    rows = old.unionByName(new, allowMissingColumns=True).where(F.col(key).isNotNull())
    columns = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(order, *columns)).alias("_best")
    return rows.groupBy(key).agg(best).select(key, F.col(f"_best.{order}").alias(order), *[F.col(f"_best.{c}").alias(c) for c in columns])


def upsert_cells(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per cell: values of the new rows that are not null win, others stay; columns of either side are kept."""
    a = old.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_a_{c}") for c in old.columns if c != key])
    b = new.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_b_{c}") for c in new.columns if c != key])
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    both = a.join(b, key, "full")
    sides = lambda c: [F.col(f"_{s}_{c}") for s, t in (("b", new), ("a", old)) if c in t.columns]
    return both.select(key, *[F.coalesce(*sides(c)).alias(c) for c in columns if c != key])


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) of both, once each; edges with an empty or null relation or a null end are left out."""
    whole = "src is not null and dst is not null and rel is not null and rel <> ''"
    return old.select("src", "rel", "dst").unionByName(new.select("src", "rel", "dst")).where(whole).distinct()


def first_missing_end(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has, and that end: the source if both lack one."""
    ids = nodes.select("eid").distinct()
    s, d = ids.select(F.col("eid").alias("src"), F.lit(True).alias("_s")), ids.select(F.col("eid").alias("dst"), F.lit(True).alias("_d"))
    both = edges.join(s, "src", "left").join(d, "dst", "left")
    return both.where("_s is null or _d is null").select("src", "rel", "dst", F.when(F.col("_s").isNull(), F.col("src")).otherwise(F.col("dst")).alias("missing"))


def mint_ids(rows: DataFrame, existing: DataFrame, order: Sequence[str], key: str = "eid", letter: str = "N", width: int = 8) -> DataFrame:
    """Rows with a null key get the numbers after the greatest existing one, in ``order``.

    Numbers are dense: positions are counted per block of hashed order values with block offsets, not in one task.
    """
    from newsloom.operators.ranking import dense_positions

    digits = F.regexp_extract(F.col(key), f"^{letter}([0-9]+)$", 1)
    top = existing.where(F.col(key).rlike(f"^{letter}[0-9]+$")).agg(F.coalesce(F.max(digits.cast("long")), F.lit(1)).alias("_top"))
    fresh = dense_positions(rows.where(F.col(key).isNull()), order, "_n")
    minted = fresh.join(F.broadcast(top)).withColumn(key, F.concat(F.lit(letter), T.zfill(F.col("_top") + F.col("_n"), width)))  # one row
    return rows.where(F.col(key).isNotNull()).unionByName(minted.drop("_n", "_top"))


def entity_type(classes: Column | str, places: Sequence[str] = PLACE_CLASSES) -> Column:
    """Type by the classes an item is an instance of: person, region, place; ambiguous or none gives null, others are bodies."""
    c = F.col(classes) if isinstance(classes, str) else classes
    has = lambda values: F.arrays_overlap(c, F.array(*map(F.lit, values))) if values else F.lit(False)
    return (
        F.when(c.isNull() | (F.size(c) == 0), F.lit(None).cast("string"))
        .when(has(PERSON_CLASSES), "PER")
        .when(has(REGION_CLASSES), "REG")
        .when(has(places), "LOC")
        .when(has([AMBIGUOUS_CLASS]), F.lit(None).cast("string"))
        .otherwise("ORG")
    )


def final_type(mention: Column | str, base: Column | str) -> Column:
    """The mention's type unless it says person and the knowledge base knows one."""
    m, b = (F.col(x) if isinstance(x, str) else x for x in (mention, base))
    return F.when((m != "PER") | b.isNull(), m).otherwise(b)


def name_or_form(label: Column | str, form: Column | str) -> Column:
    return F.coalesce(F.nullif(label if not isinstance(label, str) else F.col(label), F.lit("")), form if not isinstance(form, str) else F.col(form))


def base_items(items: DataFrame) -> DataFrame:
    """eid, name, etype, summary, website of knowledge-base items as JSON (eid, form, value).

    The label names the item, or else the form it was met under; the type follows from the classes of P31, the website is the first
    of P856. Items that can't be read have neither type nor website.
    """
    schema = "label string, description string, claims map<string, array<string>>"
    rows = items.select("eid", "form", F.from_json("value", schema).alias("x"))
    first = lambda p: F.get(F.try_element_at("x.claims", F.lit(p)), F.lit(0))
    return rows.select(
        "eid", name_or_form(F.col("x.label"), "form").alias("name"), entity_type(F.try_element_at("x.claims", F.lit("P31"))).alias("etype"),
        F.col("x.description").alias("summary"), first("P856").alias("website"),
    )


def entity_documents(nodes: DataFrame, details: DataFrame, known: DataFrame, key: str = "eid") -> DataFrame:
    """Nodes not known yet, with the details' values over their own where these are not null."""
    fresh = _one_each(nodes.join(known.select(key).distinct(), key, "left_anti"), key)
    d = _one_each(details, key).select(key, *[F.col(c).alias(f"_d_{c}") for c in details.columns if c != key])
    columns = list(dict.fromkeys([*nodes.columns, *details.columns]))
    pick = lambda c: F.coalesce(*[F.col(x) for x in ([f"_d_{c}"] if c in details.columns else []) + ([c] if c in nodes.columns else [])])
    return fresh.join(d, key, "left").select(key, *[pick(c).alias(c) for c in columns if c != key])


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least by its other columns, in their order, that can be ordered."""
    rest = [c for c in rows.columns if c != key]
    order = [F.to_json(F.struct(c)) if "map" in rows.schema[c].dataType.simpleString() else F.col(c) for c in rest]
    if not rest:
        return rows.distinct()
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def relations_between(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, property, label) of the properties that link two items; claims (src, rel, dst), labels (rel, label)."""
    return claims.select("src", "dst", "rel").distinct().join(labels.select("rel", "label").distinct(), "rel").select("src", "dst", "rel", "label")


def edges_to_labelled(edges: DataFrame, nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges whose target has one of the labels (nodes: eid, labels array)."""
    wanted = F.array(*map(F.lit, labels))
    t = nodes.where(F.arrays_overlap("labels", wanted)).select(F.col("eid").alias("dst")).distinct()
    return edges.join(t, "dst", "left_semi").select("src", "rel", "dst")


def ends_by_name(relations: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """Old relations (name1, rel, name2) with the identifiers of their ends: the node's, else the knowledge base's, else null.

    Nodes and base have (name, eid); of several the least. Relations without a name are left out.
    """
    pick = lambda t, c: t.where("name is not null").groupBy("name").agg(F.min("eid").alias(c))
    found = pick(nodes, "n").join(pick(base, "b"), "name", "full").select("name", F.coalesce("n", "b").alias("eid"))
    out = relations.where("rel is not null and rel <> ''")
    for i in ("1", "2"):
        out = out.join(found.select(F.col("name").alias(f"name{i}"), F.col("eid").alias(f"eid{i}")), f"name{i}", "left")
    return out.select("name1", "eid1", "rel", "name2", "eid2")


def picture_of(images: DataFrame) -> DataFrame:
    """The highest image of each item, the first of equals; images (eid, pos, url, height); no url or height is no image."""
    best = F.max_by(F.struct("url", "height", "pos"), F.struct("height", -F.col("pos"))).alias("b")
    good = images.where("url is not null and height > 0")
    return good.groupBy("eid").agg(best).select("eid", "b.url", "b.height", "b.pos")
