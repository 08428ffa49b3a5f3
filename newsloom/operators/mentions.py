"""Mentions: from tag sequences to spans, filters of forms, coreference, linking, entity pairs.

Positions are [start, end) in the sentence. Null tags count as outside; rows with a null key are groups of their own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.plans.runtime import shuffled

# Second characters that make a two-character form no name.
NO_NAME_ENDS = ("姓", "男", "女", "某", "嫌", "犯")


def tag_type(number: Column) -> Column:
    """Type of a tag number: O, or the type without its B or I."""
    labels = F.array(*[F.lit(t.split("-")[-1]) for t in T.TAGS])
    return F.coalesce(F.get(labels, number), F.lit("O"))


def spans(sequences: DataFrame, flush_tail: bool = True) -> DataFrame:
    """aid, sidx, eidx, form, type, start, end of every run of one type.

    A run ends at O or where the type changes; B and I are not told apart, so neighbours of one type are one run.
    ``flush_tail`` keeps a run that reaches the end of the sentence. Runs are found inside each row's array, without a shuffle;
    repeated rows give one result.
    """
    types = F.transform("tags", tag_type)
    rows = sequences.select("aid", "sidx", "sentence", "tags").distinct().withColumn("t", types).withColumn("n", F.size("tags"))
    at = F.sequence(F.lit(0), F.col("n") - 1)
    here = lambda i: F.get("t", i)
    starts = F.filter(at, lambda i: (here(i) != "O") & ((i == 0) | (F.get("t", i - 1) != here(i))))
    rows = rows.where("n > 0").withColumn("starts", starts)
    stops = F.transform(
        "starts",
        lambda s: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (j > s) & (F.get("t", j) != F.get("t", s)))), F.col("n")),
    )
    ends = F.zip_with("starts", stops, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    kept = ends if flush_tail else F.filter(ends, lambda x: x["end"] < F.col("n"))
    out = rows.select("aid", "sidx", "sentence", "t", F.posexplode(kept).alias("eidx", "x"))
    form = F.substring(F.col("sentence"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    return out.select("aid", "sidx", "eidx", form.alias("form"), F.get("t", F.col("x.start")).alias("type"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def spans_by_windows(sequences: DataFrame, flush_tail: bool = True) -> DataFrame:
    """The same by gaps and islands over exploded tags: for sequences too long for one row's array work."""
    tagged = sequences.select("aid", "sidx", "sentence", "tags").distinct().select("aid", "sidx", "sentence", F.size("tags").alias("n"), F.posexplode("tags").alias("pos", "tag"))
    key = ["aid", "sidx", "sentence"]
    w = Window.partitionBy(*key).orderBy("pos")
    t = tagged.withColumn("type", tag_type(F.col("tag")))
    t = t.withColumn("change", (~F.lag("type").over(w).eqNullSafe(F.col("type"))).cast("int")).withColumn("island", F.sum("change").over(w))
    runs = t.where("type <> 'O'").groupBy(*key, "n", "island", "type").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    runs = runs if flush_tail else runs.where("`end` < n")
    order = Window.partitionBy(*key).orderBy("start")
    form = F.substring(F.col("sentence"), F.col("start") + 1, F.col("end") - F.col("start"))
    return runs.select("aid", "sidx", (F.row_number().over(order) - 1).alias("eidx"), form.alias("form"), "type", "start", "end")


def word_tags(words: DataFrame) -> DataFrame:
    """aid, sidx, pos, tag in B-/I- form for words with their entity type (null: none): a word goes on if its neighbour has the type."""
    w = Window.partitionBy("aid", "sidx").orderBy("pos")
    before = F.lag("type").over(w)
    tag = F.when(F.col("type").isNull(), "O").when(before.eqNullSafe(F.col("type")), F.concat(F.lit("I-"), "type")).otherwise(F.concat(F.lit("B-"), "type"))
    return words.select("aid", "sidx", "pos", tag.alias("tag"))


def name_like(mentions: DataFrame) -> DataFrame:
    """Mentions whose form can be a name.

    Three characters or more: kept. Two: kept unless Latin letters or with an end of NO_NAME_ENDS. One: kept if an earlier
    mention of the article (by sidx, start) with three characters or more begins with it. Null and empty forms go.
    """
    n = F.length("form")
    place = F.struct("sidx", "start", "eidx")
    firsts = (
        mentions.where(n >= 3)
        .groupBy("aid", F.substring("form", 1, 1).alias("_c"))
        .agg(F.min(place).alias("_first"))
        .select("aid", F.col("_c").alias("form"), "_first")
    )
    two = (n == 2) & ~T.is_ascii_word("form") & ~F.substring("form", 2, 1).isin(*NO_NAME_ENDS)
    known = mentions.where(n == 1).join(firsts, ["aid", "form"]).where(F.col("_first") < place).select(*mentions.columns)
    return mentions.where((n >= 3) | two).unionByName(known)


def earlier_full_form(mentions: DataFrame) -> DataFrame:
    """aid, sidx, eidx, form, full: the first earlier form of the article, longer than the mention's and of its type, that contains it.

    Each distinct form of an article offers its single characters and pairs of neighbours as keys, and distinct forms meet them by the
    characters they begin with: an equi-join whose pairs share an article, a type and a beginning, however many mentions one article holds.
    """
    known = (
        mentions.where("length(form) > 1")
        .groupBy("aid", "type", "form")
        .agg(F.min(F.struct("sidx", "eidx")).alias("first"))
        .select("aid", "type", F.col("form").alias("full"), "first")
    )
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("full") - n + 1), lambda i: F.substring(F.col("full"), i, F.lit(n)))
    offered = known.select("aid", "type", "full", "first", F.explode(F.array_distinct(F.concat(grams(1), grams(2)))).alias("_k"))
    short = mentions.where("form <> ''").select("aid", "type", "form").distinct().withColumn("_k", F.substring("form", 1, 2))
    inside = short.join(offered, ["aid", "type", "_k"]).where("length(full) > length(form) and contains(full, form)")
    best = inside.groupBy("aid", "type", "form").agg(F.min(F.struct("first", "full")).alias("x"))
    met = mentions.join(best, ["aid", "type", "form"]).where(F.col("x.first") < F.struct("sidx", "eidx"))
    return met.groupBy("aid", "sidx", "eidx", "form").agg(F.min("x").alias("x")).select("aid", "sidx", "eidx", "form", F.col("x.full").alias("full"))


def linked_by_alias(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with all candidates of their form, in the alias table's order; without one the candidate columns are null.

    Repeated alias rows count once. Entries with an empty identifier are known to be unlinkable and are no candidates.
    """
    good = aliases.where("form is not null and eid <> ''").select("form", "seq", "eid", "formal", "exrest").distinct()
    return mentions.join(good, "form", "left")


def unlinked(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """aid, sidx, eidx of mentions whose form no alias links."""
    good = aliases.where("form is not null and eid <> ''").select("form").distinct()
    return mentions.join(good, "form", "left_anti").select("aid", "sidx", "eidx").distinct()


def best_candidates(candidates: DataFrame, group: list[str], score: str = "score", order: str = "pos", most: int = 10, above: float = 0.5) -> DataFrame:
    """Of the first ``most`` candidates in ``order`` the best by score, the earliest of equals, if strictly above the threshold."""
    capped = Window.partitionBy(*group).orderBy(order)
    best = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), order)
    first = candidates.withColumn("_n", F.row_number().over(capped)).where(F.col("_n") <= most)  # the candidate list's length is the feature
    return first.withColumn("_b", F.row_number().over(best)).where((F.col("_b") == 1) & (F.col(score) > above)).drop("_n", "_b")


def article_entities(mentions: DataFrame) -> DataFrame:
    """aid, eid once each."""
    return mentions.where("aid is not null and wikiID is not null").select("aid", F.col("wikiID").alias("eid")).distinct()


def entity_pairs(mentions: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs i < j of linked mentions of a sentence, in order; the pairs are the feature and a sentence is short.

    Null eidx and unlinked mentions take no part; repeated rows count once.
    """
    m = mentions.where("wikiID is not null").select("aid", "sidx", "eidx", "form", "wikiID").distinct()
    lists = m.groupBy("aid", "sidx").agg(F.array_sort(F.collect_list(F.struct("eidx", "form", "wikiID"))).alias("l")).where("size(l) > 1")
    a = lists.select("aid", "sidx", "l", F.posexplode("l").alias("i", "a"))
    pairs = a.select("aid", "sidx", "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    return pairs.select("aid", "sidx", F.col("a.eidx").alias("i"), F.col("b.eidx").alias("j"), F.col("a.form").alias("form1"), F.col("a.wikiID").alias("eid1"), F.col("b.form").alias("form2"), F.col("b.wikiID").alias("eid2"))


def negative_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of entities of a sentence that no edge links, in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return pairs.join(both, (pairs["eid1"] == both["src"]) & (pairs["eid2"] == both["dst"]), "left_anti")


def question_answers(pairs: DataFrame, sentences: DataFrame, answers: DataFrame) -> DataFrame:
    """aid, sidx, query, answer, start, end: place of the relation word of an entity pair in its sentence; absent ones give -1."""
    q = pairs.join(answers, ["eid1", "eid2"]).join(sentences.select("aid", "sidx", "sentence").distinct(), ["aid", "sidx"])
    start = F.expr("position(answer in sentence) - 1")
    return q.select("aid", "sidx", T.question("form1", "form2", False).alias("query"), "answer", start.alias("start"), F.when(start >= 0, start + F.length("answer")).otherwise(-1).alias("end"))


def tag_accuracy(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Share of equal tags over positions of both, and of an all-O guess.

    Rows are joined as arrays and divided into positions where they are counted, so no position is shuffled or sent to the driver.
    """
    g = gold.where("tags is not null").select(*keys, F.col("tags").alias("_g"))
    p = predicted.where("tags is not null").select(*keys, F.col("tags").alias("_p"))
    pairs = F.slice(F.arrays_zip(F.col("_g").alias("g"), F.col("_p").alias("p")), F.lit(1), F.least(F.size("_g"), F.size("_p")))
    both = g.join(shuffled(p), keys).select(F.inline(pairs))
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("g") == F.col("p")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("g") == 0).cast("double")), 6).alias("all_o"))
