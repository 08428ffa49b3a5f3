"""Relation spans as extractive answers: windows over tokens, owners of positions, n-best decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_BEST, LONGEST_ANSWER, LONGEST, STRIDE = 20, 30, 384, 128


def token_windows(docs: DataFrame, query_length: int = 0, longest: int = LONGEST, stride: int = STRIDE) -> DataFrame:
    """id, span, start, length: overlapping windows of at most ``longest - query - 3`` tokens; ``docs`` has id and n tokens.

    The next window starts ``min(length, stride)`` later; the last one is the first that reaches the end. No tokens, no window.
    """
    room = max(1, longest - query_length - 3)
    step = min(room, stride)
    last = F.when(F.col("n") <= room, 0).otherwise(F.ceil((F.col("n") - room) / step))
    starts = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: i * step))
    return docs.select("id", "n", F.posexplode(starts).alias("span", "start")).select("id", "span", F.col("start").cast("int").alias("start"), F.least(F.lit(room), F.col("n") - F.col("start")).cast("int").alias("length"))


def position_owners(windows: DataFrame) -> DataFrame:
    """id, pos, span: the window in which a token has most context: max of min(left, right) + 0.01 * length, the first of equals.

    Only the windows are shuffled, by their text; a text's positions are unfolded and compared where its windows then are.
    Score (in hundredths) and place of the window are one number, so that the comparison is a plain maximum.
    """
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few windows unfold to many positions
    p = windows.select("id", "span", "start", "length").repartition(n, "id")
    p = p.select("id", "span", "start", "length", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    left, right = F.col("pos") - F.col("start"), F.col("start") + F.col("length") - 1 - F.col("pos")
    hundredths = F.least(left, right).cast("long") * 100 + F.col("length")
    most = (1 << 31) - 1
    best = p.groupBy("id", "pos").agg(F.max(hundredths * (1 << 31) + (F.lit(most) - F.col("span"))).alias("best"))
    return best.select("id", "pos", (F.lit(most) - F.pmod("best", F.lit(1 << 31))).cast("int").alias("span"))


def best_positions(logits: DataFrame, n: int = N_BEST) -> DataFrame:
    """id, pos, value, rank of the n greatest values of each id's array, the lower index of equals."""
    w = Window.partitionBy("id").orderBy(F.desc("value"), "pos")
    p = logits.select("id", F.posexplode("values").alias("pos", "value"))
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def answer_spans(starts: DataFrame, ends: DataFrame, longest: int = LONGEST_ANSWER) -> DataFrame:
    """id, start, end, score of the pairs of best positions with start <= end and at most ``longest`` tokens (N_BEST squared at most)."""
    s = starts.select("id", F.col("pos").alias("start"), F.col("value").alias("sv"))
    e = ends.select("id", F.col("pos").alias("end"), F.col("value").alias("ev"))
    length = F.col("end") - F.col("start") + 1
    return s.join(e, "id").where(length.between(1, longest)).select("id", "start", "end", (F.col("sv") + F.col("ev")).alias("score"))


def n_best(spans: DataFrame, texts: DataFrame, n: int = N_BEST) -> DataFrame:
    """id, text, score, rank, probability: the n best answers by score with different texts; probabilities by a shifted softmax.

    ``texts`` has (id, start, end, text). Of equal texts the best counts, of equal scores the earlier span.
    """
    t = spans.join(texts, ["id", "start", "end"])
    once = t.groupBy("id", "text").agg(F.max(F.struct("score", (-F.col("start")).alias("a"), (-F.col("end")).alias("b"))).alias("x"))
    w = Window.partitionBy("id").orderBy(F.desc("x.score"), F.desc("x.a"), F.desc("x.b"), "text")
    ranked = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("id", "text", F.col("x.score").alias("score"), "rank")
    whole = Window.partitionBy("id")
    weight = F.exp(F.col("score") - F.max("score").over(whole))
    return ranked.withColumn("probability", weight / F.sum(weight).over(whole))


def decide(best: DataFrame, nulls: DataFrame, threshold: float = 0.0) -> DataFrame:
    """id, text: the best answer, or an empty text if the null score beats it by more than the threshold or there is none."""
    top = best.where("rank = 1").select("id", "text", "score")
    both = nulls.join(top, "id", "left")
    empty = F.col("text").isNull() | ((F.col("null_score") - F.col("score")) > threshold)
    return both.select("id", F.when(empty, F.lit("")).otherwise(F.col("text")).alias("text"))


def triples(pairs: DataFrame, relation: str = "relation") -> DataFrame:
    """Triples with an identifier made of their place, the same on every run and in every partitioning."""
    place = F.md5(F.concat_ws("/", "aid", "sidx", "i", "j"))
    return pairs.where(F.col(relation) != "").withColumn("triple_id", place)
