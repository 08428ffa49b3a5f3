import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first().y


@pytest.mark.parametrize("text", ["", None, "a1;<=>?@!中文，（好）", "a\tb\\c 1中"])
def test_cleaning_equals_the_pattern(spark, text):
    for make, pattern in ((T.clean_for_clusters, T.CLUSTER_NOISE), (T.clean_for_summaries, T.SUMMARY_NOISE), (T.han_only, T.NOT_HAN)):
        assert one(spark, text, make) == (None if text is None else re.sub(pattern, "", text))


def test_zfill_keeps_longer_values(spark):
    assert one(spark, "12345678901", lambda x: T.zfill(x, 10)) == "12345678901"
    assert one(spark, "7", lambda x: T.zfill(x, 10)) == "0000000007"


@pytest.mark.parametrize(
    "given,wanted",
    [("2021/03/04 05:06", "2021-03-04 05:06:00"), ("2021-03-04T05:06:07+08:00", "2021-03-04 05:06:07"), ("2021-03-04 05:06:07", "2021-03-04 05:06:07"), ("soon", None), (None, None)],
)
def test_normal_time(spark, given, wanted):
    assert one(spark, given, T.normal_time) == wanted


def test_first_paragraph(spark):
    assert one(spark, "ab\\nlong enough\\nrest", T.first_paragraph) == "longenough"
    assert one(spark, "ab\\n", T.first_paragraph) is None


def test_small_functions(spark):
    assert one(spark, "x -lrb-y-rrb-", T.unescape_brackets) == "x (y)"
    assert one(spark, "a ##b ##c  d", T.whole_words) == "abc d"
    assert one(spark, "aaaa", lambda x: T.occurrences(x, F.lit("aa"))) == 2
    assert one(spark, "aaaa", lambda x: T.occurrences(x, F.lit(""))) == 0
    assert one(spark, "a b c", lambda x: T.ngrams(F.split(x, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda x: T.ngrams(F.split(x, " "), 2)) == []
    assert one(spark, "a b", lambda x: T.padded(F.split(x, " "), 3, "-")) == ["a", "b", "-"]
    assert one(spark, "the then", lambda x: T.wildcard_occurrences(x, "the*")) == 2
    assert one(spark, "http://a/b/politics/1", T.topic_of) == "政治"


def test_alignment(spark):
    df = spark.createDataFrame([("a bc", "xx A b  c y"), ("zz", "abc"), (None, "q")], "p string, o string")
    assert [r.y for r in df.select(T.align_answer("p", "o").alias("y")).collect()] == ["A b  c", "abc", "q"]


def test_overlay_right_wins(spark):
    df = spark.range(1).select(T.overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))).alias("m"))
    assert df.first().m == {"a": 1, "b": 2}


def test_old_cleaning_and_item_names(spark):
    text = "  a。b\\n」c//d_e-f@g\\\\h''i\n"
    want = text.strip()
    for literal in T.OLD_NOISE:
        want = want.replace(literal, "")
    assert one(spark, text, T.clean_old) == want
    assert one(spark, T.ITEM_ADDRESS + "Q5[3]", T.wiki_name) == "Q5"


def test_round_places_as_binary_values_are(spark):
    values = [2.675, 0.125, 0.375, 1.005, 0.575, -2.675, -0.125, 0.0, 123456.785, 2.5, 1e-9, 0.285] + [i / 1000 for i in range(-300, 300, 7)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [(r.x, r.y) for r in df.select("x", T.round_places(F.col("x"), 2).alias("y")).collect()]
    assert all(y == round(x, 2) for x, y in got)
