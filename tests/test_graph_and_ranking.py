import math

from pyspark.sql import functions as F

from newsloom.operators import graph, ranking, retrieval


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "w")], "k string, t int, v string")
    assert {tuple(r) for r in graph.upsert_latest(old, new, "k", "t").collect()} == {("a", 2, None), ("b", 1, "y"), ("c", 1, "w")}
    cells = graph.upsert_cells(old.select("k", "v"), new.select("k", "v"), "k").where("k is not null")
    assert {tuple(r) for r in cells.collect()} == {("a", "x"), ("b", "y"), ("c", "w")}


def test_edges(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("a", "", "b"), ("a", "s", "x"), (None, "r", "b")], "src string, rel string, dst string")
    assert graph.merge_edges(e, e).count() == 2
    nodes = spark.createDataFrame([("a",), ("b",)], "eid string")
    assert [tuple(r) for r in graph.first_missing_end(graph.merge_edges(e, e.limit(0)), nodes).collect()] == [("a", "s", "x", "x")]
    assert retrieval.edges_between(e, nodes).count() == 0
    assert retrieval.edges_between(e, nodes, "a", "x").count() == 0
    assert retrieval.edges_between(e, nodes, "a", "b").count() == 3


def test_minted_ids_are_dense(spark):
    rows = spark.createDataFrame([(None, f"f{i:03d}") for i in range(100)] + [("Q1", "q")], "eid string, form string")
    there = spark.createDataFrame([("N00000041",), ("Q9",)], "eid string")
    got = {r.form: r.eid for r in graph.mint_ids(rows, there, ["form"]).collect()}
    assert got["q"] == "Q1" and got["f000"] == "N00000042" and got["f099"] == "N00000141" and len(set(got.values())) == 101


def test_types(spark):
    df = spark.createDataFrame([(["Q5"],), (["Q515"],), (["Q4167410"],), ([],), (None,), (["Q1"],), (["Q6256", "Q515"],)], "c array<string>")
    assert [r.t for r in df.select(graph.entity_type("c", ["Q515"]).alias("t")).collect()] == ["PER", "LOC", None, None, None, "ORG", "REG"]


def test_fallback_match_and_time(spark):
    a = spark.createDataFrame([("k", 1)], "key string, v int")
    b = spark.createDataFrame([("k", 2), ("l", 3)], "key string, v int")
    assert {tuple(r) for r in retrieval.with_fallback([a, b], "key").collect()} == {("k", 1), ("l", 3)}
    assert retrieval.first_index_with([a, b], "key", "l").first().v == 3
    assert retrieval.time_prefix(2021, 3, 4) == "2021-03-04" and retrieval.time_prefix(2021, None, 4) == "2021"
    docs = spark.createDataFrame([(1, "red fish"), (2, "Red red"), (3, None), (4, "")], "id int, text string")
    words, asked = {1: ["red", "fish"], 2: ["red", "red"], 3: [], 4: []}, ["red", "fish"]
    mean = sum(map(len, words.values())) / 4
    idf = {q: math.log(1 + (4 - n + 0.5) / (n + 0.5)) for q in asked for n in [sum(q in w for w in words.values())]}
    bm25 = {i: sum(idf[q] * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for q in asked) for i, w in words.items()}
    got = [(r.id, r.score) for r in retrieval.matching(docs, "id", "text", "red FISH").collect()]
    assert [i for i, _ in got] == [1, 2] and all(abs(x - bm25[i]) < 1e-9 for i, x in got)
    assert retrieval.matching(docs, "id", "text", "").count() == 0 and retrieval.matching(docs.limit(0), "id", "text", "red").count() == 0
    assert retrieval.by_properties(docs, {"text": None}).count() == 1


def test_splits_and_statistics(spark):
    rows = spark.createDataFrame([("g", i) for i in range(5)], "g string, n int")
    assert ranking.positional_split(rows, ["g"], ["n"], 0.5).where("part = 'head'").count() == 2
    z = ranking.standardised(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in z] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    share = spark.range(2000).select(ranking.hash_fifth(F.col("id").cast("string")).cast("double").alias("t")).agg(F.avg("t")).first()[0]
    assert 0.15 < share < 0.25
    assert ranking.sample_rows(spark.range(100), 50, 10, F.col("id") >= 0).count() == 10
