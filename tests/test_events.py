import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import summaries as S
from newsloom.operators import traits
from newsloom.operators import vectors as V
from newsloom.plans import event_queries
from newsloom.streaming import incremental as I


def naive(vectors, theta):
    """All members kept, every cosine computed."""
    clusters, out = [], []
    for v in vectors:
        norm = sum(x * x for x in v.values()) ** 0.5
        u = {k: x / norm for k, x in v.items()}
        best, at = 0.0, -1
        for c, members in enumerate(clusters):
            if any(k in m for m in members for k in u):
                mean = sum(sum(x * m.get(k, 0.0) for k, x in u.items()) for m in members) / len(members)
                if mean > best + 1e-12:
                    best, at = mean, c
        if at < 0 or best < theta:
            at = len(clusters)
            clusters.append([])
        clusters[at].append(u)
        out.append(at)
    return out


def made(n, seed):
    rng = random.Random(seed)
    return [{f"t{rng.randrange(12)}": round(rng.uniform(0.1, 1), 3) for _ in range(4)} for _ in range(n)]


def test_single_pass_equals_the_naive_clustering():
    for theta in (0.1, 0.5):
        state, vs = V.SinglePass(theta), made(150, 1)
        assert [state.add(v) for v in vs] == naive(vs, theta)


def test_single_pass_in_blocks_and_as_a_stream(spark, tmp_path):
    vs = made(60, 2)
    rows = [(i, f"b{i % 2}", i // 20, v) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id long, block string, t int, terms map<string,double>")
    batch = {r.id: (r.block, r.cluster) for r in V.single_pass(df, "id", "t", 0.3, "block").collect()}
    for b in ("b0", "b1"):
        mine = [i for i, x in enumerate(rows) if x[1] == b]
        assert [batch[i][1] for i in mine] == naive([vs[i] for i in mine], 0.3)
    for t in range(3):
        df.where(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = I.cluster_stream(stream, "id", "t", 0.3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.id: (r.block, r.cluster) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch


def test_term_weights_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    spark.createDataFrame([(i, f"common w{i} x{i // 2}") for i in range(50)], "id long, text string").write.parquet(str(tmp_path / "docs"))
    w = V.tfidf(V.document_terms(spark.read.parquet(str(tmp_path / "docs")), "id", "text"), "id")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert w.count() == 100


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "ab"[i % 2], float(i)) for i in range(60)] + [(99, None, 1, "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd HH:mm:ss")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = I.event_counts(stream, late="10 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in I.event_counts(df).collect()}
    assert I.sessions(df, "1 hour").count() > 0


def test_events_of_clusters(spark):
    c = spark.createDataFrame([("b", "x", 0), ("b", "y", 0), ("b", "z", 12345678901 % 10**9)], "block string, id string, cluster long")
    t = spark.createDataFrame([("x", "2021-02-02 00:00:00"), ("y", "2021-02-01 00:00:00"), ("z", None)], "id string, time string").withColumn("time", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss")))
    e = V.cluster_events(c, t, "id")
    assert {tuple(r) for r in V.event_lists(e).collect()} == {("2021-02-010000000000", "y,x"), ("0000-00-00" + str(12345678901 % 10**9).zfill(10), "z")}
    assert V.article_events(e).count() == 3


def test_times_of_articles_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    rows = [(f"a{i}", f"2021-02-{1 + i % 28:02d} 00:00:00") for i in range(100)]
    spark.createDataFrame(rows, "id string, time string").withColumn("time", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd HH:mm:ss"))).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    e = V.cluster_events(t.select(F.lit("b").alias("block"), "id", F.lit(0).alias("cluster")), t, "id")
    assert "BroadcastHashJoin" not in V.article_events(e)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in V.event_lists(e)._jdf.queryExecution().executedPlan().toString()
    assert V.article_events(e).count() == 100


def test_events_of_articles_send_no_side_of_a_join_to_the_driver(spark, tmp_path):
    text, other = "甲乙丙丁", "戊己庚辛"
    rows = [("a", "2021-02-01 10:00:00", text), ("b", "2021/02/01 09:00", text), ("c", "2021-02-01 11:00:00", other), ("d", "2021-02-02 08:00:00", text), ("e", None, text), ("f", "2021-02-02 09:00:00", None)]
    spark.createDataFrame(rows, "id string, time string, content string").write.parquet(str(tmp_path / "articles.parquet"))
    e = event_queries.cluster_events(spark, str(tmp_path))
    planned = e._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in e.collect()} == {("2021-02-010000000000", "b,a"), ("2021-02-010000000001", "c"), ("2021-02-020000000000", "d")}
    for plan in (planned, e._jdf.queryExecution().executedPlan().toString()):  # also as adapted while it ran
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3


def test_joins_of_events_of_articles_do_not_depend_on_the_broadcast_threshold(spark, tmp_path):
    rows = [(f"a{i}", f"2021-02-0{1 + i % 3} 10:00:{i:02d}", "甲乙丙丁" if i % 2 else "戊己庚辛") for i in range(30)]
    spark.createDataFrame(rows, "id string, time string, content string").write.parquet(str(tmp_path / "articles.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")  # any estimate is below it
    try:
        e = event_queries.cluster_events(spark, str(tmp_path))
        planned = e._jdf.queryExecution().executedPlan().toString()
        members = [a for r in e.collect() for a in r.aid.split(",")]
        adapted = e._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(members) == sorted(r[0] for r in rows)
    assert "BroadcastHashJoin" not in planned + adapted


def test_choice_of_sentences():
    rows = [(0, "A", list("abcdefgh"), 3.0), (1, "B", list("abcdefgz"), 2.0), (2, "C", list("xaby"), 1.0), (3, "D", list("qrs"), 0.5), (4, "E", list("ybc"), 0.4)]
    assert S.choose(rows) == ["A", "C", "E"]
    assert S.choose([]) == []


def test_summaries_and_upsert(spark):
    rows = [("e", i, s, list(w), x) for i, s, w, x in ((0, "A", "abcdefgh", 3.0), (1, "C", "xaby", 1.0))]
    df = spark.createDataFrame(rows, "event_id string, pos int, sentence string, words array<string>, score double")
    assert S.summaries(df).first().abstract == "AC" and S.best_sentence(df).first().abstract == "A"
    old = spark.createDataFrame([("a", "x", ""), ("b", "y", "n"), ("c", "z", None)], "eid string, abstract string, name string")
    new = spark.createDataFrame([(k, "new", "n") for k in "abcd"], old.schema)
    assert {(r.eid, r.abstract) for r in S.upsert_summaries(old, new).collect()} == {("a", "new"), ("b", "y"), ("c", "new"), ("d", "new")}


def test_traits(spark):
    df = spark.createDataFrame([(1, "中文中文"), (2, "abc"), (3, None)], "id int, text string")
    c = traits.lexicon_counts(df, {"k": ["中"], "w": ["文*"]})
    assert [(r.words, r.k, r.w) for r in c.where("id = 1").collect()] == [(4, 2, 2)]
    assert {(r.id, r.feature) for r in traits.trait_features(c, {"k": 0.5, "w": 0.1}).collect()} == {(1, "k-"), (1, "w+")}
    h = traits.attention_layer(np.eye(3), np.eye(3), np.ones((2, 3, 2)), np.ones((2, 2)), np.ones((2, 2)))
    assert h.shape == (2, 3, 2) and np.allclose(h, 1)


def test_nearest_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None)], "id long, v array<double>")
    got = {(r.query, r.rank): r.id for r in V.nearest(df, df.where("id % 20 = 0 and id < 60"), "id", "v", 3, block=2).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [i for i in np.argsort(-(u @ u[q])) if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order
