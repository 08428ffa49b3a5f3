from pyspark.sql import functions as F

from newsloom.operators import scoring as C
from newsloom.plans import pipelines


def test_gazetteer_takes_the_leftmost_longest(spark):
    names = spark.createDataFrame([("ab", "PER"), ("abcd", "ORG"), ("cd", "LOC"), ("x", "PER"), (None, "PER"), ("de", "LOC")], "name string, etype string")
    rows = spark.createDataFrame([("a", 0, "zabcde cd x"), ("a", 1, None), ("a", 2, ""), ("a", 0, "zabcde cd x")], "aid string, sidx int, sentence string")
    want = {("a", 0, 1, 5, "abcd", "ORG"), ("a", 0, 7, 9, "cd", "LOC")}
    for block in (2, 500_000):
        assert {tuple(r) for r in C.GazetteerTagger(names, block).run(rows).collect()} == want
    assert C.GazetteerTagger(names.limit(0)).run(rows).count() == 0


def test_words_and_sentences(spark):
    df = spark.createDataFrame([("T", "一。二！」三\\n four\n"), (None, None)], "t string, b string")
    assert [r.s for r in df.select(C.sentences_of("t", "b").alias("s")).collect()] == [["T", "一。", "二！」", "三", "four"], [""]]
    assert df.select(C.words_of(F.lit("中文字 Ab_1 我x")).alias("w")).first().w == ["中文", "文字", "ab_1", "我", "x"]
    w = spark.createDataFrame([([("a", "n"), ("b", "u"), ("a", "u"), ("c", "v")],), ([],)], "w array<struct<word:string,pos:string>>")
    assert [r.x for r in w.select(C.content_words("w").alias("x")).collect()] == [["c"], []]
    d = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, ["y"])], "id int, words array<string>")
    stop = spark.createDataFrame([("y",), ("y",)], "word string")
    assert {r.id: r.words for r in C.without_stop_words(d, "id", "words", stop).collect()} == {1: ["x", "x"], 2: [], 3: []}


def test_scorers(spark):
    t = spark.createDataFrame([(1, "abc", "abd"), (2, None, "x"), (3, "", "")], "id int, token string, exrest string")
    got = {r.id: round(r.score, 4) for r in C.OverlapScorer().run(t).collect()}
    assert got == {1: 0.6667, 2: 0.0, 3: 0.0}
    s = spark.createDataFrame([("e", 0, ["a", "b"]), ("e", 1, ["a", "b"]), ("e", 2, ["z"]), ("e", 3, [])], "event_id string, pos int, words array<string>")
    c = {r.pos: r.score for r in C.CentroidScorer(0.0).run(s).collect()}
    assert c[0] == c[1] > c[2] > c[3] == 0.0


def test_arrival_types_and_candidates(spark):
    rows = spark.createDataFrame([("b", "2"), ("a", "2"), ("b", "1"), (None, "0"), ("c", None)], "g string, t string")
    assert {r.g: r.ordinal for r in C.arrival_order(rows, "g", "t").collect()} == {"b": 0, "a": 1}
    assert rows.select(C.new_type(F.lit("人物")).alias("t")).first().t == "PER"
    p = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "term string, cluster int")
    q = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "z")], "id string, term string")
    assert [tuple(r) for r in C.cluster_candidates(p, q, "id").collect()] == [("d", [1, 2])]


def test_chain_from_tags_to_edges(spark):
    seq = spark.createDataFrame([("a", 1, "王小明見李大同", [1, 2, 2, 0, 1, 2, 2]), ("a", 2, "空", [0])], "aid string, sidx int, sentence string, tags array<int>")
    ali = spark.createDataFrame([("王小明", 0, "Q1", "王小明", None), ("李大同", 0, "Q2", "李大同", "見過王"), ("李大同", 1, "Q3", "李大同", "無關")], "form string, seq int, eid string, formal string, exrest string")
    assert {(r.form, r.wikiID) for r in pipelines.linked_mentions(seq, ali).collect()} == {("王小明", "Q1"), ("李大同", "Q2")}
    assert [tuple(r) for r in pipelines.knowledge_graph(seq, ali).collect()] == [("Q1", "with", "Q2")]
    assert pipelines.knowledge_graph(seq.limit(0), ali).count() == 0
