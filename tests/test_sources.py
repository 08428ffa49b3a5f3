import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from newsloom.sources import articles as A
from newsloom.sources import pages as P
from newsloom.sources import sinks

ROOT = Path(__file__).resolve().parent.parent


def test_article_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    new = "id:\ti1\nurl:\tu\ntime:\t2020-01-01 00:00:00\ntitle:\tT\ntheme:\tth\nkeywords:\ta\tb\ncontent:\tone\\ntwo\nmore\nsource:\tS\n"
    (tmp_path / "x/a.html").write_text(new)
    (tmp_path / "x/b.html").write_text("id:\ti2\nurl:\tu\n\ntime:\tt\ntitle:\tT\ntheme:\tth\ncontent:\told\n")
    (tmp_path / "x/c.html").write_text("nothing")
    (tmp_path / "x/d.txt").write_text("skipped")
    files = A.text_files(spark, str(tmp_path))
    got = {r.id: r for r in A.parse_articles(files).collect()}
    assert got["i1"].content == "one\\ntwo\nmore" and got["i1"].source == "S" and got["i1"].keywords == ["a", "b"] and not got["i1"].corrupt
    assert got[None].corrupt and got["i2"].content == "old"
    old = {r.id: r for r in A.parse_articles(files, legacy=True).collect()}
    assert old["i1"].content == "one\\ntwo\nmore\nsource:\tS" and old["i2"].content == "old" and old["i2"].keywords == []
    assert A.text_files(spark, str(tmp_path), first=1).count() == 1


def test_articles_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("i", "u", "2020-01-05 00:00:00", "t", "x", ["k"], "c", "s"), ("j", "u", None, "t", None, None, "c", None)], A.ARTICLE)
    A.write_articles(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("ym = '2020-01'").first().id == "i" and back.count() == 2


def test_annotations(spark):
    lines = ["#Text=王小明來了", "1-1\t0-1\t王\t*[1]\tPER[1]", "1-2\t1-3\t小明\t*\tPER", "1-3\t3-5\t來了\t_\t_", "#Text=李四", "2-1\t0-2\t李四\tQ2|Q3\tPER|LOC"]
    lines[1] = "1-1\t0-1\t王\tQ1\tPER"
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "path string, number int, value string")
    got = {tuple(r) for r in A.annotated_mentions(A.annotations(df)).select("sid", "identity", "type", "start", "end", "form").collect()}
    assert got == {(1, "Q1", "PER", 0, 3, "王小明"), (2, "Q2", "PER", 0, 2, "李四")}


def test_pages(spark):
    html = "<html><head><title> A  t </title><meta name=keywords content='k1, k2'><script>x<y</script></head><body><p>one<p>two <a href='/2020/03-04/1'>l</a><time datetime='2020/03/04 01:02'></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    parsed = P.parsed_pages(df)
    row = parsed.where("page_id = 1").first()
    assert row.title == "A t" and row.blocks == ["one", "two l"] and row.keywords == ["k1", "k2"]
    arts = {r.page_id: r for r in P.page_articles(parsed).collect()}
    assert arts[1].content == "one\\ntwo l" and arts[1].time == "2020-03-04 01:02:00" and arts[2].corrupt and arts[3].corrupt
    assert P.links_of_day(parsed, "2021-03-04").first().href == "/2020/03-04/1"


def test_records_posts_and_sets(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["http1", "a", "b", "http2", "c"])], "path string, number int, value string")
    assert [len(r.lines) for r in A.records(df, 2).orderBy("record").collect()] == [3, 2]
    p = spark.createDataFrame([("n_7", "f1", 1, "a "), ("n_7", "f1", 2, "b"), ("n_7", "f2", 1, "c")], "folder string, file string, number int, value string")
    assert tuple(P.post_pages(p).first()) == ("7", "n", "ab<sep>c") and P.post_pages(p.limit(0)).count() == 0
    w = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "url string")
    assert [r.url for r in P.still_to_fetch(w, w.where("url = 'a'")).collect()] == ["b"]
    links = spark.createDataFrame([("x", "消歧義", False, ["y", "x", "q"]), ("y", "", False, [])], "title string, description string, ambiguous boolean, links array<string>")
    assert [tuple(r) for r in P.linked_pages(links).collect()] == [("x", "y")]


def test_sinks(spark, tmp_path):
    rows = spark.range(5).withColumn("k", F.col("id") % 3)
    sinks.append_new(rows, str(tmp_path / "t"), "k")
    sinks.append_new(rows, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.json"))) == 3
    t = spark.createDataFrame([("a", 0, 0, "w", "O"), ("a", 0, 1, "v", "B-PER")], "aid string, sidx int, pos int, word string, tag string")
    sinks.write_conll(t, str(tmp_path / "c"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*"))) == "w O\nv B-PER\n\n"


def test_core_stands_without_the_llm_subpackage():
    code = "import sys; sys.modules['newsloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k[0] == 'p' and k[1:2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "k", "at")
    assert t.read() is None
    make = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    t.upsert(make([("a", 1, "x"), ("b", 1, "y")]))
    t.upsert(make([("a", 2, "z"), ("c", 1, None), ("b", 0, "old")]))
    assert {tuple(r) for r in t.read().select("k", "at", "v").collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 1, None)}
    t.batch(make([("a", 9, "again")]), 1)
    assert t.versions() == [0, 1] and t.read().where("v = 'again'").count() == 0
    make([("d", 1, "s")]).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, at int, v string").parquet(str(tmp_path / "in"))
    u = sinks.VersionedTable(spark, str(tmp_path / "u"), "k", "at")
    s.writeStream.foreachBatch(u.batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert u.read().count() == 1
    try:
        u.clear()
        raise AssertionError
    except ValueError:
        u.clear(sure=True)
    assert u.read().count() == 0


def test_lists_tables_and_shards(spark, tmp_path):
    (tmp_path / "words.txt").write_text("a\n b \n\na\n", encoding="utf-8")
    assert {r.word for r in A.word_list(spark, str(tmp_path / "words.txt")).collect()} == {"a", "b"}
    (tmp_path / "numbers.csv").write_text("1, 2.5,x\n-3,,4\n", encoding="utf-8")
    got = {r.row: r["values"] for r in A.number_table(spark, str(tmp_path / "numbers.csv")).collect()}
    assert got == {0: [1.0, 2.5, None], 1: [-3.0, None, 4.0]}
    (tmp_path / "r.json").write_text('{"k": 1}\n', encoding="utf-8")
    assert [r.k for r in A.sharded(spark, str(tmp_path / "r.json")).collect()] == [1]
    for i in range(2):
        (tmp_path / f"r.{i}.json").write_text(f'{{"k": {i + 5}}}\n', encoding="utf-8")
    assert sorted(r.k for r in A.sharded(spark, str(tmp_path / "r.json")).collect()) == [5, 6]


def test_links_of_a_day_are_dates(spark):
    rows = [("s", [(f"/a/{x}", "") for x in ("30101105", "20201105", "2020-11-05/x", "11051", "1105")] + [("/b", "on 11/05")])]
    parsed = spark.createDataFrame(rows, "page_id string, links array<struct<href:string,text:string>>")
    assert {r.href for r in P.links_of_day(parsed, "2020-11-05").collect()} == {"/a/20201105", "/a/2020-11-05/x", "/a/1105", "/b"}


def test_themes_titles_and_items(spark):
    from newsloom.operators import graph, ranking

    t = spark.createDataFrame([("政治", None), ("政治新聞", ["k"]), ("生活", []), (None, None)], "theme string, keywords array<string>")
    assert {r.theme for r in P.known_themes(t, ["政治新聞", "生活"], ["生活"]).collect()} == {"政治", "政治新聞"}
    assert P.known_themes(t, [], []).count() == 0
    assert [r.k for r in t.where("theme is not null").select(P.keywords_or_theme().alias("k")).collect()] == [["政治"], ["k"], ["生活"]]
    assert {r.title for r in P.title_list(spark.createDataFrame([(" a ",), ("a",), ("",), (None,)], "value string")).collect()} == {"a"}
    items = [("Q1", "f", '{"label": "L", "description": "d", "claims": {"P31": ["Q5"], "P856": ["w", "x"]}}'), ("Q2", "f", "{broken"), ("Q3", "f", None), ("Q4", "f", '{"label": "", "claims": {"P31": ["Q43229"]}}')]
    got = {r.eid: (r.name, r.etype, r.summary, r.website) for r in graph.base_items(spark.createDataFrame(items, "eid string, form string, value string")).collect()}
    assert got == {"Q1": ("L", "PER", "d", "w"), "Q2": ("f", None, None, None), "Q3": ("f", None, None, None), "Q4": ("f", "ORG", None, None)}
    rows = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("h", 4, 0)], "g string, n long, tag int")
    assert sorted((r.n, r.tag) for r in ranking.oversampled(rows, ["g"], "n", "tag").collect()) == [(1, 1), (1, 1), (1, 1), (2, 0), (3, 1), (4, 0)]
    assert ranking.sample_rows(rows, 3, 2, rows["tag"] >= 0, key="n").collect() == ranking.sample_rows(rows.repartition(3), 3, 2, rows["tag"] >= 0, key="n").collect()
