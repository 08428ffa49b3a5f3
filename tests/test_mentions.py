import random

from newsloom.functions.text import TAGS
from newsloom.operators import mentions as M
from newsloom.operators import relations as R

SCHEMA = "aid string, sidx int, sentence string, tags array<int>"


def brute_spans(tags, flush):
    out, start, kind = [], 0, "O"
    for i, t in enumerate([*tags, None]):
        now = "END" if t is None else TAGS[t].split("-")[-1]
        if now != kind:
            if kind != "O" and (now != "END" or flush):
                out.append((start, i, kind))
            start, kind = i, now
    return out


def test_spans_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"a{i}", 0, "x" * n, [rng.choice([0, 0, 0, 1, 2, 2, 3, 4, 10]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 5, 30, 200] * 8)]
    df = spark.createDataFrame(rows + rows[:5] + [("n", 1, None, None)], SCHEMA)
    for flush in (True, False):
        want = {(a, s, e, k) for a, _, _, tags in rows for s, e, k in brute_spans(tags, flush)}
        for f in (M.spans, M.spans_by_windows):
            got = f(df, flush).collect()
            assert {(r.aid, r.start, r.end, r.type) for r in got} == want
            assert len(got) == len(want)


def test_name_like_and_full_forms(spark):
    rows = [("a", 0, 0, "王小明", "PER", 0), ("a", 0, 1, "王", "PER", 5), ("a", 0, 2, "李", "PER", 7), ("a", 1, 0, "ab", "PER", 0), ("a", 1, 1, "張某", "PER", 3), ("a", 1, 2, "小明", "PER", 6), ("b", 0, 0, None, "PER", 0)]
    df = spark.createDataFrame(rows, "aid string, sidx int, eidx int, form string, type string, start int")
    assert {r.form for r in M.name_like(df).collect()} == {"王小明", "王", "小明"}
    full = M.earlier_full_form(df).collect()
    assert {(r.form, r.full) for r in full} == {("王", "王小明"), ("小明", "王小明")}


def test_pairs_links_and_negatives(spark):
    m = spark.createDataFrame([("a", 0, 0, "x", "Q1"), ("a", 0, 1, "y", "Q2"), ("a", 0, 2, "z", None), ("a", 0, 3, "w", "Q3"), ("a", 0, 0, "x", "Q1")], "aid string, sidx int, eidx int, form string, wikiID string")
    p = M.entity_pairs(m)
    assert {(r.i, r.j) for r in p.collect()} == {(0, 1), (0, 3), (1, 3)}
    e = spark.createDataFrame([("Q2", "Q1")], "src string, dst string")
    assert {(r.eid1, r.eid2) for r in M.negative_pairs(p, e).collect()} == {("Q1", "Q3"), ("Q2", "Q3")}
    a = spark.createDataFrame([("x", 0, "Q1", "X", None), ("x", 0, "Q1", "X", None), ("y", 0, "", None, None)], "form string, seq int, eid string, formal string, exrest string")
    assert M.linked_by_alias(m.select("aid", "sidx", "eidx", "form").distinct(), a).count() == 4
    assert {r.eidx for r in M.unlinked(m, a).collect()} == {1, 2, 3}
    assert M.entity_pairs(m.limit(0)).count() == 0


def test_best_candidates_are_strictly_above_and_capped(spark):
    rows = [("a", i, 0.4) for i in range(10)] + [("a", 10, 0.9), ("b", 0, 0.5), ("c", 0, 0.6), ("c", 1, 0.6)]
    df = spark.createDataFrame(rows, "form string, pos int, score double")
    assert {(r.form, r.pos) for r in M.best_candidates(df, ["form"]).collect()} == {("c", 0)}


def brute_windows(n, query):
    room, out, at = max(1, R.LONGEST - query - 3), [], 0
    while at < n:
        length = min(room, n - at)
        out.append((at, length))
        if at + length == n:
            break
        at += min(length, R.STRIDE)
    return out


def test_windows_and_owners(spark):
    sizes = [0, 1, 316, 317, 318, 445, 446, 1000, 5000]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int")
    w = R.token_windows(df, 64)
    got = {}
    for r in w.collect():
        got.setdefault(r.id, []).append((r.start, r.length))
    assert {i: sorted(v) for i, v in got.items()} == {i: brute_windows(n, 64) for i, n in enumerate(sizes) if n}
    for r in R.position_owners(w.where("id = 7")).collect():
        best = max(enumerate(brute_windows(1000, 64)), key=lambda x: (min(r.pos - x[1][0], x[1][0] + x[1][1] - 1 - r.pos) + 0.01 * x[1][1], -x[0]) if x[1][0] <= r.pos < sum(x[1]) else (-1, 0))
        assert r.span == best[0]


def test_answers_equal_a_plain_decoding(spark):
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(12)], [round(rng.uniform(-1, 1), 3) for _ in range(12)]) for i in range(20)]
    s = spark.createDataFrame([(i, a) for i, a, _ in rows], "id int, values array<double>")
    e = spark.createDataFrame([(i, b) for i, _, b in rows], "id int, values array<double>")
    spans = R.answer_spans(R.best_positions(s, 4), R.best_positions(e, 4), 5)
    texts = spans.selectExpr("id", "start", "end", "concat(start, '-', end) as text")
    best = {r.id: r.text for r in R.n_best(spans, texts, 3).where("rank = 1").collect()}
    for i, a, b in rows:
        top = lambda v: sorted(range(12), key=lambda k: (-v[k], k))[:4]
        found = [(a[x] + b[y], -x, -y) for x in top(a) for y in top(b) if 0 <= y - x < 5]
        if found:
            _, x, y = max(found)
            assert best[i] == f"{-x}-{-y}"
        else:
            assert i not in best
    nulls = spark.createDataFrame([(i, 5.0) for i in range(20)], "id int, null_score double")
    assert {r.text for r in R.decide(R.n_best(spans, texts), nulls).collect()} == {""}


def test_accuracy_of_tags_without_a_broadcast(spark, tmp_path):
    gold = [("a", 0, "", [0, 1, 2, 0]), ("a", 1, "", [3, None]), ("b", 0, "", []), ("c", 0, "", None), ("d", 0, "", [0]), (None, 0, "", [0])]
    guess = [("a", 0, "", [0, 2, 2]), ("a", 1, "", [3, 4, 4]), ("b", 0, "", [1]), ("c", 0, "", [1]), ("e", 0, "", [0]), ("a", 0, "", [1])]
    for name, rows in (("g", gold), ("p", guess)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name))
    g, p = (spark.read.parquet(str(tmp_path / name)) for name in "gp")
    made = M.tag_accuracy(g, p, ["aid", "sidx"])
    assert tuple(made.first()) == (6, 0.6, 0.4)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert tuple(M.tag_accuracy(g.limit(0), p, ["aid", "sidx"]).first()) == (0, None, None)
