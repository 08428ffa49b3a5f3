import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import near_duplicates as nd
from newsloom.llm import splits
from newsloom.llm.components import connected_components


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(450, 450), (1, 0)]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    want = {k: v for k, v in roots(500, edges).items() if any(k in e for e in edges)}
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_splits(spark):
    rows = [(1, "Tok a", "F1", 1), (2, " tok A ", "f2", 0), (3, "x", " F2", 0), (4, None, None, None), (5, "", "", 1), (6, "y", None, 1), (7, "y", "z", 0), (7, "y", "z", 0)]
    df = spark.createDataFrame(rows, "sample_id long, token string, form string, tag int")
    got = {r.sample_id: r.group_form for r in splits.record_groups(df).collect()}
    assert got == {1: "f1", 2: "f1", 3: "f1", 4: None, 5: None, 6: "z", 7: "z"}
    many = [(i, f"t{i // 3}", "hot" if i % 3 == 0 and i < 900 else f"f{i // 6}", int(i % 4 == 0)) for i in range(3000)]
    s = splits.split_records(spark.createDataFrame(many, df.schema)).collect()
    assert len(s) == 3000
    for key in (1, 2):
        where = {}
        for r in s:
            where.setdefault(many[r.sample_id][key], set()).add(r.split)
        assert all(len(v) == 1 for v in where.values())
    train = sum(r.split == "train" for r in s) / 3000
    assert 0.74 < train < 0.86
    assert splits.split_records(df.limit(0)).count() == 0
    fixed = lambda n: {r.sample_id: r.split for r in splits.split_records(spark.createDataFrame(many[:n], df.schema), seed=3).collect()}
    some, more = fixed(1500), fixed(3000)
    assert sum(some[k] != more[k] for k in some) < 20  # only groups that grew together change


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(300)) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        for j in range(8):
            t = list(b)
            for _ in range(j * 4):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((f"{i:02d}{j}", "".join(t)))
    rows += [("hot" + str(i), base[0]) for i in range(60)] + [("s1", "ab"), ("s2", "A b"), ("n", None), ("e", ""), (None, "ab"), ("b", "\\n \n"), ("s1", "ab")]
    sets = {k: set(nd.pieces(nd.squeezed(v)).tolist()) for k, v in rows if k and nd.squeezed(v)}
    keys = sorted(sets)
    edges = [(x, y) for x in range(len(keys)) for y in range(x) if len(sets[keys[x]] & sets[keys[y]]) >= 0.6 * len(sets[keys[x]] | sets[keys[y]])]
    root = roots(len(keys), edges)
    want = {(keys[a], keys[b]) for a in range(len(keys)) for b in range(a + 1, len(keys)) if root[a] == root[b]}
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "key string, value string, token int")
    assert {(r.id_a, r.id_b) for r in nd.grouped_pairs(df).collect()} == want and ("s1", "s2") in want
    kept, nd.BROADCAST_TOKENS = nd.BROADCAST_TOKENS, 0
    try:
        assert {(r.id_a, r.id_b) for r in nd.grouped_pairs(df).collect()} == want
    finally:
        nd.BROADCAST_TOKENS = kept
    assert nd.grouped_pairs(df.limit(0)).count() == 0
    assert len(nd.combination_keys(np.array([5], np.int64), 5, 100)) == 100


def test_groups_of_texts_with_a_common_boilerplate(spark):
    rng = random.Random(8)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n))
    common = word(76)
    rows = []
    for i in range(150):
        shared = word(7)
        rows += [(f"{i:03d}{j}", shared + common + word(22), 1) for j in (0, 1)]
        rows += [(f"{i:03d}s", common + word(30), 1)]
    sets = {k: set(nd.pieces(nd.squeezed(v)).tolist()) for k, v, _ in rows}
    keys = sorted(sets)
    edges = [(x, y) for x in range(len(keys)) for y in range(x) if len(sets[keys[x]] & sets[keys[y]]) >= 0.6 * len(sets[keys[x]] | sets[keys[y]])]
    root = roots(len(keys), edges)
    want = {(keys[a], keys[b]) for a in range(len(keys)) for b in range(a + 1, len(keys)) if root[a] == root[b]}
    df = spark.createDataFrame(rows, "key string, value string, token int")
    assert {(r.id_a, r.id_b) for r in nd.grouped_pairs(df).collect()} == want and len(want) == 150


def test_pairs_just_similar_enough_beside_a_common_block(spark):
    rng = random.Random(5)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(n))
    common, rows = word(70), []
    for i in range(200):
        own, k = word(80), rng.randrange(3)
        lost = 46 + k  # 5-character pieces that only one of the two holds, each
        rows += [(f"{i:03d}a", common + own + word(lost), 1), (f"{i:03d}b", common + own + word(lost), 1)]
    sets = {k: set(nd.pieces(nd.squeezed(v)).tolist()) for k, v, _ in rows}
    keys = sorted(sets)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [share(f"{i:03d}a", f"{i:03d}b") for i in range(200)]
    assert 0.6 <= min(near) and max(near) < 0.62
    edges = [(x, y) for x in range(len(keys)) for y in range(x) if share(keys[x], keys[y]) >= 0.6]
    root = roots(len(keys), edges)
    want = {(keys[a], keys[b]) for a in range(len(keys)) for b in range(a + 1, len(keys)) if root[a] == root[b]}
    df = spark.createDataFrame(rows, "key string, value string, token int")
    assert {(r.id_a, r.id_b) for r in nd.grouped_pairs(df).collect()} == want and len(want) == 200


def test_texts_and_buckets_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    word = lambda i: "".join(chr(0x4E00 + (i * 977 + 31 * j) % 9000) for j in range(40))
    spark.createDataFrame([(str(i), word(i)) for i in range(200)], "key string, value string").write.parquet(str(tmp_path / "rows"))
    texts = nd.distinct_texts(spark.read.parquet(str(tmp_path / "rows")))[1]
    links = texts.select(F.col("text_id").alias("u"), F.col("text_id").alias("v"))
    buckets = nd.combination_buckets(texts, nd._divided(texts, nd.frequent_tokens(texts, 0))[1], 0.6)
    for made in (nd.similar_links(texts, links), nd.shared_buckets(buckets)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert nd.similar_links(texts, links).count() == 200


def test_frequent_tokens_come_packed(spark):
    tokens = spark.range(-500, 500).selectExpr("id as token").repartition(3)
    assert sorted(nd._packed(tokens)) == list(range(-500, 500)) and len(nd._packed(tokens.limit(0))) == 0
