"""Queries over built-in scorers, text preparation and whole chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import retrieval, scoring as C, vectors as V
from newsloom.plans import pipelines
from newsloom.plans.entity_queries import _spans_sql
from newsloom.plans.event_queries import _sentences, _themes
from newsloom.plans.runtime import table


def gazetteer_tags(s: SparkSession, d: str) -> DataFrame:
    """Names of entities found in the stored sentences."""
    e = table(s, d, "entities")
    names = e.select("name", "etype").unionByName(e.select(F.col("name_cht").alias("name"), "etype"))
    return C.GazetteerTagger(names).run(table(s, d, "tag_sequences"))


def candidate_scores(s, d):
    rows = table(s, d, "el_training").select("sample_id", "token", "exrest")
    return C.OverlapScorer().run(rows).select("sample_id", F.round("score", 6).alias("score"))


def sentence_scores(s, d):
    return C.CentroidScorer().run(_sentences(s, d)).select("event_id", "pos", F.round("score", 5).alias("score"))


def title_and_sentences(s, d):
    """Title and body sentences of each article, counted."""
    a = table(s, d, "articles").where("content is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), "content")).alias("x"))
    p = C.sentences_of("x.title", "x.content")
    return a.select("id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


def article_words(s, d):
    a = table(s, d, "articles").where("title is not null").select("id", F.explode(C.words_of("title")).alias("word"))
    return a.groupBy("word").agg(F.count("*").alias("n"))


def content_words(s, d):
    """Words with the part of speech of their tag: entity words count as content, others as particles."""
    t = table(s, d, "tag_sequences").where("sentence is not null and tags is not null").groupBy("aid", "sidx").agg(F.min(F.struct("sentence", "tags")).alias("x"))
    w = F.zip_with(F.split("x.sentence", ""), "x.tags", lambda c, g: F.struct(c.alias("word"), F.when(g > 0, "n").otherwise("u").alias("pos")))
    return t.select("aid", "sidx", F.size(C.content_words(w)).alias("n"))


def stop_words(s, d):
    """Tokens of documents without the two hundred most frequent ones."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", T.tokens("text").alias("words"))
    stops = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(200)
    return C.without_stop_words(docs, "doc_id", "words", stops).select("doc_id", F.size("words").alias("n"))


def cluster_candidates(s, d):
    """Themes that share a keyword with each article."""
    a = table(s, d, "articles").select("id", "theme", F.explode("keywords").alias("term")).where("theme is not null")
    return C.cluster_candidates(a.select("term", F.col("theme").alias("cluster")), a.select("id", "term").distinct(), "id").select("id", F.array_join("clusters", ",").alias("clusters"))


def arrival_order(s, d):
    return C.arrival_order(table(s, d, "articles").select("source", T.normal_time("time").alias("time")), "source", "time")


def old_types(s, d):
    old = F.when(F.col("etype") == "PER", "人物").when(F.col("etype") == "ORG", "组织").when(F.col("etype") == "LOC", "地名").otherwise("x")
    return table(s, d, "entities").select("eid", C.new_type(old).alias("etype")).distinct()


def json_props(s, d):
    """Counts by the parsed property of events; unreadable JSON gives null."""
    k = F.from_json("props", "k int")["k"]
    return table(s, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min(F.to_json(F.struct(k.alias("k")))).alias("json"))


def group_volume(s, d):
    """Events of a theme and day by the number of their articles, the ten largest."""
    return _themes(s, d).groupBy("event_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_id").limit(10)


def theme_similarity(s, d):
    """Mean cosine of each vector to each of the other labels' members is left to mean_similarity; here the labels' own cohesion."""
    g = V.mean_similarity_to_groups(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    return g.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("cohesion"))


def graph_linked(s, d):
    """Spans of the tag sequences with their linked entities."""
    return pipelines.linked_mentions(table(s, d, "tag_sequences"), table(s, d, "aliases")).select("aid", "sidx", "eidx", "form", "wikiID")


def graph_edges(s, d):
    return pipelines.knowledge_graph(table(s, d, "tag_sequences"), table(s, d, "aliases"))


def event_summaries(s, d):
    sent = _sentences(s, d)
    names = sent.where("pos = 0").select("event_id", F.col("sentence").alias("name"))
    return pipelines.event_summaries(names, sent)


def latest_pages(s, d):
    """The last fetch of each page, by host."""
    p = table(s, d, "crawled_pages").select("page_id", "url", "fetched_at").distinct()
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return retrieval.top_by(p, ["page_id"], [F.desc("fetched_at"), F.col("url")], 1).groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.max("fetched_at").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        gazetteer_tags, candidate_scores, sentence_scores, title_and_sentences, article_words, content_words, stop_words, cluster_candidates, arrival_order, old_types,
        json_props, group_volume, theme_similarity, graph_linked, graph_edges, event_summaries, latest_pages,
    )
}

_TOKENS = r"(select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as words from documents where text is not null)"

# Spans that can be names, and with the best candidate of their form by the overlap of sentence and description.
_NAMED = f"""m as (select aid, sidx, eidx, form, type, start from ({_spans_sql("true")})), one as (select aid, substr(form, 1, 1) as form, min((sidx, start, eidx)) as first from m where length(form) >= 3 group by 1, 2),
    names as (select m.* from m left join one using (aid, form) where length(form) >= 3 or (length(form) = 2 and not regexp_matches(form, '^[A-Za-z]+$') and substr(form, 2, 1) not in ('姓', '男', '女', '某', '嫌', '犯'))
    or (length(form) = 1 and one.first < (m.sidx, m.start, m.eidx)))"""
_SET = "list_distinct(list_filter(string_split(coalesce({}, ''), ''), lambda x: x <> ''))"
_LINKED = f"""with {_NAMED}, a as (select distinct form, seq, eid, formal, exrest from aliases where form is not null and eid <> ''),
    t as (select aid, sidx, min(sentence) as token from tag_sequences group by aid, sidx),
    c as (select n.aid, n.sidx, n.eidx, n.form, a.seq, a.eid, {_SET.format("token")} as x, {_SET.format("exrest")} as y from names n join a using (form) join t using (aid, sidx)),
    s as (select *, case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / sqrt(len(x)::double * len(y)) else 0.0 end as score from c),
    b as (select aid, sidx, eidx, form, arg_max(eid, (score, -seq, eid)) as eid, max(score) as score, count(*) as n from s group by all),
    l as (select n.aid, n.sidx, n.eidx, n.form, b.eid as wikiID from names n left join (select * from b where n = 1 or score > 0) b using (aid, sidx, eidx, form))"""

SQL = {
    "graph_linked": f"{_LINKED} select * from l",
    "graph_edges": f"""{_LINKED}, d as (select distinct aid, sidx, eidx, form, wikiID from l where wikiID is not null)
        select distinct a.wikiID as src, 'with' as rel, b.wikiID as dst from d a join d b on a.aid = b.aid and a.sidx = b.sidx and (a.eidx, a.form, a.wikiID) < (b.eidx, b.form, b.wikiID) where a.wikiID <> b.wikiID""",
    "candidate_scores": """with t as (select sample_id, list_distinct(list_filter(string_split(coalesce(token, ''), ''), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(coalesce(exrest, ''), ''), lambda x: x <> '')) as b from el_training)
        select sample_id, round(case when len(a) > 0 and len(b) > 0 then len(list_intersect(a, b)) / sqrt(len(a)::double * len(b)) else 0.0 end, 6) as score from t""",
    "sentence_scores": r"""with s as (select aid as event_id, sidx as pos, list_filter(regexp_split_to_array(sentence, '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from
        (select aid, sidx, min(sentence) as sentence from tag_sequences where sentence is not null group by aid, sidx)),
        t as (select event_id, pos, unnest(list_distinct(words)) as term from s), n as (select event_id, count(distinct pos) as n from t group by event_id),
        w as (select event_id, term, ln(1 + n / df) as w, df from (select event_id, term, count(*) as df from t group by all) join n using (event_id)),
        c as (select event_id, sqrt(sum(w * df * w * df)) as c from w group by event_id),
        e as (select event_id, pos, sum(w * w * df) as d, sqrt(sum(w * w)) as s from t join w using (event_id, term) group by event_id, pos)
        select event_id, pos, round(coalesce(d / (e.s * c), 0) + case when pos = 0 then 0.1::double else 0.0 end, 5) as score from s left join e using (event_id, pos) left join c using (event_id)""",
    "title_and_sentences": r"""with a as (select id, min((coalesce(title, ''), content)) as x from articles where content is not null group by id),
        p as (select id, list_prepend(x[1], list_filter(list_transform(string_split(regexp_replace(regexp_replace(x[2], '\\n|\n', '␞', 'g'), '([。！？!?]+[」』”’）)]*)', '\1␞', 'g'), '␞'), lambda y: regexp_replace(y, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda y: y <> '')) as p from a)
        select id, len(p)::int as n, md5(array_to_string(p, '|')) as digest from p""",
    "article_words": r"""with t as (select id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) as t from articles where title is not null),
        r as (select id, unnest(regexp_extract_all(t, '\p{Han}+|\P{Han}+')) as r from t),
        w as (select unnest(case when length(r) >= 2 and regexp_full_match(r, '\p{Han}+') then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [r] end) as word from r)
        select word, count(*) as n from w group by word""",
    "content_words": """with x as (select aid, sidx, unnest(min((sentence, tags))) from tag_sequences where sentence is not null and tags is not null group by aid, sidx),
        y as (select * from x y(aid, sidx, sentence, tags)), c as (select aid, sidx, tags, unnest(string_split(sentence, '')) as w, generate_subscripts(string_split(sentence, ''), 1) as i from y),
        l as (select aid, sidx, w, list(tags[i] order by i)[-1] as g from c group by aid, sidx, w), n as (select aid, sidx, count(*)::int as n from l where g > 0 and w <> ' ' group by aid, sidx)
        select y.aid, y.sidx, coalesce(n.n, 0)::int as n from y left join n on y.aid = n.aid and y.sidx = n.sidx""",
    "stop_words": f"""with t as {_TOKENS}, s as (select list(word) as s from (select word from (select unnest(words) as word from t) group by word order by count(*) desc, word limit 200))
        select doc_id, len(list_filter(words, lambda w: not list_contains(s, w)))::int as n from t, s""",
    "cluster_candidates": """with a as (select id, theme, unnest(keywords) as term from articles where theme is not null)
        select id, string_agg(distinct c, ',' order by c) as clusters from (select distinct a.id, b.theme as c from a join (select distinct term, theme from a) b on a.term = b.term) group by id""",
    "arrival_order": r"""select source, first, (dense_rank() over (order by first, source) - 1)::int as ordinal from (select source, min(case when regexp_matches(time, '^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$')
        then replace(time, '/', '-') || ':00' when regexp_matches(time, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$') then time end) as first from articles where source is not null group by source) where first is not null""",
    "old_types": "select distinct eid, case when etype in ('PER', 'ORG', 'LOC') then etype end as etype from entities",
    "json_props": """select k, count(*) as n, min('{"k":' || k || '}') as json from (select (props::json ->> 'k')::int as k from events) group by k""",
    "group_volume": r"""select event_id, count(*) as n from (select distinct concat_ws('/', theme, substr(case when time like '____/%' then replace(time, '/', '-') else time end, 1, 10)) as event_id, id
        from articles where theme is not null) group by event_id order by n desc, event_id limit 10""",
    "theme_similarity": """with u as (select label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings)
        select a.label, count(distinct a.rowid) as n, round(avg(list_dot_product(a.u, b.u)), 5) as cohesion from (select *, row_number() over () as rowid from u) a join u b on a.label = b.label group by a.label""",
    "latest_pages": r"""with p as (select page_id, url, fetched_at, row_number() over (partition by page_id order by fetched_at desc nulls last, url) as k from (select distinct page_id, url, fetched_at from crawled_pages))
        select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, count(*) as n, max(fetched_at) as last from p where k = 1 group by 1""",
}
