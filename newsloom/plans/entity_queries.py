"""Queries over mentions, entities, aliases and tag sequences, and over tables that stand in for graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import graph, mentions as M, ranking, relations as R, retrieval
from newsloom.plans.text_queries import words_sql
from newsloom.plans.runtime import table

# A range of one article's life used as search arguments.
A_PREFIX, A_TYPE = "Q70", "PER"


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mentions").where("form is not null")


def _aliases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "aliases")


def ner_spans(s, d):
    """Spans of the stored tag sequences; a run that reaches the end counts."""
    return M.spans(table(s, d, "tag_sequences"))


def ner_spans_shipped(s, d):
    return M.spans(table(s, d, "tag_sequences"), flush_tail=False)


def ner_spans_windows(s, d):
    return M.spans_by_windows(table(s, d, "tag_sequences"))


def _stored(s, d):
    return table(s, d, "mentions").select("aid", "sidx", "eidx", "form", "type", F.get("idx", F.lit(0)).alias("start"), "wikiID").distinct()


def form_filter(s, d):
    return M.name_like(_stored(s, d)).select("aid", "sidx", "eidx", "form", "start", "type").distinct()


def mention_frequency(s, d):
    return _mentions(s, d).groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("aid").alias("articles"))


def coreference(s, d):
    return M.earlier_full_form(table(s, d, "mentions").select("aid", "sidx", "eidx", "form", "type").distinct())


def alias_link(s, d):
    m = _mentions(s, d).select("aid", "sidx", "eidx", "form").distinct()
    return M.linked_by_alias(m, _aliases(s, d)).select("aid", "sidx", "eidx", "form", "seq", "eid", "formal")


def alias_unlinked(s, d):
    return M.unlinked(_mentions(s, d), _aliases(s, d))


def link_best(s, d):
    """Candidates of a training form scored by the overlap of tokens of sentence and description; the best above the threshold."""
    t = table(s, d, "el_training").where("token is not null and form is not null")
    a, b = F.array_distinct(F.split("token", "")), F.array_distinct(F.split(F.coalesce("exrest", F.lit("")), ""))
    score = F.round(F.size(F.array_intersect(a, b)) / F.size(b), 6)
    rows = t.select("form", "token", "sample_id", "formal", score.alias("score"))
    return M.best_candidates(rows, ["form", "token"], order="sample_id", above=0.3).select("form", "token", "sample_id", "formal", "score")


def article_entity(s, d):
    return M.article_entities(table(s, d, "mentions"))


def tag_accuracy(s, d):
    """Stored tags against those with every B taken for I."""
    rows = table(s, d, "tag_sequences").where("tags is not null").groupBy("aid", "sidx").agg(F.min("tags").alias("tags"))
    return M.tag_accuracy(rows, rows.withColumn("tags", F.transform("tags", lambda t: F.when(t % 2 == 1, t + 1).otherwise(t))), ["aid", "sidx"])


def tag_counts(s, d):
    t = table(s, d, "tag_sequences").select(F.explode("tags").alias("t"))
    return t.groupBy(M.tag_type(F.col("t")).alias("type")).agg(F.count("*").alias("n"))


def word_bio(s, d):
    rows = table(s, d, "tag_sequences").where("sidx > 0 and tags is not null").groupBy("aid", "sidx").agg(F.min("tags").alias("tags"))
    w = rows.select("aid", "sidx", F.posexplode("tags").alias("pos", "t"))
    typed = w.withColumn("type", F.nullif(M.tag_type(F.col("t")), F.lit("O")))
    return M.word_tags(typed).groupBy("tag").agg(F.count("*").alias("n"))


def entity_pairs(s, d):
    return M.entity_pairs(table(s, d, "mentions"))


def relation_triples(s, d):
    """Pairs with the word between their forms as relation, identified by their place."""
    p = M.entity_pairs(table(s, d, "mentions"))
    return R.triples(p.withColumn("relation", F.concat_ws("+", F.substring("form1", 1, 1), F.substring("form2", 1, 1)))).select("aid", "sidx", "i", "j", "relation", "triple_id")


def _part_edges(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("in").alias("rel"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))


def negative_pairs(s, d):
    """Pairs of entities that share no other sentence with the same two in the other order."""
    p = M.entity_pairs(table(s, d, "mentions")).where("eid1 <> eid2")
    edges = p.where("eid1 > eid2").select(F.col("eid1").alias("src"), F.col("eid2").alias("dst"))
    return M.negative_pairs(p, edges).select("aid", "sidx", "i", "j", "eid1", "eid2")


def question_answers(s, d):
    """Questions on pairs with the second form as answer, and its place in the stored sentence."""
    p = M.entity_pairs(table(s, d, "mentions")).select("aid", "sidx", "form1", "form2", "eid1", "eid2").distinct()
    answers = p.groupBy("eid1", "eid2").agg(F.min("form2").alias("answer"))
    q = M.question_answers(p, table(s, d, "tag_sequences").where("sentence is not null"), answers)
    return q.distinct()


def joined_features(s, d):
    """Tag sequences with the mentions of the same sentence."""
    n = table(s, d, "mentions").select("aid", "sidx", "eidx").distinct().groupBy("aid", "sidx").agg(F.count("*").alias("n"))
    return table(s, d, "tag_sequences").select("aid", "sidx").distinct().join(n, ["aid", "sidx"]).select("aid", "sidx", "n")


def token_windows(s, d):
    return R.token_windows(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n")), 64)


def window_owners(s, d):
    """For each token the window with most context, counted per document and window."""
    w = R.token_windows(table(s, d, "articles").select("id", F.length("content").alias("n")).distinct(), 64)
    return R.position_owners(w).groupBy("id", "span").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def best_positions(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return R.best_positions(e, 5).select("id", "pos", "rank")


def answers(s, d):
    """Vectors as logits: their halves as start and end scores, decoded to the best answers."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    half = lambda a: e.select("id", F.transform(F.slice("embedding", a, 32), lambda x: F.round(x.cast("double"), 4)).alias("values"))
    spans = R.answer_spans(R.best_positions(half(1), 5), R.best_positions(half(33), 5))
    best = R.n_best(spans, spans.select("id", "start", "end", F.concat_ws("-", "start", (F.col("end") % 7)).alias("text")), 5)
    nulls = e.select("id", F.lit(0.2).alias("null_score"))
    return R.decide(best, nulls)


def search_exact(s, d):
    return retrieval.by_key(table(s, d, "entities"), "eid", "Q7048174").unionByName(retrieval.by_key(table(s, d, "entities"), "name", "田昀思")).select("eid", "etype", "name")


def search_prefix(s, d):
    return retrieval.by_prefix(table(s, d, "entities"), "eid", A_PREFIX).select("eid", "name")


def search_alias_prefix(s, d):
    return retrieval.by_prefix(_aliases(s, d), "form", "大").select("form", "seq", "eid").distinct()


def search_article(s, d):
    """Articles of the entity that most articles name."""
    links = M.article_entities(table(s, d, "mentions"))
    top = links.groupBy("eid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "eid").limit(1)
    return links.join(F.broadcast(top), "eid").select("aid", "eid")


MATCHED = "the ferry left the harbor near the library 公共圖書館開放"


def search_match(s, d):
    found = retrieval.matching(table(s, d, "documents"), "doc_id", "text", MATCHED)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def search_phrase(s, d):
    return retrieval.with_phrase(table(s, d, "documents"), "text", "名單尚未對外公開").select("doc_id")


def search_by_time(s, d):
    rows = table(s, d, "documents").where("pub_time is not null").select(T.event_id(F.date_format("pub_time", "yyyy-MM-dd"), "doc_id").alias("event_id"), "theme")
    return retrieval.by_time(rows, "event_id", 2020, 11)


def search_time_page(s, d):
    """A page of ten thousand first, then the day; the filter-first form is search_by_time."""
    rows = table(s, d, "documents").select("doc_id", F.date_format("pub_time", "yyyy-MM-dd").alias("day"))
    return retrieval.page_then_filter(rows, "doc_id", F.col("day").startswith("2020-12"))


def search_all_indices(s, d):
    a = table(s, d, "entities").select(F.col("eid").alias("key"), F.col("name").alias("value"))
    b = _aliases(s, d).where("eid <> ''").groupBy(F.col("eid").alias("key")).agg(F.min("form").alias("value"))
    return retrieval.first_index_with([a, b], "key", "Q7048174")


def search_properties(s, d):
    return retrieval.by_properties(table(s, d, "entities"), {"etype": "PER", "party": None}).select("eid", "name")


def search_types(s, d):
    return retrieval.by_types(table(s, d, "entities"), "etype", graph.NODE_TYPES).groupBy("etype").agg(F.count("*").alias("n"))


def index_fallback(s, d):
    """Name of an identifier from entities, else from aliases, else from mentions."""
    a = table(s, d, "entities").where("name_cht is not null").select(F.col("eid").alias("key"), F.col("name_cht").alias("value"))
    b = _aliases(s, d).where("eid <> '' and formal is not null").select(F.col("eid").alias("key"), F.col("formal").alias("value"))
    c = table(s, d, "mentions").where("wikiID is not null and name is not null").select(F.col("wikiID").alias("key"), F.col("name").alias("value"))
    return retrieval.with_fallback([a, b, c], "key")


def existence_guard(s, d):
    """Linked identifiers that entities lack, and the number of those it has."""
    m = table(s, d, "mentions").where("wikiID is not null").select(F.col("wikiID").alias("eid")).distinct()
    e = table(s, d, "entities")
    return retrieval.missing_in(m, e, "eid").select("eid", F.lit("missing").alias("state")).unionByName(retrieval.present_in(m, e, "eid").select("eid", F.lit("there").alias("state")))


def _nodes(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("eid")).unionByName(table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("eid")))


def edge_merge(s, d):
    """Supplier-part edges of both returned and open lines, once each."""
    l = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return graph.merge_edges(l.where("rel = 'R'"), l.where("rel <> 'R'"))


def edge_missing(s, d):
    """Orders of customers or nations that are not among the nodes."""
    e = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.lit("of").alias("rel"), F.concat(F.lit("n"), F.col("c_nationkey") + 20).alias("dst"))
    nodes = table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("eid")).unionByName(_nodes(s, d))
    return graph.first_missing_end(e, nodes)


def edge_search(s, d):
    e = _part_edges(s, d)
    return retrieval.edges_between(e, _nodes(s, d), "n3").unionByName(retrieval.edges_between(e, _nodes(s, d), "n4", "r4"))


def node_update(s, d):
    """Nodes overwritten by the values of linked mentions that are not null."""
    e = table(s, d, "entities").select("eid", "etype", "name", "party")
    new = table(s, d, "mentions").where("wikiID is not null").groupBy(F.col("wikiID").alias("eid")).agg(F.min("name").alias("name"), F.count("*").cast("string").alias("position"))
    return graph.upsert_cells(e, new, "eid")


def node_delete(s, d):
    return graph.delete_keys(table(s, d, "entities"), table(s, d, "mentions").select(F.col("wikiID").alias("eid")), "eid").select("eid")


def node_new_ids(s, d):
    """Identifiers for alias forms that no entity is known for, after the greatest number in use."""
    rows = _aliases(s, d).where("eid = '' and form is not null").select(F.lit(None).cast("string").alias("eid"), "form").distinct()
    return graph.mint_ids(rows, table(s, d, "entities"), ["form"])


def etype_case(s, d):
    """Types of customers by their segment as classes, and the mention's type over it."""
    classes = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Q5"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("Q6256")))
    classes = classes.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("Q515"))).when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("Q4167410"))).otherwise(F.array(F.lit("Q43229")))
    base = graph.entity_type(classes, ["Q515"])
    return table(s, d, "customer").select("c_custkey", base.alias("base"), graph.final_type(F.when(F.col("c_custkey") % 2 == 0, "PER").otherwise("ORG"), base).alias("final"), graph.name_or_form(F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_name")), F.lit("form")).alias("name"))


def entity_documents(s, d):
    e = table(s, d, "entities").select("eid", "name", "summary")
    details = _aliases(s, d).where("eid <> ''").groupBy("eid").agg(F.min("exrest").alias("summary"), F.count("*").alias("forms"))
    return graph.entity_documents(e, details, e.where("eid like 'N%'").select("eid"))


def relations_between(s, d):
    claims = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.col("s_nationkey").cast("string").alias("rel"), (F.col("s_suppkey") % 7).cast("string").alias("dst"))
    labels = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("rel"), F.col("n_name").alias("label"))
    return graph.relations_between(claims, labels)


def edges_to_labelled(s, d):
    nodes = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("eid"), F.array("r_name").alias("labels"))
    return graph.edges_to_labelled(_part_edges(s, d), nodes, ["ASIA", "EUROPE"])


def ends_by_name(s, d):
    rel = table(s, d, "nation").select(F.col("n_name").alias("name1"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise("in").alias("rel"), F.concat(F.lit("x"), "n_regionkey").alias("name2"))
    nodes = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("eid"))
    base = table(s, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("Q"), "n_nationkey").alias("eid"))
    return graph.ends_by_name(rel, nodes, base)


def picture_choice(s, d):
    i = table(s, d, "part").select((F.col("p_partkey") % 50).alias("eid"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_name")).alias("url"), F.col("p_size").alias("height"))
    return graph.picture_of(i).select("eid", "height", "pos")


def first_form(s, d):
    """The first form of each linked entity by place."""
    m = table(s, d, "mentions").where("wikiID is not null and form is not null").select("wikiID", "aid", "sidx", "eidx", "form").distinct()
    return ranking.first_wins(m, ["wikiID"], ["aid", "sidx", "eidx", "form"])


def oversampled(s, d):
    """Training rows in groups of form and place: the right candidate again before each row after the first wrong one."""
    t = table(s, d, "el_training").where("form is not null and token is not null and tag is not null").select("form", "token", "sample_id", "tag")
    return ranking.oversampled(t, ["form", "token"], "sample_id", "tag").groupBy("sample_id", "tag").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ner_spans, ner_spans_shipped, ner_spans_windows, form_filter, mention_frequency, coreference, alias_link, alias_unlinked, link_best, article_entity, tag_accuracy,
        tag_counts, word_bio, entity_pairs, relation_triples, negative_pairs, question_answers, joined_features, token_windows, window_owners, best_positions, answers,
        search_exact, search_prefix, search_alias_prefix, search_article, search_match, search_phrase, search_by_time, search_time_page, search_all_indices,
        search_properties, search_types, index_fallback, existence_guard, edge_merge, edge_missing, edge_search, node_update, node_delete, node_new_ids, etype_case,
        entity_documents, relations_between, edges_to_labelled, ends_by_name, picture_choice, first_form, oversampled,
    )
}

_TYPED = """select aid, sidx, sentence, n, pos, coalesce(['O','PER','PER','ORG','ORG','LOC','LOC','REG','REG','OTH','OTH'][tag + 1], 'O') as type from
    (select *, len(tags) as n, unnest(tags) as tag, generate_subscripts(tags, 1) - 1 as pos from (select distinct aid, sidx, sentence, tags from tag_sequences))"""


def _spans_sql(tail: str) -> str:
    return f"""with t as ({_TYPED}), c as (select *, case when lag(type) over w is distinct from type then 1 else 0 end as change from t window w as (partition by aid, sidx, sentence order by pos)),
        i as (select *, sum(change) over (partition by aid, sidx, sentence order by pos) as island from c),
        r as (select aid, sidx, sentence, n, type, min(pos) as s, max(pos) + 1 as e from i where type <> 'O' group by aid, sidx, sentence, n, island, type)
        select aid, sidx, (row_number() over (partition by aid, sidx, sentence order by s) - 1)::int as eidx, substr(sentence, s::int + 1, (e - s)::int) as form, type, s::int as start, e::int as "end"
        from r where {tail}"""


_PAIRS = """select a.aid, a.sidx, a.eidx as i, b.eidx as j, a.form as form1, a.wikiID as eid1, b.form as form2, b.wikiID as eid2 from
    (select distinct aid, sidx, eidx, form, wikiID from mentions where wikiID is not null) a join (select distinct aid, sidx, eidx, form, wikiID from mentions where wikiID is not null) b
    on a.aid = b.aid and a.sidx = b.sidx and (a.eidx, coalesce(a.form, ''), a.wikiID) < (b.eidx, coalesce(b.form, ''), b.wikiID)"""

SQL = {
    "ner_spans": _spans_sql("true"),
    "ner_spans_shipped": _spans_sql("e < n"),
    "ner_spans_windows": _spans_sql("true"),
    "form_filter": """with m as (select distinct aid, sidx, eidx, form, type, idx[1] as start, wikiID from mentions),
        f as (select *, list(case when length(form) >= 3 then substr(form, 1, 1) end) over (partition by aid order by sidx, start, eidx rows between unbounded preceding and 1 preceding) as firsts from m)
        select distinct aid, sidx, eidx, form, start, type from f where length(form) >= 3 or (length(form) = 2 and not regexp_matches(form, '^[A-Za-z]+$')
        and substr(form, 2, 1) not in ('姓', '男', '女', '某', '嫌', '犯')) or (length(form) = 1 and list_contains(firsts, form))""",
    "mention_frequency": "select form, count(*) as n, count(distinct aid) as articles from mentions where form is not null group by form",
    "coreference": """with m as (select distinct aid, sidx, eidx, form, type from mentions),
        k as (select aid, type, form as full, min((sidx, eidx)) as first from m where length(form) > 1 group by aid, type, form)
        select m.aid, m.sidx, m.eidx, m.form, arg_min(k.full, (k.first, k.full)) as full from m join k on m.aid = k.aid and m.type = k.type
        where length(k.full) > length(m.form) and contains(k.full, m.form) and k.first < (m.sidx, m.eidx) group by m.aid, m.sidx, m.eidx, m.form""",
    "alias_link": """select distinct m.aid, m.sidx, m.eidx, m.form, a.seq, a.eid, a.formal from (select distinct aid, sidx, eidx, form from mentions where form is not null) m
        left join (select distinct form, seq, eid, formal, exrest from aliases where form is not null and eid <> '') a on m.form = a.form""",
    "alias_unlinked": """select distinct aid, sidx, eidx from mentions where form is not null and form not in (select form from aliases where form is not null and eid <> '')""",
    "tag_accuracy": """with t as (select unnest(tags) as g from (select aid, sidx, min(tags) as tags from tag_sequences where tags is not null group by aid, sidx))
        select count(*) as n, round(avg((g % 2 = 0)::int::double), 6) as accuracy, round(avg((g = 0)::int::double), 6) as all_o from t where g is not null""",
    "word_bio": """with t as (select aid, sidx, min(tags) as tags from tag_sequences where sidx > 0 and tags is not null group by aid, sidx),
        p as (select aid, sidx, unnest(tags) as g, generate_subscripts(tags, 1) as pos from t), y as (select *, coalesce(['O','PER','PER','ORG','ORG','LOC','LOC','REG','REG','OTH','OTH'][g + 1], 'O') as type from p),
        l as (select *, lag(type) over (partition by aid, sidx order by pos) as before from y)
        select case when type = 'O' then 'O' when before = type then 'I-' || type else 'B-' || type end as tag, count(*) as n from l group by 1""",
    "link_best": """with t as (select form, token, sample_id, formal, list_distinct(string_split(token, '')) as a, list_distinct(string_split(coalesce(exrest, ''), '')) as b from el_training
        where token is not null and form is not null), s as (select *, round(len(list_intersect(a, b)) / greatest(1, len(b)), 6) as score, row_number() over (partition by form, token order by sample_id) as k from t),
        r as (select *, row_number() over (partition by form, token order by score desc, sample_id) as b2 from s where k <= 10)
        select form, token, sample_id, formal, score from r where b2 = 1 and score > 0.3""",
    "article_entity": "select distinct aid, wikiID as eid from mentions where aid is not null and wikiID is not null",
    "tag_counts": """select coalesce(['O','PER','PER','ORG','ORG','LOC','LOC','REG','REG','OTH','OTH'][t + 1], 'O') as type, count(*) as n
        from (select unnest(tags) as t from tag_sequences) group by 1""",
    "entity_pairs": _PAIRS,
    "relation_triples": f"""select aid, sidx, i, j, substr(form1, 1, 1) || '+' || substr(form2, 1, 1) as relation, md5(aid || '/' || sidx || '/' || i || '/' || j) as triple_id from ({_PAIRS})""",
    "negative_pairs": f"""with p as (select * from ({_PAIRS}) where eid1 <> eid2), e as (select distinct eid1 as a, eid2 as b from p where eid1 > eid2)
        select aid, sidx, i, j, eid1, eid2 from p where not exists (select 1 from e where (e.a = p.eid1 and e.b = p.eid2) or (e.b = p.eid1 and e.a = p.eid2))""",
    "question_answers": f"""with p as (select distinct aid, sidx, form1, form2, eid1, eid2 from ({_PAIRS})), a as (select eid1, eid2, min(form2) as answer from p group by eid1, eid2)
        select distinct p.aid, p.sidx, form1 || '?' || form2 as query, answer, (instr(sentence, answer) - 1)::int as start,
        (case when instr(sentence, answer) > 0 then instr(sentence, answer) - 1 + length(answer) else -1 end)::int as "end"
        from p join a using (eid1, eid2) join (select distinct aid, sidx, sentence from tag_sequences where sentence is not null) s on s.aid = p.aid and s.sidx = p.sidx""",
    "joined_features": """select aid, sidx, n from (select distinct aid, sidx from tag_sequences) join (select aid, sidx, count(*) as n from
        (select distinct aid, sidx, eidx from mentions) group by aid, sidx) using (aid, sidx)""",
    "token_windows": """select id, span::int as span, (span * 128)::int as start, least(317, n - span * 128)::int as length from (select doc_id as id, n_chars as n,
        unnest(range(case when n_chars <= 317 then 1 else ceil((n_chars - 317) / 128)::bigint + 1 end)) as span from documents where n_chars > 0)""",
    "window_owners": """with d as (select distinct id, length(content) as n from articles where content is not null), w as (select id, span, span * 128 as start, least(317, n - span * 128) as len from
        (select id, n, unnest(range(case when n <= 317 then 1 else ceil((n - 317) / 128)::bigint + 1 end)) as span from d where n > 0)),
        p as (select id, span, start, len, unnest(range(start, start + len)) as pos from w),
        o as (select id, pos, arg_max(span, (least(pos - start, start + len - 1 - pos) + 0.01::double * len, -span)) as span from p group by id, pos)
        select id, span::int as span, count(*) as n, min(pos)::int as first from o group by id, span""",
    "answers": """with e as (select vec_id as id, unnest([1, 2]) as side, unnest([embedding[1:32], embedding[33:64]]) as v from embeddings),
        p as (select id, side, unnest(range(len(v))) as pos, round(unnest(v)::double, 4) as value from e),
        b as (select id, side, pos, value from p qualify row_number() over (partition by id, side order by value desc, pos) <= 5),
        s as (select a.id, a.pos as s, z.pos as e, a.value + z.value as score, a.pos || '-' || z.pos % 7 as text from b a join b z on a.id = z.id and a.side = 1 and z.side = 2 and z.pos - a.pos + 1 between 1 and 30),
        o as (select id, text, score, s, e from s qualify row_number() over (partition by id, text order by score desc, s, e) = 1),
        t as (select id, text, score from o qualify row_number() over (partition by id order by score desc, s, e, text) = 1)
        select vec_id as id, case when text is null or 0.2::double - score > 0 then '' else text end as text from embeddings left join t on t.id = vec_id""",
    "best_positions": """select id, pos::int as pos, rank::int as rank from (select id, pos, row_number() over (partition by id order by value desc, pos) as rank from
        (select vec_id as id, unnest(embedding) as value, generate_subscripts(embedding, 1) - 1 as pos from embeddings)) where rank <= 5""",
    "search_exact": "select eid, etype, name from entities where eid = 'Q7048174' union all select eid, etype, name from entities where name = '田昀思'",
    "search_prefix": "select eid, name from entities where starts_with(eid, 'Q70')",
    "search_alias_prefix": "select distinct form, seq, eid from aliases where starts_with(form, '大')",
    "search_article": """with l as (select distinct aid, wikiID as eid from mentions where aid is not null and wikiID is not null)
        select aid, eid from l where eid = (select eid from l group by eid order by count(*) desc, eid limit 1)""",
    "search_match": f"""with w as (select doc_id, coalesce({words_sql("text")}, []) as w from documents),
        q as (select unnest(list_distinct({words_sql(f"'{MATCHED}'")})) as q), n as (select count(*) as n, avg(len(w)) as mean from w),
        tf as (select doc_id, len(w) as l, q, len(list_filter(w, lambda x: x = q)) as tf from w, q),
        df as (select q, count(*) as df from tf where tf > 0 group by q)
        select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) as score
        from tf join df using (q), n where tf > 0 group by doc_id order by score desc, doc_id limit 10""",
    "search_phrase": "select doc_id from documents where contains(text, '名單尚未對外公開')",
    "search_by_time": """select event_id, theme from (select strftime(pub_time, '%Y-%m-%d') || lpad(doc_id::varchar, greatest(10, length(doc_id::varchar))::int, '0') as event_id, theme from documents where pub_time is not null)
        where starts_with(event_id, '2020-11') order by event_id limit 10000""",
    "search_time_page": "select * from (select doc_id, strftime(pub_time, '%Y-%m-%d') as day from documents order by doc_id limit 10000) where starts_with(day, '2020-12')",
    "search_all_indices": """select key, value from (select 0 as k, eid as key, name as value from entities union all select 1, eid, min(form) from aliases where eid <> '' group by eid)
        where key = 'Q7048174' order by k limit 1""",
    "search_properties": "select eid, name from entities where etype = 'PER' and party is null",
    "search_types": "select etype, count(*) as n from entities where etype in ('PER', 'ORG', 'LOC', 'REG', 'OTH') group by etype",
    "index_fallback": """select key, arg_min(value, (k, value)) as value from (select 0 as k, eid as key, name_cht as value from entities where name_cht is not null
        union all select 1, eid, formal from aliases where eid <> '' and formal is not null union all select 2, wikiID, name from mentions where wikiID is not null and name is not null) group by key""",
    "existence_guard": """select eid, case when eid in (select eid from entities where eid is not null) then 'there' else 'missing' end as state from
        (select distinct wikiID as eid from mentions where wikiID is not null)""",
    "edge_merge": "select distinct 's' || l_suppkey as src, l_returnflag as rel, 'p' || l_partkey as dst from lineitem where l_returnflag is not null and l_returnflag <> ''",
    "edge_missing": """with e as (select 'c' || c_custkey as src, 'of' as rel, 'n' || (c_nationkey + 20) as dst, c_custkey % 3 = 0 as no_src, c_nationkey + 20 not in (select n_nationkey from nation) as no_dst from customer)
        select src, rel, dst, case when no_src then src else dst end as missing from e where no_src or no_dst""",
    "edge_search": """select 'n' || n_nationkey as src, 'in' as rel, 'r' || n_regionkey as dst from nation where n_nationkey = 3
        union all select 'n' || n_nationkey, 'in', 'r' || n_regionkey from nation where n_nationkey = 4 and n_regionkey = 4""",
    "node_update": """select coalesce(e.eid, m.eid) as eid, e.etype, coalesce(m.name, e.name) as name, e.party, m.position from (select distinct eid, etype, name, party from entities) e full join
        (select wikiID as eid, min(name) as name, count(*)::varchar as position from mentions where wikiID is not null group by wikiID) m on e.eid = m.eid""",
    "node_delete": "select eid from entities where eid not in (select wikiID from mentions where wikiID is not null)",
    "node_new_ids": """select 'N' || lpad(((select max(substr(eid, 2)::bigint) from entities where regexp_matches(eid, '^N[0-9]+$')) + row_number() over (order by form))::varchar, 8, '0') as eid, form
        from (select distinct form from aliases where eid = '' and form is not null)""",
    "etype_case": """with t as (select *, case c_mktsegment when 'BUILDING' then 'PER' when 'MACHINERY' then 'REG' when 'HOUSEHOLD' then 'LOC' when 'FURNITURE' then null else 'ORG' end as base,
        case when c_custkey % 2 = 0 then 'PER' else 'ORG' end as m from customer)
        select c_custkey, base, case when m <> 'PER' or base is null then m else base end as final, case when c_custkey % 5 = 0 then 'form' else c_name end as name from t""",
    "entity_documents": """select e.eid, e.name, coalesce(a.summary, e.summary) as summary, a.forms from (select distinct eid, name, summary from entities where eid not like 'N%') e left join
        (select eid, min(exrest) as summary, count(*) as forms from aliases where eid <> '' group by eid) a on e.eid = a.eid""",
    "relations_between": """select distinct 's' || s_suppkey as src, (s_suppkey % 7)::varchar as dst, s_nationkey::varchar as rel, n_name as label from supplier join nation on s_nationkey = n_nationkey""",
    "edges_to_labelled": "select 'n' || n_nationkey as src, 'in' as rel, 'r' || n_regionkey as dst from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')",
    "ends_by_name": """select n_name as name1, case when n_nationkey % 2 = 0 then 'N' || n_nationkey else 'Q' || n_nationkey end as eid1, 'in' as rel, 'x' || n_regionkey as name2, null::varchar as eid2
        from nation where n_nationkey % 4 <> 0""",
    "picture_choice": """select eid, height, pos from (select p_partkey % 50 as eid, p_size as height, p_partkey as pos, row_number() over (partition by p_partkey % 50 order by p_size desc, p_partkey) as k
        from part where p_size % 7 <> 0 and p_name is not null and p_size > 0) where k = 1""",
    "first_form": """select wikiID, aid, sidx, eidx, form from (select *, row_number() over (partition by wikiID order by aid, sidx, eidx, form) as k from
        (select distinct wikiID, aid, sidx, eidx, form from mentions where wikiID is not null and form is not null)) where k = 1""",
    "oversampled": """with t as (select *, sum(case when tag = 0 then 1 else 0 end) over (partition by form, token order by sample_id) as wrong,
        min(case when tag = 1 then sample_id end) over (partition by form, token) as r from el_training where form is not null and token is not null and tag is not null)
        select sample_id, tag, count(*) as n from (select sample_id, tag from t union all select r, 1 from t where wrong >= 1 and r is not null) group by sample_id, tag""",
}
