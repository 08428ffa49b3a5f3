"""Queries over term weights, vectors, clusters, summaries, traits and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ranking, summaries as S, traits, vectors as V
from newsloom.plans.runtime import shuffled, spread, table
from newsloom.plans.text_queries import words_sql
from newsloom.sources import pages as P
from newsloom.sources import sinks
from newsloom.streaming import incremental as I


def _terms(s: SparkSession, d: str) -> DataFrame:
    return V.document_terms(table(s, d, "documents").where("text is not null"), "doc_id", "text")


def doc_freq(s, d):
    return V.document_frequency(_terms(s, d), "doc_id")


def tfidf(s, d):
    w = V.tfidf(_terms(s, d), "doc_id")
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


def tfidf_pivoted(s, d):
    w = V.pivoted(V.tfidf(_terms(s, d), "doc_id"), "doc_id")
    return w.groupBy("doc_id").agg(F.round(F.sum("weight"), 4).alias("weight"))


def term_cosine(s, d):
    """Cosine of the entities whose number is divisible by 20 with all others by shared words of their summaries."""
    docs = table(s, d, "entities").where("summary is not null").select("eid", "summary")
    w = V.unit(V.tfidf(V.document_terms(docs, "eid", "summary"), "eid"), "eid")
    q = w.where(F.regexp_extract("eid", "[0-9]+$", 0).try_cast("long") % 20 == 0)
    return V.term_similarity(q, w, "eid").where("cosine > 0.05").select("query", "eid", F.round("cosine", 5).alias("cosine"))


def mean_similarity(s, d):
    g = V.mean_similarity_to_groups(table(s, d, "embeddings"), "vec_id", "embedding", "label")
    return g.select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def nearest_vectors(s, d):
    """The five nearest of every twentieth vector among all."""
    e = table(s, d, "embeddings")
    return V.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")


def _weighted(s, d) -> DataFrame:
    """Articles with the weights of their content's words as a map."""
    a = table(s, d, "articles").where("content is not null and time is not null").select("id", "content", T.normal_time("time").alias("time")).where("time is not null")
    once = a.groupBy("id").agg(F.min("content").alias("content"), F.min("time").alias("time"))
    w = V.tfidf(V.document_terms(once.select("id", T.clean_for_clusters("content").alias("content")), "id", "content"), "id")
    return w.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.round("weight", 6).alias("weight"))))).alias("terms")).join(shuffled(once.select("id", "time")), "id")


def single_pass(s, d):
    """Contents of one day clustered in the order of (time, id); a day is a block."""
    w = _weighted(s, d).withColumn("day", F.substring("time", 1, 10))
    return V.single_pass(w, "id", "time", 0.1, "day")


def single_pass_vectors(s, d):
    """The vectors as one block in the order of their numbers: exact, one task."""
    e = table(s, d, "embeddings")
    terms = F.map_from_arrays(F.transform("embedding", lambda x, i: i.cast("string")), F.transform("embedding", lambda x: x.cast("double")))
    return V.single_pass(e.select("vec_id", terms.alias("terms")).withColumn("at", F.col("vec_id")), "vec_id", "at", 0.1)


def cluster_events(s, d):
    c = single_pass(s, d)
    times = table(s, d, "articles").select("id", F.to_timestamp_ntz(T.normal_time("time"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time")).groupBy("id").agg(F.min("time").alias("time"))
    return V.event_lists(V.cluster_events(c, times, "id"))


def article_event(s, d):
    c = single_pass(s, d)
    times = table(s, d, "articles").select("id", F.to_timestamp_ntz(T.normal_time("time"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time")).groupBy("id").agg(F.min("time").alias("time"))
    return V.article_events(V.cluster_events(c, times, "id"))


def _themes(s, d) -> DataFrame:
    return table(s, d, "articles").where("theme is not null").select(F.concat_ws("/", "theme", F.substring(T.normal_time("time"), 1, 10)).alias("event_id"), F.col("id").alias("aid")).distinct()


def event_documents(s, d):
    docs = S.event_documents(_themes(s, d), table(s, d, "articles").select(F.col("id").alias("aid"), "content"))
    return docs.select("event_id", F.length("content").alias("n"), F.md5("content").alias("digest"))


def _sentences(s, d) -> DataFrame:
    t = table(s, d, "tag_sequences").where("sentence is not null").groupBy("aid", "sidx").agg(F.min("sentence").alias("sentence"))
    return t.select(F.col("aid").alias("event_id"), F.col("sidx").alias("pos"), "sentence", F.filter(F.split("sentence", r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("words"))


def usable_sentences(s, d):
    return S.usable_sentences(_sentences(s, d)).select("event_id", "pos", F.size("words").alias("n"))


def _scored(s, d) -> DataFrame:
    return S.usable_sentences(_sentences(s, d)).withColumn("score", F.size(F.array_distinct("words")).cast("double") - F.col("pos") / 100)


def summary_best(s, d):
    return S.best_sentence(_scored(s, d))


def summary_chosen(s, d):
    return S.summaries(_scored(s, d))


def summary_upsert(s, d):
    e = table(s, d, "articles").where("theme is not null").groupBy(F.col("theme").alias("eid"))
    old = e.agg(F.min("title").alias("abstract"), F.max(F.when(F.col("source") == "HB", "").otherwise(F.col("source"))).alias("name"))
    new = e.agg(F.max("title").alias("abstract"), F.lit("new").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("eid"), F.lit("a").alias("abstract"), F.lit("new").alias("name")))
    return S.upsert_summaries(old.withColumn("name", F.when(F.col("eid") == "地方", "").otherwise(F.col("name"))), new)


def ngram_overlap(s, d):
    """Entities' summaries by whether they share a two-word sequence with a fixed text."""
    fixed = T.ngrams(F.split(F.lit("we checked twice and the ferry left at"), " "), 2)
    g = T.ngrams(T.tokens("summary"), 2)
    return table(s, d, "entities").where("summary is not null").select("eid", F.size(g).alias("n"), F.arrays_overlap(g, fixed).alias("shares"))


def segment_ids(s, d):
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "R").alias("is_sep"))
    return S.segment_ids(t.groupBy("id", "pos").agg(F.max("is_sep").alias("is_sep")))


def padded_tags(s, d):
    """Tag arrays cut or filled to eight, added up."""
    t = table(s, d, "tag_sequences").where("tags is not null").select("aid", "sidx", T.padded("tags", 8, 0).alias("t")).distinct()
    return t.select("aid", "sidx", F.size("t").alias("n"), F.aggregate("t", F.lit(0), lambda a, x: a + x).alias("total"))


def characters(s, d):
    return table(s, d, "entities").where("name is not null").select("eid", F.size(T.characters("name")).alias("n")).distinct()


def map_overlay(s, d):
    left = F.create_map(F.lit("a"), F.col("r_name"), F.lit("b"), F.lit("old"))
    right = F.create_map(F.lit("b"), F.col("r_name"), F.lit("c"), F.lit("new"))
    m = T.overlay(left, right)
    return table(s, d, "region").select("r_regionkey", F.get(F.array(m["a"]), F.lit(0)).alias("a"), m["b"].alias("b"), m["c"].alias("c"))


LEXICON = {"talk": ["說", "指出", "表示"], "money": ["款", "補助"], "plan": ["計畫", "工程"]}
MEANS = {"talk": 0.01, "money": 0.0, "plan": 0.02}


def trait_features(s, d):
    pages = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return traits.trait_features(traits.lexicon_counts(pages, LEXICON), MEANS)


def trait_scores(s, d):
    """Lexicon counts times fixed hidden states and a linear layer."""
    pages = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    counts = traits.lexicon_counts(pages, LEXICON)
    x = counts.select("id", F.explode(F.create_map(*[v for c in LEXICON for v in (F.lit(c), F.col(c))])).alias("word", "x"))
    hidden = s.createDataFrame([("talk", 0, 1.0), ("money", 0, 2.0), ("plan", 0, 4.0)], "word string, dim int, h double")
    weights = s.createDataFrame([("open", 0, 0.5), ("calm", 0, -0.25)], "trait string, dim int, w double")
    bias = s.createDataFrame([("open", 0.0), ("calm", 1.0)], "trait string, b double")
    return traits.trait_scores(traits.weighted_mean(x, hidden), weights, bias)


def standardised(s, d):
    rows = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return ranking.standardised(rows, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


def event_counts(s, d):
    return I.event_counts(table(s, d, "events"))


def event_sessions(s, d):
    return I.sessions(table(s, d, "events"), "2 hours")


def event_resume(s, d):
    """Events after a checkpoint that the orders have not used."""
    e = I.after_checkpoint(table(s, d, "events").select("event_id", "event_type"), "event_id", 500)
    return I.resumed(e, table(s, d, "orders").select((F.col("o_orderkey") * 2).alias("event_id")), "event_id")


def two_phase(s, d):
    """Forms linked by the table; those it lacks resolved once by their own hash and added."""
    forms = table(s, d, "mentions").where("form is not null").select("form")
    linked, _ = I.two_phase_links(forms, table(s, d, "aliases").where("form is not null"), lambda f: f.select("form", F.concat(F.lit("X"), F.substring(F.md5("form"), 1, 6)).alias("eid")))
    return linked


def user_posts(s, d):
    p = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), "event_type")
    return P.posts_of_users(p, 3)


def post_pages(s, d):
    p = table(s, d, "orders").select(F.concat_ws("_", F.lit("c"), "o_custkey").alias("folder"), F.col("o_orderkey").alias("file"), F.lit(1).alias("number"), F.col("o_orderpriority").alias("value"))
    return P.post_pages(p)


def conll(s, d):
    t = table(s, d, "tag_sequences").where("sentence is not null and tags is not null").groupBy("aid", "sidx").agg(F.min(F.struct("sentence", "tags")).alias("x"))
    words = t.select("aid", "sidx", F.posexplode(F.arrays_zip(F.split("x.sentence", "").alias("w"), F.col("x.tags").alias("t"))).alias("pos", "z"))
    tokens = words.where("z.w is not null and z.t is not null").select("aid", "sidx", "pos", F.col("z.w").alias("word"), F.col("z.t").cast("string").alias("tag"))
    return sinks.conll_lines(tokens).groupBy("aid").agg(F.count("*").alias("n"), F.sum((F.col("line") == "").cast("int")).alias("gaps"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_freq, tfidf, tfidf_pivoted, term_cosine, mean_similarity, nearest_vectors, single_pass, single_pass_vectors, cluster_events, article_event, event_documents,
        usable_sentences, summary_best, summary_chosen, summary_upsert, ngram_overlap, segment_ids, padded_tags, characters, map_overlay, trait_features, trait_scores,
        standardised, event_counts, event_sessions, event_resume, two_phase, user_posts, post_pages, conll,
    )
}

_TERMS = f"(select doc_id, unnest(list_distinct({words_sql('text')})) as term from documents where text is not null)"
_IDF = f"t as {_TERMS}, n as (select count(distinct doc_id) as n from t), w as (select t.doc_id, t.term, log2((select n from n) / df) as weight from t join (select term, count(*) as df from t group by term) using (term) where df < (select n from n))"
_WORDS = r"""(select aid as event_id, sidx as pos, sentence, list_filter(regexp_split_to_array(sentence, '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from
    (select aid, sidx, min(sentence) as sentence from tag_sequences where sentence is not null group by aid, sidx))"""
_USABLE = f"""(select event_id, pos, sentence, words from (select *, row_number() over (partition by event_id order by pos) as k, count(*) over (partition by event_id) as a
    from (select event_id, pos, sentence, words[1:200] as words from {_WORDS} where len(words) > 5)) where a >= 3 and k <= 100)"""
_LEX = """select doc_id as id, length(h) as words, h, ((length(h) - length(replace(h, '說', ''))) + (length(h) - length(replace(h, '指出', ''))) / 2 + (length(h) - length(replace(h, '表示', ''))) / 2)::int as talk,
    ((length(h) - length(replace(h, '款', ''))) + (length(h) - length(replace(h, '補助', ''))) / 2)::int as money, ((length(h) - length(replace(h, '計畫', ''))) / 2 + (length(h) - length(replace(h, '工程', ''))) / 2)::int as plan
    from (select doc_id, regexp_replace(text, '[^一-龥]', '', 'g') as h from documents where text is not null)"""

# printf rounds a double by its exact binary value, ties to even, as the scores are rounded.
SQL = {
    "doc_freq": f"select term, count(*) as df from {_TERMS} group by term",
    "tfidf": f"with {_IDF} select doc_id, count(*) as terms, round(sum(weight), 4) as weight from w group by doc_id",
    "tfidf_pivoted": f"""with {_IDF}, l as (select doc_id, sqrt(sum(weight * weight)) as n from w group by doc_id)
        select doc_id, round(sum(weight / (0.9::double * 10 + 0.1::double * n)), 4) as weight from w join l using (doc_id) group by doc_id""",
    "term_cosine": f"""with t as (select eid, unnest(list_distinct({words_sql('summary')})) as term from entities where summary is not null),
        n as (select count(distinct eid) as n from t), w as (select eid, term, log2((select n from n) / df) as weight from t join (select term, count(*) as df from t group by term) using (term)),
        l as (select eid, sqrt(sum(weight * weight)) as n from w where weight > 0 group by eid), u as (select eid, term, weight / n as weight from w join l using (eid) where weight > 0)
        select a.eid as query, b.eid, round(sum(a.weight * b.weight), 5) as cosine from u a join u b using (term) where a.eid <> b.eid and try_cast(regexp_extract(a.eid, '[0-9]+$') as bigint) % 20 = 0 group by 1, 2 having sum(a.weight * b.weight) > 0.05""",
    "mean_similarity": """with e as (select vec_id, label, embedding::double[] as v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from e where list_dot_product(v, v) > 0)
        select a.vec_id, a.label, round(avg(list_dot_product(a.u, b.u)), 5) as similarity from u a join u b on a.label = b.label group by a.vec_id, a.label""",
    "nearest_vectors": """select query, vec_id, round(c, 5) as cosine, rank::int as rank from (select *, row_number() over (partition by query order by c desc, vec_id) as rank from
        (select q.vec_id as query, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as c from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0)) where rank <= 5""",
    "event_documents": r"""with e as (select distinct concat_ws('/', theme, substr(case when time like '____/%' then replace(time, '/', '-') else time end, 1, 10)) as event_id, id as aid from articles where theme is not null),
        p as (select distinct id as aid, replace(replace(list_filter(string_split(content, '\n'), lambda x: length(x) > 3)[1], ' ', ''), chr(8232), '') as p from articles where content is not null)
        select event_id, length(c)::int as n, md5(c) as digest from (select event_id, string_agg(p, chr(10) order by aid, p) as c from e join p using (aid) where p is not null group by event_id)""",
    "usable_sentences": f"select event_id, pos, len(words)::int as n from {_USABLE}",
    "summary_best": f"""select event_id, sentence as abstract from (select event_id, sentence, row_number() over (partition by event_id
        order by len(list_distinct(words))::double - pos::double / 100 desc, pos) as k from {_USABLE}) where k = 1""",
    "summary_upsert": """with o as (select theme as eid, min(title) as abstract, case when theme = '地方' then '' else max(case when source = 'HB' then '' else source end) end as name from articles where theme is not null group by theme),
        n as (select theme as eid, max(title) as abstract, 'new' as name from articles where theme is not null group by theme union all select r_name, 'a', 'new' from region),
        f as (select * from n where eid not in (select eid from o where name is not null and length(name) > 0))
        select * from o where eid not in (select eid from f) union all select * from f""",
    "ngram_overlap": r"""with t as (select eid, regexp_extract_all(lower(summary), '[\p{L}\p{N}_]+') as w from entities where summary is not null),
        g as (select eid, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else [] end as g from t)
        select eid, len(g)::int as n, list_has_any(g, ['we checked', 'checked twice', 'twice and', 'and the', 'the ferry', 'ferry left', 'left at']) as shares from g""",
    "segment_ids": """select l_orderkey as id, l_linenumber as pos, (coalesce(sum(sep::int) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) % 2)::int as segment
        from (select l_orderkey, l_linenumber, max(l_returnflag = 'R') as sep from lineitem group by all)""",
    "padded_tags": """select aid, sidx, 8 as n, coalesce(list_sum(tags[1:8]), 0)::int as total from (select distinct aid, sidx, tags[1:8] as tags from tag_sequences where tags is not null)""",
    "characters": r"select distinct eid, length(regexp_replace(name, '[ \t\n\r\f\x0b]|\x{202F}', '', 'g'))::int as n from entities where name is not null",
    "map_overlay": "select r_regionkey, r_name as a, r_name as b, 'new' as c from region",
    "trait_features": f"""select id, category, ratio, category || case when ratio > mean then '+' else '-' end as feature from (select id, 'talk' as category, printf('%.2f', talk / words)::double as ratio, 0.01::double as mean from ({_LEX}) where words > 0
        union all select id, 'money', printf('%.2f', money / words)::double, 0.0 from ({_LEX}) where words > 0 union all select id, 'plan', printf('%.2f', plan / words)::double, 0.02 from ({_LEX}) where words > 0)""",
    "trait_scores": f"""select id, trait, printf('%.2f', v * w + b)::double as score from (select id, (talk * 1.0::double + money * 2.0::double + plan * 4.0::double) / (talk + money + plan) as v from ({_LEX}) where talk + money + plan <> 0),
        (select 'open' as trait, 0.5::double as w, 0.0::double as b union all select 'calm', -0.25, 1.0)""",
    "standardised": "select c_custkey, round((c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer), 4) as c_acctbal from customer",
    "event_counts": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
    "event_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events where ts is not null and user_id is not null),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select user_id, min(ts) as start, max(ts) + interval 2 hours as "end", count(*) as n from s group by user_id, k""",
    "event_resume": "select event_id, event_type from events where event_id > 500 and event_id not in (select o_orderkey * 2 from orders)",
    "two_phase": """with a as (select distinct form, eid from aliases where form is not null and eid <> ''), f as (select distinct form from mentions where form is not null)
        select f.form, coalesce(a.eid, 'X' || substr(md5(f.form), 1, 6)) as eid from f left join a on f.form = a.form""",
    "user_posts": "select id, pos, event_type from (select user_id as id, event_id as pos, event_type, row_number() over (partition by user_id order by event_id) as k from events) where k <= 3",
    "post_pages": "select o_custkey::varchar as id, 'c' as name, string_agg(trim(o_orderpriority), '<sep>' order by o_orderkey) as text from orders group by o_custkey",
    "conll": """select aid, sum(n + (n > 0)::int)::bigint as n, sum((n > 0)::int)::bigint as gaps from (select aid, least(length(sentence), len(tags)) as n from
        (select aid, sidx, unnest(min((sentence, tags))) from tag_sequences where sentence is not null and tags is not null group by aid, sidx) x(aid, sidx, sentence, tags)) where n > 0 group by aid""",
}
