"""Queries over articles and documents: scalar functions, order, counts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import graph, ranking, retrieval
from newsloom.plans.runtime import table
from newsloom.sources import articles as A
from newsloom.sources import pages as P

# A small table of traditional characters and their simplified forms.
SIMPLER = dict(zip("學號長門車馬風電龍書東國會這時無說過個對", "学号长门车马风电龙书东国会这时无说过个对"))


def _articles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "articles")


def term_frequency(s: SparkSession, d: str) -> DataFrame:
    """Tokens of two or more characters with their frequency, the fifty most frequent."""
    terms = table(s, d, "documents").select(F.explode(T.words_of("text")).alias("term")).where(F.length("term") >= 2)
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


def article_latest(s, d):
    """One row per article: the latest fetch of each identifier."""
    rows = _articles(s, d).select("id", "fetched_at", "time", "url", "source")
    return graph.upsert_latest(rows, rows.limit(0), "id", "fetched_at")


def article_content_id(s, d):
    return A.with_content_id(_articles(s, d)).groupBy("id").agg(F.count("*").alias("n"))


def article_order(s, d):
    """The three latest articles of each source by (time, id)."""
    rows = _articles(s, d).select("id", "source", T.normal_time("time").alias("time")).distinct().where("time is not null")
    return retrieval.top_by(rows, ["source"], [F.desc("time"), F.desc("id")], 3)


def theme_stats(s, d):
    """Articles per theme and per month in one pass."""
    rows = _articles(s, d).select("id", "theme", T.year_month("time").alias("ym"))
    return rows.groupingSets([["theme"], ["ym"]], "theme", "ym").agg(F.grouping("theme").cast("int").alias("by_month"), F.count("*").alias("n"))


def time_normal(s, d):
    return _articles(s, d).groupBy(T.normal_time("time").isNull().alias("unknown"), T.year_month("time").alias("ym")).agg(F.count("*").alias("n"))


def first_paragraph(s, d):
    return _articles(s, d).select("id", T.first_paragraph("content").alias("paragraph")).distinct()


def lead_paragraph(s, d):
    return _articles(s, d).select("id", F.get(T.paragraphs("content"), F.lit(0)).alias("lead")).distinct()


def paragraph_counts(s, d):
    p = T.paragraphs("content")
    return _articles(s, d).where("content is not null").select("id", F.size(p).alias("n"), F.array_max(F.transform(p, F.length)).alias("longest")).distinct()


def clean_cluster(s, d):
    c = T.clean_for_clusters("text")
    return table(s, d, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def clean_summary(s, d):
    c = T.clean_for_summaries("text")
    return table(s, d, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def clean_old(s, d):
    return table(s, d, "documents").select("doc_id", F.length(T.clean_old("text")).alias("n"))


def han_only(s, d):
    return table(s, d, "documents").select("doc_id", F.length(T.han_only("text")).alias("n"))


def brackets(s, d):
    escaped = F.replace(F.replace(F.col("text"), F.lit("("), F.lit("-lrb-")), F.lit(")"), F.lit("-rrb-"))
    return table(s, d, "documents").select("doc_id", F.md5(T.unescape_brackets(escaped)).alias("digest"))


def event_ids(s, d):
    day = F.date_format("pub_time", "yyyy-MM-dd")
    return table(s, d, "documents").where("pub_time is not null").select("doc_id", T.event_id(day, "doc_id").alias("event_id"), T.zfill("n_chars", 2).alias("short"))


def simpler_characters(s, d):
    return _articles(s, d).select("id", T.translate_characters("title", SIMPLER).alias("title")).distinct()


def small_texts(s, d):
    """Spaces written as %20, names after a colon, names of encyclopaedia addresses, blanks, word pieces, questions."""
    e = table(s, d, "entities").where("name is not null")
    stored = F.concat(F.lit("properties:"), F.replace(F.col("name"), F.lit(" "), F.lit("%20")))
    return e.select(
        "eid", T.spaces_back(T.after_last(stored)).alias("name"), T.wiki_name(F.concat(F.lit(T.ITEM_ADDRESS), "name", F.lit("[12]"))).alias("wiki"),
        T.without_blanks(F.replace(F.col("name"), F.lit(" "), F.lit("  "))).alias("solid"), T.whole_words(F.concat(F.lit("un ##"), "eid", F.lit("  x"))).alias("words"),
        T.question("name", "eid").alias("asked"), T.is_ascii_word("name").alias("ascii"),
    ).distinct()


def counted_parts(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.occurrences("text", F.lit("……")).alias("pauses"), T.wildcard_occurrences("text", "the").alias("the"), F.round(F.col("n_chars") / 7, 2).alias("seventh"))


def topic_of_url(s, d):
    topics = {"society": "社會", "politic": "政治", "technews": "科技", "money": "財經", "env": "環境"}
    return _articles(s, d).select("url", T.topic_of("url", topics, part=3).alias("topic")).distinct()


def url_todo(s, d):
    return P.still_to_fetch(table(s, d, "crawled_pages"), _articles(s, d))


def keywords_distinct(s, d):
    return P.keywords_of(_articles(s, d))


def keyword_todo(s, d):
    """Keywords that name no theme."""
    done = _articles(s, d).select(F.col("theme").alias("keyword"))
    return P.still_to_fetch(P.keywords_of(_articles(s, d)), done, "keyword")


def theme_url(s, d):
    return P.search_results(_articles(s, d).select("theme", "url", "time"), ["政治", "科技", "國際"], 2019)


def theme_valid(s, d):
    """Themes that hold a known topic or are held by one; excluded ones left out."""
    return P.known_themes(_articles(s, d), ["政治新聞", "財經", "科技", "生活"], ["生活"]).groupBy("theme").agg(F.count("*").alias("n"))


def keyword_repair(s, d):
    """Articles without keywords get their theme as one."""
    k = P.keywords_or_theme()
    return _articles(s, d).where("theme is not null").select("id", F.array_join(k, "\t").alias("keywords")).distinct()


def split_hash(s, d):
    return table(s, d, "el_training").select("sample_id", ranking.hash_fifth(F.col("sample_id").cast("string")).alias("test"))


def split_half(s, d):
    rows = table(s, d, "el_training").where("form is not null").select("form", "sample_id")
    return ranking.positional_split(rows, ["form"], ["sample_id"], 0.5)


def corpus_append(s, d):
    """Corpora of two runs put together, the earlier run's rows first."""
    a = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("n"), F.lit(1).alias("run"))
    b = _articles(s, d).select("id", F.length("content").alias("n"), F.lit(2).alias("run"))
    return a.unionByName(b).groupBy("run").agg(F.count("*").alias("rows"), F.count("n").alias("texts"))


def text_records(s, d):
    """Lines longer than five characters of all pages, per page."""
    lines = table(s, d, "crawled_pages").where("content is not null").select("page_id", F.explode(F.split("content", "\n")).alias("value"))
    return A.long_lines(lines, 5).groupBy("page_id").agg(F.count("*").alias("n"))


def article_files(s, d):
    """Articles written as file text and read back by key; the content survives, also over several lines."""
    rows = _articles(s, d).where("content is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("url", "time", "title", "theme", "keywords", "content", "source")])
    back = A.parse_articles(A.as_text(rows).select(F.col("id").alias("path"), "value"))
    return back.select("id", "corrupt", F.md5("content").alias("digest"))


def page_read(s, d):
    """Pages wrapped in markup and read by the parser; their lines come back as blocks."""
    rows = table(s, d, "crawled_pages").where("content is not null").dropDuplicates(["page_id", "content"])
    safe = F.replace(F.replace(F.col("content"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><p>"), F.replace(safe, F.lit("\n"), F.lit("<p>")), F.lit("</body>"))
    return P.parsed_pages(rows.select("page_id", html.alias("html"))).select("page_id", F.size("blocks").alias("n_blocks")).groupBy("page_id").agg(F.sum("n_blocks").alias("n_blocks"))


QUERIES = {
    f.__name__: f
    for f in (
        term_frequency, article_latest, article_content_id, article_order, theme_stats, time_normal, first_paragraph, lead_paragraph, paragraph_counts, clean_cluster,
        clean_summary, clean_old, han_only, brackets, event_ids, simpler_characters, small_texts, counted_parts, topic_of_url, url_todo, keywords_distinct, keyword_todo,
        theme_url, theme_valid, keyword_repair, split_hash, split_half, corpus_append, text_records, article_files, page_read,
    )
}

_TIME = r"""case when regexp_matches(time, '^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$') then replace(time, '/', '-') || ':00'
    when regexp_matches(time, '^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$') then replace(time, '/', '-')
    when regexp_matches(time, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$') then time || ':00'
    when regexp_matches(time, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$') then time end"""



def words_sql(text: str) -> str:
    """The words of ``T.words_of`` in SQL, those of Han runs last."""
    pairs = "list_transform(range(1, greatest(length(r), 2)), lambda i: substr(r, i, 2))"
    return (
        f"list_concat(regexp_extract_all(regexp_replace(lower({text}), '\\p{{Han}}+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'),"
        f" flatten(list_transform(regexp_extract_all(lower({text}), '\\p{{Han}}+'), lambda r: {pairs})))"
    )


SQL = {
    "term_frequency": f"""select term, count(*) as n from (select unnest({words_sql("text")}) as term from documents)
        where length(term) >= 2 group by term order by n desc, term limit 50""",
    "article_latest": """select id, fetched_at, time, url, source from (select *, row_number() over (partition by id
        order by fetched_at desc nulls last, time desc nulls last, url desc nulls last, source desc nulls last) as k from articles where id is not null) where k = 1""",
    "article_content_id": "select case when content is not null and content <> '' then md5(content) else id end as id, count(*) as n from articles group by 1",
    "article_order": f"""select id, source, time, rank from (select *, row_number() over (partition by source order by time desc, id desc) as rank
        from (select distinct id, source, {_TIME} as time from articles) where time is not null) where rank <= 3""",
    "theme_stats": f"""select theme, ym, grouping(theme)::int as by_month, count(*) as n from (select theme, substr({_TIME}, 1, 7) as ym from articles)
        group by grouping sets ((theme), (ym))""",
    "time_normal": f"select t is null as unknown, substr(t, 1, 7) as ym, count(*) as n from (select {_TIME} as t from articles) group by 1, 2",
    "first_paragraph": r"""select distinct id, replace(replace(list_filter(string_split(content, '\n'), lambda p: length(p) > 3)[1], ' ', ''), chr(8232), '') as paragraph from articles""",
    "lead_paragraph": r"select distinct id, string_split(content, '\n')[1] as lead from articles",
    "paragraph_counts": r"""select distinct id, len(string_split(content, '\n'))::int as n, list_max(list_transform(string_split(content, '\n'), lambda p: length(p)))::int as longest
        from articles where content is not null""",
    "clean_cluster": rf"select doc_id, length(c)::int as n, md5(c) as digest from (select doc_id, regexp_replace(text, '{T.CLUSTER_NOISE}', '', 'g') as c from documents)",
    "clean_summary": rf"select doc_id, length(c)::int as n, md5(c) as digest from (select doc_id, regexp_replace(text, '{T.SUMMARY_NOISE}', '', 'g') as c from documents)",
    "clean_old": r"""select doc_id, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
        '。', ''), '\n', ''), '」', ''), '//', ''), '_', ''), '-', ''), chr(13), ''), chr(10), ''), chr(9), ''), '@', ''), '\\', ''), '''''', ''))::int as n from documents""",
    "han_only": "select doc_id, length(regexp_replace(text, '[^一-龥]', '', 'g'))::int as n from documents",
    "brackets": """select doc_id, md5(replace(replace(replace(replace(replace(replace(text, '-lrb-', '('), '-rrb-', ')'), '-lcb-', '{'), '-rcb-', '}'), '``', '"'), '''''', '"')) as digest
        from documents""",
    "event_ids": """select doc_id, strftime(pub_time, '%Y-%m-%d') || case when length(doc_id::varchar) >= 10 then doc_id::varchar else lpad(doc_id::varchar, 10, '0') end as event_id,
        case when length(n_chars::varchar) >= 2 then n_chars::varchar else lpad(n_chars::varchar, 2, '0') end as short from documents where pub_time is not null""",
    "simpler_characters": f"select distinct id, translate(title, '{''.join(SIMPLER)}', '{''.join(SIMPLER.values())}') as title from articles",
    "small_texts": r"""select distinct eid, name, name as wiki, regexp_replace(name, '[\s\p{Z}]+', '', 'g') as solid, 'un' || eid || ' x' as words,
        '"' || name || '"?"' || eid || '"' as asked, regexp_matches(name, '^[A-Za-z]+$') as ascii from entities where name is not null""",
    "counted_parts": r"""select doc_id, ((length(text) - length(replace(text, '……', ''))) / 2)::int as pauses, len(regexp_extract_all(text, 'the[\p{L}\p{M}\p{Nd}\p{Pc}]*'))::int as the,
        round(n_chars / 7, 2) as seventh from documents where text is not null""",
    "topic_of_url": """select distinct url, case string_split(url, '/')[4] when 'society' then '社會' when 'politic' then '政治' when 'technews' then '科技'
        when 'money' then '財經' when 'env' then '環境' end as topic from articles""",
    "url_todo": "select distinct url from crawled_pages where url is not null and url not in (select url from articles where url is not null)",
    "keywords_distinct": "select distinct trim(k) as keyword from (select unnest(keywords) as k from articles) where trim(k) <> ''",
    "keyword_todo": """select distinct trim(k) as keyword from (select unnest(keywords) as k from articles) where trim(k) <> ''
        and trim(k) not in (select theme from articles where theme is not null)""",
    "theme_url": f"select distinct theme, url from articles where substr({_TIME}, 1, 4)::int >= 2019 and theme in ('政治', '科技', '國際')",
    "theme_valid": """select theme, count(*) as n from articles where theme <> '生活' and len(list_filter(['政治新聞', '財經', '科技', '生活'],
        lambda t: contains(t, theme) or contains(theme, t))) > 0 group by theme""",
    "keyword_repair": """select distinct id, case when coalesce(len(keywords), 0) = 0 then theme else array_to_string(keywords, chr(9)) end as keywords from articles where theme is not null""",
    "split_hash": "select sample_id, ('0x' || substr(md5(sample_id::varchar), 1, 8))::bigint % 5 = 0 as test from el_training",
    "split_half": """select form, sample_id, case when row_number() over (partition by form order by sample_id) <= floor(count(*) over (partition by form) * 0.5) then 'head' else 'tail' end as part
        from el_training where form is not null""",
    "corpus_append": """select 1 as run, count(*) as rows, count(text) as texts from documents union all select 2, count(*), count(content) from articles""",
    "text_records": """select page_id, count(*) as n from (select page_id, unnest(string_split(content, chr(10))) as value from crawled_pages where content is not null) where length(value) + 1 > 5 group by page_id""",
    "article_files": r"""select distinct id, false as corrupt, md5(content) as digest from (select id, min(content) as content from articles where content is not null group by id)""",
    "page_read": r"""select page_id, sum(n)::bigint as n_blocks from (select page_id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g') <> '')) as n
        from (select distinct page_id, content from crawled_pages where content is not null)) group by page_id""",
}
