"""Queries over sources and sinks: what is written is read back, from folders beside the checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import graph, ranking, scoring as C, summaries as S, vectors as V
from newsloom.plans.entity_queries import _spans_sql
from newsloom.plans.event_queries import SQL as EVENT_SQL
from newsloom.plans.event_queries import _themes
from newsloom.plans.runtime import ensure_checkpoint_dir, table
from newsloom.plans.text_queries import _TIME
from newsloom.sources import articles as A
from newsloom.sources import pages as P
from newsloom.sources import sinks
from newsloom.streaming import incremental as I


def _folder(s: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/newsloom/{name}-{uuid.uuid4().hex}"


def stored_articles(s, d):
    """Articles written by source, month and theme, read back by these folders."""
    place = _folder(s, "articles")
    A.write_articles(table(s, d, "articles").select("id", "time", "theme", "source", "content"), place)
    back = s.read.schema("id string, time string, content string, source string, ym string, theme string").parquet(place)
    return back.groupBy(F.coalesce("source", F.lit("")).alias("source"), "ym").agg(F.count("*").alias("n"), F.count("content").alias("contents"))


def annotation_runs(s, d):
    """Stored sentences as an annotation export, a line for each character, read back as mentions."""
    rows = table(s, d, "tag_sequences").select("aid", "sidx", "sentence", "tags").distinct().where("sentence is not null and tags is not null and size(tags) > 0")
    rows = rows.withColumn("path", F.concat_ws("/", "aid", "sidx", F.md5(F.to_json(F.struct("sentence", "tags")))))
    kinds = F.array(*map(F.lit, "O PER PER ORG ORG LOC LOC REG REG OTH OTH".split()))
    kind = F.coalesce(F.get(kinds, F.col("tag")), F.lit("O"))
    tokens = rows.select("path", "sentence", F.posexplode("tags").alias("pos", "tag")).withColumn("kind", kind)
    identity = F.when(F.col("kind") == "O", "_").otherwise(F.concat("kind", F.lit("|x")))
    line = F.concat_ws("\t", F.concat(F.lit("1-"), F.col("pos") + 1), F.concat_ws("-", "pos", F.col("pos") + 1), F.substring(F.col("sentence"), F.col("pos") + 1, F.lit(1)), identity, F.col("kind"))
    lines = tokens.select("path", (F.col("pos") + 1).alias("number"), line.alias("value"))
    heads = rows.select("path", F.lit(0).alias("number"), F.concat(F.lit("#Text="), "sentence").alias("value"))
    found = A.annotated_mentions(A.annotations(heads.unionByName(lines)))
    part = F.split("path", "/")
    return found.select(F.get(part, F.lit(0)).alias("aid"), F.get(part, F.lit(1)).cast("int").alias("sidx"), F.col("form"), "type", "start", "end")


def file_records(s, d):
    """Files of six-line records, titles of more than twenty characters over two lines, cut into records again."""
    a = table(s, d, "articles").where("url is not null").groupBy("id").agg(F.min("url").alias("url"), F.min(F.coalesce("title", F.lit(""))).alias("title"))
    long = F.length("title") > 20
    lines = F.concat(F.array("url", F.substring("title", 1, 20)), F.when(long, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, ("time", "theme", "words", "text"))))
    order = F.row_number().over(Window.partitionBy("path").orderBy("id")) * 10
    rows = a.withColumn("path", F.substring("id", 1, 2)).withColumn("at", order).select("path", "at", F.posexplode(lines).alias("pos", "value"))
    found = A.records(rows.select("path", (F.col("at") + F.col("pos")).alias("number"), "value"))
    return found.groupBy("path").agg(F.count("*").alias("records"), F.sum(F.col("wrapped").cast("long")).alias("wrapped"), F.sum(F.size("lines")).alias("lines"))


def first_lines(s, d):
    """Texts as files: the second line that isn't empty as the time, the last as the content."""
    found = A.first_lines(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value")))
    return found.select("id", F.md5("time").alias("time"), F.md5("content").alias("content"))


def page_fields(s, d):
    """Pages with a head made of articles, read by the parser into articles."""
    a = table(s, d, "articles").where("content is not null and title is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("title", "time", "theme")])
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit("<html><head><title>"), safe("title"), F.lit("</title><meta name='keywords' content='a, "), F.coalesce("theme", F.lit("")), F.lit("'></head><body><time datetime='"),
        F.coalesce("time", F.lit("")), F.lit("'></time><p>"), F.col("id"), F.lit("<p>second</body></html>"),
    )
    found = P.page_articles(P.parsed_pages(a.select("id", html.alias("html")), "id").withColumnRenamed("id", "page"), "page")
    return found.select("page", F.col("id").alias("digest"), "time", F.array_join("keywords", "/").alias("keywords"), "content", "corrupt")


def links_of_day(s, d):
    """Addresses of crawled pages as the links of their sites, those of one day by address or date."""
    l = table(s, d, "crawled_pages").where("source is not null and url is not null").select("source", F.struct(F.col("url").alias("href"), F.date_format("fetched_at", "MM/dd").alias("text")).alias("l"))
    parsed = l.groupBy("source").agg(F.array_sort(F.collect_set("l")).alias("links"))
    return P.links_of_day(parsed, "2020-11-05", "source").select("source", "href")


def linked_pages(s, d):
    """Forms with several candidates as ambiguous pages, their formal names as links, one hop on."""
    a = table(s, d, "aliases").where("form is not null and formal is not null")
    pages = a.groupBy("form").agg(F.array_sort(F.collect_set("formal")).alias("links"))
    names = a.select(F.col("formal").alias("form")).distinct().join(pages.select("form"), "form", "left_anti").select("form", F.array().cast("array<string>").alias("links"))
    both = pages.unionByName(names).select(F.col("form").alias("title"), F.lit(None).cast("string").alias("description"), (F.size("links") > 1).alias("ambiguous"), "links")
    return P.linked_pages(both)


def appended(s, d):
    """Customers appended twice, the second time with suppliers' keys too: only new keys arrive."""
    place = _folder(s, "appended")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("what"))
    sinks.append_new(c, place, "key")
    sinks.append_new(c.unionByName(table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("order").alias("what"))).unionByName(table(s, d, "supplier").select((-1 - F.col("s_suppkey")).alias("key"), F.lit("supplier").alias("what"))), place, "key")
    return s.read.parquet(place).groupBy("what").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


def json_split(s, d):
    """Training rows in folders of JSON lines by the hash of their number."""
    place = _folder(s, "split")
    sinks.split_json(table(s, d, "el_training").select("sample_id", "form"), place, "sample_id")
    read = lambda part: s.read.schema("sample_id long, form string").json(f"{place}/{part}").withColumn("part", F.lit(part))
    return read("train").unionByName(read("test")).groupBy("part").agg(F.count("*").alias("n"), F.count("form").alias("forms"), F.sum("sample_id").alias("total"))


def versions(s, d):
    """Orders upserted into a versioned table in two batches, the second one twice; the latest row of each customer."""
    place = _folder(s, "table")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    t = sinks.VersionedTable(s, place, "o_custkey", "o_orderkey")
    t.upsert(o.where("o_orderkey % 2 = 0"), 0)
    for _ in range(2):
        t.upsert(o.where("o_orderkey % 2 = 1"), 1)
    return t.read().select("o_custkey", "o_orderkey", "o_totalprice")


def sharded_records(s, d):
    """Parts written as numbered files and read as one by the name without number."""
    place = _folder(s, "shards")
    p = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    for i in range(3):
        p.where(F.col("p_partkey") % 3 == i).coalesce(1).write.json(f"{place}/part.{i}.json")
    return A.sharded(s, f"{place}/part.json").groupBy("p_size").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))


def event_files(s, d):
    """Event documents as the texts of files."""
    docs = S.event_documents(_themes(s, d), table(s, d, "articles").select(F.col("id").alias("aid"), "content"))
    return C.event_document_text(docs).select("event_id", F.md5("value").alias("digest"))


def drawn_rows(s, d):
    """A draw of documents by seed, those in English of it first (a sampling operator)."""
    rows = table(s, d, "documents").select("doc_id", "lang")
    return ranking.sample_rows(rows, 500, 50, F.col("lang") == "en", 7, "doc_id").select("doc_id")


def dense_cosine(s, d):
    """Cosine of each vector with the next one."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


def base_items(s, d):
    """Entities as items of a knowledge base in JSON, read back as nodes; every class in turn."""
    e = table(s, d, "entities").select("eid", "etype", "name", "summary", F.pmod(F.conv(F.substring(F.md5("eid"), 1, 8), 16, 10).cast("long"), F.lit(len(CLASSES))).cast("int").alias("k"))
    kind = F.get(F.array(*map(F.lit, CLASSES)), F.col("k"))
    claims = F.map_from_entries(F.filter(F.array(F.when(kind != "", F.struct(F.lit("P31").alias("k"), F.array(kind).alias("v"))), F.when(F.col("k") % 3 == 0, F.struct(F.lit("P856").alias("k"), F.array(F.concat(F.lit("https://"), "eid"), F.lit("b")).alias("v")))), lambda x: x.isNotNull()))
    label = F.when(F.col("k") % 4 != 1, F.col("name"))
    value = F.to_json(F.struct(label.alias("label"), F.col("summary").alias("description"), claims.alias("claims")))
    return graph.base_items(e.select("eid", F.concat(F.lit("form of "), "eid").alias("form"), value.alias("value")))


def event_stream(s, d):
    """Events as a stream that is run over what has arrived, counted by day and type."""
    place, rows = _folder(s, "stream"), table(s, d, "events")
    stream = s.readStream.schema(rows.schema).parquet(f"{d}/events.parquet".rsplit("/", 1)[0] + "/events.parquet*")
    out = f"{place}/out"
    I.run_available(I.event_counts(stream, "1 day"), lambda batch, _: batch.write.mode("overwrite").parquet(out), f"{place}/state", "complete")
    return s.read.parquet(out)


#: Classes of items: persons, regions, every class of places, an ambiguous one, a body, none.
CLASSES = (*graph.PERSON_CLASSES, *graph.REGION_CLASSES, *graph.PLACE_CLASSES, graph.AMBIGUOUS_CLASS, "Q43229", "")

QUERIES = {
    f.__name__: f
    for f in (
        stored_articles, annotation_runs, file_records, first_lines, page_fields, links_of_day, linked_pages, appended, json_split, versions, sharded_records,
        event_files, drawn_rows, dense_cosine, base_items, event_stream,
    )
}



def _any(values) -> str:
    return f"list_contains([{', '.join(repr(c) for c in values)}], kind)"


SQL = {
    "stored_articles": f"select coalesce(source, '') as source, coalesce(substr({_TIME}, 1, 7), 'unknown') as ym, count(*) as n, count(content) as contents from articles group by 1, 2",
    "annotation_runs": f"""select aid, sidx, form, type, start, "end" from ({_spans_sql("true")})""",
    "file_records": """select substr(id, 1, 2) as path, count(*) as records, sum((length(title) > 20)::int)::bigint as wrapped, sum(6 + (length(title) > 20)::int)::bigint as lines
        from (select id, min(coalesce(title, '')) as title from articles where url is not null group by id) group by 1""",
    "first_lines": r"""select id, md5(l[2]) as time, md5(l[-1]) as content from (select doc_id::varchar as id, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ') <> '') as l from documents) where l[-1] is not null""",
    "page_fields": rf"""select id as page, md5(id || '\n' || 'second') as digest, {_TIME} as time, array_to_string(list_filter(['a', trim(coalesce(theme, ''))], lambda x: x <> ''), '/') as keywords, id || '\n' || 'second' as content, false as corrupt
        from (select id, min(title) as title, min(time) as time, min(theme) as theme from articles where content is not null and title is not null group by id)""",
    "links_of_day": r"""select distinct source, url as href from crawled_pages where source is not null and regexp_matches(concat_ws(' ', url, strftime(fetched_at, '%m/%d')), '(^|[^0-9])(2020[-/.]?)?11[-/.]?05([^0-9]|$)')""",
    "linked_pages": """with a as (select form, formal from aliases where form is not null and formal is not null), p as (select form, count(distinct formal) as n from a group by form)
        select distinct a.form as "from", a.formal as target from a join p using (form) where p.n > 1 and a.form <> a.formal""",
    "appended": """select 'customer' as what, count(*) as n, sum(c_custkey)::bigint as total from customer union all select 'supplier', count(*), sum(-1 - s_suppkey)::bigint from supplier
        union all select 'order', count(*), sum(o_custkey)::bigint from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer)) having count(*) > 0""",
    "json_split": """select case when ('0x' || substr(md5(sample_id::varchar), 1, 8))::bigint % 5 = 0 then 'test' else 'train' end as part, count(*) as n, count(form) as forms, sum(sample_id)::bigint as total from el_training group by 1""",
    "versions": "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey",
    "sharded_records": "select p_size, count(*) as n, sum(p_partkey)::bigint as total from part group by p_size",
    "event_files": EVENT_SQL["event_documents"].replace("length(c)::int as n, md5(c) as digest", r"md5(concat_ws(chr(10), 'eventID', event_id, 'content', c)) as digest"),
    "drawn_rows": "select doc_id from (select doc_id, lang, md5('7:' || doc_id) as r from documents order by r, doc_id limit 500) where lang = 'en' order by r, doc_id limit 50",
    "dense_cosine": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "base_items": f"""with e as (select eid, name, summary, ('0x' || substr(md5(eid), 1, 8))::bigint % {len(CLASSES)} as k from entities), c as (select *, {list(CLASSES)}[k + 1] as kind from e)
        select eid, case when k % 4 <> 1 and name <> '' then name else 'form of ' || eid end as name, case when kind = '' then null when {_any(graph.PERSON_CLASSES)} then 'PER' when {_any(graph.REGION_CLASSES)} then 'REG'
        when {_any(graph.PLACE_CLASSES)} then 'LOC' when kind = '{graph.AMBIGUOUS_CLASS}' then null else 'ORG' end as etype, summary, case when k % 3 = 0 then 'https://' || eid end as website from c""",
    "event_stream": EVENT_SQL["event_counts"],
}
