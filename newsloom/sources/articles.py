"""Reading and writing article files and tables.

An article file is a text of lines ``key:<tab>value``. Unreadable files go to a quarantine column instead of failing the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from newsloom.functions import text as T

ARTICLE = TY.StructType(
    [TY.StructField(n, TY.StringType()) for n in ("id", "url", "time", "title", "theme")]
    + [TY.StructField("keywords", TY.ArrayType(TY.StringType())), TY.StructField("content", TY.StringType()), TY.StructField("source", TY.StringType())]
)
FIELDS = ("id", "url", "time", "title", "theme", "keywords", "content", "source")


def text_files(spark: SparkSession, path: str, suffix: str = "*.html", first: int = -1) -> DataFrame:
    """path, value: whole files below a folder, by suffix; ``first`` takes that many by path (a sampling argument)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    return files if first < 0 else files.orderBy("path").limit(first)


def _field(lines: Column, key: str) -> Column:
    line = F.get(F.filter(lines, lambda x: x.startswith(f"{key}:")), F.lit(0))
    return F.regexp_replace(line, f"^{key}:\\t?", "")


def parse_articles(files: DataFrame, legacy: bool = False) -> DataFrame:
    """path, the article's fields and ``corrupt``.

    By key: every field from the line that begins with its name; content goes on over lines up to the source line. Legacy: by position
    (blank lines dropped): with seven lines or more the sixth holds keywords and content is the rest of the seventh and all later
    lines (also the source line); with six there are no keywords; fewer are corrupt. A missing source is an empty text.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x != "")
    rows = files.withColumn("_l", lines)
    if legacy:
        cell = lambda i: F.try_element_at(F.split(F.get("_l", F.lit(i)), "\t"), F.lit(2))
        long = F.size("_l") >= 7
        rest = F.array_join(F.concat(F.array(F.regexp_replace(F.get("_l", F.lit(6)), r"^[^\t]*\t", "")), F.slice("_l", 8, 100_000)), "\n")
        words = F.filter(F.slice(F.split(F.get("_l", F.lit(5)), "\t"), 2, 1_000), lambda x: x != "")
        return rows.select(
            "path", *[cell(i).alias(n) for i, n in enumerate(FIELDS[:5])],
            F.when(long, words).otherwise(F.array().cast("array<string>")).alias("keywords"),
            F.when(long, rest).otherwise(cell(5)).alias("content"), F.lit("").alias("source"), (F.size("_l") < 6).alias("corrupt"),
        )
    content = F.regexp_extract("value", r"(?s)(?:^|\n)content:\t?(.*?)(?:\r?\nsource:[^\n]*)?\s*$", 1)
    words = F.filter(F.split(F.coalesce(_field(F.col("_l"), "keywords"), F.lit("")), "\t"), lambda x: x != "")
    bad = _field(F.col("_l"), "id").isNull() | ~F.exists("_l", lambda x: x.startswith("content:"))
    return rows.select(
        "path", *[_field(F.col("_l"), n).alias(n) for n in FIELDS[:5]], words.alias("keywords"), content.alias("content"),
        F.coalesce(_field(F.col("_l"), "source"), F.lit("")).alias("source"), bad.alias("corrupt"),
    )


def as_text(articles: DataFrame) -> DataFrame:
    """id, value: the article as a file's text."""
    cell = {n: F.coalesce(F.col(n), F.lit("")) for n in FIELDS if n != "keywords"}
    cell["keywords"] = F.coalesce(F.array_join("keywords", "\t"), F.lit(""))
    return articles.select("id", F.concat_ws("\n", *[F.concat(F.lit(f"{n}:\t"), cell[n]) for n in FIELDS]).alias("value"))


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by source, month and theme; a scan with these in its filter reads only their folders."""
    rows = articles.withColumn("ym", F.coalesce(T.year_month("time"), F.lit("unknown")))
    rows = rows.withColumn("theme", F.coalesce("theme", F.lit(""))).withColumn("source", F.coalesce("source", F.lit("")))
    rows.repartition("source", "ym", "theme").write.mode(mode).partitionBy("source", "ym", "theme").parquet(path)


def with_content_id(articles: DataFrame) -> DataFrame:
    """id = MD5 of the content; rows without content keep theirs."""
    return articles.withColumn("id", F.when(F.col("content").isNotNull() & (F.col("content") != ""), F.md5("content")).otherwise(F.col("id")))


def records(lines: DataFrame, stride: int = 6) -> DataFrame:
    """path, record, lines: text lines (path, number, value) of one file in records; a record begins at each line that starts with http.

    ``stride`` is the usual number of lines; records with one more have a title of two lines.
    """
    w = Window.partitionBy("path").orderBy("number")
    marked = lines.withColumn("record", F.sum(F.col("value").startswith("http").cast("int")).over(w)).where("record > 0")
    grouped = marked.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("l"))
    return grouped.select("path", "record", F.transform("l", lambda x: x["value"]).alias("lines"), (F.size("l") > stride).alias("wrapped"))


def long_lines(lines: DataFrame, longer_than: int = 5) -> DataFrame:
    """Lines whose length with the line end is above the bound."""
    return lines.where(F.length("value") + 1 > longer_than)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a text file, blanks at the ends removed, once each, empty ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def number_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """row, values: a text file of numbers, a line a row, numbered from 0 in the file's order; cells that are none become null."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("row", "line"))
    return lines.select("row", F.transform(F.split("line", separator), lambda x: F.trim(x).try_cast("double")).alias("values"))


def sharded(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """The records of ``path`` with a number of shard before its ending (a.0.json, a.1.json ...), else of the file itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    stem, dot, end = path.rpartition(".")
    shards = f"{stem}.[0-9]*{dot}{end}"
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.format(kind).load(shards if fs.globStatus(place(shards)) else path)


def first_lines(files: DataFrame) -> DataFrame:
    """id = path, time from the second line, content from the last line that isn't empty; files without content are left out."""
    l = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = files.select(F.col("path").alias("id"), F.get(l, F.lit(1)).alias("time"), F.try_element_at(l, F.lit(-1)).alias("content"))
    return rows.where("content is not null")


def annotations(lines: DataFrame) -> DataFrame:
    """path, sentence, sid, tokens (array of pos, token, id, type) of a tab-separated annotation export.

    Sentences begin at ``#Text=``; other lines hold number, offsets, token, identity and type. The sentence number is a running sum.
    """
    w = Window.partitionBy("path").orderBy("number")
    marked = lines.withColumn("sid", F.sum(F.col("value").startswith("#Text=").cast("int")).over(w)).where("sid > 0")
    text = F.max(F.when(F.col("value").startswith("#Text="), F.substring("value", 7, 1_000_000)))
    cells = F.split("value", "\t")
    token = F.when(~F.col("value").startswith("#") & (F.size(cells) >= 5), F.struct("number", F.get(cells, F.lit(2)).alias("token"), F.get(cells, F.lit(3)).alias("identity"), F.get(cells, F.lit(4)).alias("type")))
    grouped = marked.groupBy("path", "sid").agg(text.alias("sentence"), F.array_sort(F.collect_list(token)).alias("tokens"))
    return grouped.select("path", "sid", "sentence", "tokens")


def annotated_mentions(annotated: DataFrame) -> DataFrame:
    """path, sid, identity, type, start, end, form: runs of tokens with one identity; a run ends with its sentence.

    An identity ``*`` continues the token before; of ``a|b`` the first counts. ``_`` is none.
    """
    tokens = annotated.select("path", "sid", F.posexplode("tokens").alias("pos", "t")).select("path", "sid", "pos", "t.token", F.regexp_extract("t.identity", r"^([^|]*)", 1).alias("raw"), F.regexp_extract("t.type", r"^([^|]*)", 1).alias("type"))
    w = Window.partitionBy("path", "sid").orderBy("pos")
    filled = F.last(F.when(F.col("raw") != "*", F.col("raw")), ignorenulls=True).over(w)
    rows = tokens.withColumn("identity", F.coalesce(filled, F.lit("_")))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("token")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("run", F.sum((~F.lag("identity").over(w).eqNullSafe(F.col("identity"))).cast("int")).over(w))
    g = rows.where("identity <> '_'").groupBy("path", "sid", "run", "identity")
    return g.agg(F.min_by("type", "pos").alias("type"), F.min("start").alias("start"), F.max(F.col("start") + F.length("token")).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("form")).drop("run")
