"""Sources and sinks: the test tables written in each format and read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from catalog.common import documents, mention_cte, query, table
from catalog.keywords import EXTERNAL, FREQ_PHRASES, GRAMS, SECTION_SQL, WORDS, WORD_COUNTS, top_sql, unescape_sql, visible_sql
from lexigraph.functions import text as T
from lexigraph.operators import keywords as K
from lexigraph.session import scratch_path, spread
from lexigraph.sources import files, sinks
from lexigraph.sources.html import parse_pages
from lexigraph.streaming import ingest as stream

TURN_KEY = "conv_id * 1000 + turn"
KIND_SQL = "case turn % 3 when 0 then 'text' when 1 then 'json' else 'note' end"


def turn_episodes(spark, sf):
    """Conversation turns as raw episodes: text, JSON objects and an unknown type."""
    turn = F.col("turn") % 3
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"),
        F.when(turn == 1, F.to_json(F.struct("role", "text"))).otherwise(F.col("text")).alias("content"),
        F.when(turn == 0, "text").when(turn == 1, "json").otherwise("note").alias("type"),
        F.when(turn != 2, F.col("role")).alias("description"),
    )


EPISODE_SQL = f"""turns as (select {TURN_KEY} as episode_id, role, text, turn % 3 as t from conversations),
    episode as (
      select episode_id, case when t = 1 then role || ' ' || text else text end as body, case t when 1 then 'json' else 'text' end as type,
        case when t = 2 then 'No description' else role end as description from turns
    )"""


@query("src_episodes", f"with {EPISODE_SQL} select episode_id, type, description, body from episode")
def episodes(spark, sf):
    """Episodes as JSON lines in a fixed number of files, the form for large input."""
    path = scratch_path(spark, "episodes")
    turn_episodes(spark, sf).repartition(8, "episode_id").write.json(path)
    found = files.episodes(spark, path, multi_line=False)
    body = F.when(F.col("type") == "json", T.json_to_text(F.col("content"))).otherwise(F.col("content"))
    return found.select("episode_id", "type", "description", body.alias("body"))


def passage_files(spark, sf):
    """One text file per benchmark passage."""
    path = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    return path


@query(
    "src_text",
    """select item_id, text || chr(10) as text, length(text) - length(replace(text, chr(10), '')) + 1 as line_count,
       strlen(text) + 1 as file_size, 1 as pages from benchmark""",
)
def text(spark, sf):
    found = files.parsed_text(files.text_files(spark, passage_files(spark, sf) + "/*"))
    return found.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text",
        F.col("metadata.line_count").cast("long").alias("line_count"), F.col("metadata.file_size").alias("file_size"),
        F.size("pages").alias("pages"),
    )


@query(
    "validate_input",
    """select item_id, strlen(text) + 1 as length, true as valid, '' as error from benchmark
       union all select -1 - item_id, 0, false, 'File not found or invalid: gone-' || item_id from benchmark""",
)
def validate(spark, sf):
    """The file of every passage, found by its listing, and as many names that do not exist."""
    folder = passage_files(spark, sf)
    there = files.text_files(spark, folder + "/*").select("path", F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"))
    gone = there.select(F.concat(F.lit("gone-"), F.col("item_id").cast("string")).alias("path"))
    rows = files.validate(spark, folder, there.select("path").unionByName(gone))
    known = F.regexp_extract("path", r"item_id=(\d+)", 1).try_cast("long")
    lost = -1 - F.regexp_extract("path", r"gone-(\d+)", 1).try_cast("long")
    return rows.select(F.coalesce(known, lost).alias("item_id"), "length", "valid", F.coalesce("error", F.lit("")).alias("error"))


NOTE_SQL = "'said \"no\"; ' || s_name"
CSV_SQL = f"""line as (
      select 'supplier' as kind, s_suppkey as id, concat_ws(' | ', s_suppkey, s_name, s_nationkey, s_acctbal, {NOTE_SQL}) as line, 5 as cells from supplier
      union all select 'nation', n_nationkey, concat_ws(' | ', n_nationkey, n_name, n_regionkey), 3 from nation)"""


def csv_folder(spark, sf):
    """Suppliers and nations as CSV files with different headers in one folder."""
    path = scratch_path(spark, "csv")
    suppliers = table(spark, sf, "supplier").withColumn("note", F.concat(F.lit('said "no"; '), "s_name"))
    for kind, rows in (("supplier", suppliers), ("nation", table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))):
        rows.write.option("header", True).option("sep", ";").option("quote", "'").option("escape", "'").csv(f"{path}/kind={kind}")
    return path + "/*"


def kind_of(rows):
    return F.when(F.get("cells", F.lit(1)).startswith("Supplier"), "supplier").otherwise("nation")


@query("src_csv", f"with {CSV_SQL} select kind, id, line, cells from line")
def csv(spark, sf):
    """Every record with its own cells, whatever file it stands in."""
    rows = files.csv_lines(files.csv_rows(spark, csv_folder(spark, sf), delimiter=";", quotechar="'"), include_headers=False)
    return rows.select(kind_of(rows).alias("kind"), F.get("cells", F.lit(0)).cast("long").alias("id"), "line", F.size("cells").alias("cells"))


@query(
    "src_csv_tables",
    """select 's_suppkey,s_name,s_nationkey,s_acctbal,note' as headers, count(*) as row_count, 5 as column_count from supplier
       union all select 'n_nationkey,n_name,n_regionkey', count(*), 3 from nation""",
)
def csv_tables(spark, sf):
    """Header, rows and columns per file, summed over the files of one header."""
    tables = files.csv_tables(files.csv_rows(spark, csv_folder(spark, sf), delimiter=";", quotechar="'"), delimiter=";")
    return tables.groupBy(F.array_join("headers", ",").alias("headers"), "column_count").agg(F.sum("row_count").alias("row_count"))


@query(
    "src_pages_html",
    rf"""select page_id, {visible_sql(SECTION_SQL)} as text,
      trim(regexp_replace({unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) as title,
      array_to_string(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), ' ') as links,
      len(list_filter(list_transform(string_split(regexp_replace({SECTION_SQL}, '(?i)<(h[1-6][\s>])', chr(1) || '<\1', 'g'), chr(1)),
        lambda p: {visible_sql('p')}), lambda p: p <> '')) as sections
    from pages""",
)
def pages(spark, sf):
    rows = parse_pages(spread(table(spark, sf, "pages")))
    return rows.select(
        "page_id", "text", "metadata.title", F.array_join("metadata.links", " ").alias("links"),
        F.size("pages").cast("long").alias("sections"),
    )


@query("src_corpus", f"with {WORDS}, {EXTERNAL} select doc_id, keyword, round(score, 6) as score from tfidf")
def corpus(spark, sf):
    """The benchmark passages as a file of JSON strings, read back as the corpus of TF-IDF."""
    path = scratch_path(spark, "corpus")
    table(spark, sf, "benchmark").select(F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)").alias("value")).coalesce(4).write.text(path)
    listed = files.corpus(spark, path, lines=True)
    return K.tfidf(documents(spark, sf), corpus=listed).withColumn("score", F.round("score", 6))


KINDS_SQL = "['.txt', '.csv', '.PDF', '.xlsx', '.xls', '.ods', '.xlsm', '.text', '.doc']"


@query(
    "route_by_type",
    f"""with path as (
      select 'p' || page_id as id, url as path, '' as ext from pages
      union all select 'd' || doc_id, '/data/' || source || '/' || doc_id || {KINDS_SQL}[doc_id % 9 + 1], lower({KINDS_SQL}[doc_id % 9 + 1]) from documents)
    select id, path, case when ext = '' then 'url' when ext in ('.txt', '.text') then 'txt' when ext = '.csv' then 'csv' when ext = '.pdf' then 'pdf'
      when ext = '.doc' then null else 'spreadsheet' end as parser, case when ext = '.doc' then 'No parser available for file type: .doc' end as error from path""",
)
def route(spark, sf):
    kinds = F.array(*[F.lit(x) for x in (".txt", ".csv", ".PDF", ".xlsx", ".xls", ".ods", ".xlsm", ".text", ".doc")])
    urls = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path"))
    paths = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % 9).cast("int"))).alias("path"),
    )
    return files.route(urls.unionByName(paths))


RULE = "-" * 80


def rendered_sql(most: str) -> str:
    return f"""with line as (
      select l_orderkey, l_linestatus, row_number() over (partition by l_orderkey, l_linestatus order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as i,
        concat_ws(' | ', l_linenumber, l_partkey, cast(l_quantity as bigint), l_returnflag) as line from lineitem)
    select l_orderkey as source, l_linestatus as sheet, 0 as page, '=== Sheet: ' || l_linestatus || ' ===' || chr(10) || 'line | part | quantity | flag' || chr(10)
        || '{RULE}' || chr(10) || array_to_string(list(line order by i), chr(10)) as text from line {most} group by l_orderkey, l_linestatus"""


def order_sheets(spark, sf):
    """Order lines as sheets by status."""
    order = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.col("l_linestatus").alias("sheet"), (F.row_number().over(order) - 1).alias("row_idx"),
        F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag")).alias("cells"),
    )


@query("render_table_text", rendered_sql(""))
def render(spark, sf):
    """Whole sheets, page by page."""
    return files.render_tables(order_sheets(spark, sf), ["line", "part", "quantity", "flag"])


@query("render_table_text_first_rows", rendered_sql("where i < 3"))
def render_first(spark, sf):
    """Three rows per sheet."""
    return files.render_tables(order_sheets(spark, sf), ["line", "part", "quantity", "flag"], max_rows_per_sheet=3)


@query(
    "sink_keywords_json",
    f"""select doc_id, 'word_freq' as method, count(*) as num_keywords, array_to_string(list(keyword order by rank), '|') as keywords, round(max(score), 6) as best
        from ({top_sql(f"{WORDS}, {GRAMS}, {WORD_COUNTS}", "counted", FREQ_PHRASES, 10)}) group by doc_id""",
)
def keywords_json(spark, sf):
    path = scratch_path(spark, "keywords")
    options = replace(K.KeywordOptions(), method="word_freq")
    out = sinks.keywords_envelope(K.extract(documents(spark, sf), options=options), options)
    sinks.write_json(out, path)
    back = spark.read.schema(out.schema).json(path)
    return back.select(
        "doc_id", "method", F.col("num_keywords").cast("long").alias("num_keywords"),
        F.array_join(F.transform("keywords", lambda k: k["keyword"]), "|").alias("keywords"),
        F.round(F.array_max(F.transform("keywords", lambda k: k["score"])), 6).alias("best"),
    )


@query(
    "stream_ingest",
    f"""with {EPISODE_SQL}, {mention_cte('episode', 'episode_id', 'body')},
    counted as (select episode_id, count(*) as n from mention group by all)
    select episode_id, 'Episode ' || episode_id as name, type as source, description as source_description, coalesce(n, 0) as entity_count
    from episode left join counted using (episode_id)""",
)
def stream_ingest(spark, sf):
    """Episodes arrive as JSON files and are appended by a stream that stops when it has caught up."""
    arrivals, target, state = (scratch_path(spark, name) for name in ("arrivals", "ingested", "state"))
    turn_episodes(spark, sf).repartition(4, "episode_id").write.json(arrivals)
    stream.ingest(spark, arrivals, target, state, multi_line=False).awaitTermination()
    return spark.read.parquet(target).select(
        "episode_id", "name", "source", "source_description", F.col("entity_count").cast("long").alias("entity_count")
    )
