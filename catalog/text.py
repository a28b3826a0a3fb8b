"""Text scalars over whole documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import PUNCT, STOP, WS, documents, query, sentence_cte, sents, table, tok
from lexigraph.functions import text as T
from lexigraph.operators import phrases as P


@query("txt_strip_tags", "select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("txt_strip_punct", f"select doc_id, translate(text, {PUNCT}, '') as text from documents")
def strip_punct(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_punct(F.col("text")).alias("text"))


@query("txt_strip_numeric", r"select doc_id, regexp_replace(text, '\d+', '', 'g') as text from documents")
def strip_numeric(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_numeric(F.col("text")).alias("text"))


@query(
    "txt_stopwords",
    rf"""select doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'),
         lambda w: w <> '' and lower(w) not in ({STOP}, 'les', 'und')), ' ') as text from documents""",
)
def stopwords(spark, sf):
    kept = T.drop_stopwords(T.words(F.col("text")), T.stopword_set(["Les", "und"]))
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("text"))


@query(
    "txt_strip_short",
    r"""select doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'),
        lambda w: length(w) between 3 and 50), ' ') as text from documents""",
)
def strip_short(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.keep_lengths(T.words(F.col("text"))), " ").alias("text"))


@query("tokenize", f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {tok('text')} as t from documents)")
def tokenize(spark, sf):
    docs = documents(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


COMMON = "'a', 'an', 'the', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'can', 'should', 'will', 'would'"


def gram_sql(n: int) -> str:
    """Rows (doc_id, pos, gram) of acceptable n-grams from a CTE ``toks(doc_id, t)``."""
    parts = ", ".join(f"t[i + {j}]" for j in range(n))
    rules = f"length(gram) between {3 * n} and {50 * n}"
    if n == 2:
        rules += (
            f" and not (a in ({STOP}) and b in ({STOP})) and not (a in ({COMMON}) and length(b) <= 4)"
            f" and b not in ({COMMON}) and length(a) >= 3 and length(b) >= 3"
        )
    else:
        rules += "".join(f" and t[i + {j}] not in ({STOP})" for j in range(1, n - 1))
    return f"""select doc_id, {n} as n, i as pos, gram from (
        select doc_id, t, i, concat_ws(' ', {parts}) as gram, t[i] as a, t[i + 1] as b
        from (select doc_id, t, unnest(range(1, len(t) - {n} + 2)) as i from toks)) where {rules}"""


@query(
    "ngrams",
    f"""with toks as (select doc_id, {tok('text')} as t from documents),
    grams as ({' union all '.join(gram_sql(n) for n in (2, 3, 4))})
    select doc_id, n, gram as ngram, count(*) as occurrences from grams group by all""",
)
def ngrams(spark, sf):
    """Counted in the row; only where rows share a doc_id are counts added up."""
    docs = documents(spark, sf)
    lists = docs.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    rows = P.counts(lists, "doc_id", P.Rules((2, 3, 4), 3, 50)).select("doc_id", "n", F.col("keyword").alias("ngram"), F.col("tf").alias("occurrences"))
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "n", "ngram").agg(F.sum("occurrences").alias("occurrences"))


@query(
    "sentences_kw",
    f"""select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as sentence
        from (select doc_id, {sents('text')} as s from documents)""",
)
def sentences_kw(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")
    ).withColumn("pos", F.col("pos").cast("long"))


@query(
    "sentences_idx",
    f"""with {sentence_cte('documents', 'doc_id', 'text')}
    select doc_id, text, idx as sentence_index, cast(start as bigint) as start_char, cast(stop as bigint) as end_char from sent""",
)
def sentences_idx(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.inline(T.indexed_sentences(F.col("text"))))
    return docs.select(
        "doc_id", "text", F.col("index").cast("long").alias("sentence_index"),
        F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"),
    )


@query(
    "chunk_text",
    f"""with recursive src as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents),
    para as (select doc_id, string_split(text, chr(10) || chr(10)) as p from src where length(text) > 5000),
    walk as (
      select doc_id, p, 1 as i, 0 as page, p[1] || chr(10) || chr(10) as cur, false as closed, '' as done from para
      union all
      select doc_id, p, i + 1,
             case when length(cur) + length(p[i + 1]) <= 5000 then page else page + 1 end,
             case when length(cur) + length(p[i + 1]) <= 5000 then cur || p[i + 1] || chr(10) || chr(10) else p[i + 1] || chr(10) || chr(10) end,
             length(cur) + length(p[i + 1]) > 5000, cur
      from walk where i < len(p)
    ),
    out as (
      select doc_id, page - 1 as page, done as text from walk where closed
      union all select doc_id, page, cur from walk where i = len(p)
      union all select doc_id, 0, text from src where length(text) <= 5000
    )
    select doc_id, page, case when exists (select 1 from para where para.doc_id = out.doc_id) then trim(text, {WS}) else text end as page_text from out""",
)
def chunk_text(spark, sf):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return documents(spark, sf).select("doc_id", F.posexplode(T.chunk_text(text)).alias("page", "page_text"))


@query(
    "json_to_text",
    """select event_id, concat_ws(' ', case when json_extract_string(props, '$.k') <> '0' then json_extract_string(props, '$.k') end) as text from events""",
)
def json_to_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.json_to_text(F.col("props")).alias("text"))


TITLE_SQL = f"""list_transform(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda l: trim(l, {WS})),
    lambda l: l <> '' and length(l) < 100 and ((upper(l) = l and lower(l) <> l) or starts_with(l, '#'))), lambda l: lower(l))"""


@query(
    "title_lines",
    f"""with src as (select doc_id, source || chr(10) || upper(replace(split_part(text, chr(10), 1), 'ß', 'ss')) || chr(10) || '# ' || lang || chr(10) || text as text from documents)
    select doc_id, array_to_string({TITLE_SQL}, '|') as titles from src""",
)
def title_lines(spark, sf):
    """Headings of documents under a made heading block: source, shouted first line, marked language."""
    first = F.replace(F.substring_index(F.col("text"), "\n", 1), F.lit("ß"), F.lit("ss"))
    headed = F.concat_ws("\n", "source", F.upper(first), F.concat(F.lit("# "), "lang"), F.col("text"))
    return documents(spark, sf, "source", "lang").select("doc_id", F.array_join(T.title_lines(headed), "|").alias("titles"))


@query("snippet", "select doc_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as summary from documents")
def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", T.snippet(F.col("text")).alias("summary"))


MENTION_TEXT = "url || ' ' || chr(34) || 'page ' || page_id || '.pdf' || chr(34) || ', /data/' || page_id || '.csv; file=/in/' || page_id || '.xlsx see ' || html"


@query(
    "extract_urls",
    rf"""with src as (select page_id, {MENTION_TEXT} as t from pages),
    found as (
      select page_id, list_distinct(
        regexp_extract_all(t, 'https?://[^\s<>"{{}}|\\^`\[\]]+')
        || list_transform(regexp_extract_all(t, '["'']([^"'']*[^"'']+\.{T._EXT})["'']', 1), lambda x: trim(x))
        || list_transform(regexp_extract_all(t, '(?:^|[\s,=(\[{{<:|"''`])(/[^\s,/][^\s,]*\.{T._EXT})', 1), lambda x: rtrim(x, '.,;'))
        || list_transform(list_filter(regexp_extract_all(t, '([^\s,]+\.{T._EXT})', 1),
             lambda x: not contains(x, '://') and not starts_with(x, 'http')), lambda x: rtrim(x, '.,;'))) as links from src)
    select page_id, unnest(links) as link from found""",
)
def extract_urls(spark, sf):
    """Links in pages that also mention a quoted and an absolute file name."""
    text = F.concat(
        "url", F.lit(' "page '), F.col("page_id").cast("string"), F.lit('.pdf", /data/'), F.col("page_id").cast("string"),
        F.lit(".csv; file=/in/"), F.col("page_id").cast("string"), F.lit(".xlsx see "), "html",
    )
    return table(spark, sf, "pages").select("page_id", F.explode(T.extract_links(text)).alias("link"))
