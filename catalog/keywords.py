"""Keyword statistics and extraction over all documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.common import documents, query, sents, table, tok
from catalog.text import TITLE_SQL, gram_sql
from lexigraph.operators import keywords as K
from lexigraph.plans.extract import keywords_of
from lexigraph.sources.html import parse_pages
from lexigraph.session import spread

OPTIONS = K.KeywordOptions()


def rounded(df, column="score"):
    return df.withColumn(column, F.round(column, 6))


# -- SQL: words ------------------------------------------------------------------

WORDS = f"""toks as (select doc_id, {tok('text')} as t from documents),
    word as (select doc_id, unnest(t) as keyword from toks),
    freq as (select doc_id, keyword, count(*) as tf from word group by all)"""

RANKED = f"""sens as (select doc_id, text, {sents('text')} as s from documents),
    sen as (select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as pos from sens where len(s) >= 2),
    sentok as (select doc_id, pos, {tok('sentence')} as t from sen),
    met as (select doc_id, unnest(list_distinct(t)) as keyword, len(list_distinct(t)) - 1 as met from sentok),
    hit as (select doc_id, unnest(t) as keyword from sentok),
    degree as (select doc_id, keyword, sum(met) as degree from met group by all),
    seen as (select doc_id, keyword, count(*) as n from hit group by all),
    textrank as (
      select doc_id, keyword, degree / (n + 1) as score from degree join seen using (doc_id, keyword)
      union all
      select doc_id, keyword, cast(tf as double) from freq where doc_id in (select doc_id from sens where len(s) < 2)
    )"""

PLACED = f"""place as (select doc_id, lower(s[1]) as first_sentence, len(s) > 0 as placed, {TITLE_SQL} as titles from sens)"""


def factor_sql(keyword: str) -> str:
    return (
        f"(case when contains(first_sentence, {keyword}) then 1.5 else 1.0 end"
        f" * case when len(list_filter(titles, lambda t: contains(t, {keyword}))) > 0 then 2.0 else 1.0 end)"
    )


TFIDF = """df as (select keyword, count(*) as df from freq group by all),
    weight as (
      select doc_id, keyword, tf * log2((select count(*) from documents) / df) as w from freq join df using (keyword)
    ),
    tfidf as (
      select * from (
        select doc_id, keyword, w / sqrt(sum(w * w) over (partition by doc_id)) as score from weight where abs(w) > 1e-12
      ) where abs(score) > 1e-12
    )"""

EXTERNAL = f"""ctok as (select item_id, {tok('text')} as t from benchmark),
    cdf as (select keyword, count(distinct item_id) as df from (select item_id, unnest(t) as keyword from ctok) group by all),
    weight as (
      select doc_id, keyword, tf * log2(((select count(*) from benchmark) + 1) / (coalesce(df, 0) + 1)) as w
      from freq left join cdf using (keyword)
    ),
    tfidf as (
      select * from (
        select doc_id, keyword, w / sqrt(sum(w * w) over (partition by doc_id)) as score from weight where abs(w) > 1e-12
      ) where abs(score) > 1e-12
    )"""

COMBINED = f"""every_key as (select doc_id, keyword from freq union select doc_id, keyword from textrank),
    top as (select doc_id, max(tf) as top from freq group by all),
    combined as (
      select * from (
        select doc_id, keyword,
          (1.0 * coalesce(tfidf.score, 0) + (0.5 * coalesce(textrank.score, 0) + 0.3 * (coalesce(tf, 0) / coalesce(top, 1))))
            * case when placed then 1.0 + 0.2 * ({factor_sql('keyword')} - 1.0) else 1.0 end as score
        from every_key left join tfidf using (doc_id, keyword) left join textrank using (doc_id, keyword)
          left join freq using (doc_id, keyword) left join top using (doc_id) join place using (doc_id)
      ) where score > 0
    )"""

NO_TFIDF = "tfidf as (select doc_id, keyword, 0.0 as score from freq where false)"

GRAMS = f"""grams as ({' union all '.join(gram_sql(n) for n in (2, 3, 4))}),
    gfreq as (select doc_id, n, gram as keyword, count(*) as tf from grams group by all)"""

GRAM_TFIDF = """gdf as (select n, keyword, count(*) as df from gfreq group by all),
    gweight as (
      select doc_id, n, keyword, tf * log2((select count(*) from documents) / df) as w from gfreq join gdf using (n, keyword)
    ),
    gtfidf as (
      select * from (
        select doc_id, n, keyword, w / sqrt(sum(w * w) over (partition by doc_id, n)) as score from gweight where abs(w) > 1e-12
      ) where abs(score) > 1e-12
    )"""


def top_sql(ctes: str, words: str, phrases: str | None, k: int) -> str:
    every = f"select doc_id, keyword, score, 'unigram' as type from {words}"
    if phrases:
        every += f" union all {phrases}"
    return f"""with {ctes}
    select doc_id, rank, keyword, round(score, 6) as score, type from (
      select *, row_number() over (partition by doc_id order by round(score, 9) desc, keyword) as rank from ({every})
    ) where rank <= {k}"""


FREQ_PHRASES = "select doc_id, keyword, tf * 1.2, n || '-gram' from gfreq"
TFIDF_PHRASES = "select doc_id, keyword, score * 1.2, n || '-gram' from gtfidf"


# -- queries ---------------------------------------------------------------------


@query("kw_word_freq", f"with {WORDS} select doc_id, keyword, cast(tf as double) as score from freq")
def word_freq(spark, sf):
    return K.word_freq(documents(spark, sf))


@query("kw_tfidf", f"with {WORDS}, {TFIDF} select doc_id, keyword, round(score, 6) as score from tfidf")
def tfidf_self(spark, sf):
    return rounded(K.tfidf(documents(spark, sf)))


@query("kw_tfidf_external", f"with {WORDS}, {EXTERNAL} select doc_id, keyword, round(score, 6) as score from tfidf")
def tfidf_external(spark, sf):
    return rounded(K.tfidf(documents(spark, sf), corpus=table(spark, sf, "benchmark")))


@query("kw_tfidf_top", top_sql(f"{WORDS}, {TFIDF}", "tfidf", None, 10))
def tfidf_top(spark, sf):
    options = replace(OPTIONS, enable_ngrams=False)
    return rounded(K.extract(documents(spark, sf), self_corpus=True, options=options)).withColumn("rank", F.col("rank").cast("long"))


@query("kw_textrank", f"with {WORDS}, {RANKED} select doc_id, keyword, round(score, 6) as score from textrank")
def textrank(spark, sf):
    return rounded(K.textrank(documents(spark, sf)))


@query(
    "kw_position",
    f"""with {WORDS}, {RANKED}, {PLACED}
    select doc_id, keyword, cast({factor_sql('keyword')} as double) as factor
    from (select distinct doc_id, keyword from word) join place using (doc_id) where placed""",
)
def position(spark, sf):
    return K.position(documents(spark, sf))


@query("kw_combined", f"with {WORDS}, {RANKED}, {PLACED}, {TFIDF}, {COMBINED} select doc_id, keyword, round(score, 6) as score from combined")
def combined(spark, sf):
    return rounded(K.combined(documents(spark, sf)))


@query("kw_ngram_freq", f"with {WORDS}, {GRAMS} select doc_id, n, keyword, cast(tf as double) as score from gfreq")
def ngram_freq(spark, sf):
    return K.ngram_freq(documents(spark, sf))


@query("kw_ngram_tfidf", f"with {WORDS}, {GRAMS}, {GRAM_TFIDF} select doc_id, n, keyword, round(score, 6) as score from gtfidf")
def ngram_tfidf(spark, sf):
    return rounded(K.ngram_tfidf(documents(spark, sf)))


def ranked(df):
    return rounded(df).withColumn("rank", F.col("rank").cast("long"))


@query("kw_extract", top_sql(f"{WORDS}, {RANKED}, {PLACED}, {TFIDF}, {COMBINED}, {GRAMS}", "combined", FREQ_PHRASES, 20))
def extract_combined(spark, sf):
    options = replace(OPTIONS, method="combined", num_keywords=20)
    return ranked(K.extract(documents(spark, sf), self_corpus=True, options=options))


@query("kw_extract_tfidf", top_sql(f"{WORDS}, {TFIDF}, {GRAMS}, {GRAM_TFIDF}", "tfidf", TFIDF_PHRASES, 10))
def extract_tfidf(spark, sf):
    return ranked(K.extract(documents(spark, sf), self_corpus=True, options=OPTIONS))


WORD_COUNTS = "counted as (select doc_id, keyword, cast(tf as double) as score from freq)"


@query("kw_extract_single", top_sql(f"{WORDS}, {GRAMS}, {WORD_COUNTS}", "counted", FREQ_PHRASES, 10))
def extract_single(spark, sf):
    """TF-IDF without a corpus: every text alone, which falls back to counts."""
    return ranked(K.extract(documents(spark, sf), options=OPTIONS))


@query("kw_extract_textrank", top_sql(f"{WORDS}, {RANKED}, {GRAMS}", "textrank", FREQ_PHRASES, 10))
def extract_textrank(spark, sf):
    return ranked(K.extract(documents(spark, sf), options=replace(OPTIONS, method="textrank")))


@query(
    "kw_list",
    f"""select doc_id, array_to_string(list(keyword order by rank), '|') as keywords from (
      {top_sql(f"{WORDS}, {GRAMS}, {WORD_COUNTS}", "counted", FREQ_PHRASES, 10)}) group by all""",
)
def keyword_list(spark, sf):
    lists = K.keyword_lists(K.extract(documents(spark, sf), options=replace(OPTIONS, method="word_freq")))
    return lists.select("doc_id", F.array_join("keywords", "|").alias("keywords"))


SECTION_SQL = r"""regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g')"""


def unescape_sql(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def visible_sql(column: str) -> str:
    text = unescape_sql(rf"regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


PAGES = f"documents as (select page_id as doc_id, {visible_sql(SECTION_SQL)} as text from pages)"


@query(
    "parse_then_keywords",
    top_sql(f"{PAGES}, {WORDS}, {RANKED}, {PLACED}, {NO_TFIDF}, {COMBINED}, {GRAMS}", "combined", FREQ_PHRASES, 20),
)
def parse_then_keywords(spark, sf):
    """Pages to text to keywords, each page for itself."""
    pages = parse_pages(spread(table(spark, sf, "pages")))
    return ranked(keywords_of(pages.select(F.col("page_id").alias("doc_id"), "text")))
