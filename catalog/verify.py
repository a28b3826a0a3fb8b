"""Verification requests and verdicts over all documents.

Answers are derived from the mentions themselves, in the forms an outside
service would send them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import mention_cte, query, quoted, sentence_cte
from catalog.entities import DATED, dated_orders, weight_sql
from lexigraph.functions import constants as C, entities as E
from lexigraph.operators import verify as V

MENTIONS = mention_cte("documents", "doc_id", "text")
PER, DATE = (quoted(f"- {k}: {C.ENTITY_DESCRIPTIONS[k]}") for k in ("PER", "DATE"))


@query(
    "verify_requests",
    f"""with {DATED}, {sentence_cte('dated', 'o_orderkey', 'text')},
    placed as (select *, row_number() over (partition by o_orderkey order by idx) - 1 as pos from sent),
    keyed as (select o_orderkey || ':' || pos as sid, text from placed),
    {mention_cte('keyed', 'sid', 'text')},
    located as (
      select p.o_orderkey, pos // 2 as block_index, pos, m.*, p.text as sent from mention m join placed p on m.sid = p.o_orderkey || ':' || p.pos
    ),
    block as (select o_orderkey, pos // 2 as block_index, array_to_string(list(text order by pos), ' ') as block_text from placed group by all)
    select o_orderkey, block_index,
      'Entity type definitions:' || case when bool_or(type = 'DATE') then chr(10) || {DATE} else '' end || case when bool_or(type = 'PER') then chr(10) || {PER} else '' end as definitions,
      '[' || array_to_string(list('{{"text":"' || text || '","type":"' || type || '","sent":"' || sent || '","verified":false}}' order by pos, pass, n), ',') || ']' as entities_json,
      any_value(block_text) as block_text
    from located join block using (o_orderkey, block_index) group by o_orderkey, block_index""",
)
def requests(spark, sf):
    rows = V.requests(dated_orders(spark, sf), "o_orderkey", blocksize=2)
    return rows.select("o_orderkey", F.col("block_index").cast("long").alias("block_index"), "definitions", "entities_json", "block_text")


def _found(docs):
    return docs.withColumn("entities", E.pattern_mentions(F.col("text")))


def json_answers(spark, sf):
    """Answers as prose around a JSON array with a trailing comma; years are struck out, some under the other key."""
    docs = _found(dated_orders(spark, sf).withColumnRenamed("o_orderkey", "doc_id"))
    item = lambda m: F.concat(
        F.when(m["type"] == "PER", F.lit('{"entity": "')).otherwise(F.lit('{"text": "')), F.upper(m["text"]), F.lit('", "type": "'),
        F.when(F.length(m["text"]) == 4, "REMOVE").otherwise(m["type"]),
        F.when(F.length(m["text"]) == 4, F.lit('", "verified": false, "reasoning": "just a year"}')).otherwise(F.lit('", "reasoning": "found it"},'[:-1])),
    )
    body = F.concat(F.lit("Here you are:\n[ "), F.array_join(F.transform("entities", item), ", "), F.lit(",\n]\nDone."))
    return docs.withColumn("response", body)


@query(
    "verify_parse_json",
    f"""with {DATED}, {mention_cte('dated', 'o_orderkey', 'text')}
    select o_orderkey as doc_id, upper(text) as text, case when length(text) = 4 then 'REMOVE' else type end as type, length(text) <> 4 as verified,
      case when length(text) = 4 then 'just a year' else 'found it' end as reasoning from mention""",
)
def parse_json(spark, sf):
    rows = json_answers(spark, sf).select("doc_id", F.inline(V.json_verdicts(F.col("response"))))
    return rows.select("doc_id", "text", "type", "verified", "reasoning")


def markdown_answers(spark, sf):
    """Answers as a headed list: own names in full or in part, and one entity of the service's own."""
    docs = _found(dated_orders(spark, sf).withColumnRenamed("o_orderkey", "doc_id"))
    of = lambda kind: F.array_join(
        F.transform(F.filter("entities", lambda m: m["type"] == kind), lambda m: F.concat(F.lit("*   "), m["text"], F.lit(" (seen)"))), "\n"
    )
    body = F.concat(F.lit("I checked.\n**People (PER)**\n"), of("PER"), F.lit("\n- Anna\n\n**Dates (DATE)**\n"), of("DATE"),
                    F.lit("\n**Places (LOC)**\n- Order Desk "), F.col("doc_id").cast("string"))
    return docs.withColumn("response", body)


@query(
    "verify_parse_markdown",
    f"""with {DATED}, {mention_cte('dated', 'o_orderkey', 'text')},
    numbered as (select o_orderkey as doc_id, text, type, row_number() over (partition by o_orderkey order by pass, n) as ord from mention),
    listed as (
      select doc_id, text as item, type, ord as line from numbered
      union all select distinct doc_id, 'Anna', 'PER', -1 from numbered
      union all select distinct doc_id, 'Order Desk ' || doc_id, 'LOC', -2 from numbered
    ),
    hit as (
      select listed.doc_id, item, listed.type, line, arg_min(n.text, ord) as original from listed left join numbered n
        on n.doc_id = listed.doc_id and (contains(lower(n.text), lower(item)) or contains(lower(item), lower(n.text))) group by all
    )
    select doc_id, coalesce(original, item) as text, type, case when original is null then 0.8 else 1.0 end::double as confidence from hit""",
)
def parse_markdown(spark, sf):
    rows = V.parse_responses(markdown_answers(spark, sf))
    return rows.select("doc_id", "text", "type", "confidence")


@query(
    "verify_apply",
    f"""with {DATED}, {mention_cte('dated', 'o_orderkey', 'text')},
    judged as (select o_orderkey as doc_id, text, type, pass * 1000000 + n as ord, length(text) <> 4 or starts_with(text, '  ') as own from mention),
    texts as (select doc_id, text from judged where own),
    ordered as (
      select *, exists (select 1 from texts t where t.doc_id = j.doc_id and lower(t.text) = lower(j.text))
        or (j.type = 'DATE' and exists (select 1 from texts t where t.doc_id = j.doc_id and contains(lower(t.text), lower(j.text)))) as matched
      from judged j
    ),
    summed as (
      select doc_id, lower(text) as k, sum(w) as score, arg_min(text, ord) as keyword, arg_min(type, ord) as type, min(ord) as ord, bool_or(matched) as matched
      from (select *, {weight_sql('type', 'text')} as w from ordered) group by all
    ),
    best as (select *, row_number() over (partition by doc_id order by round(score, 4) desc, ord) as rank from summed)
    select doc_id, rank, keyword, round(least(round(score, 4) / first_value(round(score, 4)) over (partition by doc_id order by rank), 1.0), 4) as score, type,
      case when matched then 'verified' else 'Not verified' end as status,
      case when matched then 'found it' else 'Not verified by LLM model LLM - using original classification (' || type || ')' end as reasoning
    from best where rank <= 20""",
)
def apply(spark, sf):
    """Verdicts on every order's text; struck-out years come back as not verified unless a kept date contains them."""
    answers = json_answers(spark, sf).select("doc_id", V.json_verdicts(F.col("response")).alias("verdicts"))
    docs = dated_orders(spark, sf).withColumnRenamed("o_orderkey", "doc_id")
    return V.apply_verdicts(docs, answers).withColumn("rank", F.col("rank").cast("long"))


@query(
    "ner_keywords_deep_verified",
    f"""with {DATED}, {sentence_cte('dated', 'o_orderkey', 'text')},
    keyed as (select o_orderkey || ':' || idx as sid, text from sent),
    {mention_cte('keyed', 'sid', 'text')},
    ordered as (
      select cast(split_part(sid, ':', 1) as bigint) as doc_id, cast(split_part(sid, ':', 2) as bigint) as place, text, type,
             cast(split_part(sid, ':', 2) as bigint) * 10000000 + pass * 1000000 + n as ord, length(text) <> 4 as matched from mention
    ),
    summed as (
      select doc_id, lower(text) as k, sum(w) as score, arg_min(text, ord) as keyword, arg_min(type, ord) as type, min(ord) as ord, bool_or(matched) as matched, list(place) as places
      from (select *, {weight_sql('type', 'text')} as w from ordered) group by all
    ),
    best as (select *, row_number() over (partition by doc_id order by round(score, 4) desc, ord) as rank from summed)
    select doc_id, rank, keyword, round(least(round(score, 4) / first_value(round(score, 4)) over (partition by doc_id order by rank), 1.0), 4) as score, type,
      case when matched then 'verified' else 'Not verified' end as status,
      case when matched then 'found it' else 'Not verified by LLM model LLM - using original classification (' || type || ')' end as reasoning,
      array_to_string(list_sort(list_distinct(places)), ',') as sentence_indices
    from best where rank <= 20""",
)
def apply_deep(spark, sf):
    """Verdicts per sentence block, texts in capitals; struck-out years come back as not verified."""
    docs = dated_orders(spark, sf).withColumnRenamed("o_orderkey", "doc_id")
    found = docs.select("doc_id", F.explode(E.mentions_in_sentences(F.col("text"))).alias("m"))
    year = F.length("m.text") == 4
    verdict = F.struct(
        F.upper("m.text").alias("text"), F.when(year, "REMOVE").otherwise(F.col("m.type")).alias("type"), (~year).alias("verified"),
        F.when(year, "just a year").otherwise("found it").alias("reasoning"),
    )
    blocks = found.groupBy("doc_id", F.floor(F.col("m.sentence_index") / 2).alias("block_index")).agg(F.collect_list(verdict).alias("verdicts"))
    rows = V.apply_verdicts(docs, blocks, deep=True)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("sentence_indices", F.array_join("sentence_indices", ","))
