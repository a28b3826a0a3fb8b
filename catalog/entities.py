"""Mentions, enriched episodes and entity keywords over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import documents, mention_cte, quoted, query, sentence_cte, table
from lexigraph.functions import constants as C, entities as E
from lexigraph.operators import entities as O, gazetteer as G
from lexigraph.session import spread

MENTIONS = mention_cte("documents", "doc_id", "text")
ORDERED = "ordered as (select *, row_number() over (partition by doc_id order by pass, n) as ord from mention)"


@query(
    "ner_pattern",
    f"with {MENTIONS} select doc_id, text, type, cast(start as bigint) as start_char, cast(stop as bigint) as end_char from mention",
)
def pattern(spark, sf):
    return O.mentions(documents(spark, sf)).select(
        "doc_id", "text", "type", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char")
    )


DATED = """dated as (select o_orderkey, 'Clerk Anna Maria took it. Placed ' || strftime(o_orderdate, '%B %d, %Y') || ' for customer ' || o_custkey || '; due in '
    || (year(o_orderdate) + 1) || '.' as text from orders)"""


def dated_orders(spark, sf):
    """Orders told as sentences, so that names, full dates and years occur."""
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(
        "o_orderkey",
        F.concat(
            F.lit("Clerk Anna Maria took it. Placed "), F.date_format("o_orderdate", "MMMM dd, yyyy"), F.lit(" for customer "),
            F.col("o_custkey").cast("string"), F.lit("; due in "), (F.year("o_orderdate") + 1).cast("string"), F.lit("."),
        ).alias("text"),
    )


@query(
    "ner_pattern_dates",
    f"""with {DATED}, {mention_cte('dated', 'o_orderkey', 'text')}
    select o_orderkey, text, type, cast(start as bigint) as start_char, cast(stop as bigint) as end_char from mention""",
)
def pattern_dates(spark, sf):
    return O.mentions(dated_orders(spark, sf), "o_orderkey").select(
        "o_orderkey", "text", "type", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char")
    )


LABELS = "('PERSON', 'GPE', 'FACILITY', 'ORGANIZATION', 'NORP', 'CUSTOM')"
LABEL_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in C.ENTITY_TYPE_BY_LABEL.items())


@query(
    "ner_label_map",
    f"""with named as (select c_custkey, case c_custkey % 6 when 0 then 'PERSON' when 1 then 'GPE' when 2 then 'FACILITY'
        when 3 then 'ORGANIZATION' when 4 then 'NORP' else c_mktsegment end as label from customer)
    select c_custkey, label, case label {LABEL_CASES} else label end as type from named""",
)
def label_map(spark, sf):
    label = F.get(F.array(*[F.lit(x) for x in ("PERSON", "GPE", "FACILITY", "ORGANIZATION", "NORP")]), (F.col("c_custkey") % 6).cast("int"))
    named = table(spark, sf, "customer").select("c_custkey", F.coalesce(label, F.col("c_mktsegment")).alias("label"))
    return named.withColumn("type", E.entity_type(F.col("label")))


@query(
    "ner_context",
    f"""with {MENTIONS}, {sentence_cte('documents', 'doc_id', 'text')},
    around as (select *, lag(text) over (partition by doc_id order by idx) as previous, lead(text) over (partition by doc_id order by idx) as following from sent)
    select m.doc_id, m.text, m.type, cast(m.start as bigint) as start_char, s.idx as sentence_index,
      trim(substr(d.text, cast(greatest(m.start - 100, 0) + 1 as bigint), cast(least(m.start, 100) as bigint))) as before,
      trim(substr(d.text, cast(m.stop + 1 as bigint), 100)) as after, s.text as sentence,
      concat_ws(' ', s.previous, s.text, s.following) as extended,
      case m.type when 'PER' then {quoted(C.ENTITY_DESCRIPTIONS['PER'])} else {quoted(C.ENTITY_DESCRIPTIONS['DATE'])} end as description
    from mention m join documents d using (doc_id) join around s on s.doc_id = m.doc_id and m.start >= s.start and m.start < s.stop""",
)
def context(spark, sf):
    rows = O.mentions_with_context(documents(spark, sf))
    return rows.select(
        "doc_id", "text", "type", F.col("start").cast("long").alias("start_char"), F.col("sentence_index").cast("long").alias("sentence_index"),
        "context.before", "context.after", "context.sentence", "context.extended", "context.description",
    )


EPISODES = """episodes as (select doc_id, case when doc_id % 3 = 0 then 'json' else 'text' end as type, text as plain from documents)"""


def episodes(spark, sf):
    """Documents as episodes; every third one is a JSON object around its text."""
    docs = documents(spark, sf, "lang")
    as_json = F.to_json(F.struct("lang", F.col("text").alias("body"), F.lit(False).alias("draft")))
    is_json = F.col("doc_id") % 3 == 0
    return docs.select(
        F.col("doc_id").alias("episode_id"),
        F.when(is_json, as_json).otherwise(F.col("text")).alias("content"),
        F.when(is_json, "json").otherwise("text").alias("type"),
    )


TAGGED = """tagged as (select doc_id, case when doc_id % 3 = 0 then lang || ' ' || text else text end as text from documents)"""
GROUPED = """distinct_mention as (select doc_id, type, text, min(pass * 1000000 + n) as first from mention group by all),
    by_type as (select doc_id, type, list(text order by first) as texts, min(first) as first from distinct_mention group by all)"""


@query(
    "ner_enrich",
    f"""with {TAGGED}, {mention_cte('tagged', 'doc_id', 'text')}, {GROUPED},
    summed as (select doc_id, array_to_string(list(type || '=' || array_to_string(texts, ',') order by first), ';') as entities_by_type from by_type group by all),
    counted as (select doc_id, count(*) as n from mention group by all)
    select doc_id as episode_id, coalesce(n, 0) as entity_count, coalesce(entities_by_type, '') as entities_by_type
    from documents left join counted using (doc_id) left join summed using (doc_id)""",
)
def enrich(spark, sf):
    rows = O.enrich(episodes(spark, sf))
    shown = F.array_join(
        F.transform(F.map_entries("entities_by_type"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";"
    )
    return rows.select("episode_id", F.col("entity_count").cast("long").alias("entity_count"), shown.alias("entities_by_type"))


@query(
    "ner_annotate",
    f"""with {MENTIONS}, {GROUPED},
    note as (
      select doc_id, array_to_string(list(type || ': ' || array_to_string(texts[1:5], ', ') ||
             case when len(texts) > 5 then ' (+' || (len(texts) - 5) || ' more)' else '' end order by type), '; ') as note
      from by_type group by all
    )
    select doc_id, case when note is null then text else text || chr(10) || chr(10) || '[ENTITIES: ' || note || ']' end as enriched_content
    from documents left join note using (doc_id)""",
)
def annotate(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("content"), F.lit("text").alias("type"))
    return O.annotate(O.enrich(docs)).select("doc_id", "enriched_content")


def weight_sql(kind: str, text: str) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in C.ENTITY_KEYWORD_WEIGHTS.items())
    return rf"(cast(case {kind} {cases} else 0.5 end as double) + least(len(string_split_regex(trim({text}), '\s+')) * cast(0.1 as double), 0.3))"


def keyword_sql(key: str, indices: bool) -> str:
    extra = ", array_to_string(list_sort(list_distinct(places)), ',') as sentence_indices" if indices else ""
    return f"""summed as (
      select {key}, lower(text) as k, sum(w) as score, arg_min(text, ord) as keyword, arg_min(type, ord) as type, min(ord) as ord, list(place) as places
      from (select *, {weight_sql('type', 'text')} as w from ordered) group by all
    ),
    best as (select *, row_number() over (partition by {key} order by round(score, 4) desc, ord) as rank from summed)
    select {key}, rank, keyword, round(least(round(score, 4) / first_value(round(score, 4)) over (partition by {key} order by rank), 1.0), 4) as score, type{extra}
    from best where rank <= 20"""


@query("ner_keywords", f"with {MENTIONS}, ordered as (select *, 0 as place, pass * 1000000 + n as ord from mention), {keyword_sql('doc_id', False)}")
def keywords(spark, sf):
    rows = O.entity_keywords(documents(spark, sf))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(
    "ner_keywords_deep",
    f"""with {DATED}, {sentence_cte('dated', 'o_orderkey', 'text')},
    keyed as (select o_orderkey || ':' || idx as sid, text from sent),
    {mention_cte('keyed', 'sid', 'text')},
    ordered as (
      select cast(split_part(sid, ':', 1) as bigint) as o_orderkey, cast(split_part(sid, ':', 2) as bigint) as place, text, type,
             cast(split_part(sid, ':', 2) as bigint) * 10000000 + pass * 1000000 + n as ord from mention
    ), {keyword_sql('o_orderkey', True)}""",
)
def keywords_deep(spark, sf):
    rows = O.entity_keywords(dated_orders(spark, sf), "o_orderkey", deep=True)
    return rows.withColumn("rank", F.col("rank").cast("long")).withColumn("sentence_indices", F.array_join("sentence_indices", ","))


@query(
    "sentence_blocks",
    f"""with {sentence_cte('documents', 'doc_id', 'text')},
    placed as (select *, (row_number() over (partition by doc_id order by idx) - 1) // 3 as block_index from sent)
    select doc_id, block_index, array_to_string(list(text order by idx), ' ') as text, array_to_string(list(idx order by idx), ',') as indices,
           cast(min(start) as bigint) as start_char, cast(max(stop) as bigint) as end_char
    from placed group by all""",
)
def blocks(spark, sf):
    rows = O.block_table(documents(spark, sf), blocksize=3)
    return rows.select(
        "doc_id", F.col("block_index").cast("long").alias("block_index"), "text", F.array_join("indices", ",").alias("indices"),
        F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"),
    )


@query(
    "label_to_type",
    f"""select c_custkey, list_filter(['Entity', c_mktsegment, case when c_nationkey % 2 = 0 then 'PER' else 'ORG' end, 'LOC'],
        lambda l: l in ({', '.join(quoted(t) for t in C.NODE_LABEL_TYPES)}))[1] as type from customer""",
)
def label_to_type(spark, sf):
    labels = F.array(F.lit("Entity"), F.col("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "PER").otherwise("ORG"), F.lit("LOC"))
    return table(spark, sf, "customer").select("c_custkey", E.label_type(labels).alias("type"))


# -- dictionary tagger over shipments: places and companies by name ---------------------

SHIPMENTS = """shipment as (
      select l_orderkey as doc_id, 'Order ' || l_orderkey || ' was shipped by ' || s_name || ' (' || lower(n_name) || ', ' || r_name || ') from ' || strftime(day, '%Y-%m-%d') || '.' as text
      from (select l_orderkey, min(l_suppkey) as l_suppkey, min(l_shipdate) as day from lineitem group by l_orderkey)
      join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    gazetteer as (select n_name as name, 'LOC' as type from nation union all select r_name, 'LOC' from region union all select s_name, 'ORG' from supplier)"""


def shipments(spark, sf):
    """A sentence per order that names its first supplier with nation and region."""
    line, supplier, nation, region = (table(spark, sf, n) for n in ("lineitem", "supplier", "nation", "region"))
    named = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = line.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_shipdate").alias("day"))
    rows = orders.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    text = F.concat(
        F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" was shipped by "), "s_name", F.lit(" ("), F.lower("n_name"), F.lit(", "), "r_name",
        F.lit(") from "), F.date_format("day", "yyyy-MM-dd"), F.lit("."),
    )
    return spread(rows.select(F.col("l_orderkey").alias("doc_id"), text.alias("text")))


def star_gazetteer(spark, sf):
    """Nations and regions are places, suppliers organisations."""
    names = lambda t, c, kind: table(spark, sf, t).select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    return names("nation", "n_name", "LOC").unionByName(names("region", "r_name", "LOC")).unionByName(names("supplier", "s_name", "ORG"))


@query(
    "ner_gazetteer",
    f"""with {SHIPMENTS},
    word as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from shipment),
    entry as (select regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+') as words, min(type) as type from gazetteer group by 1),
    place as (select doc_id, text, w, unnest(range(1, len(w) + 1)) as spot from word),
    hit as (select doc_id, spot, len(words) as n, words, type from place join entry on w[spot] = words[1] and w[spot:spot + len(words) - 1] = words),
    covered as (select doc_id, spot, n, type, words, unnest(range(spot, spot + n)) as pos from hit),
    judged as (select *, row_number() over (partition by doc_id, pos order by n desc, spot) as r from covered)
    select doc_id, array_to_string(words, ' ') as name, type, count(*) as mentions from (
      select doc_id, spot, words, type from judged group by doc_id, spot, n, words, type having max(r) = 1) group by all""",
)
def gazetteer(spark, sf):
    found = G.gazetteer_mentions(shipments(spark, sf), star_gazetteer(spark, sf))
    name = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return found.groupBy("doc_id", name.alias("name"), "type").agg(F.count(F.lit(1)).alias("mentions"))
