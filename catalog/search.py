"""Search and ranking: documents for benchmark passages, graph nodes for questions about the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import documents, mention_cte, query, sql_list, table, tok
from catalog.graph import STAR, star_edges, star_nodes
from catalog.questions import detect_sql
from lexigraph.functions import constants as C, scores as S
from lexigraph.operators import graph as G, ranking as R
from lexigraph.operators.cells import CellIndex
from lexigraph.operators.lexical_index import LexicalIndex
from lexigraph.plans import search
from lexigraph.session import materialize, scratch_path, spread
from lexigraph.sources.sinks import results_envelope, write_json


def bm25_sql(nodes: str, questions: str, limit: int) -> str:
    """CTEs ending in ``lexical(query_id, uuid, score, rank)`` over ``nodes(uuid, text)``."""
    return f"""ntok as (select uuid, {tok('text')} as t from {nodes}),
    post as (select uuid, token, count(*) as tf, any_value(dl) as dl from (select uuid, len(t) as dl, unnest(t) as token from ntok) group by uuid, token),
    size as (select count(distinct uuid) as n, sum(tf) / count(distinct uuid) as mean from post),
    qtok as (select distinct query_id, unnest({tok('query')}) as token from {questions}),
    qdf as (select token, count(*) as df from post where token in (select token from qtok) group by token),
    bm25 as (
      select query_id, uuid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) as score
      from post join qtok using (token) join qdf using (token), size group by query_id, uuid
    ),
    lexical as (
      select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, uuid) as rank from bm25) where rank <= {limit}
    )"""


PASSAGES = """node_text as (select 'doc:' || doc_id as uuid, text from documents),
    question as (select item_id as query_id, text as query from benchmark)"""


def document_postings(spark, sf):
    nodes = documents(spark, sf).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uuid"), "text")
    return materialize(R.lexical_postings(nodes, F.col("text")), "postings")


def ranked(df, *columns):
    return df.select(*columns, "uuid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("rank_lexical", f"with {PASSAGES}, {bm25_sql('node_text', 'question', 20)} select query_id, uuid, round(score, 6) as score, rank from lexical")
def lexical(spark, sf):
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranked(R.bm25(questions, document_postings(spark, sf), 20), "query_id")


@query("rank_lexical_blocks", f"with {PASSAGES}, {bm25_sql('node_text', 'question', 20)} select query_id, uuid, round(score, 6) as score, rank from lexical")
def lexical_blocks(spark, sf):
    """Through the block index: the same rows, with most postings of common words left closed."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    nodes = documents(spark, sf).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uuid"), "text")
    index = LexicalIndex.build(nodes, F.col("text"), scratch_path(spark, "lexical"))
    return ranked(index.search(questions, 20), "query_id")


def near_sql(limit: int) -> str:
    """CTEs ending in ``near(query_id, uuid, score, rank)``: the nearest embeddings of each label's mean."""
    return f"""dims as (select label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as v from embeddings),
    centroid as (select label as query_id, list(v order by pos) as vector from (select label, pos, avg(v) as v from dims group by all) group by label),
    near as (
      select * from (
        select query_id, uuid, score, row_number() over (partition by query_id order by round(score, 9) desc, uuid) as rank from (
          select query_id, 'doc:' || vec_id as uuid, list_cosine_similarity(cast(embedding as double[]), vector) as score from embeddings, centroid)
      ) where rank <= {limit}
    )"""


def label_questions(spark, sf):
    """One question per label: the mean embedding, asked with the passage of the same number."""
    dims = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = dims.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vectors = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("vector"))
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return vectors.select(F.col("label").cast("long").alias("query_id"), "vector").join(passages, "query_id")


def passage_questions(spark, sf):
    """Every passage as a question; those whose number is a label also carry its mean embedding."""
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return passages.join(label_questions(spark, sf).select("query_id", "vector"), "query_id", "left")


def document_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("uuid"), "embedding")


@query("rank_vector", f"with {near_sql(20)} select query_id, uuid, round(score, 6) as score, rank from near")
def vector(spark, sf):
    return ranked(R.vector_top_k(label_questions(spark, sf), document_vectors(spark, sf), 20), "query_id")


@query("rank_vector_blocks", f"with {near_sql(20)} select query_id, uuid, round(score, 6) as score, rank from near")
def vector_blocks(spark, sf):
    """The way taken when the questions are too many to broadcast, here from four questions up."""
    return ranked(R.vector_top_k(label_questions(spark, sf), document_vectors(spark, sf), 20, shared_bytes=4 * 8 * 64), "query_id")


@query("rank_vector_cells", f"with {near_sql(20)} select query_id, uuid, round(score, 6) as score, rank from near")
def vector_cells(spark, sf):
    """Through the cell index, every cell visited; tests measure what is found in few of them."""
    index = CellIndex.build(document_vectors(spark, sf), scratch_path(spark, "cells"))
    return ranked(index.search(label_questions(spark, sf), 20, probes=len(index.centroids)), "query_id")


def fused_sql(limit: int) -> str:
    return f"""node_text as (select 'doc:' || doc_id as uuid, text from documents),
    question as (select item_id as query_id, text as query from benchmark),
    {bm25_sql('node_text', 'question', search.RETRIEVAL_DEPTH)}, {near_sql(search.RETRIEVAL_DEPTH)},
    part as (select query_id, uuid, 1.0 / (60 + rank) as p from lexical union all
      select query_id, uuid, 1.0 / (60 + rank) from near where query_id in (select query_id from question)),
    fused as (select query_id, uuid, sum(p) as score from part group by all)
    select query_id, uuid, round(score, 6) as score, rank from (
      select *, row_number() over (partition by query_id order by round(score, 9) desc, uuid) as rank from fused) where rank <= {limit}"""


@query("rank_rrf", f"with {fused_sql(20)}")
def rrf(spark, sf):
    found = search.hybrid(passage_questions(spark, sf), document_postings(spark, sf), document_vectors(spark, sf), 20)
    return ranked(found, "query_id")


@query("search_standard", f"with {fused_sql(5)}")
def standard(spark, sf):
    found = search.standard(passage_questions(spark, sf), document_postings(spark, sf), document_vectors(spark, sf))
    return ranked(found, "query_id")


# -- questions about the star schema -------------------------------------------------

CAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
STAR_QUESTIONS = f"""question as (
      select min(p_partkey) as query_id, case length(p_name) % 4
        when 0 then 'Who ordered the ' || {CAP} || ' in ' || (1995 + length(p_name) % 7) || '?'
        when 1 then 'Where is the ' || {CAP} || ' made?'
        when 2 then 'What company supplied the ' || {CAP} || ' in ' || (1995 + length(p_name) % 7) || '?'
        else 'How many of the ' || {CAP} || ' and Customer#000000001 were ordered?' end as query
      from part group by p_name
      union all
      select 1000000000 + min(o_orderkey), 'When was an order with priority ' || o_orderpriority || ' and status ' || o_orderstatus
        || ' placed in ' || (year(min(o_orderdate)) + 1) || '?' from orders group by o_orderpriority, o_orderstatus
    )"""


def star_questions(spark, sf):
    """One question per part name and one per kind of order; nodes grow, question kinds do not."""
    name, length = F.initcap("p_name"), F.length("p_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    year = 1995 + length % 7
    parts = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select(
        "query_id",
        F.when(length % 4 == 0, text("Who ordered the ", name, " in ", year, "?"))
        .when(length % 4 == 1, text("Where is the ", name, " made?"))
        .when(length % 4 == 2, text("What company supplied the ", name, " in ", year, "?"))
        .otherwise(text("How many of the ", name, " and Customer#000000001 were ordered?"))
        .alias("query"),
    )
    kinds = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.min("o_orderkey").alias("k"), F.min("o_orderdate").alias("d")
    )
    orders = kinds.select(
        (F.lit(1000000000) + F.col("k")).alias("query_id"),
        text("When was an order with priority ", F.col("o_orderpriority"), " and status ", F.col("o_orderstatus"),
             " placed in ", F.year("d") + 1, "?").alias("query"),
    )
    return parts.unionByName(orders)


def star_postings(spark, sf, nodes):
    return R.shared_postings(spread(nodes), F.concat_ws(" ", "name", "summary"), search.RETRIEVAL_DEPTH)


def star_candidates(spark, sf, nodes, questions):
    return materialize(search.hybrid(questions, star_postings(spark, sf, nodes)), "candidates")


STAR_CANDIDATES = f"""{STAR}, {STAR_QUESTIONS},
    node_text as (select uuid, name || ' ' || summary as text from node),
    {bm25_sql('node_text', 'question', 20)},
    cand as (select query_id, uuid, 1.0 / (60 + rank) as original_score from lexical)"""

DEGREE_SQL = """deg as (select uuid, count(*) as degree from ends where uuid in (select uuid from cand) group by uuid),
    linked as (select cand.*, coalesce(degree, 0) as degree,
      coalesce(coalesce(degree, 0) / nullif(max(coalesce(degree, 0)) over (partition by query_id), 0), 0) as connection_score
      from cand left join deg using (uuid))"""


@query("score_connection", f"with {STAR_CANDIDATES}, {DEGREE_SQL} select query_id, uuid, degree, round(connection_score, 6) as connection_score from linked")
def score_connection(spark, sf):
    nodes, questions = star_nodes(spark, sf), star_questions(spark, sf)
    rows = R.connection_score(star_candidates(spark, sf, nodes, questions), star_edges(spark, sf))
    return rows.select("query_id", "uuid", "degree", F.round("connection_score", 6).alias("connection_score"))


@query(
    "search_connection",
    f"""with {STAR_CANDIDATES}, {DEGREE_SQL}, final as (select *, 0.85 * original_score + 0.15 * connection_score as final_score from linked)
    select query_id, uuid, round(final_score, 6) as final_score, row_number() over (partition by query_id order by round(final_score, 9) desc, uuid) as rank from final""",
)
def search_connection(spark, sf):
    nodes, questions = star_nodes(spark, sf), star_questions(spark, sf)
    rows = search.by_connection(star_candidates(spark, sf, nodes, questions), star_edges(spark, sf))
    return rows.select("query_id", "uuid", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("long").alias("rank"))


@query(
    "score_temporal",
    """with asked as (select *, 1994 + o_orderkey % 10 as y from orders)
    select o_orderkey, y as query_year, cast(case
        when o_orderstatus = 'P' and contains(strftime(o_orderdate, '%Y-%m-%d'), cast(y as varchar)) then 1.0
        when o_orderstatus = 'O' and year(o_orderdate) <= y and y <= year(o_orderdate) + 2 then 1.0
        when o_orderstatus = 'F' then case when y between year(o_orderdate) and year(o_orderdate + interval 400 day) then 1.0 else 0.3 end
        when year(o_orderdate) <= y then 0.8 else 0.5 end as double) as temporal_score from asked""",
)
def score_temporal(spark, sf):
    """Orders as nodes: pending ones carry a date, open ones a span of years, finished ones an end of validity."""
    year = (1994 + F.col("o_orderkey") % 10).cast("int")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    span = F.concat_ws("-", F.year("o_orderdate"), F.year("o_orderdate") + 2)
    attributes = (
        F.when(F.col("o_orderstatus") == "P", F.create_map(F.lit("date"), day))
        .when(F.col("o_orderstatus") == "O", F.create_map(F.lit("term_start"), span))
        .otherwise(F.create_map(F.lit("priority"), F.col("o_orderpriority")))
    )
    ends = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 400 days"))
    return table(spark, sf, "orders").select(
        "o_orderkey", year.cast("long").alias("query_year"),
        S.temporal_score(year, attributes, F.col("o_orderdate"), ends).alias("temporal_score"),
    )


def weight_case(entity: str) -> str:
    cases = " ".join(f"when '{k}' then {s['weights'].get(entity, 1.0)}" for k, s in C.QUESTION_TYPES.items())
    return f"cast(case q.type {cases} else 1.0 end as double)"


def hits_share(text: str) -> str:
    return f"len(list_filter(terms, lambda t: contains({text}, t))) / greatest(len(terms), 1)"


FEATURES = rf"""{DEGREE_SQL}, {detect_sql('question')},
    qterm as (
      select query_id, lower(query) as ql, cast(nullif(regexp_extract(query, '\b(19|20)\d{{2}}\b'), '') as int) as y,
        list_filter(regexp_extract_all(lower(query), '\b[a-z]+\b'), lambda t: length(t) > 2 and t not in ({sql_list(C.QUESTION_STOPWORDS)})) as terms,
        regexp_extract_all(query, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') as nouns
      from question
    ),
    cnode as (select * from node where uuid in (select uuid from cand)),
    ctext as (select uuid, name || ' ' || summary || ' ' || array_to_string(attrs, ' ') as text from cnode),
    {mention_cte('ctext', 'uuid', 'text')},
    kinds as (select uuid, count(distinct case when type = 'PER' then text end) as per, count(distinct case when type = 'DATE' then text end) as dat from mention group by uuid),
    pterm as (select cand.query_id, cand.uuid, unnest(terms) as term, generate_subscripts(terms, 1) as pos from cand join qterm using (query_id)),
    nhit as (
      select query_id, pterm.uuid, count(distinct pos) as neighbour_hits from pterm
      join ends on ends.uuid = pterm.uuid join node on node.uuid = ends.other where contains(lower(node.name), term) group by all
    ),
    scored as (
      select l.query_id, l.uuid, n.name, n.summary, degree, original_score, connection_score,
        cast(case when y is null then 1.0 when date_attr is not null and contains(date_attr, cast(y as varchar)) then 1.0
          when valid_at is not null and invalid_at is not null then case when y between year(valid_at) and year(invalid_at) then 1.0 else 0.3 end
          when valid_at is not null and year(valid_at) <= y then 0.8 else 0.5 end as double) as temporal_score,
        (case when contains(ql, lower(n.name)) then 3.0 else {hits_share('lower(n.name)')} * 3.0 end
          + case when len(list_filter(nouns, lambda u: contains(lower(n.name), lower(u)) or contains(lower(u), lower(n.name)))) > 0 then 2.0 else 0.0 end
          + {hits_share('lower(n.summary)')} * 1.5
          + coalesce(neighbour_hits, 0) / greatest(len(terms), 1) * 1.0
          + {hits_share("lower(array_to_string(attrs, ' '))")} * 1.0
          + {hits_share("'entity ' || lower(label)")} * 0.5) / 9.0 as query_match_score,
        case when q.type = 'GENERAL' or per + dat is null then cast(1.0 as double)
          else greatest(0.5, least(2.0, (coalesce(per, 0) * {weight_case('PER')} + coalesce(dat, 0) * {weight_case('DATE')}) / (per + dat))) end as entity_type_score
      from linked l join cnode n using (uuid) join qterm using (query_id) join typed q using (query_id)
        left join kinds using (uuid) left join nhit on nhit.query_id = l.query_id and nhit.uuid = l.uuid
    )"""


def final_sql(ws: str, wc: str, wt: str, wq: str, we: str) -> str:
    return f"""final as (select *, ({ws} * original_score + {wc} * connection_score + {wt} * temporal_score + {wq} * query_match_score)
        * (1.0 + {we} * (entity_type_score - 1.0)) as final_score from scored),
    ranked as (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, uuid) as rank from final)"""


SHOW = """select query_id, rank, uuid, round(original_score, 6) as original_score, round(connection_score, 6) as connection_score, temporal_score,
      round(query_match_score, 6) as query_match_score, round(entity_type_score, 6) as entity_type_score, round(final_score, 6) as final_score from ranked"""
SEMANTIC = "(cast(1.0 as double) - cast(0.15 as double) - cast(0.2 as double) - cast(0.2 as double) - cast(0.15 as double))"
FIVE = final_sql(SEMANTIC, "0.15", "0.2", "0.2", "0.15")


def star_search(spark, sf, run):
    nodes, questions = star_nodes(spark, sf), star_questions(spark, sf)
    found = star_candidates(spark, sf, nodes, questions)
    return run(search.analyse(questions), found, nodes, star_edges(spark, sf))


def shown(rows):
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "uuid", six("original_score"), six("connection_score"), "temporal_score",
        six("query_match_score"), six("entity_type_score"), six("final_score"),
    )


@query("search_question_aware", f"with {STAR_CANDIDATES}, {FEATURES}, {FIVE} {SHOW}")
def question_aware(spark, sf):
    nodes, questions = star_nodes(spark, sf), star_questions(spark, sf)
    return shown(search.answer(questions, star_postings(spark, sf, nodes), nodes, star_edges(spark, sf)))


@query("search_temporal", f"with {STAR_CANDIDATES}, {FEATURES}, {final_sql('0.65', '0.15', '0.2', '0.0', '0.0')} {SHOW}")
def search_temporal(spark, sf):
    return shown(star_search(spark, sf, search.temporal))


@query("search_multi_factor", f"with {STAR_CANDIDATES}, {FEATURES}, {final_sql('0.45', '0.15', '0.2', '0.2', '0.0')} {SHOW}")
def search_multi_factor(spark, sf):
    return shown(star_search(spark, sf, search.multi_factor))


@query("score_query_match", f"with {STAR_CANDIDATES}, {FEATURES} select query_id, uuid, round(query_match_score, 6) as query_match_score from scored")
def score_query_match(spark, sf):
    rows = star_search(spark, sf, search.question_aware)
    return rows.select("query_id", "uuid", F.round("query_match_score", 6).alias("query_match_score"))


@query("score_entity_type", f"with {STAR_CANDIDATES}, {FEATURES} select query_id, uuid, round(entity_type_score, 6) as entity_type_score from scored")
def score_entity_type(spark, sf):
    rows = star_search(spark, sf, search.question_aware)
    return rows.select("query_id", "uuid", F.round("entity_type_score", 6).alias("entity_type_score"))


@query(
    "score_breakdown",
    f"""with {STAR_CANDIDATES}, {FEATURES}, {FIVE} select query_id, uuid, round({SEMANTIC} * original_score, 6) as weighted_original, round(0.15 * connection_score, 6) as weighted_connection,
      round(0.2 * temporal_score, 6) as weighted_temporal, round(0.2 * query_match_score, 6) as weighted_query_match, round(final_score, 6) as final_score from ranked""",
)
def score_breakdown(spark, sf):
    rows = R.score_breakdown(star_search(spark, sf, search.question_aware))
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "query_id", "uuid", six("weighted_original"), six("weighted_connection"), six("weighted_temporal"), six("weighted_query_match"), six("final_score")
    )


@query(
    "weights_validate",
    f"""with {STAR_CANDIDATES}, {FEATURES}, {final_sql('0.0', '0.25', '0.25', '0.25', '0.25')} select query_id, rank, uuid, round(final_score, 6) as final_score from ranked""",
)
def weights_validate(spark, sf):
    """Weights that sum to exactly 1.0 are accepted and leave nothing to the semantic score."""
    weights = R.Weights(0.25, 0.25, 0.25, 0.25)
    rows = star_search(spark, sf, lambda q, c, n, e: search.question_aware(q, c, n, e, weights))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "uuid", F.round("final_score", 6).alias("final_score"))


@query(
    "graph_central",
    f"""with {STAR_CANDIDATES}, joined as (select query_id, src, round(original_score, 9) as s from cand join edge on edge.dst = cand.uuid)
    select query_id, max(src) as center from joined where (query_id, s) in (select query_id, max(s) from joined group by query_id) group by query_id""",
)
def central(spark, sf):
    nodes, questions = star_nodes(spark, sf), star_questions(spark, sf)
    return G.central(star_candidates(spark, sf, nodes, questions).select("query_id", "uuid", "score"), star_edges(spark, sf))


CENTERS = f"""{STAR_CANDIDATES}, joined as (select query_id, src, round(original_score, 9) as s from cand join edge on edge.dst = cand.uuid),
    centered as (select query_id, max(src) as center from joined where (query_id, s) in (select query_id, max(s) from joined group by query_id) group by query_id),
    walk(center, uuid, hops) as (
      select distinct center, center, 0 from centered
      union select walk.center, ends.other, walk.hops + 1 from walk join ends on ends.uuid = walk.uuid where walk.hops < 3),
    away as (select center, uuid, min(hops) as hops from walk group by center, uuid)"""


@query("graph_distance", f"with recursive {CENTERS} select query_id, uuid, hops from centered join away using (center)")
def distance(spark, sf):
    """Every node within three edges of a question's center."""
    nodes, questions, edges = star_nodes(spark, sf), star_questions(spark, sf), star_edges(spark, sf)
    candidates = materialize(star_candidates(spark, sf, nodes, questions).select("query_id", "uuid", "score"), "distance-candidates")
    return G.distances(materialize(G.central(candidates, edges), "centers"), edges)


@query(
    "search_by_distance",
    f"""with recursive {CENTERS} select query_id, cand.uuid, hops, row_number() over (partition by query_id order by hops nulls last, round(original_score, 9) desc, cand.uuid) as rank
    from cand left join centered using (query_id) left join away on away.center = centered.center and away.uuid = cand.uuid""",
)
def distance_search(spark, sf):
    nodes, questions, edges = star_nodes(spark, sf), star_questions(spark, sf), star_edges(spark, sf)
    candidates = materialize(star_candidates(spark, sf, nodes, questions).select("query_id", "uuid", "score"), "distance-candidates")
    return search.by_distance(candidates, edges).select("query_id", "uuid", "hops", F.col("rank").cast("long").alias("rank"))


KINDS_AT = """kinds_at as (select uuid, array_to_string(list(distinct rel_type order by rel_type), ',') as relationship_types from ends group by uuid)"""


@query(
    "search_response",
    f"""with {STAR_CANDIDATES}, {FEATURES}, {FIVE}, {KINDS_AT}
    select query_id, rank, uuid, name, summary, round(final_score, 6) as final_score, degree as connection_count, coalesce(relationship_types, '') as relationship_types
    from ranked left join kinds_at using (uuid) where rank <= 5""",
)
def search_response(spark, sf):
    edges = star_edges(spark, sf)
    rows = search.response(search.with_relationships(star_search(spark, sf, search.question_aware), edges))
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "uuid", "name", "summary",
        F.round("scoring.final_score", 6).alias("final_score"), "connection_count", F.array_join("relationship_types", ",").alias("relationship_types"),
    )


@query(
    "search_response_connections",
    f"""with {STAR_CANDIDATES}, {FEATURES}, {FIVE}, pair as (select distinct uuid, other from ends where uuid in (select uuid from ranked where rank <= 5))
    select pair.uuid, other as neighbour, name, label as type, 'Entity|' || label as labels from pair join node on node.uuid = pair.other""",
)
def search_response_connections(spark, sf):
    """Every neighbour of every node in the answers, once per node."""
    nodes, edges = star_nodes(spark, sf), star_edges(spark, sf)
    rows = materialize(search.response(star_search(spark, sf, search.question_aware)), "response")
    degrees = rows.select("uuid", F.col("connection_count").alias("degree")).distinct()
    pages = search.connection_pages(rows, G.neighbours(nodes, edges, rows.select("uuid")), degrees, page_size=100)
    return pages.select("uuid", F.explode("entities").alias("e")).select(
        "uuid", F.col("e.uuid").alias("neighbour"), "e.name", "e.type", F.array_join("e.labels", "|").alias("labels")
    )


@query(
    "sink_results_json",
    f"""with {STAR_CANDIDATES}, {FEATURES}, {FIVE}, {KINDS_AT}
    select query_id, query, 'question-aware' as method, rank, uuid, name, summary, round(final_score, 6) as final_score, round(query_match_score, 6) as query_match_score,
      degree as connections, coalesce(relationship_types, '') as relationship_types, strftime(valid_at, '%Y-%m-%d') as valid_at, coalesce(per, 0) + coalesce(dat, 0) as entities
    from ranked join question using (query_id) left join kinds_at using (uuid) left join kinds using (uuid) left join (select uuid, valid_at from node) using (uuid)""",
)
def results_json(spark, sf):
    """Search answers written as JSON and read back, whole."""
    path = scratch_path(spark, "results")
    ranked_rows = search.with_relationships(star_search(spark, sf, search.question_aware), star_edges(spark, sf))
    out = results_envelope(ranked_rows, "question-aware")
    write_json(out, path)
    back = spark.read.schema(out.schema).json(path).select("query_id", "query", "method", F.explode("results").alias("r"))
    distinct = F.array_distinct(F.col("r.all_entities"))
    return back.select(
        "query_id", "query", "method", F.col("r.rank").cast("long").alias("rank"), "r.uuid", "r.name", "r.summary",
        F.round("r.scoring.final_score", 6).alias("final_score"), F.round("r.scoring.query_match_score", 6).alias("query_match_score"),
        F.col("r.connections.count").alias("connections"), F.array_join("r.connections.relationship_types", ",").alias("relationship_types"),
        F.date_format("r.temporal_info.valid_at", "yyyy-MM-dd").alias("valid_at"), F.size(distinct).cast("long").alias("entities"),
    )
