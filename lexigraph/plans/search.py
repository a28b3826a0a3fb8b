"""Search plans: questions in, ranked nodes out, for any number of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.functions import constants as C, entities as E, questions as Q, scores as S
from lexigraph.operators import graph as G, ranking as R
from lexigraph.session import materialize


def analyse(questions: DataFrame, query: str = "query") -> DataFrame:
    """Questions plus type, description, confidence, entity_weights and query terms."""
    info, terms = Q.detect_question(F.col(query)), Q.query_terms(F.col(query))
    return questions.withColumn("_info", info).withColumn("_terms", terms).select("*", "_info.*", "_terms.*").drop("_info", "_terms")


# How deep each list goes before fusion. It does not follow the size of the result, so a shorter answer is the start of a longer one.
RETRIEVAL_DEPTH = 100


def hybrid(
    questions: DataFrame,
    postings: DataFrame | R.SharedPostings,
    embeddings: DataFrame | None = None,
    limit: int = C.SEARCH_RESULT_LIMIT,
    k: int = 60,
    depth: int = RETRIEVAL_DEPTH,
) -> DataFrame:
    """(query_id, uuid, score, rank): lexical and, where given, vector lists fused.

    ``embeddings`` is (uuid, embedding); the questions then carry ``vector``, and
    those without one have a lexical list alone. Each list holds ``depth`` nodes.
    """
    if depth < limit:
        raise ValueError("depth must be at least limit")
    lists = [R.bm25(questions, postings, depth)]
    if embeddings is not None:
        lists.append(R.vector_top_k(questions, embeddings, depth))
    return R.fuse(lists, limit, k)


def standard(questions: DataFrame, postings: DataFrame, embeddings: DataFrame | None = None, limit: int = C.SEARCH_TOP_K) -> DataFrame:
    """Hybrid search without re-ranking: the first ``limit`` fused hits."""
    return hybrid(questions, postings, embeddings, limit)


def by_connection(candidates: DataFrame, edges: DataFrame, weight: float = C.WEIGHT_CONNECTION) -> DataFrame:
    """Re-rank candidates by original score and connectivity alone."""
    rows = R.connection_score(candidates.withColumnRenamed("score", "original_score").drop("rank"), edges)
    rows = rows.withColumn("original_score", F.coalesce("original_score", F.lit(1.0)))
    rows = rows.withColumn(
        "final_score", (1.0 - weight) * F.col("original_score") + weight * F.col("connection_score")
    )
    return _ranked(rows)


def _ranked(rows: DataFrame) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.round("final_score", R.RANK_DIGITS).desc(), "uuid")
    return rows.withColumn("rank", F.row_number().over(best_first))


def by_distance(candidates: DataFrame, edges: DataFrame, most_hops: int = 3) -> DataFrame:
    """Re-rank candidates around the center of each question's hits: the fewer edges away the better, then by score.

    The center is the source of the best-scored edge. Candidates beyond
    ``most_hops``, and all of a question without a center, keep their order at the end.
    """
    found = candidates.select("query_id", "uuid", F.coalesce("score", F.lit(1.0)).alias("original_score"))
    centers = materialize(G.central(candidates, edges), "centers")
    away = G.distances(centers, edges, most_hops, found)
    rows = found.join(away, ["query_id", "uuid"], "left")
    nearest = Window.partitionBy("query_id").orderBy(F.col("hops").asc_nulls_last(), F.round("original_score", R.RANK_DIGITS).desc(), "uuid")
    return rows.withColumn("rank", F.row_number().over(nearest))


def question_aware(
    questions: DataFrame,
    candidates: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    weights: R.Weights = R.Weights(),
    extract: E.Extractor = E.pattern_mentions,
) -> DataFrame:
    """All candidates of every question, re-ranked by five factors.

    ``questions`` comes from :func:`analyse`, ``candidates`` is (query_id, uuid,
    score). Node work (entities, degree) is done once per candidate node, not
    once per pair.
    """
    found = candidates.select("query_id", "uuid", F.coalesce("score", F.lit(1.0)).alias("original_score"))
    mentioned = extract(R.node_text())
    details = (
        nodes.join(found.select("uuid").distinct(), "uuid")
        .withColumn("_mentions", mentioned)
        .withColumn("recognized_entities", E.texts_by_type(F.col("_mentions")))
        .withColumn("all_entities", F.transform("_mentions", lambda m: F.struct(m["text"].alias("text"), m["type"].alias("type"))))
        .drop("_mentions")
        .withColumn("type_counts", E.type_counts(F.col("recognized_entities")))
    )
    ends = materialize(R.candidate_ends(found, edges), "candidate-ends")  # edges are read once
    hits = R.neighbour_hits(found, questions, nodes, edges, ends)
    rows = (
        R.connection_score(found, edges, ends)
        .join(details, "uuid")
        .join(questions, "query_id")
        .join(hits, ["query_id", "uuid"], "left")
        .withColumn(
            "temporal_score",
            S.temporal_score(F.col("query_year"), F.col("attributes"), F.col("valid_at"), F.col("invalid_at")),
        )
        .withColumn(
            "query_match_score",
            S.query_match_score(
                F.col("original_query"), F.col("important_terms"), F.col("proper_nouns"), F.col("name"),
                F.col("summary"), F.col("attributes"), F.col("labels"), F.col("neighbour_hits"),
            ),
        )
        .withColumn("entity_type_score", S.entity_type_score(F.col("entity_weights"), F.col("type_counts")))
    )
    base, final = R.final_score(weights)
    return _ranked(rows.withColumn("base_score", base).withColumn("final_score", final))


def temporal(questions: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Three factors: semantic, connections and time."""
    return question_aware(questions, candidates, nodes, edges, R.Weights(query_match=0.0, entity_type=0.0))


def multi_factor(questions: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Four factors: the temporal preset plus term matching."""
    return question_aware(questions, candidates, nodes, edges, R.Weights(entity_type=0.0))


def scoring() -> Column:
    """The scoring struct of a response."""
    names = ["final_score", "original_score", "connection_score", "temporal_score", "query_match_score", "entity_type_score"]
    return F.struct(*names)


def with_relationships(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked rows plus ``relationship_types``, the sorted kinds of edge at each node.

    Kinds are combined per task before they move, so a hub moves as a short list.
    The rows are written, so their nodes are known before the edges are read.
    """
    ranked = materialize(ranked, "ranked")
    return ranked.join(G.relationship_types(edges, ranked.select("uuid").distinct()), "uuid", "left").withColumn(
        "relationship_types", F.coalesce("relationship_types", F.expr("cast(array() as array<string>)"))
    )


def public_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, _: k != "name_embedding")


def response(ranked: DataFrame, limit: int = C.SEARCH_TOP_K) -> DataFrame:
    """Rows of a search answer, at most ``limit`` per question (1..100).

    Works for plain and scored results; scores, connection counts, relationship
    types and entities are added where present.
    Connected entities are a table of their own, see :func:`connection_pages`.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie within 1..100")
    columns = ["query_id", "rank", "uuid", "name", "summary", "labels", public_attributes(F.col("attributes")).alias("attributes")]
    if "final_score" in ranked.columns:
        columns.append(scoring().alias("scoring"))
    if "degree" in ranked.columns:
        columns.append(F.col("degree").alias("connection_count"))
    columns += [c for c in ("relationship_types", "recognized_entities", "all_entities") if c in ranked.columns]
    return ranked.where(F.col("rank") <= limit).select(*columns)


def connection_pages(results: DataFrame, neighbours: DataFrame, degrees: DataFrame, page_size: int = 1000) -> DataFrame:
    """(uuid, page, entities): the neighbours of each node among the results, all of them.

    A table per node, joined to results by uuid, so a node that many questions
    return is laid out once. A hub can have any number of neighbours; they come
    in pages of about ``page_size`` picked by hash, each built by its own group.
    """
    keyed = results.select("uuid").distinct().join(degrees.select("uuid", "degree"), "uuid")
    keyed = materialize(keyed, "result-nodes")
    rows = keyed.join(neighbours.withColumnRenamed("name", "neighbour_name").withColumnRenamed("labels", "neighbour_labels"), "uuid")
    pages = F.greatest(F.lit(1), F.ceil(F.col("degree") / page_size)).cast("long")
    return (
        rows.withColumn("page", F.pmod(F.xxhash64("neighbour"), pages).cast("int"))
        .groupBy("uuid", "page")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("neighbour_name").alias("name"), F.col("type"), F.col("neighbour_labels").alias("labels"),
                        F.col("neighbour").alias("uuid"),
                    )
                )
            ).alias("entities")
        )
    )


def answer(
    questions: DataFrame,
    postings: DataFrame | R.SharedPostings,
    nodes: DataFrame,
    edges: DataFrame,
    embeddings: DataFrame | None = None,
    weights: R.Weights = R.Weights(),
    extract: E.Extractor = E.pattern_mentions,
    limit: int = C.SEARCH_RESULT_LIMIT,
) -> DataFrame:
    """Questions to re-ranked candidates in one call.

    The candidates (at most ``limit`` per question) feed several features, so they
    are written once to the shared folder instead of being searched again.
    """
    found = materialize(hybrid(questions, postings, embeddings, limit), "candidates")
    return question_aware(analyse(questions), found, nodes, edges, weights, extract)
