"""Node and edge tables and their connectivity features.

nodes(uuid, name, summary, labels, attributes, created_at, valid_at, invalid_at)
edges(src, dst, rel_type)

A hub may touch any share of the edges, so features are combined counts or flat
rows; nothing collects all neighbours of a node into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.functions import entities as E
from lexigraph.session import materialize

EDGE_SCHEMA = "src string, dst string, rel_type string"


def _ends(edges: DataFrame) -> DataFrame:
    """Both directions of every edge in one pass: (uuid, other, rel_type)."""
    return edges.select(
        F.inline(
            F.array_distinct(
                F.array(
                    F.struct(F.col("src").alias("uuid"), F.col("dst").alias("other"), "rel_type"),
                    F.struct(F.col("dst").alias("uuid"), F.col("src").alias("other"), "rel_type"),
                )
            )
        )
    )


# Node ids that a step may broadcast; they are counted before.
SHARED_IDS = 200_000


def _few(ids: DataFrame) -> bool:
    return ids.limit(SHARED_IDS + 1).count() <= SHARED_IDS


def ends(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uuid, other[, rel_type]): the ends of edges at the rows of ``wanted`` (uuid, ...), with their columns; a self-loop has one end.

    Few rows visit the edges where they lie, so no other edge moves.
    """
    asked = F.broadcast(wanted) if _few(wanted) else wanted
    kind = [c for c in ("rel_type",) if c in edges.columns]
    out = edges.select(F.col("src").alias("uuid"), F.col("dst").alias("other"), *kind)
    into = edges.where(~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("dst").alias("uuid"), F.col("src").alias("other"), *kind)
    return out.join(asked, "uuid").unionAll(into.join(asked, "uuid"))


def _entity(m: Column) -> Column:
    """Id of the entity a mention names: its lower-case text and type."""
    return F.sha2(F.concat_ws("|", F.lower(m["text"]), m["type"]), 256)


def _episode(key: str) -> Column:
    return F.concat(F.lit("episode:"), F.col(key).cast("string"))


def _numbered(mentions: Column) -> Column:
    return F.transform(mentions, lambda m, i: F.struct(i.alias("ord"), m.alias("m")))


def tagged(
    episodes: DataFrame,
    key: str = "episode_id",
    text: str = "content",
    reference_time: str = "reference_time",
    extract: E.Extractor = E.pattern_mentions,
) -> DataFrame:
    """(episode, valid_at, m): the mentions of every episode, with their sentences."""
    return episodes.select(_episode(key).alias("episode"), F.col(reference_time).alias("valid_at"), E.mentions_in_sentences(F.col(text), extract).alias("m"))


def _combined(rows: DataFrame) -> DataFrame:
    """Rows (uuid, first, name, type, valid_at) combined by id: the earliest date, and the name as it stands in the first place."""
    return rows.groupBy("uuid").agg(
        F.min_by("name", "first").alias("name"), F.min("type").alias("type"), F.min("valid_at").alias("valid_at"), F.min("first").alias("first")
    ).select("uuid", "first", "name", "type", "valid_at")


def _first_places(rows: DataFrame) -> DataFrame:
    """Mentions (episode, valid_at, ord, m) as rows that ``merge_entities`` combines."""
    return rows.select(
        _entity(F.col("m")).alias("uuid"), F.struct("episode", "ord").alias("first"), F.col("m.text").alias("name"), F.col("m.type").alias("type"), "valid_at"
    )


def entity_parts(mentions: DataFrame) -> DataFrame:
    """What a set of tagged episodes says of each entity: (uuid, first, name, type, valid_at).

    Parts of disjoint sets of episodes merge to the part of their union, in any order.
    """
    return _combined(_first_places(mentions.select("episode", "valid_at", F.inline(_numbered(F.col("m"))))))


def merge_entities(parts: DataFrame) -> DataFrame:
    """Parts of several sets of episodes -> one row per entity."""
    return _combined(parts)


def entity_nodes(parts: DataFrame) -> DataFrame:
    """Node rows of merged entities."""
    return parts.select(
        "uuid",
        "name",
        F.lit("").alias("summary"),
        F.array(F.lit("Entity"), F.col("type")).alias("labels"),
        F.expr("cast(map() as map<string,string>)").alias("attributes"),
        F.col("valid_at").alias("created_at"),
        "valid_at",
        F.lit(None).cast("timestamp").alias("invalid_at"),
    )


def episode_nodes(episodes: DataFrame, key: str = "episode_id", text: str = "content", reference_time: str = "reference_time") -> DataFrame:
    """Node rows of the episodes themselves."""
    return episodes.select(
        _episode(key).alias("uuid"),
        F.concat(F.lit("Episode "), F.col(key).cast("string")).alias("name"),
        F.col(text).alias("summary"),
        F.array(F.lit("Episodic")).alias("labels"),
        F.expr("cast(map() as map<string,string>)").alias("attributes"),
        F.col(reference_time).alias("created_at"),
        F.col(reference_time).alias("valid_at"),
        F.lit(None).cast("timestamp").alias("invalid_at"),
    )


def mention_edges(mentions: DataFrame) -> DataFrame:
    """PART_OF and CO_MENTION edges of tagged episodes; each edge once."""
    part_of = F.transform("m", lambda m: F.struct(_entity(m).alias("src"), F.col("episode").alias("dst"), F.lit("PART_OF").alias("rel_type")))
    in_text_order = F.array_sort(
        "m", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"])
    )
    linked = F.filter(
        F.transform(
            "sorted",
            lambda m, i: F.when(
                (i > 0) & (F.get("sorted", i - 1)["sentence_index"] == m["sentence_index"]),
                F.struct(_entity(F.get("sorted", i - 1)).alias("src"), _entity(m).alias("dst"), F.lit("CO_MENTION").alias("rel_type")),
            ),
        ),
        lambda e: e.isNotNull() & (e["src"] != e["dst"]),
    )
    return mentions.withColumn("sorted", in_text_order).select(F.inline(F.concat(part_of, linked))).distinct()


def build(
    episodes: DataFrame,
    key: str = "episode_id",
    text: str = "content",
    reference_time: str = "reference_time",
    extract: E.Extractor = E.pattern_mentions,
) -> tuple[DataFrame, DataFrame]:
    """Entity and episode nodes with PART_OF and CO_MENTION edges.

    An entity is a lower-case text with its type. CO_MENTION links mentions that
    follow each other in a sentence, which keeps edges linear in the mentions.
    """
    # An expression, not a column, goes into the generator: Catalyst would otherwise guard it with a filter that finds all mentions again.
    numbered = _numbered(E.mentions_in_sentences(F.col(text), extract))
    rows = episodes.select(_episode(key).alias("episode"), F.col(reference_time).alias("valid_at"), F.inline(numbered))
    nodes = entity_nodes(_combined(_first_places(rows))).unionByName(episode_nodes(episodes, key, text, reference_time))
    return nodes, mention_edges(tagged(episodes, key, text, reference_time, extract))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, degree): incident edges of every node; a self-loop counts once."""
    counts = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("uuid")).groupBy("uuid").agg(
        F.count(F.lit(1)).alias("degree")
    )
    return nodes.select("uuid").join(counts, "uuid", "left").select("uuid", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(uuid, neighbour, name, labels, type), one row per distinct pair; of the nodes of ``wanted`` (uuid), if given."""
    found = _ends(edges) if wanted is None else ends(edges, wanted)
    pairs = found.select("uuid", F.col("other").alias("neighbour")).distinct()
    pairs = pairs if wanted is None else materialize(pairs, "pairs")  # a written table tells its size to the join with the nodes
    named = nodes.select(F.col("uuid").alias("neighbour"), "name", "labels", E.label_type(F.col("labels")).alias("type"))
    return pairs.join(named, "neighbour").select("uuid", "neighbour", "name", "labels", "type")


def relationship_types(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(uuid, relationship_types): a short sorted list per node, or per node of ``wanted`` (uuid)."""
    found = _ends(edges) if wanted is None else ends(edges, wanted)
    return found.groupBy("uuid").agg(F.sort_array(F.collect_set("rel_type")).alias("relationship_types"))


def temporal(nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(uuid, created_at, valid_at, invalid_at, episode_date), one row per distinct date.

    ``episodes`` is (uuid, valid_at). A node without episodes keeps one row.
    """
    dated = (
        _ends(edges.where(F.col("rel_type") == "PART_OF"))
        .join(episodes.select(F.col("uuid").alias("other"), F.col("valid_at").alias("episode_date")), "other")
        .where(F.col("episode_date").isNotNull())
        .select("uuid", "episode_date")
        .distinct()
    )
    return nodes.select("uuid", "created_at", "valid_at", "invalid_at").join(dated, "uuid", "left")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, relationships."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn(
        "relationships", edges.agg(F.count(F.lit(1))).scalar()
    )


def central(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, center): source node of the best-scored edge per question.

    ``hits`` is (query_id, uuid, score) over node ids. Of the edges into a node
    only the one with the largest source can win, so a hub moves as one row, and
    edges into other nodes than the hits do not move where these are few.
    """
    into = edges.select(F.col("dst").alias("uuid"), "src")
    asked = hits.select("uuid").distinct()
    if _few(asked):
        into = into.join(F.broadcast(asked), "uuid")
    into = into.groupBy("uuid").agg(F.max("src").alias("src"))
    scored = hits.join(into, "uuid")
    best = F.max_by("src", F.struct(F.round("score", 9), F.col("src")))
    return scored.groupBy("query_id").agg(best.alias("center"))


def distances(centers: DataFrame, edges: DataFrame, most_hops: int = 3, targets: DataFrame | None = None) -> DataFrame:
    """(query_id, uuid, hops): nodes within ``most_hops`` edges, either way, of a question's center (query_id, center).

    One breadth-first search per distinct center, whatever number of questions
    share it. A round joins the last frontier with the edges and keeps what no
    earlier round has; frontiers are written, so nothing is searched twice. A
    frontier of few rows visits the edges where they lie, for a larger one a hub's
    edges are split by adaptive execution. The center itself has 0 hops.

    With ``targets`` (query_id, uuid) the distances of these nodes alone: the
    last round, the widest, then starts at the targets' own edges.
    """
    asked = centers.select("query_id", F.col("center").alias("source")).where(F.col("source").isNotNull()).distinct()
    frontier = materialize(asked.select("source", F.col("source").alias("uuid")).distinct(), "frontier")
    rounds = [frontier.withColumn("hops", F.lit(0))]
    for hops in range(1, most_hops + 1):
        seen = rounds[0].select("source", "uuid")
        for earlier in rounds[1:]:
            seen = seen.unionAll(earlier.select("source", "uuid"))
        if targets is not None and hops == most_hops:
            near = ends(edges, targets.select("uuid").distinct()).select("uuid", "other").distinct()
            step = materialize(near, "target-ends").join(frontier.withColumnRenamed("uuid", "other"), "other").select("source", "uuid").distinct()
        else:
            step = ends(edges, frontier).select("source", F.col("other").alias("uuid")).where(F.col("uuid").isNotNull()).distinct()
        frontier = materialize(step.join(seen, ["source", "uuid"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier.withColumn("hops", F.lit(hops)))
    found = rounds[0]
    for later in rounds[1:]:
        found = found.unionAll(later)
    away = asked.join(found, "source").select("query_id", "uuid", "hops")
    return away if targets is None else away.join(targets.select("query_id", "uuid").distinct(), ["query_id", "uuid"], "left_semi")


def write(nodes: DataFrame, edges: DataFrame, folder: str, mode: str = "append") -> None:
    """Append nodes and edges as Parquet; edges are laid out by type."""
    nodes.write.mode(mode).parquet(f"{folder}/nodes")
    edges.write.mode(mode).partitionBy("rel_type").parquet(f"{folder}/edges")


def read(spark, folder: str, node_schema) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(node_schema).parquet(f"{folder}/nodes"),
        spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges"),
    )


def clear(spark, folder: str, node_schema) -> dict[str, int]:
    """Empty a written graph: counts before and the nodes left afterwards."""
    nodes, edges = read(spark, folder, node_schema)
    before = stats(nodes, edges).first()
    if before["nodes"] == 0:
        return {"nodes": 0, "relationships": before["relationships"], "remaining": 0}
    spark.createDataFrame([], node_schema).write.mode("overwrite").parquet(f"{folder}/nodes")
    spark.createDataFrame([], EDGE_SCHEMA).write.mode("overwrite").parquet(f"{folder}/edges")
    nodes, _ = read(spark, folder, node_schema)
    return {"nodes": before["nodes"], "relationships": before["relationships"], "remaining": nodes.count()}
