"""JSON outputs of searches and keyword runs."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.operators.keywords import KeywordOptions
from lexigraph.plans.search import public_attributes, scoring


def results_envelope(ranked: DataFrame, method: str, timestamp: Column | None = None) -> DataFrame:
    """(query_id, query, method, timestamp, total_results, results[]) per question.

    The results of a question are limited beforehand (20 candidates or a limit
    up to 100), so a question's list is short. Scored results carry a
    ``scoring`` struct, connections, times and entities, plain ones a ``score``.
    The connected entities of a node are unbounded and make a table of their own
    (``search.connection_pages``), written beside this one.
    """
    fields = [
        F.col("rank"), F.col("uuid"), F.col("name"), F.col("summary"), F.col("labels"),
        public_attributes(F.col("attributes")).alias("attributes"),
    ]
    if "final_score" in ranked.columns:
        fields += [
            scoring().alias("scoring"),
            F.struct(
                F.col("degree").alias("count"),
                *([F.col("relationship_types")] if "relationship_types" in ranked.columns else []),
            ).alias("connections"),
            F.struct("created_at", "valid_at", "invalid_at").alias("temporal_info"),
            F.col("recognized_entities"),
            F.col("all_entities"),
        ]
    else:
        fields.append(F.col("score"))
    # Maps have no order of their own, so rows are compared by rank alone.
    listed = F.array_sort(
        F.collect_list(F.struct(*fields)),
        lambda a, b: a["rank"] - b["rank"],
    )
    return ranked.groupBy("query_id", "query").agg(listed.alias("results")).select(
        "query_id",
        "query",
        F.lit(method).alias("method"),
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        F.size("results").alias("total_results"),
        "results",
    )


def keywords_envelope(keywords: DataFrame, options: KeywordOptions, key: str = "doc_id", verified: bool | None = None) -> DataFrame:
    """(key, method, num_keywords, keywords[], parameters[, verified]) per document."""
    fields = [c for c in keywords.columns if c != key]
    settings = {k: v for k, v in asdict(options).items() if isinstance(v, (int, float, bool)) and k != "method"}
    out = keywords.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("keywords"))
    out = out.select(
        key,
        F.lit(options.method).alias("method"),
        F.size("keywords").alias("num_keywords"),
        "keywords",
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("parameters"),
    )
    return out if verified is None else out.withColumn("verified", F.lit(verified))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
