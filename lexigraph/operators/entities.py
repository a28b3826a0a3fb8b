"""Entity tables: mentions, enriched episodes and entity keywords.

Mentions belong to one text, so every operator here is a map over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.functions import entities as E, text as T
from lexigraph.functions.arrays import let, merge_mentions


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text", extract: E.Extractor = E.pattern_mentions) -> DataFrame:
    """(key, ord, text, type, start, end, label), one row per mention."""
    return docs.select(key, F.posexplode(extract(F.col(text))).alias("ord", "m")).select(key, "ord", "m.*")


def mentions_with_context(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100, extract: E.Extractor = E.pattern_mentions
) -> DataFrame:
    """Mentions with sentence index and a nested ``context``."""
    return docs.select(key, F.inline(E.with_context(F.col(text), window, extract)))


def sentence_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, index, start, end) of indexed sentences."""
    return docs.select(key, F.inline(T.indexed_sentences(F.col(text))))


def block_table(docs: DataFrame, key: str = "doc_id", text: str = "text", blocksize: int = 1) -> DataFrame:
    """(key, text, indices, start, end, block_index) of sentence blocks."""
    return docs.select(key, F.inline(T.sentence_blocks(T.indexed_sentences(F.col(text)), blocksize)))


def episode_text(content: Column, kind: Column) -> Column:
    """Text to tag: the content itself, or the values of a JSON episode."""
    return F.when(kind == "json", F.coalesce(T.json_to_text(content), content)).otherwise(content)


def enrich(episodes: DataFrame, content: str = "content", kind: str = "type", extract: E.Extractor = E.pattern_mentions) -> DataFrame:
    """Episodes plus entities, entities_by_type, entity_count and all_entities."""
    return (
        episodes.withColumn("entities", extract(episode_text(F.col(content), F.col(kind))))
        .withColumn("entities_by_type", E.texts_by_type(F.col("entities")))
        .withColumn("entity_count", F.size("entities"))
        .withColumn("all_entities", F.transform("entities", lambda m: m["text"]))
    )


def annotate(enriched: DataFrame, content: str = "content") -> DataFrame:
    """Enriched episodes with their entities written behind the content."""
    return enriched.withColumn("enriched_content", E.annotate(F.col(content), F.col("entities_by_type")))


def keyword_entries(found: Column) -> Column:
    """Mentions as input of :func:`merge_mentions`.

    ``found`` is array<struct<text, type, sentence_index, ...>>.
    """
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lower(F.trim(m["text"])).alias("item"),
            i.alias("ord"),
            F.trim(m["text"]).alias("text"),
            m["type"].alias("type"),
            E.keyword_weight(m["type"], m["text"]).alias("weight"),
            m["sentence_index"].alias("sentence_index"),
        ),
    )


def rank_keywords(groups: Column, num_keywords: int) -> Column:
    """Best groups first (ties by first appearance), scores relative to the best."""
    ordered = F.slice(
        F.sort_array(
            F.transform(
                groups,
                lambda g: F.struct(
                    (-F.round(g["weight"], 4)).alias("order"), g["ord"].alias("ord"), g.alias("group")
                ),
            )
        ),
        1,
        num_keywords,
    )
    return let(
        ordered,
        lambda best: F.transform(
            best,
            lambda b, i: F.struct(
                (i + 1).alias("rank"),
                b["group"]["text"].alias("keyword"),
                F.round(F.least(b["order"] / F.element_at(best, 1)["order"], F.lit(1.0)), 4).alias("score"),
                b["group"].alias("group"),
            ),
        ),
    )


def _document_mentions(text: Column, extract: E.Extractor) -> Column:
    return F.transform(
        extract(text), lambda m: F.struct(m["text"].alias("text"), m["type"].alias("type"), F.lit(0).alias("sentence_index"))
    )


def entity_keywords(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    num_keywords: int = 20,
    deep: bool = False,
    extract: E.Extractor = E.pattern_mentions,
) -> DataFrame:
    """(key, rank, keyword, score, type[, sentence_indices]): entities as keywords.

    ``deep`` looks sentence by sentence and also says where each keyword occurs.
    """
    found = E.mentions_in_sentences(F.col(text), extract) if deep else _document_mentions(F.col(text), extract)
    ranked = rank_keywords(merge_mentions(keyword_entries(found)), num_keywords)
    rows = docs.select(key, F.inline(ranked)).select(
        key, "rank", "keyword", "score", "group.type", *(["group.sentence_indices"] if deep else [])
    )
    return rows
