"""Request and verdict tables for an outside entity verification step.

Calling the outside service is not part of this package. One text block makes
one request row; one answer makes one response row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.functions import entities as E, text as T
from lexigraph.functions.arrays import let, merge_mentions
from lexigraph.operators.entities import rank_keywords

VERDICTS = "array<struct<text:string,entity:string,type:string,verified:boolean,reasoning:string,confidence:double>>"
VERDICT = ["text", "type", "verified", "reasoning", "confidence"]


def requests(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    blocksize: int = 1,
    instruction: str = "Verify the entities below. Answer with a JSON array.",
    extract: E.Extractor = E.pattern_mentions,
) -> DataFrame:
    """(key, block_index, definitions, entities_json, request) per block with entities.

    Mentions do not cross sentences, so a block's mentions are those of its text.
    """

    def define(kind: Column) -> Column:
        return F.concat(
            F.lit("- "), kind, F.lit(": "), F.coalesce(E.type_description(kind), F.concat(kind, F.lit(" entity")))
        )

    def describe(block: Column, found: Column) -> Column:
        kinds = F.sort_array(F.array_distinct(F.transform(found, lambda m: m["type"])))
        listed = F.transform(
            found,
            lambda m: F.struct(
                F.trim(m["text"]).alias("text"),
                m["type"].alias("type"),
                m["sentence"].alias("sent"),
                F.lit(False).alias("verified"),
            ),
        )
        return F.when(
            F.size(found) > 0,
            F.struct(
                block["block_index"].alias("block_index"),
                F.array_join(F.concat(F.array(F.lit("Entity type definitions:")), F.transform(kinds, define)), "\n").alias("definitions"),
                F.to_json(listed).alias("entities_json"),
                block["text"].alias("block_text"),
            ),
        )

    asked = F.transform(
        T.sentence_blocks(T.indexed_sentences(F.col(text)), blocksize),
        lambda b: let(E.mentions_in_sentences(b["text"], extract), lambda found: describe(b, found)),
    )
    return docs.select(key, F.inline(F.filter(asked, lambda r: r.isNotNull()))).withColumn(
        "request",
        F.concat_ws(
            "\n\n",
            F.lit(instruction),
            "definitions",
            F.concat(F.lit("Full text context:\n"), F.col("block_text")),
            "entities_json",
        ),
    )


def json_verdicts(response: Column) -> Column:
    """array<struct<text, type, verified, reasoning, confidence>>, or null without a JSON array.

    The outermost array counts; trailing commas and an ``entity`` key are forgiven.
    """
    strict = F.regexp_extract(response, r"(?s)\[\s*\{.*\}\s*\]", 0)
    loose = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    body = F.regexp_replace(F.when(strict != "", strict).otherwise(loose), r",(\s*[\]\}])", "$1")
    return F.transform(
        F.filter(F.from_json(F.nullif(body, F.lit("")), VERDICTS), lambda v: v.isNotNull()),
        lambda v: F.struct(
            F.trim(F.coalesce(F.nullif(v["text"], F.lit("")), v["entity"], F.lit(""))).alias("text"),
            v["type"].alias("type"),
            F.coalesce(v["verified"], F.lit(True)).alias("verified"),
            F.trim(F.coalesce(v["reasoning"], F.lit(""))).alias("reasoning"),
            F.coalesce(v["confidence"], F.lit(1.0)).alias("confidence"),
        ),
    )


# Fixed format of a headed list: "**Title (TYPE)**", then lines starting with * - or a dot.
HEADER = r"(?m)^[^\S\n]*\*\*[^*\n]+?\s*\((\w+)\)\*\*.*$"
BULLET = r"^[*\-•]\s+"


def markdown_items(response: Column) -> Column:
    """array<struct<type, text>> from a headed list.

    Cutting at the headers pairs each with its own section, so nothing has to be
    carried from line to line.
    """
    kinds = F.regexp_extract_all(response, F.lit(HEADER), F.lit(1))
    sections = F.split(response, HEADER, -1)

    def items(section: Column) -> Column:
        lines = F.filter(F.transform(F.split(section, "\n", -1), T.trimmed), lambda line: line.rlike(BULLET))
        return F.filter(
            F.transform(
                lines,
                lambda line: F.trim(
                    F.regexp_replace(F.regexp_replace(line, BULLET, ""), r"\s*\([^)]+\)\s*$", "")
                ),
            ),
            lambda x: x != "",
        )

    return let(
        sections,
        lambda parts: F.flatten(
            F.transform(
                kinds,
                lambda kind, i: F.transform(
                    items(F.get(parts, i + 1)), lambda x: F.struct(kind.alias("type"), x.alias("text"))
                ),
            )
        ),
    )


def markdown_verdicts(response: Column, found: Column, model: str = "LLM") -> Column:
    """Listed entities as verdicts; ``found`` holds the text's own mentions."""

    def verdict(item: Column) -> Column:
        lowered = F.lower(item["text"])
        same = F.get(
            F.filter(
                found,
                lambda m: F.contains(F.lower(F.trim(m["text"])), lowered) | F.contains(lowered, F.lower(F.trim(m["text"]))),
            ),
            F.lit(0),
        )
        return let(
            same,
            lambda original: F.struct(
                F.coalesce(original["text"], item["text"]).alias("text"),
                item["type"].alias("type"),
                F.lit(True).alias("verified"),
                F.when(
                    original.isNotNull(), F.concat(F.lit("Verified as "), item["type"], F.lit(f" by LLM model {model}"))
                )
                .otherwise(
                    F.concat(F.lit("Identified as "), item["type"], F.lit(f" by LLM model {model} (not in original results)"))
                )
                .alias("reasoning"),
                F.when(original.isNotNull(), 1.0).otherwise(0.8).alias("confidence"),
            ),
        )

    return F.transform(markdown_items(response), verdict)


def verdicts_of(response: Column, found: Column, model: str = "LLM") -> Column:
    """The verdicts of an answer: its JSON array where that parses, else its headed list."""

    def either(answer: Column, mentions: Column) -> Column:
        return let(
            json_verdicts(answer),
            lambda v: F.when(F.coalesce(F.size(v), F.lit(0)) > 0, v).otherwise(markdown_verdicts(answer, mentions, model)),
        )

    return let(response, lambda answer: let(found, lambda mentions: either(answer, mentions)))


def parse_responses(
    responses: DataFrame, key: str = "doc_id", response: str = "response", found: str = "entities", model: str = "LLM"
) -> DataFrame:
    """(key, text, type, verified, reasoning, confidence), one row per verdict."""
    return responses.select(key, F.inline(verdicts_of(F.col(response), F.col(found), model)))


def kept_verdicts(verdicts: Column, model: str = "LLM") -> Column:
    """Verdicts that confirm an entity, each with some reasoning."""
    return F.transform(
        F.filter(
            verdicts,
            lambda v: (F.coalesce(v["type"], F.lit("")) != "REMOVE") & v["verified"] & (v["text"] != ""),
        ),
        lambda v: F.struct(
            v["text"].alias("text"),
            v["type"].alias("type"),
            F.coalesce(
                F.nullif(v["reasoning"], F.lit("")),
                F.concat(F.lit("Verified as "), F.coalesce(v["type"], F.lit("entity")), F.lit(f" by LLM model {model}")),
            ).alias("reasoning"),
        ),
    )


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _at(verdicts: Column, lowered: Column, text: Column) -> Column:
    """First verdict whose place in ``lowered`` holds the text; null if none does."""
    return F.get(verdicts, F.array_position(lowered, text).cast("int") - 1)


def match_verdict(mention: Column, verdicts: Column, lowered: Column) -> Column:
    """First verdict with the same text, the same text up to spacing, or the same type and one text inside the other.

    ``lowered`` are the verdicts' texts in lower case; what comes after the same
    text is only looked at where that is missing.
    """
    def first(rule: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(verdicts, rule), F.lit(0))

    def loosely(own: Column, spaced: Column) -> Column:
        def related(v: Column) -> Column:
            other = F.lower(v["text"])
            inside = [(other, own), (own, other), (other, spaced), (spaced, other)]
            return (v["type"] == mention["type"]) & reduce(lambda a, b: a | b, (F.contains(x, y) for x, y in inside))

        return F.coalesce(first(lambda v: _normal(v["text"]) == spaced), first(related))

    return let(
        F.lower(F.trim(mention["text"])),
        lambda own: F.coalesce(_at(verdicts, lowered, own), let(_normal(mention["text"]), lambda spaced: loosely(own, spaced))),
    )


def same_text(mention: Column, verdicts: Column, lowered: Column) -> Column:
    """First verdict with the same text, else the first with the same text up to spacing; ``lowered`` are the verdicts' trimmed texts in lower case."""
    return F.coalesce(_at(verdicts, lowered, F.lower(F.trim(mention["text"]))), _at(verdicts, lowered, _normal(mention["text"])))


def apply_verdicts(
    docs: DataFrame,
    verdicts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    num_keywords: int = 20,
    model: str = "LLM",
    drop_removed: bool = False,
    extract: E.Extractor = E.pattern_mentions,
    deep: bool = False,
) -> DataFrame:
    """(key, rank, keyword, score, type, status, reasoning[, sentence_indices]): verified entity keywords.

    ``verdicts`` is (key, verdicts) with one row per document: one equi-join,
    then all matching happens inside the row. Removed entities come back as
    not verified unless ``drop_removed`` is set.

    ``deep`` looks sentence by sentence and takes (key, block_index, verdicts),
    a row per block of a document. The last verdict on a text counts, and texts
    match exactly or up to spacing; keywords say in which sentences they occur.
    """
    if deep:
        ordered = F.sort_array(F.collect_list(F.struct("block_index", "verdicts")))
        verdicts = verdicts.groupBy(key).agg(F.reverse(F.flatten(F.transform(ordered, lambda b: b["verdicts"]))).alias("verdicts"))
    match = same_text if deep else match_verdict
    joined = docs.select(key, text).join(verdicts.select(key, "verdicts"), key, "left")
    kept = joined.withColumn("kept", F.coalesce(kept_verdicts(F.col("verdicts"), model), F.expr("cast(array() as array<struct<text:string,type:string,reasoning:string>>)")))
    kept = kept.withColumn("lowered", F.transform("kept", lambda v: F.lower(F.trim(v["text"]) if deep else v["text"])))
    usable = F.size("kept") > 0

    def judge(m: Column, i: Column) -> Column:
        def with_match(v: Column) -> Column:
            kind = F.coalesce(v["type"], m["type"])
            return F.struct(
                F.lower(F.trim(m["text"])).alias("item"),
                i.alias("ord"),
                F.trim(m["text"]).alias("text"),
                kind.alias("type"),
                E.keyword_weight(kind, m["text"]).alias("weight"),
                (m["sentence_index"] if deep else F.lit(0)).alias("sentence_index"),
                v.isNotNull().alias("matched"),
                F.when(v.isNotNull(), v["reasoning"])
                .when(
                    usable,
                    F.concat(
                        F.lit(f"Not verified by LLM model {model} - using original classification ("), m["type"], F.lit(")")
                    ),
                )
                .otherwise("Verification unavailable - using original classification")
                .alias("reasoning"),
            )

        return let(match(m, F.col("kept"), F.col("lowered")), with_match)

    found_in = (lambda t: E.mentions_in_sentences(t, extract)) if deep else extract
    found = found_in(F.col(text))
    if drop_removed:
        struck = F.transform(
            F.filter("verdicts", lambda v: (v["type"] == "REMOVE") | ~v["verified"]), lambda v: F.lower(v["text"])
        )
        found = let(
            F.coalesce(struck, F.expr("cast(array() as array<string>)")),
            lambda removed: F.filter(found_in(F.col(text)), lambda m: ~F.array_contains(removed, F.lower(F.trim(m["text"])))),
        )
    judged = F.transform(found, judge)
    ranked = rank_keywords(merge_mentions(judged), num_keywords)
    rows = kept.select(key, F.inline(ranked))
    matched = F.filter("group.members", lambda x: x["matched"])
    return rows.select(
        key,
        "rank",
        "keyword",
        "score",
        F.coalesce(F.get(matched, F.size(matched) - 1)["type"], F.col("group.type")).alias("type"),
        F.when(F.size(matched) > 0, "verified").otherwise("Not verified").alias("status"),
        F.when(F.size(matched) > 0, F.get(matched, F.lit(0))["reasoning"])
        .otherwise(
            F.element_at(
                F.sort_array(F.transform("group.members", lambda x: F.struct(F.length(x["reasoning"]), x["reasoning"])), asc=False), 1
            )["reasoning"]
        )
        .alias("reasoning"),
        *(["group.sentence_indices"] if deep else []),
    )
