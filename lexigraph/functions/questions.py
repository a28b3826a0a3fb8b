"""Question classification and query terms as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lexigraph.functions import constants as C
from lexigraph.functions.arrays import let


def _literal_map(values: dict[str, float]) -> Column:
    if not values:
        return F.expr("cast(map() as map<string,double>)")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def detect_question(query: Column) -> Column:
    """struct<type, description, confidence, entity_weights>.

    Every type counts its matching patterns; most matches win and the earlier
    declared type wins a tie.
    """

    def matches(lowered: Column, pattern: str) -> Column:
        """A pattern that opens with plain words is only tried where those words occur at all."""
        opening = re.match(r"\\b([a-z ]+)", pattern)
        found = lowered.rlike(f"(?U){pattern}")
        return F.contains(lowered, F.lit(opening.group(1))) & found if opening else found

    def candidates(lowered: Column) -> Column:
        counted = []
        for order, (name, spec) in enumerate(C.QUESTION_TYPES.items()):
            hits = sum((matches(lowered, p).cast("int") for p in spec["patterns"]), F.lit(0))
            counted.append(F.struct(hits.alias("hits"), F.lit(-order).alias("priority"), F.lit(name).alias("type")))
        return F.array_max(F.array(*counted))

    def describe(best: Column) -> Column:
        name = F.when(best["hits"] > 0, best["type"]).otherwise(C.GENERAL_QUESTION[0])
        description, weights = F.lit(C.GENERAL_QUESTION[1]), _literal_map({})
        for key, spec in C.QUESTION_TYPES.items():
            description = F.when(name == key, F.lit(spec["description"])).otherwise(description)
            weights = F.when(name == key, _literal_map(spec["weights"])).otherwise(weights)
        return F.struct(
            name.alias("type"),
            description.alias("description"),
            F.least(best["hits"] / 2.0, F.lit(1.0)).alias("confidence"),
            weights.alias("entity_weights"),
        )

    return let(let(F.lower(query), candidates), describe)


def query_year(query: Column) -> Column:
    """First year of the 20th or 21st century in the question, else null."""
    return F.nullif(F.regexp_extract(query, rf"(?U){C.YEAR_PATTERN}", 0), F.lit("")).try_cast("int")


def important_terms(query: Column) -> Column:
    """Lower-case ASCII words, without stopwords and words of one or two letters; repeats stay."""
    return F.filter(
        F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\b[a-zA-Z]+\b"), F.lit(0)),
        lambda t: (F.length(t) > 2) & ~t.isin(*C.QUESTION_STOPWORDS),
    )


def proper_nouns(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(f"(?U){C.PROPER_NOUN_PATTERN}"), F.lit(0))


def query_terms(query: Column) -> Column:
    return F.struct(
        query_year(query).alias("query_year"),
        important_terms(query).alias("important_terms"),
        proper_nouns(query).alias("proper_nouns"),
        F.lower(query).alias("original_query"),
    )
