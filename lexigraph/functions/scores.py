"""The ranking factors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigraph.functions import constants as C
from lexigraph.functions.arrays import let


def temporal_score(year: Column, attributes: Column, valid_at: Column, invalid_at: Column) -> Column:
    """1.0 in period, 0.3 outside, 0.8 open-ended, 0.5 unknown; 1.0 without a year in the question."""

    def leading_year(part: Column) -> Column:
        return F.substring(F.regexp_replace(part, r"\P{Nd}+", ""), 1, 4).try_cast("int")

    def covers(value: Column) -> Column:
        parts = F.split(value, "-", -1)
        in_range = (
            value.contains("-")
            & (F.length(value) < 20)
            & year.between(leading_year(F.get(parts, F.lit(0))), leading_year(F.get(parts, F.lit(1))))
        )
        return value.contains(year.cast("string")) | F.coalesce(in_range, F.lit(False))

    fields = F.array(*[F.try_element_at(attributes, F.lit(f)) for f in C.TEMPORAL_FIELDS])
    in_field = F.exists(F.filter(fields, lambda v: v.isNotNull()), covers)
    return (
        F.when(F.coalesce(year, F.lit(0)) == 0, 1.0)
        .when(F.coalesce(in_field, F.lit(False)), 1.0)
        .when(
            valid_at.isNotNull() & invalid_at.isNotNull(),
            F.when(year.between(F.year(valid_at), F.year(invalid_at)), 1.0).otherwise(0.3),
        )
        .when(valid_at.isNotNull() & (F.year(valid_at) <= year), 0.8)
        .otherwise(0.5)
    )


def matched_terms(terms: Column, text: Column) -> Column:
    """How many of the terms (repeats counted) occur inside a lower-case text."""
    return let(text, lambda bound: F.size(F.filter(terms, lambda t: F.contains(bound, t))))


def query_match_score(
    query: Column,
    terms: Column,
    nouns: Column,
    name: Column,
    summary: Column,
    attributes: Column,
    labels: Column,
    neighbour_hits: Column,
) -> Column:
    """Weighted share of question terms found in a node, 0..1.

    ``neighbour_hits`` is the number of terms found in neighbour names; it is
    aggregated beforehand because a hub may have any number of neighbours.
    An empty node name matches nothing.
    """
    lowered = F.lower(F.coalesce(name, F.lit("")))
    named = lowered != ""
    denominator = F.greatest(F.size(terms), F.lit(1))

    def share(text: Column) -> Column:
        return F.coalesce(matched_terms(terms, text) / denominator, F.lit(0.0))

    noun_hit = let(
        lowered,
        lambda own: F.exists(nouns, lambda n: F.contains(own, F.lower(n)) | F.contains(F.lower(n), own)),
    )
    earned = (
        F.when(named & F.contains(query, lowered), F.lit(C.MATCH_NAME)).otherwise(share(lowered) * C.MATCH_NAME)
        + F.when(named & noun_hit, F.lit(C.MATCH_PROPER_NOUN)).otherwise(0.0)
        + share(F.lower(summary)) * C.MATCH_SUMMARY
        + F.coalesce(neighbour_hits / denominator, F.lit(0.0)) * C.MATCH_NEIGHBOURS
        + share(F.lower(F.array_join(F.map_values(attributes), " "))) * C.MATCH_ATTRIBUTES
        + share(F.lower(F.array_join(labels, " "))) * C.MATCH_LABELS
    )
    possible = (
        C.MATCH_NAME + C.MATCH_PROPER_NOUN + C.MATCH_SUMMARY + C.MATCH_NEIGHBOURS + C.MATCH_ATTRIBUTES + C.MATCH_LABELS
    )
    return earned / possible


def entity_type_score(weights: Column, counts: Column) -> Column:
    """Mean question weight over a node's distinct entities, held within 0.5..2.0.

    ``counts`` is array<struct<type, n>>.
    """

    def mean(found: Column, wanted: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, e: acc + e["n"])
        weighted = F.aggregate(
            found,
            F.lit(0.0),
            lambda acc, e: acc + F.coalesce(F.try_element_at(wanted, e["type"]), F.lit(1.0)) * e["n"],
        )
        return F.greatest(F.lit(0.5), F.least(F.lit(2.0), weighted / total))

    return F.when((F.size(weights) > 0) & (F.size(counts) > 0), let(counts, lambda found: let(weights, lambda wanted: mean(found, wanted)))).otherwise(1.0)
