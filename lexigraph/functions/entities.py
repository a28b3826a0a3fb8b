"""Entity mentions as Column expressions over a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lexigraph.functions import constants as C
from lexigraph.functions.arrays import let
from lexigraph.functions.text import indexed_sentences, spans

MENTION = "struct<text:string,type:string,start:int,end:int,label:string>"
Extractor = Callable[[Column], Column]


def pattern_mentions(text: Column) -> Column:
    """array<MENTION> in pass order: names, full dates, years.

    The passes are independent, so a year inside a date is a mention of its own.
    """

    def tagged(pattern: str, kind: str) -> Column:
        return spans(
            text,
            pattern,
            lambda found, start, end: F.struct(
                found.alias("text"), F.lit(kind).alias("type"), start.alias("start"), end.alias("end"), F.lit(kind).alias("label")
            ),
        )

    return F.flatten(F.array(tagged(C.NAME_PATTERN, "PER"), tagged(C.DATE_PATTERN, "DATE"), tagged(C.YEAR_PATTERN, "DATE")))


def entity_type(label: Column) -> Column:
    """Normalised entity type of a source label; unknown labels stay."""
    known = F.create_map(*[F.lit(x) for pair in C.ENTITY_TYPE_BY_LABEL.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), label)


def label_type(labels: Column) -> Column:
    """First node label that names an entity type."""
    return F.get(F.filter(labels, lambda x: x.isin(*C.NODE_LABEL_TYPES)), F.lit(0))


def type_description(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.ENTITY_DESCRIPTIONS.items() for x in pair])
    return F.try_element_at(known, kind)


def texts_by_type(mentions: Column) -> Column:
    """map<type, array<text>>: unique texts per type in order of appearance."""
    return let(
        mentions,
        lambda found: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(found, lambda m: m["type"])),
                lambda kind: F.struct(
                    kind.alias("key"),
                    F.array_distinct(
                        F.transform(F.filter(found, lambda m: m["type"] == kind), lambda m: m["text"])
                    ).alias("value"),
                ),
            )
        ),
    )


def type_counts(by_type: Column) -> Column:
    """array<struct<type, n>> from :func:`texts_by_type`."""
    return F.transform(
        F.map_entries(by_type), lambda e: F.struct(e["key"].alias("type"), F.size(e["value"]).alias("n"))
    )


def annotation(by_type: Column, per_type: int = 5) -> Column:
    """``TYPE: a, b (+k more); ...`` with types in order."""
    return F.array_join(
        F.transform(
            F.sort_array(F.map_entries(by_type)),
            lambda e: F.concat(
                e["key"],
                F.lit(": "),
                F.array_join(F.slice(e["value"], 1, per_type), ", "),
                F.when(
                    F.size(e["value"]) > per_type,
                    F.concat(F.lit(" (+"), (F.size(e["value"]) - per_type).cast("string"), F.lit(" more)")),
                ).otherwise(""),
            ),
        ),
        "; ",
    )


def annotate(text: Column, by_type: Column) -> Column:
    """The text with its entities appended, or unchanged where it has none."""
    return F.when(
        F.size(by_type) > 0, F.concat(text, F.lit("\n\n[ENTITIES: "), annotation(by_type), F.lit("]"))
    ).otherwise(text)


def mentions_in_sentences(text: Column, extract: Extractor = pattern_mentions) -> Column:
    """Mentions found sentence by sentence, with offsets into the whole text."""

    def within(sentences: Column) -> Column:
        return F.flatten(
            F.transform(
                sentences,
                lambda s, i: F.transform(
                    extract(s["text"]),
                    lambda m: F.struct(
                        m["text"].alias("text"),
                        m["type"].alias("type"),
                        (m["start"] + s["start"]).alias("start"),
                        (m["end"] + s["start"]).alias("end"),
                        m["label"].alias("label"),
                        s["index"].alias("sentence_index"),
                        s["text"].alias("sentence"),
                        F.get(sentences, i - 1)["text"].alias("previous"),
                        F.get(sentences, i + 1)["text"].alias("following"),
                    ),
                ),
            )
        )

    return let(indexed_sentences(text), within)


def with_context(text: Column, window: int = C.CONTEXT_WINDOW, extract: Extractor = pattern_mentions) -> Column:
    """Mentions with the surrounding characters, their sentence and its neighbours.

    A mention never crosses a sentence end, so looking per sentence finds the
    same mentions and needs no offset join.
    """

    def surrounded(whole: Column, m: Column) -> Column:
        return F.struct(
            type_description(m["type"]).alias("description"),
            F.trim(
                F.substring(whole, F.greatest(m["start"] - window, F.lit(0)) + 1, F.least(m["start"], F.lit(window)))
            ).alias("before"),
            F.trim(F.substring(whole, m["end"] + 1, F.lit(window))).alias("after"),
            m["sentence"].alias("sentence"),
            F.concat_ws(" ", m["previous"], m["sentence"], m["following"]).alias("extended"),
            F.lit(window).alias("window_size"),
        )

    return let(
        text,
        lambda whole: F.transform(
            mentions_in_sentences(whole, extract),
            lambda m: F.struct(
                m["text"].alias("text"),
                m["type"].alias("type"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["label"].alias("label"),
                m["sentence_index"].alias("sentence_index"),
                F.when(type_description(m["type"]).isNotNull(), surrounded(whole, m)).alias("context"),
            ),
        ),
    )


def keyword_weight(kind: Column, surface: Column) -> Column:
    """Score one mention adds to its keyword: type weight plus a bonus per word."""
    weights = F.create_map(*[F.lit(x) for pair in C.ENTITY_KEYWORD_WEIGHTS.items() for x in pair])
    word_count = F.regexp_count(surface, F.lit(r"(?U)\S+"))
    return F.coalesce(
        F.try_element_at(weights, kind), F.lit(C.ENTITY_KEYWORD_DEFAULT_WEIGHT)
    ) + F.least(word_count * 0.1, F.lit(0.3))
