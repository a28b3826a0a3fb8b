import re

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import constants as C, entities as E, questions as Q
from lexigraph.operators import entities as O

TEXT = "From January 3, 2011 to January 3, 2017 Kamala Harris was Attorney General. In 1999 Ana Maria left."


def test_pattern_passes(one):
    found = [(m["text"], m["type"], m["start"], m["end"]) for m in one(TEXT, E.pattern_mentions)]
    expected = []
    for pattern, kind in ((C.NAME_PATTERN, "PER"), (C.DATE_PATTERN, "DATE"), (C.YEAR_PATTERN, "DATE")):
        expected += [(m.group(), kind, m.start(), m.end()) for m in re.finditer(pattern, TEXT)]
    assert found == expected
    assert ("From January", "PER", 0, 12) in found


def test_sentence_mentions_are_the_text_mentions(one):
    whole = {(m["text"], m["start"], m["end"]) for m in one(TEXT, E.pattern_mentions)}
    pieces = {(m["text"], m["start"], m["end"]) for m in one(TEXT, E.mentions_in_sentences)}
    assert whole == pieces


def test_annotation_shows_five_per_type(one):
    names = ", ".join(f"Ann {c}oe" for c in "ABCDEFG")
    noted = one(names, lambda c: E.annotate(c, E.texts_by_type(E.pattern_mentions(c))))
    assert noted.endswith("[ENTITIES: PER: Ann Aoe, Ann Boe, Ann Coe, Ann Doe, Ann Eoe (+2 more)]")
    assert one("nothing here", lambda c: E.annotate(c, E.texts_by_type(E.pattern_mentions(c)))) == "nothing here"


def test_label_maps(one):
    for label, kind in (("PERSON", "PER"), ("GPE", "LOC"), ("FACILITY", "FAC"), ("OTHER", "OTHER"), ("NEW", "NEW")):
        assert one(label, E.entity_type) == kind
    assert one("x", lambda c: E.label_type(F.array(F.lit("Entity"), F.lit("LOC"), F.lit("PER")))) == "LOC"
    assert one("x", lambda c: E.label_type(F.array(F.lit("Entity")))) is None


def test_enrich_json_episode(spark):
    rows = [("text", TEXT), ("json", '{"name":"Kamala Harris","draft":false,"start":"2011-01-03"}')]
    found = O.enrich(spark.createDataFrame(rows, "type string, content string")).collect()
    assert found[0].entity_count == len(found[0].entities) == 9
    assert found[1].entities_by_type == {"PER": ["Kamala Harris"], "DATE": ["2011"]}
    assert found[1].all_entities == ["Kamala Harris", "2011"]


def test_entity_keywords(spark):
    docs = spark.createDataFrame([(1, "Ana Maria met John Smith. Then ana Ana Maria left in 1999.")], "doc_id long, text string")
    rows = O.entity_keywords(docs).collect()
    assert [(r.rank, r.keyword, r.type) for r in rows] == [(1, "Ana Maria", "PER"), (2, "John Smith", "PER"), (3, "1999", "DATE")]
    assert [r.score for r in rows] == [1.0, 0.5, round(0.5 / 2.4, 4)]
    deep = O.entity_keywords(docs, deep=True).collect()
    assert {r.keyword: r.sentence_indices for r in deep} == {"Ana Maria": [0, 1], "John Smith": [0], "1999": [1]}


def test_pluggable_extractor(spark):
    one_word = lambda text: F.transform(
        F.regexp_extract_all(text, F.lit("[A-Z]+"), F.lit(0)),
        lambda w: F.struct(w.alias("text"), F.lit("ORG").alias("type"), F.lit(0).alias("start"), F.length(w).alias("end"), F.lit("ORG").alias("label")),
    )
    docs = spark.createDataFrame([(1, "the UN and NATO")], "doc_id long, text string")
    assert [r.keyword for r in O.entity_keywords(docs, extract=one_word).collect()] == ["UN", "NATO"]


@pytest.mark.parametrize(
    "query, kind, confidence",
    [
        ("Who was the Attorney General?", "WHO", 0.5), ("Why did she resign?", "WHY", 1.0), ("Tell me more", "GENERAL", 0.0),
        ("Where did she work?", "WHERE", 0.5), ("When did it start?", "WHEN", 0.5), ("What company was it?", "WHAT_ORG", 0.5),
        ("What position did she hold?", "WHAT_POSITION", 0.5), ("How many people?", "HOW_MANY", 0.5), ("What happened then?", "WHAT_EVENT", 0.5),
        ("WHO WAS THE SENATOR?", "WHO", 0.5), ("Who, whose and whom?", "WHO", 1.0), ("In which city?", "WHERE", 0.5),
    ],
)
def test_question_types(one, query, kind, confidence):
    info = one(query, Q.detect_question)
    assert (info["type"], info["confidence"]) == (kind, confidence)
    assert info["entity_weights"] == (C.QUESTION_TYPES[kind]["weights"] if kind != "GENERAL" else {})


def test_query_terms(one):
    terms = one("Who was the California Attorney General in 2020?", Q.query_terms)
    assert terms["query_year"] == 2020
    assert terms["important_terms"] == ["california", "attorney", "general"]
    assert terms["proper_nouns"] == ["Who", "California Attorney General"]
    assert one("no year", Q.query_terms)["query_year"] is None
